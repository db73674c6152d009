"""Names: normalised keys, edit distance and similarity."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say what kind of region a name is, and apostrophes that are dropped inside words.
NOISE = ("district", "dist", "taluk", "taluka", "tehsil", "block", "mandal", "county", "province", "region", "division", "subdivision", "the", "of", "and")
APOSTROPHES = "'’ʼ"

_SPACE = r"[\s\x1c-\x1f]"


@cache
def _combining() -> str:
    """A pattern for the characters of a combining class, from Python's Unicode data."""
    points = [i for i in range(sys.maxunicode + 1) if unicodedata.combining(chr(i))]
    ranges: list[list[int]] = []
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def strip_space(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def normalise_key(name: Column) -> Column:
    """The key under which spellings of one name meet.

    Compatibility decomposition, no combining marks, lower case, apostrophes dropped, other punctuation a blank, single
    blanks, no noise words, unless nothing else is left. Null stays null. Names beyond ASCII are decomposed by ICU, a library
    that Spark itself brings (com.ibm.icu, for its collations).
    """
    plain = F.when(name.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), name, F.lit(True)), _combining(), "")).otherwise(name)
    bare = F.regexp_replace(F.lower(plain), f"[{APOSTROPHES}]", "")
    blank = F.regexp_replace(bare, rf"(?U)[^\p{{L}}\p{{N}}_{_SPACE[1:-1]}]", " ")
    collapsed = F.trim(F.regexp_replace(blank, rf"(?U){_SPACE}+", " "))
    # a variable of a lambda is worked out once, however often it is used
    key = F.transform(F.array(collapsed), lambda x: F.coalesce(F.nullif(F.array_join(F.filter(F.split(x, " "), lambda w: ~w.isin(*NOISE)), " "), F.lit("")), x))
    return F.element_at(key, 1)


def edit_distance(a: Column, b: Column, cap: int | None = None) -> Column:
    """Levenshtein distance in code points. Above cap, a number above cap: that of the longer string if the other is empty, else cap + 1."""
    if cap is None:
        return F.levenshtein(a, b)
    longer = F.greatest(F.length(a), F.length(b))
    capped = F.levenshtein(a, b, cap)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), longer).when(capped == -1, cap + 1).otherwise(capped)


def similarity(a: Column, b: Column) -> Column:
    """1 less the distance over the longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)
