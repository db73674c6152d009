from __future__ import annotations

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regionlink.functions.names import NOISE, edit_distance, normalise_key, similarity
from regionlink.functions.values import class_of, general, one_decimal, plain, short_number, to_number, xml_escape


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def key(name):
    import re

    text = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    text = re.sub(r"['’ʼ]", "", text)
    text = " ".join("".join(c if c.isspace() or c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in text).split())
    return " ".join(w for w in text.split(" ") if w not in NOISE) or text


NAMES = ["Bengalūru Urban", "ＢＥＮＧＡＬＵＲＵ-URBAN", "O’Brien's County", "the District of", "  a b\x1fc ", "", "...", "ﬁeld_12", "Łódź", "मैसूर", "Saint-Étienne & Co", "DISTRICT Mysuru district"]


def test_normalise(spark):
    assert column(spark, NAMES, normalise_key) == [key(n) for n in NAMES]
    assert column(spark, [None], normalise_key) == [None]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(max_codepoint=0x24F), max_size=12), min_size=1, max_size=50))
def test_normalise_any_latin(spark, names):
    assert column(spark, names, normalise_key) == [key(n) for n in names]


def test_distance(spark):
    pairs = [("kitten", "sitting"), ("sitting", "kitten"), ("abc", "abc"), ("", "abcd"), ("é", "e"), ("", "")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a string, b string").orderBy("i")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in rows.select(edit_distance(a, b)).collect()] == [3, 3, 0, 4, 1, 0]
    assert [r[0] for r in rows.select(edit_distance(a, b, 2)).collect()] == [3, 3, 0, 4, 1, 0]
    assert [r[0] for r in rows.select(similarity(a, b)).collect()] == [1 - 3 / 7, 1 - 3 / 7, 1.0, 0.0, 0.0, 1.0]


CELLS = {"42": 42, "1,234.5": 1234.5, "₹ 2,000": 2000, "87%": 87, "(42)": -42, "n/a": None, "": None, None: None, "1e5": 15, "(-5)": 5, "2020-21": None, "1.2.3": None, "-": None, "  7 ": 7, "(": None, "()": None, "-.": None, "(0)": 0}


def test_to_number(spark):
    assert column(spark, list(CELLS), lambda c: to_number(c, None)) == list(CELLS.values())
    assert column(spark, list(CELLS), to_number) == [v or 0 for v in CELLS.values()]


def test_text(spark):
    assert column(spark, [1_500_000.0, 1500.0, 12.0, 3.25, -2000.0, 999_999.0], short_number, "double") == ["1.5M", "1.5k", "12", "3.2", "-2.0k", "1000.0k"]
    assert column(spark, [1_500_000.0, 1500.0, 12.0, 3.3, -2000.0], short_number, "double") == ["1.5M", "1.5k", "12", "3.3", "-2.0k"]
    assert column(spark, ['<a & "b">'], xml_escape) == ["&lt;a &amp; &quot;b&quot;&gt;"]


@pytest.mark.parametrize(("value", "want"), [(1.0, 0), (5.0, 0), (5.1, 1), (9.0, 1), (99.0, 1), (float("nan"), 1), (None, None)])
def test_class_of(spark, value, want):
    assert column(spark, [value], lambda c: class_of(c, F.array(F.lit(5.0), F.lit(9.0))), "double") == [want]


NUMBERS = [10177050.0, 10177150.0, -10177050.0, 10177049.999999998, 99999950.0, 9999995.0, 1234565e7, 0.0, -0.0, 1.0, 0.25, 0.35, 0.45, 2.675, 7.25, 7.35, -7.25, 0.05, 999.95, 1050.0, 1234567.0, 999999.5, 999999.4, 123456.5, 100000.0, 1e6, 1e15, 1e-4, 0.00012345678, 9.9999995e-5, 1e-7, -1.5e300, 3.14159265, float("nan"), float("inf"), float("-inf")]


def test_numbers_as_text(spark):
    """As Python writes them: the exact value is rounded, and a tie goes to the even digit."""
    import random

    rng = random.Random(9)
    values = NUMBERS + [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 12) for _ in range(300)] + [round(rng.uniform(-2000, 2000), 2) for _ in range(300)] + [rng.randrange(-4000, 4000) / 8 for _ in range(200)] + [float(rng.randrange(10**6) * 10 + 5) * 10 ** rng.randrange(7) for _ in range(300)]
    assert column(spark, values, general, "double") == [f"{v:g}" for v in values]
    finite = [v for v in values if abs(v) < 1e14]
    assert column(spark, finite, one_decimal, "double") == [f"{v:.1f}" for v in finite]

    def short(v):
        if abs(v) >= 1e6:
            return f"{v / 1e6:.1f}M"
        if abs(v) >= 1e3:
            return f"{v / 1e3:.1f}k"
        return str(int(v)) if v == int(v) else f"{v:.1f}"

    assert column(spark, finite, short_number, "double") == [short(v) for v in finite]


LARGE_AND_SMALL = [12345678.9, 73512345.67, 1e7, -9.87654321e12, 1e-4, -1.5e-300, 1.5e300, 0.1 + 0.2, 1e22, 5e-324, 0.0, 7.0]


def test_plain_numbers_are_read_as_they_were(spark):
    text = column(spark, LARGE_AND_SMALL, plain, "double")
    assert [float(t) for t in text] == LARGE_AND_SMALL and not any("E" in t or "," in t for t in text)
    assert column(spark, LARGE_AND_SMALL, lambda c: to_number(plain(c)), "double") == LARGE_AND_SMALL


def test_to_number_of_numbers(spark):
    assert column(spark, [*LARGE_AND_SMALL, None], lambda c: to_number(c, None), "double") == [*LARGE_AND_SMALL, None]
    assert column(spark, [12345678, None], to_number, "long") == [12345678.0, 0.0]
    assert column(spark, [12345678], lambda c: to_number((c / 10).cast("decimal(20,7)")), "long") == [1234567.8]
