"""License scans (6) [native]: ordered signature rules, gated by keywords, with priority and interval-containment suppression.

The text is normalised once. A few stems keep almost all texts away from the rules; a rule's keyword keeps the rest away from
its pattern. What patterns find are intervals of words. An interval inside one of a stronger rule, or inside a longer or
earlier one of an equally strong rule, is suppressed.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, row_key, written
from .license_rules import CONFIDENCE, STEMS, rules

#: Phrases that always count, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"
_RULE = "array<struct<id:int,label:string,priority:int,confidence:double,keyword:string,literal:string,pattern:string>>"


def normalised(text: Column) -> Column:
    """The words with a blank before, between and after them; one blank without words.

    Lower case is that of all letters: no letter beyond A-Z becomes one that a base phrase has, and which characters make
    words stays the same.
    """
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), _BREAK, " ")


def _blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def found_spans(norm: Column) -> Column:
    """All intervals of words that the rules find: array of (start, end, id, label, priority, confidence), end excluded."""
    table = [{"id": i, "label": r.label, "priority": r.priority, "confidence": CONFIDENCE[r.priority], "keyword": r.keyword, "literal": r.literal, "pattern": f" ({r.pattern})(?= )"} for i, r in enumerate(rules())]
    known = F.from_json(F.lit(json.dumps(table)), _RULE)
    gated = reduce(Column.__or__, (F.contains(norm, F.lit(s)) for s in STEMS))
    hit = F.filter(known, lambda r: F.contains(norm, r["keyword"]) & F.contains(norm, r["literal"]) & F.rlike(norm, r["pattern"]))
    at = lambda words, word: F.filter(F.transform(words, lambda w, i: F.when(word(w), i)), lambda i: i.isNotNull())

    def spans(r: Column) -> Column:
        # the first and last word of each match are marked; no word holds a control character
        marked = F.array(F.split(F.trim(F.regexp_replace(norm, r["pattern"], F.lit(" \x01$1\x02"))), " "))
        bounds = F.transform(marked, lambda w: F.arrays_zip(at(w, lambda x: F.startswith(x, F.lit("\x01"))).alias("start"), at(w, lambda x: F.endswith(x, F.lit("\x02"))).alias("end")))
        return F.transform(F.element_at(bounds, 1), lambda s: F.struct(s["start"].cast("long").alias("start"), (s["end"] + 1).cast("long").alias("end"), r["id"].alias("id"), r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence")))

    return F.when(gated, F.flatten(F.transform(hit, spans)))


def detections(scanned: DataFrame) -> DataFrame:
    """(key, start, end, label, priority, confidence, suppressed) of the intervals found in (key, spans). Rows with the same key count once."""
    found = scanned.select("key", F.explode("spans").alias("span")).select("key", "span.*").distinct()
    upto = Window.partitionBy("key").orderBy("start", F.desc("end"), "priority", "id").rowsBetween(Window.unboundedPreceding, -1)
    reach = {p: F.coalesce(F.max(F.when(F.col("priority") == p, F.col("end"))).over(upto), F.lit(-1)) for p in CONFIDENCE}
    covered = reduce(Column.__or__, ((F.col("priority") >= p) & (reach[p] >= F.col("end")) for p in CONFIDENCE))
    return found.withColumn("suppressed", covered).drop("id")


def scanned(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, key, n_words, the base columns and the spans. Texts are normalised once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # made by a generator, the normalised text is a column that nothing above is rewritten to make again
    rows = rows.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), F.explode(F.array(normalised(F.col("text")))).alias("norm"))
    n_words = _blanks(F.col("norm")) - 1
    has = [F.contains("norm", F.lit(f" {phrase} ")) for phrase, _ in BASE]
    return rows.select(
        "doc_id",
        "key",
        n_words.alias("n_words"),
        reduce(Column.__add__, (F.when(h, F.regexp_count("norm", F.lit(f" {phrase}(?= )"))).otherwise(0) for h, (phrase, _) in zip(has, BASE))).cast("long").alias("n_base"),
        F.least(*(F.when(h, _blanks(F.substring_index("norm", f" {phrase} ", 1))) for h, (phrase, _) in zip(has, BASE))).alias("first_word"),
        F.greatest(*(F.when(h, n_words - _blanks(F.substring_index("norm", f" {phrase} ", -1)) - len(phrase.split())) for h, (phrase, _) in zip(has, BASE))).alias("last_word"),
        F.array_compact(F.array(*(F.when(h, F.lit(label)) for h, (_, label) in zip(has, BASE)))).alias("base"),
        found_spans(F.col("norm")).alias("spans"),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, the base phrases (n_base, first_word, last_word, base_labels), labels, score.

    labels: those of the base phrases and of all detections that aren't suppressed. score: the confidence of the surest of
    these detections; 0 without one. A null or empty text has no words and no labels (empty strings). Texts of any length
    are scanned whole. Of equal intervals the stronger rule counts, then the earlier one. Repeated rows and null
    ids give their rows. Other columns are ignored. An empty table gives no rows.
    """
    base = written(scanned(docs), "op6 spans")
    own = detections(base).filter(~F.col("suppressed")).groupBy("key").agg(F.collect_set("label").alias("own"), F.max("confidence").alias("own_score"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return base.drop("spans").join(own, "key", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("own_score", F.lit(0.0)).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
