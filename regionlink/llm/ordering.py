"""Ranks, running sums and positions over all rows, without ever bringing a source, or copies of one row, to one task.

Rows are dealt by ranges of the order that is asked for, and sorted in each. What precedes a row is what precedes its range
plus what precedes it there. Ranges come from a sample of the keys, so they are written before anything is counted: whatever
is run again after that sees the same ones. Rows that agree in all other keys still differ in their numbers, so that a row
that is there very often is spread over ranges too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, written

#: What monotonically_increasing_id has below the number of the partition.
_BITS = 33


def source_key(source: Column) -> Column:
    """Sorts by code point, null last; never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def seeded_hash(seed: int, doc_id: Column, text: Column) -> Column:
    """32 hexadecimal digits; equal for rows that have the same id and text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("~")), F.coalesce(F.md5(text.cast("binary")), F.lit("~"))).cast("binary"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows, written, with a number of its own for each (uid). Only rows that agree otherwise are ever told apart by it."""
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), name)


def ranged(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows, written in ranges of the keys: _range, and _at from 0 in each."""
    dealt = rows.repartitionByRange(n_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    return written(dealt, name).withColumn("_range", F.shiftright("_id", _BITS)).withColumn("_at", F.col("_id").bitwiseAND((1 << _BITS) - 1)).drop("_id")


def placed(rows: DataFrame, measure: Column, name: str) -> DataFrame:
    """rows (source, hash, doc_id, uid, ...) with before: the measure of all rows of the source before, by hash, then id."""
    rows = ranged(rows.withColumn("_m", measure), ["source", "hash", "doc_id", "uid"], name)
    sums = rows.groupBy("source", "_range").agg(F.sum("_m").alias("_sum"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range, and one more for each source
    sums = sums.select("source", "_range", F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy("source").orderBy("_range"))), F.lit(0)).alias("_offset"))
    inside = F.coalesce(F.sum("_m").over(earlier(Window.partitionBy("source", "_range").orderBy("_at"))), F.lit(0))
    return rows.withColumn("_inner", inside).join(sums, ["source", "_range"]).withColumn("before", (F.col("_offset") + F.col("_inner")).cast("long")).drop("_m", "_offset", "_inner", "_range", "_at")


def positioned(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with position, from 0, gapless over all rows in the order of the keys."""
    rows = ranged(rows, keys, name)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row for each range
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return rows.join(offsets, "_range").withColumn("position", (F.col("_offset") + F.col("_at")).cast("long")).drop("_offset", "_range", "_at")
