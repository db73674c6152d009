"""Sharding (5) [native]: proportional stratified interleaving.

Rows are ranked in a seeded shuffle within each source; rank r of n rows becomes the fraction (2r + 1) / 2n. Sorted by
fraction, the sources are mixed evenly everywhere, and cutting that order into equal runs gives every shard the mixture.
Ranks and positions are found range by range (see ordering), so no source and no sort lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, n_bytes
from .ordering import numbered, placed, positioned, seeded_hash, source_key


def interleave(docs: DataFrame, seed: int = 5) -> tuple[DataFrame, int]:
    """(doc_id, source, hash, size, text_crc32, rank, source_rows, fraction, position) of each row of docs, and their number.

    position: from 0, gapless over all rows. source: as source_key gives it.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source_key(F.col("source")).alias("source"),
        seeded_hash(seed, F.col("doc_id"), F.col("text")).alias("hash"),
        (n_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = numbered(narrow, "op5 rows")
    totals = rows.groupBy("source").agg(F.count("*").alias("source_rows"))
    ranked = placed(rows, F.lit(1), "op5 order").withColumnRenamed("before", "rank").join(totals, "source")
    ranked = ranked.withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("source_rows")).cast("double"))
    return positioned(ranked, ["fraction", "source", "hash", "doc_id", "uid"], "op5 positions").drop("uid"), rows.count()


def shards(docs: DataFrame, n_shards: int = 8, seed: int = 5) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    size: UTF-8 bytes of the text plus 1. Row counts of shards differ by one at most, and so do, up to rounding, those of a
    source. A null text has size 1 and the CRC of the empty string; a text of any length is one row. A null source is one of its own, the last. Repeated rows
    are dealt as rows of their own; which of them comes first makes no difference. Ties of fractions go by source, then hash.
    Other columns are ignored. An empty table gives no rows.
    """
    rows, n = interleave(docs, seed)
    shard = F.expr(f"position * {n_shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}")
    return rows.withColumn("shard", shard.cast("long")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("position") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))
