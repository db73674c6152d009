"""Documents to training shards: quality rules, near duplicates, benchmark leaks, source weights, shards.

Stages take documents with any further columns, whatever their names: what a stage adds stands beside the whole row, not in it.
Each treats null, empty and very long texts, ties, repeated rows and empty tables as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlink.llm import decontamination, jaccard_join, quality_rules, sharding, source_mixing
from regionlink.llm.common import n_words, row_key, whole_row, written
from regionlink.llm.ordering import seeded_hash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose lines are content enough.

    Null and empty texts go. Rows with equal text fare alike, so there are no ties; repeated rows stay or go together. Texts of
    any length are judged whole. An empty table stays empty.
    """
    model = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep_content(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links join: the one with the smallest id (null last), of rows of one id the first by text digest.

    Of repeated rows (same id and text) one stays: the least by its columns as JSON. Rows without words, null texts included,
    link with nothing and all stay. Texts of any length are compared whole. An empty table stays empty.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(whole_row(docs), doc_id.alias("doc_id"), row_key(text).alias("key"), (n_words(text) > 0).alias("worded"), text.alias("text"))
    _, found = jaccard_join.linked(rows.filter("worded").select("key", "text"))
    # a row for each text, however many copies there are, then one for each group
    texts = rows.filter("worded").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))).alias("rank"))
    grouped = texts.join(found.withColumnRenamed("node", "key"), "key", "left").groupBy(F.coalesce("component", "key")).agg(F.min(F.struct("rank", "key")).alias("first"))
    first = grouped.select("first.key", "first.rank.none", "first.rank.id")
    kept = rows.filter("worded").select("row", "key", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")).join(first, ["key", "none", "id"])
    one = kept.groupBy("key", "none", "id").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return one.select("row.*").unionByName(rows.filter("NOT worded").select("row.*"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found.

    Null and empty texts stay. Rows with equal text fare alike, so there are no ties; repeated rows stay or go together. Texts
    of any length are searched whole. An empty table stays empty.
    """
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its words are taken, on average: taken / size is rounded up with the probability of its fraction, by the row's hash.

    Rows without words, null texts included, are taken no words of and go. Rows with the same id and text are taken together
    as often as their mean says. Texts of any length count whole. An empty table stays empty.
    """
    taken = source_mixing.mix(docs).filter("size > 0")
    share = taken.groupBy("hash").agg((F.sum("taken") / F.sum("size")).alias("share"))
    chance = F.conv(F.substring("hash", 20, 8), 16, 10).cast("double") / float(16**8)
    times = F.floor(F.col("share") + chance).cast("int")
    rows = docs.select(whole_row(docs), seeded_hash(4, F.col("doc_id"), F.col("text")).alias("hash"))
    return rows.join(share.hint("merge"), "hash").withColumn("times", times).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row.

    Null and empty texts are rows like others. Ties of fractions go by source, then hash; repeated rows are dealt each by
    itself, in any order. An empty table gives no rows.
    """
    return sharding.shards(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", source_weights),
    ("sharding", shards),
]

#: The first stage decodes a trained model, which SQL cannot express; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Each one's rows are written to the shared folder and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
