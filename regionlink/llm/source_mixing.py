"""Mixing sources to target weights (4) [native]: blocks of tokens, multinomial source counts, index permutations, a join by index.

The tokens of each source, its documents in seeded order, are cut into blocks of fixed length. Each output shard draws how many
blocks of each source it holds: the counts are multinomial, given that those of a source sum to its target over all shards.
They number the shard's slots of the source. Slot j of a source takes block p(j), p a pseudorandom permutation of the
source's block numbers, another one for each time that the source is gone through. Slots and blocks meet in a join by source
and number, and what a document gives to each shard is summed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, n_words, written
from .ordering import numbered, placed, seeded_hash, source_key

#: Slots are listed in two steps, the second of so many at most.
_CHUNK = 4096
#: Slots that one task lists, about.
_TASK = 250_000
#: A prime above any number of blocks; products of two numbers below it fit in 64 bits.
_PRIME = 2_147_483_647
_ROUNDS = 12


def targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """totals (source, source_size) with target: share of all sizes dealt by weight, none above ``most`` times its source.

    weights go round over the sources in order. What is above a limit is dealt again by weight among the others, until
    nothing is; that is the level at which all sources below their limits stand. One row a source, so its window is small.
    """
    by_name, by_ratio = Window.orderBy("source"), Window.orderBy("_ratio", "source")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double")
    rows = totals.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", level)
    rows = rows.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct(F.col("_ratio"), F.col("source"), F.col("_level")))).over(everything)["_level"])
    return rows.select("source", "source_size", F.least(F.col("_cap"), F.coalesce("_level", F.lit(float("inf"))) * F.col("_w")).alias("target"))


def permuted(index: Column, n: Column, tweak: Column) -> Column:
    """A permutation of 0 to n - 1 at index, n below 2^31.

    Swap-or-not rounds: in each, x either swaps with its partner k - x or doesn't, as a hash of the pair says.
    """
    prime = F.lit(_PRIME)
    rounds = F.array(*(F.struct(*(F.lit(pow(g, r + 2, _PRIME)).cast("long").alias(c) for g, c in ((48_271, "a"), (69_621, "b"), (16_807, "k")))) for r in range(_ROUNDS)))

    def swapped(x: Column, r: Column) -> Column:
        key = F.pmod(r["k"] * F.pmod(tweak + 1, prime), prime)
        other = F.pmod(key - x, n)
        bit = F.pmod(r["a"] * F.pmod(F.greatest(x, other) + key, prime) + r["b"], prime)
        return F.when(F.pmod(F.shiftright(bit, 12), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(rounds, index.cast("long"), swapped)


def _listed(spans: DataFrame, n: Column, name: str, n_slots: int) -> DataFrame:
    """spans, each row once for each number from 0 to n - 1 (name); in two steps, between which they are dealt to many tasks."""
    columns = spans.columns
    chunks = spans.withColumn("_n", n.cast("long")).filter("_n > 0").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(_CHUNK).cast("long"))))
    dealt = chunks.repartition(max(1, -(-n_slots // _TASK)), *columns, "_chunk")
    return dealt.select(*columns, F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + _CHUNK, F.col("_n")) - 1)).alias(name))


def drawn(goals: DataFrame, n_shards: int, seed: int, n_slots: int) -> DataFrame:
    """(source, n_blocks, shard, first, count): how many slots of each source an output shard has, and the first one's number.

    goals: (source, n_blocks, slots). Each slot of a source falls to a shard by a uniform draw, so the counts of a source over
    the shards are multinomial and sum to its slots. A row for each source and shard.
    """
    each = _listed(goals, F.col("slots"), "_draw", n_slots)
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "source", F.col("_draw").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % n_shards
    counts = each.groupBy("source", "n_blocks", draw.cast("int").alias("shard")).agg(F.count("*").alias("count"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, n_shards: int = 8, seed: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (doc_id, source, hash, size, uid, before, source_size, target), pieces and slots.

    pieces: (source, block, uid, words): words of a row that lie in a block of its source. slots: (source, slot,
    shard, block): the slots that each output shard has drawn, and which block each takes. A source of 2^31 blocks or more is
    refused: block is to be larger then.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), seeded_hash(seed, F.col("doc_id"), F.col("text")).alias("hash"), n_words(F.col("text").cast("string")).alias("size"))
    rows = numbered(narrow, "op4 rows")
    words = rows.agg(F.sum("size")).first()[0] or 0
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goals = written(goals, "op4 targets")
    rows = placed(rows, F.col("size"), "op4 order").join(goals, "source")

    n_slots = int(words * share) // block + 1
    n_blocks = F.ceil(F.col("source_size") / block)
    wanted = F.when(F.col("target") >= F.col("source_size") * most, n_blocks * int(most)).otherwise(F.least(F.round(F.col("target") / block), n_blocks * int(most))).cast("long")
    refused = F.raise_error(F.concat(F.lit("too many blocks in source "), F.col("source"), F.lit(": take larger ones"))).cast("long")
    checked = goals.filter("source_size > 0").select("source", F.when(n_blocks < _PRIME, n_blocks).otherwise(refused).alias("n_blocks"), wanted.alias("slots"))
    counts = written(drawn(checked, n_shards, seed, n_slots), "op4 counts")
    slots = _listed(counts, F.col("count"), "_slot", n_slots).select("source", "n_blocks", "shard", (F.col("first") + F.col("_slot")).alias("slot"))
    slots = slots.select("source", "slot", "shard", permuted(F.expr("slot % n_blocks"), F.col("n_blocks"), F.expr("slot div n_blocks") * 7919 + seed).alias("block"))

    end = F.col("before") + F.col("size")
    first, last = F.expr(f"before div {block}"), F.expr(f"(before + size - 1) div {block}")
    pieces = rows.filter("size > 0").select("source", "uid", "before", end.alias("end"), F.explode(F.sequence(first, last)).alias("block"))
    pieces = pieces.select("source", "block", "uid", (F.least("end", (F.col("block") + 1) * block) - F.greatest("before", F.col("block") * block)).alias("words"))
    return rows, pieces, slots


def mix(docs: DataFrame, n_shards: int = 8, **options) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, taken_by_shard (and hash).

    size: words of the text, null none. target: the source's. taken: words of the row in the blocks that the shards' slots
    take, with repeats; taken_by_shard: those of each output shard, comma-joined. A null source is one of its own, the last. Rows without
    words take none; repeated rows are rows of their own. Ties of hash and id are the same text and may stand in any order.
    A text of any length lies in as many blocks as it needs. Options are those of mixed(). Other columns are ignored. An empty
    table gives no rows.
    """
    rows, pieces, slots = mixed(docs, n_shards=n_shards, **options)
    each = [f"_in_{k}" for k in range(n_shards)]
    times = slots.groupBy("source", "block").agg(*(F.sum(F.when(F.col("shard") == k, 1).otherwise(0)).alias(c) for k, c in enumerate(each)))
    # the lists that slots come from look small to the planner, so it would broadcast the slots
    words = pieces.join(times.hint("merge"), ["source", "block"]).groupBy("uid").agg(*(F.sum(F.col("words") * F.col(c)).alias(c) for c in each))
    by_shard = [F.coalesce(F.col(c), F.lit(0)).cast("long") for c in each]
    return rows.join(words, "uid", "left").select("doc_id", "size", "source_size", "target", reduce(Column.__add__, by_shard).alias("taken"), F.concat_ws(",", *(c.cast("string") for c in by_shard)).alias("taken_by_shard"), "hash")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("hash")
