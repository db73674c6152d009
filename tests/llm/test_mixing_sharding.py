from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from regionlink.llm.ordering import numbered, placed, ranged
from regionlink.llm.sharding import interleave, shards
from regionlink.llm.source_mixing import drawn, mix, mixed, permuted

from .conftest import ODD, rows


def water(sizes, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        new = {s for s in free if target[s] > 2 * sizes[s]}
        if not new:
            return target
        full |= new


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997])
def test_permutation(spark, n):
    for tweak in (4, 7923):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(tweak).cast("long"))).collect()]
        assert sorted(got) == list(range(n))
    assert n < 10 or got != list(range(n))


def check_mix(table, given, slack):
    words = lambda t: len((t or "").encode().split())
    sizes: Counter = Counter()
    for r in given:
        sizes[r[3]] += words(r[1])
    goal = water(sizes)
    by_target = defaultdict(float)
    found = mix(table).drop("hash").collect()
    assert sorted((r.doc_id, r.size) for r in found if r.doc_id is not None) == sorted((r[0], words(r[1])) for r in given if r[0] is not None)
    for r in found:
        assert r.taken <= 2 * r.size
        by_target[round(r.target, 6), r.source_size] += r.taken
    want = Counter()
    for s, g in goal.items():
        want[round(g, 6), sizes[s]] += g
    assert by_target.keys() == want.keys()
    for k, taken in by_target.items():
        assert abs(taken - want[k]) <= slack * max(1, sum(1 for s in goal if (round(goal[s], 6), sizes[s]) == k))
    assert rows(mix(table)) == rows(mix(table))


def test_mix(docs, odd, empty):
    check_mix(docs, [tuple(r) for r in docs.collect()], 130)
    check_mix(odd, ODD, 130)
    assert rows(mix(empty)) == []


def test_slots_follow_the_counts(docs):
    _, pieces, slots = mixed(docs)
    blocks = {(r.source, r.block) for r in pieces.collect()}
    taken = Counter((r.source, r.block) for r in slots.collect())
    assert set(taken) <= blocks
    assert max(taken.values()) <= 2
    assert {r.shard for r in slots.collect()} == set(range(8))


def test_shards_draw_their_counts(spark):
    goals = spark.createDataFrame([("0a", 5_000, 8_000), ("0b", 7, 14), ("1", 1, 0)], "source string, n_blocks long, slots long")
    got = drawn(goals, 8, 4, 8_014).collect()
    by = {s: sorted((r.shard, r["first"], r["count"]) for r in got if r.source == s) for s in ("0a", "0b", "1")}
    assert [sum(c for _, _, c in by[s]) for s in by] == [8_000, 14, 0]
    for counts in by.values():
        upto = 0
        for _, first, count in counts:
            assert first == upto
            upto += count
    counts = [c for _, _, c in by["0a"]]
    # 1,000 on average, standard deviation 30
    assert all(860 < c < 1140 for c in counts) and len(set(counts)) > 4
    assert sorted(map(tuple, drawn(goals, 8, 4, 8_014).collect())) == sorted(map(tuple, got))
    assert sorted(map(tuple, drawn(goals, 8, 5, 8_014).collect())) != sorted(map(tuple, got))


def test_many_sources_of_one_row_and_one_row_very_often(spark):
    """Neither is one task: all sources of one row have one fraction, all copies of one row have one hash."""
    one_each = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    often = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("x").alias("source"))
    for table in (one_each, often):
        found = shards(table).collect()
        assert sorted((r.shard, r.slot) for r in found) == [(k, i) for k in range(8) for i in range(500)]
        rows, _ = interleave(table)
        assert sorted(r.position for r in rows.collect()) == list(range(4000))
        before = placed(numbered(table.select("doc_id", "source", F.lit("0" * 32).alias("hash")), "t rows"), F.lit(3), "t order")
        got = defaultdict(list)
        for r in before.collect():
            got[r.source].append(r.before)
        assert all(sorted(x) == [3 * i for i in range(len(x))] for x in got.values())
    ranges = ranged(numbered(often.select("doc_id", "source"), "t rows"), ["source", "doc_id", "uid"], "t ranges")
    assert max(r["count"] for r in ranges.groupBy("_range").count().collect()) < 2000
    taken = mix(often).collect()
    assert len(taken) == 4000 and abs(sum(r.taken for r in taken) - 18_000) < 130


def test_words_taken_by_shard(docs):
    _, pieces, slots = mixed(docs)
    words = defaultdict(Counter)
    for r in slots.collect():
        words[r.source, r.block][r.shard] += 1
    want = defaultdict(Counter)
    for r in pieces.collect():
        for shard, n in words[r.source, r.block].items():
            want[r.uid][shard] += n * r.words
    found = mix(docs).collect()
    assert sorted(r.taken_by_shard for r in found if r.taken) == sorted(",".join(str(w[k]) for k in range(8)) for w in want.values())
    assert all(r.taken == sum(map(int, r.taken_by_shard.split(","))) for r in found)


def test_too_many_blocks_are_refused(spark):
    rows = spark.createDataFrame([("a", "x y " * 200)], "source string, text string").withColumn("doc_id", F.lit(1))
    assert mix(rows).count() == 1
    import regionlink.llm.source_mixing as own

    prime, own._PRIME = own._PRIME, 1
    try:
        with pytest.raises(Exception, match="too many blocks"):
            mix(rows).collect()
    finally:
        own._PRIME = prime


def check_shards(table, given):
    found = shards(table).collect()
    n = len(given)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in found)) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in given)
    by = defaultdict(list)
    for r in found:
        assert (r.law, r.grown_shard) == ("rows", None)
        by[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert max(map(len, by.values()), default=0) - min((len(by.get(s, ())) for s in range(8)), default=0) <= 1
    assert n == sum(map(len, by.values()))
    return found


def test_shards(docs, odd, empty):
    check_shards(odd, ODD)
    given = [tuple(r) for r in docs.collect()]
    source = {r[0]: r[3] for r in given}
    mixture = Counter((r.shard, source[r.doc_id]) for r in check_shards(docs, given))
    for s in set(source.values()):
        counts = [mixture[k, s] for k in range(8)]
        assert max(counts) - min(counts) <= 2
    assert rows(shards(empty)) == []
    assert rows(shards(docs)) == rows(shards(docs.repartition(5)))
