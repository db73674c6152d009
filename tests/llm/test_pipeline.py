from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from regionlink.llm import quality_rules
from regionlink.llm.entry import oracle_sql, queries

from .test_decontamination import brute as leaks
from .test_jaccard_join import brute as classes
from .test_quality_rules import base


def is_content(text, model):
    """The rules by themselves: base checks, the best labelling of the lines by tables of sums, and the share of its words."""
    if not text or base(text)[-1]:
        return False
    best = [[model.start[0]], [model.start[1]]]  # of the labellings that end with y: their sum
    came = []
    for i, x in enumerate(quality_rules.text_features(text)):
        if i:
            options = [[best[a][-1] + model.trans[a][y] for a in (0, 1)] for y in (0, 1)]
            came.append([int(o[1] >= o[0]) for o in options])
            for y in (0, 1):
                best[y].append(max(options[y]))
        best[1][-1] += model.score(x)
    labels = [int(best[1][-1] >= best[0][-1])]
    for step in reversed(came):
        labels.append(step[labels[-1]])
    sizes = [len(x.split()) for x in text.split("\n")]
    return sum(n for n, y in zip(sizes, reversed(labels)) if y) >= 0.5 * sum(sizes) > 0


def leaking(docs, items):
    """Ids of the documents in which a window is similar to an item, from all windows of the pairs that share five words."""
    runs = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(t.lower().split())
    of_item = [(i, t, runs(t)) for i, t in items]
    return {d for i, t in docs if (near := [(k, u) for k, u, r in of_item if r & runs(t)]) for d, _ in leaks([(i, t)], near)}


def test_stages_do_what_they_say(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    given = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]

    model = quality_rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = stages["quality rules"](spark, docs, sf)
    good = [i for i, r in given.items() if is_content(r.text, model)]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(good)

    kept = stages["n-gram jaccard join"](spark, kept.repartition(3), sf)
    first = [i for i, _, component in classes([(i, given[i].text) for i in good]) if i == component]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first)

    kept = stages["benchmark decontamination"](spark, kept, sf)
    found = leaking([(i, given[i].text) for i in first], duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall())
    clean = [i for i in first if i not in found]
    assert 0 < len(found) < len(first)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean)

    mixed = stages["mixing sources to target weights"](spark, kept, sf)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns
    assert set(times) <= set(clean)
    assert max(times.values()) <= 2
    assert 1.1 * len(clean) < sum(times.values()) < 1.9 * len(clean)

    dealt = stages["sharding"](spark, mixed, sf)
    assert Counter(r.doc_id for r in dealt.collect()) == times
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "shard").collect()) == sorted((r.doc_id, r.shard) for r in dealt.collect())


def test_odd_rows(spark, sf, odd, empty):
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()


def test_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = ["_key", "_group", "_rank", "key", "row", "rank", "hash", "times", "share", "none", "id", "worded", "uid", "before", "size", "bucket", "target", "a b", "x.y", "n"]
    wide = docs.withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES:
        docs, wide = stage(spark, docs, sf), stage(spark, wide, sf)
        assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in wide.collect()), name
        if name != "sharding":
            assert set(names) <= set(wide.columns)
            assert all(r[c] == c for r in wide.collect() for c in names)


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in queries()}
    assert set(queries()) | {"pipeline"} <= set(names)
    assert set(oracle_sql()) <= set(queries())
