"""Windows that are similar enough but whose fingerprints are far apart."""

from __future__ import annotations

from collections import Counter

from regionlink.llm.decontamination import fingerprint, leaks, shingles, similarity

from .conftest import rows


def test_repeated_shingles_set_fingerprints_apart(spark):
    shared = [f"w{i}" for i in range(304)]
    item, text = " ".join([*shared, *["-"] * 50]), " ".join([*shared, *["+"] * 50])
    a, b = (Counter(shingles(t.encode().split())) for t in (item, text))
    x, d = similarity(a, b), (fingerprint(a) ^ fingerprint(b)).bit_count()
    assert x >= 0.75 and d > 23
    found = leaks(spark.createDataFrame([(1, f"before {text} after")], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert [r[:4] for r in rows(found)] == [(1, 7, 1, x)]
