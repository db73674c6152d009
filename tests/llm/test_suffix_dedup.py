from __future__ import annotations

import hashlib
import inspect
import random
from collections import Counter

import numpy as np
import pytest

from regionlink.llm.induced_sort import BucketQueue, InducedSort
from regionlink.llm.suffix_dedup import repeated_in, suffix_dedup

from .conftest import ODD, SCHEMA, rows


def brute(table, length=200):
    raws = [(r[0], (r[1] or "").encode()) for r in table]
    times = Counter(raw[i : i + length] for _, raw in raws for i in range(len(raw) - length + 1))
    out = []
    for doc_id, raw in raws:
        gone = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - length + 1):
            if times[raw[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out.append((doc_id, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("memory", [10**9, 7, 1])
def test_induced_sort(memory):
    rng = random.Random(memory)
    for _ in range(60):
        n, cap = rng.randint(1, 50), rng.choice([3, 1000])
        text = [rng.randint(1, rng.choice([1, 2, 3, 200])) for _ in range(n)] * rng.choice([1, 1, 3]) + [0]
        sorter = InducedSort(cap, memory)
        sa, lcp = sorter.sort(np.array(text))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert list(sa) == want
        shared = [0]
        for a, b in zip(want, want[1:]):
            k = 0
            while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            shared.append(min(k, cap))
        assert list(lcp) == shared
        sorter.close()


def test_odd_rows(odd, empty):
    assert rows(suffix_dedup(odd)) == brute(ODD)
    assert rows(suffix_dedup(empty)) == []


@pytest.mark.parametrize(("hot", "shard"), [(4000, 2_000_000), (2, 3000)])
def test_against_brute_force(spark, docs, hot, shard):
    rng = random.Random(7)
    passages = ["".join(rng.choice("ab ") for _ in range(rng.choice([150, 199, 200, 201, 400]))) for _ in range(6)]
    made = [(i, "".join(rng.choice([rng.choice(passages), "x" * rng.randint(0, 300), str(rng.random())]) for _ in range(rng.randint(0, 6))), *[None] * 6) for i in range(60)]
    assert rows(suffix_dedup(spark.createDataFrame(made, SCHEMA), hot=hot, shard_bytes=shard, memory_items=5000)) == brute(made)
    if hot > 2:
        some = [(r.doc_id, r.text) for r in docs.collect()]
        assert rows(suffix_dedup(docs)) == brute(some)


def test_a_shard_of_the_query_spills(monkeypatch):
    """With the limits that the query has, a shard's queue and arrays go to files, and its result is that of a sort in memory."""
    limits = inspect.signature(suffix_dedup).parameters
    length, memory, shard = (limits[k].default for k in ("length", "memory_items", "shard_bytes"))
    assert memory < shard
    rng = random.Random(9)
    passages = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.choice([150, 200, 260]))) for _ in range(40)]
    parts, held = [], 0
    while held < shard:
        parts.append((b"".join(rng.choice([rng.choice(passages), bytes(rng.choice(b"abcdefgh ") for _ in range(300))]) for _ in range(3)), False))
        held += len(parts[-1][0])
    spilt = []
    own = BucketQueue._spill
    monkeypatch.setattr(BucketQueue, "_spill", lambda self, char: (spilt.append(char), own(self, char)))
    got = repeated_in(parts, length, memory)
    assert spilt
    times = Counter(raw[i : i + length] for raw, _ in parts for i in range(len(raw) - length + 1))
    want = []
    for raw, _ in parts:
        twice = [times[raw[i : i + length]] > 1 for i in range(len(raw) - length + 1)]
        bounds = []
        for i, x in enumerate(twice):
            if x and (not i or not twice[i - 1]):
                bounds.append(i)
            if x and (i + 1 == len(twice) or not twice[i + 1]):
                bounds.append(i)
        want.append(bounds)
    assert got == want
