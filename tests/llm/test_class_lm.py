from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from regionlink.llm.class_lm import exchange, score, tokens_of, transitions

from .conftest import ODD


def brute(table):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for r in table if not out(r[0]) for w in tokens_of(r[1]))
    n, v = sum(counts.values()), len(counts)
    rows = []
    for r in table:
        tokens = tokens_of(r[1])
        rows.append((r[0], out(r[0]), len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    return sorted(rows, key=repr)


def check(table, given, head):
    found = score(table, head=head).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=repr)
    for a, b in zip(got, brute(given), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    return found


def test_base(docs, odd, empty):
    check(odd, ODD, 5)
    found = check(docs, [tuple(r) for r in docs.collect()], 100)
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)
    assert score(empty).count() == 0


def likelihood(pairs, classes, k):
    member = np.eye(k)[classes]
    table = member.T @ pairs @ member
    h = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return h(table) - h(table.sum(0)) - h(table.sum(1))


def test_no_exchange_is_left_that_helps():
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 3, 30)
    pairs = rng.poisson(np.where((kind[:, None] + 1) % 3 == kind[None, :], 6.0, 0.3))
    classes = exchange(pairs, 3, 20)
    reached = likelihood(pairs, classes, 3)
    for w in range(30):
        for c in range(3):
            moved = classes.copy()
            moved[w] = c
            assert likelihood(pairs, moved, 3) <= reached + 1e-6
    steps = transitions(pairs, classes, 3)
    assert np.allclose((10**steps).sum(1), 1)
