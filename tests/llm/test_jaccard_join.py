from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from regionlink.llm import jaccard_join as J
from regionlink.llm import graph
from regionlink.llm.graph import components

from .conftest import ODD, SCHEMA, rows


def brute(table):
    sets = []
    for r in table:
        words = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    group = list(range(len(table)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    places = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in places[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                group[max(top(i), top(j))] = min(top(i), top(j))
        for x in s:
            places[x].append(i)
    ids = defaultdict(list)
    for i, r in enumerate(table):
        if r[0] is not None:
            ids[top(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), (min(ids[top(i)]) if ids[top(i)] else None) if sets[i] else r[0]) for i, r in enumerate(table)), key=repr)


def test_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        x = np.unique(rng.integers(0, 2**63, n, np.uint64) * np.uint64(2))
        assert (J.unpacked(J.packed(x)) == x).all()


@pytest.mark.parametrize("frequent", [2, 16, 10**6])
def test_similar_sets_share_a_signature(frequent, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    rng = np.random.default_rng(frequent)
    for _ in range(400):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        keep = a[rng.random(len(a)) > rng.choice([0.0, 0.1, 0.2])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(len(a) * rng.choice([0, 0.05, 0.15])), np.uint64)]))
        every = np.union1d(a, b)
        df = rng.integers(1, 60, len(every))
        df[np.isin(every, np.intersect1d(a, b))] += 1
        of = lambda s: J.signatures(s, df[np.searchsorted(every, s)])
        shared = len(np.intersect1d(a, b))
        if len(b) and J.DEN * shared >= J.NUM * (len(a) + len(b) - shared):
            assert len(np.intersect1d(of(a), of(b)))


@pytest.mark.parametrize("small", [0, 200_000])
def test_components(spark, small, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = start
                todo += near[x]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if near[k] - {k}}


def test_against_brute_force(spark, docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    table, base = [], [rng.choices(words, k=rng.choice([3, 6, 40, 120])) for _ in range(8)]
    passage = rng.choices(words, k=60)
    for i in range(150):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            text += passage
        table.append((rng.choice([i, i, i, None]), " ".join(text), *[None] * 6))
    assert rows(J.jaccard_classes(spark.createDataFrame(table, SCHEMA), block_bytes=4000)) == brute(table)
    assert rows(J.jaccard_classes(docs)) == brute([tuple(r) for r in docs.collect()])


def test_odd_rows(odd, empty):
    assert rows(J.jaccard_classes(odd)) == brute(ODD)
    assert rows(J.jaccard_classes(empty)) == []


def test_differences_from_a_centre():
    rng = np.random.default_rng(3)
    for _ in range(200):
        every = np.unique(rng.integers(0, 2**63, 60, np.uint64))
        c, x, y = (np.sort(rng.choice(every, int(rng.integers(1, 50)), False)) for _ in range(3))
        # tokens that no other text has count, but are not listed
        nx, ny = len(x) + int(rng.integers(0, 5)), len(y) + int(rng.integers(0, 5))
        (v, dx), (w, dy) = (J.apart_by(J.packed(c), J.packed(s), n) for s, n in ((x, nx), (y, ny)))
        shared = len(np.intersect1d(x, y))
        assert (J.DEN * shared >= J.NUM * (nx + ny - shared)) == ((J.NUM + J.DEN) * len(np.intersect1d(dx, dy)) >= v + w - len(c))


@pytest.mark.parametrize("edits", [(0, 1, 2, 3, 4, 5, 6, 8), (4, 5, 6)])
def test_a_large_group_of_near_copies_around_one_text(spark, edits):
    rng = random.Random(len(edits))
    base = [f"b{i}" for i in range(110)]
    table = []
    for i in range(500):
        text = list(base)
        for _ in range(rng.choice(edits)):
            at = rng.randrange(len(text))
            rng.choice([lambda: text.pop(at), lambda: text.insert(at, rng.choice("xyz")), lambda: text.__setitem__(at, f"n{rng.randrange(400)}")])()  # noqa: B023
        table.append((i, " ".join(text[: rng.choice([110, 110, 95])]), *[None] * 6))
    assert rows(J.jaccard_classes(spark.createDataFrame(table, SCHEMA), block_bytes=20_000)) == brute(table)
