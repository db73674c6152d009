"""Words beyond the frequent ones get classes from their own contexts, however many there are."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionlink.llm.class_lm import END, FLOOR, Sums, exchanged, fit_head, gains, held_out, log_likelihood, placed, score, smoothed, tokens_of
from regionlink.llm.lexicon import counted


OPTIONS = {"n_frequent": 20, "n_classes": 4}


@pytest.fixture(scope="module")
def two_kinds(spark):
    """Words of two kinds that follow each other; all end alike, so nothing but contexts can tell them apart."""
    rng = random.Random(1)
    kinds = [[f"{side}{i:03d}same" for i in range(150)] for side in "ab"]
    texts = [" ".join(rng.choice(kinds[i % 2]) for i in range(40)) for _ in range(150)]
    return kinds, texts, spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)


def mixed_up(kinds, of):
    classes = [Counter(of[w.encode()] for w in kind if w.encode() in of) for kind in kinds]
    return sum(min(classes[0][c], classes[1][c]) for c in set(classes[0]) | set(classes[1])) / sum(map(len, kinds))


def test_words_of_the_head_are_told_apart(two_kinds):
    kinds, texts, docs = two_kinds
    counts = counted(docs, ["text"], tokens_of)
    model = fit_head(docs, counts, 1000, **OPTIONS)
    n = Counter(w for t in texts for w in tokens_of(t))
    assert {w: int(model.n[i]) for w, i in model.numbers.items()} == n
    assert model.classes[:-1].max() < 4 and model.classes[-1] == 4
    assert mixed_up(kinds, {w: int(model.classes[i]) for w, i in model.numbers.items()}) < 0.05
    # the table is that of the texts
    table = np.zeros((5, 5))
    for t in texts:
        c = model.classes[model.sequence(tokens_of(t))]
        for a, b in zip([c[-1], *c[:-1]], c):
            table[a, b] += 1
    assert (table == model.table).all()


def test_words_outside_the_head_are_told_apart(two_kinds, spark):
    kinds, texts, docs = two_kinds
    model = fit_head(docs, counted(docs, ["text"], tokens_of), 120, **OPTIONS)
    seen = []
    for t in texts:
        tokens = tokens_of(t)
        c = model.classes[model.sequence(tokens)].tolist()
        seen += [(bytearray(w), b) for w, b in zip(tokens, [c[-1], *c[:-1]]) if w not in model.numbers]
    rows = placed(spark.createDataFrame(seen, "word binary, prev byte").repartition(3), model).collect()
    words = {bytes(r.word): (r.n, r["class"]) for r in rows if r.word is not None}
    assert {w: n for w, (n, _) in words.items()} == Counter(bytes(w) for w, _ in seen)
    assert mixed_up(kinds, {w: c for w, (_, c) in words.items()}) < 0.1
    table = Counter()
    for r in rows:
        if r.word is None:
            table[r.prev, r["class"]] += r.n
    assert table == Counter((b, words[bytes(w)][1]) for w, b in seen)


def brute_scores(given, model, tail):
    """Scores in plain Python from the classes: model for the head, tail (word: (n, class)) for all others."""
    k = model.n_classes
    counts = {w: int(model.n[i]) for w, i in model.numbers.items()} | {w: n for w, (n, _) in tail.items()}
    emit = {w: int(model.classes[i]) for w, i in model.numbers.items()} | {w: k + c for w, (_, c) in tail.items()}
    state = lambda w: int(model.classes[model.numbers[w]]) if w in model.numbers else k
    table = np.zeros((k + 1, 2 * k))
    for text, train in given:
        tokens = tokens_of(text)
        for v, w in zip([END, *tokens], tokens):
            if train:
                table[state(v), emit[w]] += 1
    steps = 10 ** smoothed(table)
    size = np.array([sum(counts[w] for w in emit if emit[w] == c) + FLOOR * (1 + sum(1 for w in emit if emit[w] == c)) for c in range(2 * k)])
    chance = lambda a, w: steps[a, emit[w]] * (counts[w] + FLOOR) / size[emit[w]] if w in emit else (steps[a] * FLOOR / size).sum()
    for a in range(k + 1):
        assert np.isclose(sum(chance(a, w) for w in emit) + chance(a, None), 1)
    return sorted(sum(float(np.log10(chance(state(v), w))) for v, w in zip([END, *tokens_of(text)], tokens_of(text))) for text, _ in given)


@pytest.mark.parametrize("head", [3, 60, 100_000])
def test_scores_follow_from_the_classes(spark, docs, odd, head):
    for table in (docs.limit(80), odd):
        table = table.select("doc_id", "text").withColumn("train", ~held_out(F.col("doc_id"))).persist()
        train = table.filter("train")
        model = fit_head(train, counted(train, ["text"], tokens_of), head, **OPTIONS)
        seen, given = [], [(r.text, r.train) for r in table.collect()]
        for text, is_train in given:
            tokens = tokens_of(text)
            c = model.classes[model.sequence(tokens)].tolist()
            seen += [(bytearray(w), b) for w, b in zip(tokens, [c[-1], *c[:-1]]) if is_train and w not in model.numbers]
        rows = placed(spark.createDataFrame(seen, "word binary, prev byte"), model).collect()
        tail = {bytes(r.word): (r.n, r["class"]) for r in rows if r.word is not None}
        got = sorted(r.score for r in score(table.select("doc_id", "text"), head, **OPTIONS).collect())
        assert np.allclose(got, brute_scores(given, model, tail))
        table.unpersist()


def test_nothing_to_learn_from(spark):
    # crc32 of these ids ends in 0
    ids = [r.id for r in spark.range(200).filter(held_out(F.col("id"))).collect()][:3]
    found = score(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in found] == [(True, 3, 0, 0)] * 3
    # the one unseen word is all that there can be
    assert all(abs(r.score) < 1e-9 and abs(r.base_score) < 1e-9 for r in found)


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(4)
    for _ in range(40):
        table = rng.poisson(3.0, (6, 6)).astype(float)
        before, after, itself = rng.poisson(0.7, 6).astype(float), rng.poisson(0.7, 6).astype(float), float(rng.poisson(0.3))

        def moved(c):
            own = table.copy()
            own[:, c] += before
            own[c] += after
            own[c, c] += itself
            return own

        was = moved(5)
        got = gains(was, before[None], after[None], np.array([itself]), 5, np.array([True]))[0]
        want = np.array([log_likelihood(moved(c)) for c in range(5)])
        assert np.allclose(got - got[0], want - want[0])


def test_sums():
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 50, n) for n in (0, 10, 300, 7)]
    for limit in (1, 100, 10**6):
        sums = Sums(limit)
        for p in parts:
            sums.add(p)
        sums.add(np.array([3, 60]), np.array([5, 2]))
        codes, n = sums.total()
        assert dict(zip(codes.tolist(), n.tolist())) == Counter(np.concatenate(parts).tolist()) + Counter({3: 5, 60: 2})


def test_exchanged_moves_counts_and_never_lowers_the_likelihood():
    rng = np.random.default_rng(2)
    pairs, classes = rng.poisson(0.4, (40, 40)).astype(float), rng.integers(0, 5, 40)
    for w in range(40):
        member = np.eye(5)[classes]
        table = member.T @ pairs @ member
        was = log_likelihood(table)
        before, after = np.bincount(classes, pairs[:, w], 5), np.bincount(classes, pairs[w], 5)
        before[classes[w]] -= pairs[w, w]
        after[classes[w]] -= pairs[w, w]
        classes[w] = exchanged(table, int(classes[w]), before, after, pairs[w, w])
        member = np.eye(5)[classes]
        assert np.allclose(table, member.T @ pairs @ member)
        assert log_likelihood(table) >= was - 1e-6
