from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np

from regionlink.llm.quality_rules import FEATURES, PRIOR, LineModel, fit, keep_content, line_quality, objective, text_features, train

from .conftest import ODD, rows

WHITE = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    words = text.encode().split()
    times = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if times[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(c not in WHITE for c in text), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def test_base(odd, docs, empty):
    for table, given in ((odd, ODD), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        assert rows(line_quality(table, PRIOR).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(((r[0], *base(r[1])) for r in given), key=repr)
    assert rows(line_quality(empty, PRIOR)) == []


def test_viterbi_is_the_best_path():
    rng = random.Random(3)
    for _ in range(30):
        model = LineModel(tuple(rng.uniform(-2, 2) for _ in FEATURES), ((rng.uniform(-2, 2), rng.uniform(-2, 2)), (rng.uniform(-2, 2), rng.uniform(-2, 2))), (rng.random(), rng.random()))
        lines = [rng.randrange(1 << len(FEATURES)) for _ in range(rng.randint(1, 7))]

        def value(path, model=model, lines=lines):
            return model.start[path[0]] + sum(model.score(x) for x, y in zip(lines, path) if y) + sum(model.trans[a][b] for a, b in zip(path, path[1:]))

        got = tuple(model.decode(lines))
        assert abs(value(got) - max(map(value, itertools.product((0, 1), repeat=len(lines))))) < 1e-9
    assert PRIOR.decode([]) == []


def test_training_separates(spark, sf):
    assert train([(text_features("a b c"), 1)]) == PRIOR
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, 200)
    judged = line_quality(docs, model).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality", "kept").count().collect()
    right = sum(r["count"] for r in judged if bool(r.quality) == r.kept)
    assert right >= 0.95 * sum(r["count"] for r in judged)
    assert not any(r.quality == 1 and not r.kept for r in judged)


def test_filter_keeps_columns(odd, empty):
    kept = keep_content(odd, PRIOR)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} <= {r[0] for r in ODD}
    assert keep_content(empty, PRIOR).count() == 0


def test_verdict_against_all_labellings(spark):
    """kept and content_share from the best of all labellings of the lines, by their sum of scores."""
    rng = random.Random(8)
    model = LineModel(tuple(rng.uniform(-2, 2) for _ in FEATURES), ((0.7, -0.4), (-0.3, 0.9)), (0.2, -0.1))
    lines = ["Home", "MENU | LOGIN", "", "* * *", "A sentence of some words, and it ends here.", "more words without an end " * 3, "© 2020 All rights reserved", "12 34 56"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    found = {r.doc_id: r for r in line_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        feats = text_features(text)

        def value(path, feats=feats):
            return model.start[path[0]] + sum(model.score(x) for x, y in zip(feats, path) if y) + sum(model.trans[a][b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=len(feats)), key=value)
        sizes = [len(x.split()) for x in text.split("\n")]
        share = sum(n for n, y in zip(sizes, best) if y) / sum(sizes) if sum(sizes) else 0.0
        assert abs(found[i].content_share - share) < 1e-9
        assert found[i].kept == (not base(text)[-1] and share >= 0.5)


def test_a_sample_has_one_text_for_each_id(spark):
    docs = spark.createDataFrame([(1, f"text number {i} of one id\nmenu") for i in range(50)] + [(2, "menu\nmenu\nmenu"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 5), (3, 0), (None, 1)], "doc_id long, quality int")
    assert fit(docs, labels) == fit(docs.repartition(7), labels)
    assert fit(docs.limit(0), labels) == fit(docs, labels.limit(0)) == PRIOR


def test_gradient_is_that_of_the_objective():
    rng = np.random.default_rng(7)
    n, size, k = 5, 4, len(FEATURES)
    feats = rng.integers(0, 2, (n, size, k)).astype(float)
    mask = (np.arange(size) < np.array([4, 1, 2, 3, 4])[:, None]).astype(float)
    feats *= mask[..., None]
    gold, share = np.array([0, 1, 1, 0, 1]), rng.random((n, 1)) + 0.5
    theta, prior = rng.normal(size=k + 6), rng.normal(size=k + 6)
    value, grad = objective(theta, feats, mask, gold, share, prior, 0.7)

    def by_hand(theta):
        """The same from all labellings."""
        w, t, s = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
        total = 0.0
        for i in range(n):
            lines = int(mask[i].sum())
            scores = {p: s[p[0]] + sum(float(feats[i, j] @ w) for j in range(lines) if p[j]) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in itertools.product((0, 1), repeat=lines)}
            total += share[i, 0] * (scores[(gold[i],) * lines] - np.logaddexp.reduce(list(scores.values())))
        return total / n - 0.7 * ((theta - prior) ** 2).sum() / (2 * n)

    assert np.isclose(value, by_hand(theta))
    for i in range(k + 6):
        step = np.zeros(k + 6)
        step[i] = 1e-5
        assert np.isclose(grad[i], (by_hand(theta + step) - by_hand(theta - step)) / 2e-5, atol=1e-6)
