from __future__ import annotations

import random
from collections import Counter

from regionlink.llm.decontamination import MultiIndex, fingerprint, leaks, shingles, similarity, without_leaks, words_of

from .conftest import ODD, SCHEMA


def brute(docs, items, least=0.75):
    out = {}
    for doc_id, text in docs:
        words = words_of(text)
        for item_id, item in items:
            want = words_of(item)
            if words and want:
                bag = Counter(shingles(want))
                best = max(similarity(Counter(shingles(words[i : i + len(want)])), bag) for i in range(max(1, len(words) - len(want) + 1)))
                if best >= least:
                    out[doc_id, item_id] = round(best, 9)
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        rng.choice([lambda i: words.pop(i), lambda i: words.insert(i, "new"), lambda i: words.__setitem__(i, "other")])(i)
    return words


def test_multi_index_finds_all_within_the_radius():
    rng = random.Random(1)
    prints = {i: rng.getrandbits(64) for i in range(200)}
    index = MultiIndex(prints, 23)
    for _ in range(50):
        p = prints[rng.randrange(200)]
        for bit in rng.sample(range(64), rng.randint(0, 30)):
            p ^= 1 << bit
        assert index.near(p) == {i: (x ^ p).bit_count() for i, x in prints.items() if (x ^ p).bit_count() <= 23}


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 3, 5, 8, 30, 40, 60, 60])] + [(9, None), (None, "null id " * 10)]
    docs = []
    for i in range(60):
        parts = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            parts += edited(rng, (rng.choice(items[4:9])[1]).upper().split(), rng.choice([0, 0, 1, 2, 4, 8]))
            parts += [word() for _ in range(rng.randint(0, 20))]
        docs.append((i, " ".join(parts)))
    table = spark.createDataFrame([(*d, *[None] * 6) for d in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 20
    for group in (10_000, 200):
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in leaks(table, bench, group_chars=group).collect()}
        assert got == want
        clean = without_leaks(table, bench, group_chars=group)
        assert clean.columns == table.columns
        assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem ipsum"), (2, None), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(odd, bench).collect()} == {(6, 1)}
    assert leaks(empty, bench).count() == leaks(odd, bench.filter("item_id > 1")).count() == 0
    assert without_leaks(odd, bench).count() == len(ODD) - 1


def test_fingerprint_weighs_counts():
    assert fingerprint({b"a": 3, b"b": 1}) == fingerprint({b"a": 1})
