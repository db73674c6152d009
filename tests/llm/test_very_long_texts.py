"""Texts of over a million characters: of distinct words, of one phrase, and without blanks."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from regionlink.llm import class_lm, decontamination, jaccard_join, license_scan, quality_rules, sharding, source_mixing, substring_dedup, suffix_dedup, token_counts

from . import test_class_lm, test_quality_rules

WORDS = " ".join(f"w{i * 7919 % 150001}" for i in range(150_000))
PHRASE = "lorem ipsum dolor sit amet. " * 40_000
SOLID = "x" * 1_500_000
COPIED = WORDS[300_000:700_000]
TEXTS = [(1, WORDS), (2, PHRASE), (3, SOLID), (4, "before " + COPIED), (5, WORDS)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, "a") for i, t in TEXTS], "doc_id long, text string, source string").repartition(3)


def test_lines(table):
    found = {r.doc_id: r for r in substring_dedup.line_dedup(table).collect()}
    # the words and their copy are one line each, without an end of a sentence
    assert (found[1].n_removed, found[5].n_removed, found[5].text) == (0, 1, "")
    # 100 characters of the phrase at least, to the end of a sentence: four times the phrase
    assert found[2].n_units == 10_000 and found[2].n_removed == 9_999 and found[3].n_removed == 0


def test_leaks(spark, table):
    items = [(7, " ".join(WORDS.split()[70_000:70_060])), (8, "lorem ipsum dolor sit amet. " * 10), (9, "nothing of this stands anywhere in them")]
    found = decontamination.leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 7), (5, 7), (2, 8)} | ({(4, 7)} if items[0][1] in COPIED else set())
    assert {(r.similarity, r.distance) for r in found} == {(1.0, 0)}


def test_quality(table):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = {r.doc_id: tuple(r[c] for c in columns) for r in quality_rules.line_quality(table, quality_rules.PRIOR).collect()}
    assert found == {i: test_quality_rules.base(t) for i, t in TEXTS}


def test_mixing_and_sharding(table):
    sizes = {i: len(t.split()) for i, t in TEXTS}
    found = {r.doc_id: r for r in source_mixing.mix(table).collect()}
    assert {i: r.size for i, r in found.items()} == sizes
    assert abs(sum(r.taken for r in found.values()) - 1.5 * sum(sizes.values())) < 130
    assert {r.doc_id: r.size for r in sharding.shards(table).select("doc_id", F.col("size")).collect()} == {i: len(t) + 1 for i, t in TEXTS}


def test_licenses(spark, table):
    end = spark.createDataFrame([(6, WORDS + " Released under the MIT License. " + PHRASE)], "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.license_scan(table.select("doc_id", "text").unionByName(end)).collect()}
    assert {i: r.labels for i, r in found.items()} == {i: "" for i, _ in TEXTS} | {6: "mit"}
    assert (found[6].n_base, found[6].first_word, found[6].last_word) == (1, 150_001, 150_001)


def test_suffixes(table):
    found = {r.doc_id: r for r in suffix_dedup.suffix_dedup(table).collect()}
    assert [found[i].n_removed for i in (1, 5)] == [len(WORDS)] * 2  # found twice as a whole
    assert (found[2].n_removed, found[3].n_removed) == (len(PHRASE), len(SOLID))
    assert (found[4].n_removed, found[4].kept_sha256) == (len(COPIED) + (" " + COPIED in WORDS), hashlib.sha256(b"before" if " " + COPIED in WORDS else b"before ").hexdigest())


def test_sets(table):
    sets = {i: (lambda w: len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}))(t.lower().split()) for i, t in TEXTS}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(table).collect()}
    assert found == {i: (sets[i], 1 if i == 5 else i) for i, _ in TEXTS}


def test_tokens(table):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = {r.doc_id: r.n_tokens for r in token_counts.token_counts(table, path).collect()}
    assert found == {i: len(library.encode(t, add_special_tokens=False)) for i, t in TEXTS}


def test_scores(table):
    found = {r.doc_id: r for r in class_lm.score(table, head=1000).collect()}
    want = {r[0]: r for r in test_class_lm.brute(TEXTS)}
    for i, r in found.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[i][2:5]
        assert math.isclose(r.base_score, want[i][5], rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
