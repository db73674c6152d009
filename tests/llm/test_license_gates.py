"""Gates of the license rules: whatever a pattern matches must pass them."""

from __future__ import annotations

import random
import re

import pytest

from regionlink.llm.license_rules import STEMS, rules
from regionlink.llm.license_scan import license_scan

from . import test_license_scan
from .conftest import rows

BSD3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"


def matches(pattern, most=400):
    """Texts that the pattern matches: each branch, with and without what is optional; a fixed sample of them if they are many."""
    of_class = {"CATEGORY_DIGIT": "7", "CATEGORY_NOT_SPACE": "x"}

    def made(items):
        found = [""]
        for op, arg in items:
            match str(op):
                case "LITERAL":
                    part = [chr(arg)]
                case "IN":
                    part = [chr(a) if str(o) == "LITERAL" else of_class[str(a)] for o, a in arg]
                case "SUBPATTERN":
                    part = made(arg[3])
                case "BRANCH":
                    part = [x for branch in arg[1] for x in made(branch)]
                case "MAX_REPEAT" | "MIN_REPEAT":
                    least, _, items = arg
                    part = [*([""] if least == 0 else []), *(x * max(least, 1) for x in made(items))]
            if len(found) * len(part) > most:
                found = random.Random(1).sample(found, min(len(found), max(most // len(part), 1)))
            found = [f + p for f in found for p in part]
        return found

    return made(re._parser.parse(pattern))


def test_literals_are_held_by_every_match():
    for r in rules():
        texts = matches(r.pattern)
        assert texts and all(re.fullmatch(r.pattern, t) for t in texts)
        assert [t for t in texts if r.literal not in t] == [], r


@pytest.mark.parametrize("end", [" without specific prior written permission."])
def test_bsd_3_text(spark, end):
    found = license_scan(spark.createDataFrame([(1, BSD3 + end)], "doc_id long, text string")).first()
    assert "bsd-3" in found.labels.split(",") and found.score == 0.99


def test_every_match_passes_stems_and_a_keyword():
    words: dict[tuple, list[str]] = {}
    for r in rules():
        words.setdefault((r.label, r.priority, r.pattern), []).append(r.keyword)
    for rule, keywords in words.items():
        for text in matches(rule[2]):
            assert any(k in text for k in keywords) and any(s in text for s in STEMS), (rule[:2], text)


def test_against_brute_force_without_gates(spark, docs, monkeypatch):
    monkeypatch.setattr(test_license_scan, "RULES", [(label, pattern, "", priority) for label, pattern, _, priority in test_license_scan.RULES])
    patterns = sorted({r.pattern for r in rules()})
    texts = ["Released under Apache 2.0", "distributed under the 3-clause BSD", "Eclipse Public v2.0", BSD3, *(t for p in patterns for t in matches(p)[::40])]
    found = rows(license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert found == sorted((test_license_scan.brute(i, t) for i, t in enumerate(texts)), key=repr)
    assert all(r[6] for r in found if "  " not in texts[r[0]])  # normalised texts hold no two blanks
    assert rows(license_scan(docs)) == sorted((test_license_scan.brute(r.doc_id, r.text) for r in docs.collect()), key=repr)
