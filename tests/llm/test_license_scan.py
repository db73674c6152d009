from __future__ import annotations

import re

import pytest

from regionlink.llm.license_rules import CONFIDENCE, rules
from regionlink.llm.license_scan import BASE, license_scan

from .conftest import ODD, SCHEMA, rows

RULES = [(r.label, re.compile(f" ({r.pattern})(?= )"), r.keyword, r.priority) for r in rules()]


def brute(doc_id, text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    norm = f" {' '.join(words)} " if words else ""
    places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    spans = []
    for k, (label, pattern, _, priority) in enumerate(RULES):
        if RULES[k][2] not in norm:
            continue
        for m in pattern.finditer(norm):
            start = norm[: m.start() + 1].count(" ") - 1
            spans.append((start, -(start + len(m[1].split())), priority, k, label))
    spans.sort()
    left = [s for i, s in enumerate(spans) if not any(t[1] <= s[1] and t[2] <= s[2] for t in spans[:i])]
    base = sorted({label for _, label in places})
    return (
        doc_id, len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
        ",".join(base), ",".join(sorted({*base, *(s[4] for s in left)})), max((CONFIDENCE[s[2]] for s in left), default=0.0),
    )


TEXTS = [
    "Released under the MIT License.",
    "under the mit license under the MIT-license",
    "Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. CC-BY-NC 4.0!",
    "This work is licensed under the GNU General Public License, version 3.",
    "GPL 2 or later; SPDX-License-Identifier: GPL-2.0-or-later. Copyright (c) 2019 All rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "cc by nc sa 4 0 licensed under cc by nc 4.0 creative commons attribution noncommercial",
    "ünder the mit licensé, mit der Lizenz; unlicensed " * 50,
]


def test_rules_are_many_and_gated():
    assert len(rules()) >= 200
    for r in rules():
        assert any(s in r.keyword for s in __import__("regionlink.llm.license_rules", fromlist=["STEMS"]).STEMS) or r.keyword in ("prohibited",)


def test_against_brute_force(spark, docs):
    known = [(i, t, None, None, None, None, None, None) for i, t in enumerate(TEXTS)]
    assert rows(license_scan(spark.createDataFrame(known, SCHEMA))) == sorted((brute(i, t) for i, t in enumerate(TEXTS)), key=repr)
    assert rows(license_scan(docs)) == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=repr)


def test_odd_rows(odd, empty):
    assert rows(license_scan(odd)) == sorted((brute(r[0], r[1]) for r in ODD), key=repr)
    assert rows(license_scan(empty)) == []


@pytest.mark.parametrize(("text", "label"), [(TEXTS[0], "mit"), (TEXTS[3], "gpl-3"), ("see the European Union Public Licence v1.2", "eupl-1.2")])
def test_labels(spark, text, label):
    assert label in license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels.split(",")
