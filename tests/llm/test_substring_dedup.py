from __future__ import annotations

import hashlib
import re

import duckdb
import pytest

from regionlink.llm.substring_dedup import ORACLE_SQL, line_dedup

from .conftest import ODD, rows


def units_of(text, min_chars):
    """(start, end) of lines, which go on after the first end of a sentence beyond min_chars characters as further units."""
    at = 0
    for line in text.split("\n"):
        start, end = at, at + len(line)
        while start < end:
            cut = next((m.end() for m in re.finditer(r"(?<=[.!?])[ \t]+", text[start:end]) if m.start() > min_chars), None)
            stop = end if cut is None else start + cut
            yield start, stop
            start = stop
        at = end + 1


def brute(table, min_chars=100):
    part = lambda x: "-" if x is None else f"+{x}"
    key = lambda doc_id, text: hashlib.md5("\x1f".join((part(doc_id), part(text))).encode()).digest()
    seen, out = set(), {}
    for _, _, k, doc_id, text in sorted({(r[0] is None, r[0] or 0, key(r[0], r[1]), r[0], r[1]) for r in table}, key=lambda x: x[:3]):
        spans, left, upto, n = [], [], 0, 0
        for start, end in units_of(text or "", min_chars):
            words = text[start:end].encode().lower().split()
            n += bool(words)
            unit = b" ".join(words)
            if len(unit.decode()) < min_chars:
                continue
            if unit in seen:
                spans.append((start, end))
                left.append(text[upto:start])
                upto = end
            seen.add(unit)
        out[k] = (doc_id, n, len(spans), sum(b - a for a, b in spans), ",".join(f"{a}-{b}" for a, b in spans), text if not spans else "".join(left) + text[upto:])
    return sorted((out[key(r[0], r[1])] for r in table), key=repr)


def test_odd_rows(odd, empty):
    assert rows(line_dedup(odd)) == brute(ODD)
    assert rows(line_dedup(empty)) == []


@pytest.mark.parametrize("min_chars", [1, 40, 100])
def test_against_brute_force(docs, min_chars):
    assert rows(line_dedup(docs, min_chars)) == brute([tuple(r) for r in docs.collect()], min_chars)


def test_offsets_are_those_of_the_original(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in line_dedup(docs).collect():
        left, upto = [], 0
        for start, end in (map(int, s.split("-")) for s in r.removed_spans.split(",") if s):
            left.append(text[r.doc_id][upto:start])
            upto = end
        assert "".join(left) + text[r.doc_id][upto:] == r.text


def test_a_passage_goes_from_lines_of_other_texts_and_lines_without_blanks_go(spark):
    sentence = "This sentence stands here, and it is long enough to be a unit of its own wherever a line may hold it, as here. "
    url = "https://example.org/" + "a" * 500
    own = "Something else that is long enough to be a unit stands before it in the first of the two texts, and only there. "
    table = [(1, own + sentence + "The end.\n" + url), (2, f"Title\n{sentence}\n{url.upper()}\n{'Nothing of this is found elsewhere, so it stays. ' * 3}\ntitle\ntitle")]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0
    assert got[2].n_removed == 2
    assert got[2].text == "Title\n\n\n" + "Nothing of this is found elsewhere, so it stays. " * 3 + "\ntitle\ntitle"


def test_against_sql(docs, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ("doc_id", "n_units", "n_removed", "removed_chars", "removed_spans", "text")
    assert rows(line_dedup(docs)) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL})").fetchall(), key=repr)
