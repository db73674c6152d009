from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

from regionlink.llm.token_counts import token_counts

from .conftest import ODD, SCHEMA, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(table, limit=2048):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for r in table:
        n = len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)
        out.append((r[0], len((r[1] or "").encode()), n, n > limit))
    return sorted(out, key=repr)


def test_odd_rows(odd, empty):
    for head in (3, 200_000):
        assert rows(token_counts(odd, PATH, head=head)) == brute(ODD)
    assert rows(token_counts(empty, PATH)) == []


def test_odd_texts(spark):
    texts = ["It's. a.b,c .,", "ÀB. é.", "x<|endoftext|>y.", "<|ENDOFTEXT|>", "1.2.3, 4,5.", "don't we'll 'S.", "a b. c,", "é e ́", "ﬁ. Ⅷ, ½."]
    table = [(i, t, *[None] * 6) for i, t in enumerate(texts)]
    assert rows(token_counts(spark.createDataFrame(table, SCHEMA), PATH, head=2)) == brute(table)


def test_real_documents(docs):
    some = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(token_counts(docs, PATH, head=50)) == brute(some)
