"""Corpus-wide word counts, and looking words of documents up in a table of any size.

The vocabulary of a corpus has no bound, so it is never broadcast whole. Its head, the ``head`` most frequent words of at
most ``MAX_BYTES`` bytes, has one (head x MAX_BYTES bytes) and is looked up where the text is read. Every other word goes
through a shuffle join, once for each document and distinct word. Both ways together give exact sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer words never enter the head.
MAX_BYTES = 48
#: Distinct words that a task holds before it hands on what it has counted.
FLUSH = 400_000


def counted(docs: DataFrame, columns: list[str], words: Callable[..., list[bytes]]) -> DataFrame:
    """(word binary, n long): occurrences over all rows of docs. words: from the named columns of a row to its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                seen.update(words(*row))
                if len(seen) >= FLUSH:
                    yield _table(seen)
                    seen = Counter()
        if seen:
            yield _table(seen)

    return docs.select(*columns).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _table(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])


def head_words(counts: DataFrame, head: int) -> list[tuple[bytes, int]]:
    """The most frequent words, the most frequent first, ties by byte order: at most head x MAX_BYTES bytes."""
    top = counts.filter(F.octet_length("word") <= MAX_BYTES).orderBy(F.desc("n"), "word").limit(head).toArrow()
    return list(zip(top.column("word").to_pylist(), top.column("n").to_pylist()))


#: A row's own line in what is looked up. Its word starts with a line feed, so it meets no other.
OWN, TAIL = 0, 1


def own_word(key: bytes) -> bytes:
    return b"\n" + key
