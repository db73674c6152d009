"""Substring dedup (1): lines with the same normalised form are one unit; all but its earliest occurrence are removed.

A line that holds a whole paragraph is cut as if it were wrapped: at the first end of a sentence after every ``min_chars``
characters. Each unit of a text becomes a 128-bit digest. Digests are grouped over the whole corpus: partial aggregation makes
a unit that a third of all documents hold one row for each task. Those found twice or more are written as a table, so that
Spark can split the join that brings them back to their occurrences where one digest is hot. Offsets are those of the
original text throughout.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, row_key, small_batches, written

#: Shorter units stay, however often they are found: headings, menus, notices.
MIN_CHARS = 100
#: What separates words.
BLANKS = " \t\n\x0b\x0c\r"
_UNITS = "digest binary, none int, doc_id long, key binary, start int, end int"


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("key", row_key(F.col("doc_id"), F.col("text")))


def pieces(min_chars: int) -> str:
    """Matches of this pattern, one after the other, make up the whole text: line feeds and units."""
    return rf"\n|[^\n]{{{min_chars},}}?[.!?]+[\x20\x09]+|[^\n]+"


def _units(rows: DataFrame, min_chars: int) -> DataFrame:
    pattern = re.compile(pieces(min_chars))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, key, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
                for m in pattern.finditer(text or ""):
                    norm = b" ".join(m[0].encode("utf-8", "surrogatepass").lower().split())
                    if norm and len(norm.decode("utf-8", "surrogatepass")) >= min_chars:
                        for column, x in zip(out, (hashlib.blake2b(norm, digest_size=16).digest(), int(doc_id is None), doc_id, key, *m.span())):
                            column.append(x)
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], [c.split()[0] for c in _UNITS.split(", ")])

    return rows.mapInArrow(cut, _UNITS)


def repeated_units(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id, start, end) of each unit that has an earlier occurrence.

    Units are lines, long ones cut at ends of sentences. Two are the same if their words are, A-Z in lower case; units whose
    words have fewer than min_chars characters, single blanks between them included, never count as repeated. Rank: doc_id
    (null last), text digest, place in the text; a row that is there several times is one. start and end are code points of
    the original text.
    """
    units = _units(_rows(docs), min_chars)
    rank = F.struct("none", "doc_id", "key", "start")
    found = units.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).filter("first <> last").select("digest", "first")
    return units.join(written(found, "op1 repeated"), "digest").filter(rank > F.col("first")).select("key", "doc_id", "start", "end")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_units, n_removed, removed_chars, removed_spans, text.

    n_units: units that have a word. removed_spans: start-end of each removed unit in the original text, in order,
    comma-joined; end excluded. text: what is left; line feeds stay. A null text has no units and stays null, an empty one
    stays empty. Texts of any length are cut as a whole. Rows with the same id and text are one document, and each such row
    gets its result; of equal units in rows of one id, the row with the smaller text digest comes first. Other columns are
    ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = _rows(docs)
    spans = repeated_units(docs, min_chars).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    pattern = re.compile(pieces(min_chars))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, gone in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                spans = sorted((s["start"], s["end"]) for s in gone or ())
                parts, upto = [], 0
                for start, end in spans:
                    parts.append(text[upto:start])
                    upto = end
                left = "".join([*parts, text[upto:]]) if spans else text
                n = sum(1 for u in pattern.findall(text or "") if u.strip(BLANKS))
                for column, x in zip(out, (n, len(spans), sum(e - s for s, e in spans), ",".join(f"{s}-{e}" for s, e in spans), left)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_units", "n_removed", "removed_chars", "removed_spans", "text"])

    return rows.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(without, "doc_id long, n_units long, n_removed long, removed_chars long, removed_spans string, text string")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


ORACLE_SQL = rf"""
WITH piece AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pieces(MIN_CHARS)}')) AS unit, generate_subscripts(regexp_extract_all(text, '{pieces(MIN_CHARS)}'), 1) AS i FROM documents),
placed AS (SELECT doc_id, unit, i, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i) - length(unit) AS start,
             trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
           FROM piece),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) > 1 AND length(norm) >= {MIN_CHARS} AS gone FROM placed),
summed AS (SELECT doc_id, count(*) FILTER (norm <> '') AS n_units, count(*) FILTER (gone) AS n_removed, sum(length(unit)) FILTER (gone) AS removed_chars,
             string_agg(start::BIGINT || '-' || (start + length(unit))::BIGINT, ',' ORDER BY i) FILTER (gone) AS removed_spans,
             string_agg(unit, '' ORDER BY i) FILTER (NOT gone) AS left_text
           FROM ranked GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_chars, 0)::BIGINT AS removed_chars,
       coalesce(removed_spans, '') AS removed_spans, CASE WHEN text IS NOT NULL THEN coalesce(left_text, '') END AS text
FROM documents LEFT JOIN summed USING (doc_id)
"""
