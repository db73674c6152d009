"""Token counts (9): pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, n_partitions, row_key, written
from .lexicon import counted, head_words

#: A full stop or comma at the end of a word, after an ASCII letter or digit, always is a pre-token of its own.
_STOP = re.compile(rb"(?<=[a-z0-9])([.,])(?![^\x20\x09-\x0d])")
_BASE, _TAIL = 0, 1


def pre_tokens(text: str | None) -> list[bytes]:
    """Units of which the tokens of a text are the concatenation.

    The tokenizer drops white space and never joins across it, so a unit never holds ASCII white space. Lower case is the
    tokenizer's own, but it looks for special strings before; texts that may have one are left as they are.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    if b"<|" in raw:
        return raw.split()
    return _STOP.sub(rb" \1", raw.lower()).split()


def _piece_counter(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def count(words: list[bytes]) -> list[int]:
        texts = [w.decode("utf-8", "replace") for w in words]
        return [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, head: int = 200_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer_path: a ``tokenizers`` JSON file that lower-cases and drops white space, at the same place on every machine.
    head: pre-tokens that are looked up without a shuffle (see lexicon). All others are joined.

    A null text counts as empty: no bytes, no tokens. Texts of any length are counted whole. Of pre-tokens equally frequent, those
    first by bytes come into the head, which changes no count. Rows with the same id and text are one row each in the result, with
    the same counts. A null doc_id is kept. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = written(counted(docs, ["text"], pre_tokens), "op9 pre tokens")

    def with_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _piece_counter(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(count(batch.column("word").to_pylist()), pa.int64())], ["word", "pieces"])

    top = [w for w, _ in head_words(vocabulary, head)]
    known = spark.sparkContext.broadcast(dict(zip(top, _piece_counter(tokenizer_path)(top))))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known.value
        for batch in batches:
            kind, key, ids, size, total, word, freq = [], [], [], [], [], [], []
            for k, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text"))):
                units, n = Counter(pre_tokens(text)), 0
                for w, f in units.items():
                    if (p := pieces.get(w)) is not None:
                        n += p * f
                    else:
                        kind.append(_TAIL), key.append(k), ids.append(None), size.append(0), total.append(0), word.append(w), freq.append(f)
                # a row's own line meets no word: \n is in none
                kind.append(_BASE), key.append(k), ids.append(doc_id), size.append(len(text.encode("utf-8", "surrogatepass")) if text else 0), total.append(n), word.append(b"\n" + k), freq.append(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int8()), pa.array(key, pa.binary()), pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(word, pa.binary()), pa.array(freq, pa.int64())],
                ["kind", "key", "doc_id", "size", "total", "word", "freq"],
            )

    rows = docs.withColumn("key", row_key(F.col("doc_id"), F.col("text"))).mapInArrow(frequencies, "kind byte, key binary, doc_id long, size long, total long, word binary, freq long")
    # the head is no part of the tail, so each distinct pre-token is counted once
    tail = vocabulary.join(F.broadcast(spark.createDataFrame([(w,) for w in top], "word binary")), "word", "left_anti") if top else vocabulary
    tail = tail.select("word").repartition(n_partitions(spark)).mapInArrow(with_pieces, "word binary, pieces long")
    sums = (
        rows.join(tail, "word", "left")
        .groupBy("key")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("size").alias("n_bytes"),
            F.max("total").alias("_head"),
            F.sum(F.col("freq") * F.coalesce(F.col("pieces"), F.lit(0))).alias("_tail"),
            F.sum(F.when(F.col("kind") == _BASE, 1).otherwise(0)).alias("_copies"),
        )
        .withColumn("n_tokens", F.col("_head") + F.expr("_tail div _copies"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    )
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
