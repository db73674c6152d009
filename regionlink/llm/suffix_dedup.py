"""Suffix-array dedup (7): every byte covered by a string of 200 bytes that starts elsewhere too is removed.

Windows that can be equal are brought together first. The least hashed 64-gram of a window is its anchor, equal windows have
equal anchors, and consecutive windows with the same anchor form a fragment. Anchors found once in the corpus cannot repeat
and go no further. Of the others, fragments that are equal are one; an anchor with a single fragment needs no comparison.
All distinct fragments of the rest are dealt to shards by anchor, and each shard is sorted by external induction: suffixes
with 200 bytes in common lie in runs of its suffix array. An anchor with too many fragments for a shard has its windows
grouped by their digests instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, n_bytes, row_key, small_batches, written
from .induced_sort import InducedSort

GRAM = 64
_PLACE = 24
_M = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]
#: Bytes that are looked at together; places in them fit in _PLACE bits.
_CHUNK = 500_000


def _grams(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place; a multiplier for each doubling."""
    h, width = raw.astype(np.uint64) + np.uint64(1), 1
    for m in _M:
        h = (h[:-width] * m) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    h *= _M[0]
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def _fold(grams: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of the grams in any range comes by one subtraction (see _range_hash)."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * _powers(int(_M[1]))[: len(grams)])])


@lru_cache
def _powers(base: int) -> np.ndarray:
    """As many as there can be grams in one go."""
    return np.cumprod(np.append(np.ones(1, np.uint64), np.full(2 * _CHUNK + 999, base, np.uint64)))


def _range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same for equal ranges of grams, wherever they start."""
    back = _powers(pow(int(_M[1]), -1, 1 << 64))
    return _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * _M[2])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[3]
    x = (x ^ (x >> np.uint64(29))) * _M[4]
    return x ^ (x >> np.uint64(32))


#: What is known of a fragment: its first window, how many windows, its anchor, and the hash of its bytes.
_CUT = np.dtype([("start", "<i4"), ("windows", "<i4"), ("anchor", "<i8"), ("fragment", "<i8")])


def fragments(raws: list[bytes], length: int) -> list[np.ndarray]:
    """For each text its fragments (_CUT), the runs of windows with one anchor, in order."""
    out: list[list[np.ndarray]] = [[] for _ in raws]
    pieces: list[tuple[int, int, bytes]] = []
    held = 0
    for i, raw in enumerate(raws):
        for at in range(0, max(0, len(raw) - length + 1), _CHUNK):
            part = raw[at : at + _CHUNK + length - 1]
            pieces.append((i, at, part))
            held += len(part)
            if held >= _CHUNK:
                _runs(pieces, length, out)
                pieces, held = [], 0
    if pieces:
        _runs(pieces, length, out)
    return [np.concatenate(x) if x else np.empty(0, _CUT) for x in out]


def _runs(pieces: list[tuple[int, int, bytes]], length: int, out: list[list[np.ndarray]]) -> None:
    sizes = np.array([len(p) for _, _, p in pieces])
    first = np.cumsum(sizes) - sizes
    grams = _grams(np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8))
    places = np.arange(len(grams), dtype=np.uint64)
    packed = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | places
    least = _sliding_min(packed, length - GRAM + 1) & np.uint64((1 << _PLACE) - 1)
    counts = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    anchor = least[window + first[piece]].astype(np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    at = np.flatnonzero(new)
    found = np.empty(len(at), _CUT)
    own = piece[at]
    found["windows"] = np.append(at[1:], len(anchor)) - at
    found["start"] = window[at] + np.array([o for _, o, _ in pieces])[own]
    found["anchor"] = grams[anchor[at]].view(np.int64)
    begin = window[at] + first[own]
    found["fragment"] = _range_hash(_fold(grams), begin, begin + found["windows"] + length - GRAM).view(np.int64)
    for (i, _, _), a, b in zip(pieces, *(np.searchsorted(own, np.arange(len(pieces)), side) for side in ("left", "right"))):
        out[i].append(found[a:b])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for b in batches:
        fresh = []
        for k in b.column("key").to_pylist():
            fresh.append(k not in seen)
            seen.add(k)
        yield b.filter(pa.array(fresh, pa.bool_()))


_TEXT = "key binary, text binary"
_CUTS = "key binary, cuts binary"
_SEEN = "anchor long, fragment long, place long"
_PLACED = "anchor long, fragment long, key binary, start int, windows int"
_SENT = "shard int, hot boolean, anchor long, fragment long, many boolean, body binary"
_DOUBLE = "anchor long, fragment long, bounds array<int>"
_WINDOW = "anchor long, fragment long, offset int, many boolean, digest binary, place long"
_DONE = "key binary, n_removed long, n_spans long, kept_sha256 string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _batches(rows: Iterator[tuple], schema: str, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)], [n for n, _ in fields])

    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _digest(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _uncut(b: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """All fragments of a batch of _CUTS, by field, and the row of each."""
    raws = b.column("cuts").to_pylist()
    found = np.frombuffer(b"".join(raws), _CUT)
    return {n: np.ascontiguousarray(found[n]) for n in _CUT.names}, np.repeat(np.arange(len(raws)), [len(r) // _CUT.itemsize for r in raws])


def repeated_in(parts: list[tuple[bytes, bool]], length: int, memory_items: int) -> list[list[int]]:
    """For each (fragment, whether it is found several times): bounds of its windows that are found elsewhere too."""
    body = np.concatenate([np.append(np.frombuffer(raw, np.uint8).astype(np.int32) + 2, 1) for raw, _ in parts] + [np.zeros(1, np.int32)])
    sizes = np.array([len(raw) + 1 for raw, _ in parts])
    first = np.cumsum(sizes) - sizes
    sorter = InducedSort(length, memory_items, names=4 * memory_items)
    try:
        order, lcp = sorter.sort(body)
        # suffixes too short for a window share fewer bytes with all others, and so does the last 0
        together = np.asarray(lcp) >= length
        double = np.zeros(len(body), bool)
        double[order[together]] = True
        double[order[np.flatnonzero(together) - 1]] = True
    finally:
        sorter.close()
    out = []
    for i, (raw, many) in enumerate(parts):
        n = len(raw) - length + 1
        if many:
            out.append([0, n - 1])
            continue
        own = np.diff(np.concatenate([[0], double[first[i] : first[i] + n].astype(np.int8), [0]]))
        out.append(np.stack([np.flatnonzero(own == 1), np.flatnonzero(own == -1) - 1], 1).ravel().tolist())
    return out


def suffix_dedup(docs: DataFrame, length: int = 200, shard_bytes: int = 600_000, memory_items: int = 80_000, hot: int = 4000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    length: of the strings. shard_bytes: of fragments that are sorted together, about. memory_items: more items of a sort's
    queue or arrays go to files; a string of names of four times as many is still sorted in memory, a longer one by recursion. hot: distinct fragments of one anchor beyond which its windows are grouped by digest. Strings are judged on the
    input: what is removed covers all their occurrences. Texts below ``length`` bytes lose nothing; a null text is empty.
    Texts found several times lose everything, repeated rows included; texts of any
    length are looked at whole, in parts that overlap. There are no ties: all occurrences go. Null ids are kept, other columns ignored. An empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", row_key(F.col("text")))
    copied = rows.select("key", F.col("text").cast("binary").alias("text"))
    texts = copied.mapInArrow(_once, _TEXT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _once(batches):
            found = fragments(b.column("text").to_pylist(), length)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "cuts"])

    # a step of Python after another in one task has a worker of its own, which stays and keeps its memory: so an exchange or a
    # table lies between any two of them, and joins of texts are merged, never broadcast
    cuts = written(copied.mapInArrow(cut, _CUTS), "op7 cuts")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, row = _uncut(b)
            owner = np.frombuffer(b"".join(k[:8] for k in b.column("key").to_pylist()), "<u8")[row]
            place = _mix(owner + found["start"].astype(np.uint64) * _M[5])
            yield pa.RecordBatch.from_arrays([pa.array(found["anchor"]), pa.array(found["fragment"]), pa.array(place.view(np.int64))], ["anchor", "fragment", "place"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, row = _uncut(b)
            yield pa.RecordBatch.from_arrays([pa.array(found["anchor"]), pa.array(found["fragment"]), b.column("key").take(pa.array(row)), pa.array(found["start"]), pa.array(found["windows"])], ["anchor", "fragment", "key", "start", "windows"])

    again = cuts.mapInArrow(seen, _SEEN).groupBy("anchor").agg(*(f(c).alias(f"{n}_{c}") for c in ("fragment", "place") for f, n in ((F.min, "min"), (F.max, "max"))))
    # a table of its own, so that Spark can split the join where one anchor is hot
    again = written(again.filter("min_place < max_place").select("anchor", (F.col("min_fragment") < F.col("max_fragment")).alias("mixed")), "op7 anchors")
    # rows of equal texts in several tasks are one place
    found = written(cuts.mapInArrow(placed, _PLACED).join(again, "anchor"), "op7 fragments")

    mixed = found.filter("mixed").groupBy("anchor", "fragment").agg(F.min(F.struct("key", "start", "windows")).alias("one"), F.max(F.struct("key", "start", "windows")).alias("other"))
    mixed = mixed.select("anchor", "fragment", "one.*", (F.col("one") < F.col("other")).alias("many"))
    often = mixed.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("anchor", F.lit(True).alias("hot"))
    often = written(often, "op7 hot anchors")
    mixed = written(mixed.join(often, "anchor", "left"), "op7 mixed")
    size = mixed.filter("hot IS NULL").agg(F.sum(F.col("windows") + length)).first()[0] or 0
    n_shards = max(1, -(-size // shard_bytes))
    wanted = mixed.groupBy("key").agg(F.collect_list(F.struct(F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).cast("int").alias("shard"), F.coalesce("hot", F.lit(False)).alias("hot"), "anchor", "fragment", "start", "windows", "many")).alias("parts"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for raw, parts in zip(b.column("text").to_pylist(), b.column("parts").to_pylist()):
                    for p in parts:
                        yield p["shard"], p["hot"], p["anchor"], p["fragment"], p["many"], raw[p["start"] : p["start"] + p["windows"] + length - 1]

        return _batches(rows(), _SENT, 5_000)

    bodies = written(texts.join(wanted.hint("merge"), "key").select("text", "parts").mapInArrow(fetch, _SENT).dropDuplicates(["anchor", "fragment"]), "op7 bodies")

    def sort_shard(key: tuple, table: pa.Table) -> pa.Table:
        ids = sorted(zip(*(table.column(c).to_pylist() for c in ("anchor", "fragment", "body", "many"))))
        bounds = repeated_in([(body, many) for _, _, body, many in ids], length, memory_items)
        return pa.Table.from_batches(list(_batches(((a, f, b) for (a, f, _, _), b in zip(ids, bounds)), _DOUBLE, 1 << 40)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for a, f, body, many in zip(*(b.column(c).to_pylist() for c in ("anchor", "fragment", "body", "many"))):
                    for o in range(len(body) - length + 1):
                        yield a, f, o, many, hashlib.blake2b(body[o : o + length], digest_size=16).digest(), _digest(f.to_bytes(8, signed=True) + o.to_bytes(4))

        return _batches(rows(), _WINDOW)

    double = bodies.filter("NOT hot").groupBy("shard").applyInArrow(sort_shard, _DOUBLE)
    each = bodies.filter("hot").mapInArrow(windows, _WINDOW)
    twice = each.groupBy("digest").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.max("many").alias("any_many")).filter("lo < hi OR any_many").select("digest")
    grouped = each.join(twice, "digest").groupBy("anchor", "fragment").agg(F.flatten(F.collect_list(F.array("offset", "offset"))).alias("bounds"))
    double = double.unionByName(grouped)

    spans = found.filter("NOT mixed").select("key", "start", F.array(F.lit(0), F.col("windows") - 1).alias("bounds"))
    spans = spans.unionByName(found.filter("mixed").select("anchor", "fragment", "key", "start").join(double, ["anchor", "fragment"]).select("key", "start", "bounds"))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "bounds")).alias("parts"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                parts = b.column("parts")
                inner = parts.flatten()
                bounds = inner.field("bounds")
                n_bounds = pc.list_value_length(bounds).to_numpy(zero_copy_only=False) // 2
                places = np.repeat(inner.field("start").to_numpy(), n_bounds)
                ends = bounds.flatten().to_numpy().reshape(-1, 2)
                lo, hi = places + ends[:, 0], places + ends[:, 1] + length
                of_part = np.concatenate([[0], np.cumsum(n_bounds)])
                of_row = of_part[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).fill_null(0).to_numpy(zero_copy_only=False))])]
                for key, raw, x, y in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), of_row.tolist(), of_row[1:].tolist()):
                    kept, upto, gone, n = hashlib.sha256(), 0, 0, 0
                    if x < y:
                        order = np.argsort(lo[x:y], kind="stable")
                        start, reach = lo[x:y][order], np.maximum.accumulate(hi[x:y][order])
                        new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
                        n = len(new)
                        for begin, end in zip(start[new].tolist(), reach[np.append(new[1:] - 1, y - x - 1)].tolist()):
                            kept.update(raw[upto:begin])
                            gone += end - begin
                            upto = end
                    kept.update(raw[upto:])
                    yield key, gone, n, kept.hexdigest()

        return _batches(rows(), _DONE)

    done = texts.join(spans.hint("merge"), "key", "left").select("key", "text", "parts").mapInArrow(remove, _DONE).dropDuplicates(["key"])
    copies = rows.select("key").groupBy("key").agg(F.count("*").alias("copies"))
    of_text = written(done.join(copies, "key"), "op7 texts")
    out = rows.select("doc_id", "key", n_bytes(F.col("text")).alias("n_bytes")).join(of_text, "key")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))
