"""N-gram Jaccard join (8): token-combination prefixes.

A token is a shingle of five words, a document the set of its tokens. Tokens have one order, by the number of documents
that hold them, the rarest first. Two sets that are similar enough cannot both leave out of the other as many tokens as the
prefix filter allows, so they share a signature of their prefixes. Rare tokens are signatures by themselves. Frequent ones
are dealt to classes, and the signatures are the pairs of tokens of one class; a class of c tokens then counts for c - 1, so
prefixes are extended until their classes count for enough. Candidates are verified exactly.

Document frequencies come from an exchange of sorted token lists between blocks of documents and ranges of tokens: blocks
send what they hold, ranges answer with the tokens that are not unique. Nothing is broadcast. Equal texts are one text from
the start. Components are found by comparing each signature's documents with its most typical one first. Documents that this
leaves apart are joined once more, by what sets them apart from that one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, n_partitions, row_key, silent_ended, small_batches, written
from .graph import components, joined

SHINGLE = 5
#: A pair links when NUM * union <= DEN * shared (similarity 3/4).
NUM, DEN = 3, 4
#: Documents that hold a frequent token, at least.
FREQUENT = 16
#: Tokens of a prefix that one class of frequent tokens gets, about.
CLASS = 6
#: A worker that says nothing for so many seconds, and one more for each so many bytes of a block, is taken to be stuck.
SILENT_S, SILENT_BYTES = 60, 500_000
_M = np.uint64(0x9E3779B97F4A7C15)
_ENTRY, _TEXT = 0, 1


def tokens(text: str | None, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of SHINGLE words (of fewer words, of all), A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if known is None:
        known = {}
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    mixed = np.full(n, k, np.uint64)
    for i in range(k):
        mixed = ((mixed ^ (mixed >> np.uint64(31))) * _M) + ids[i : i + n]
    return np.unique(_spread(mixed))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(sorted_ints: np.ndarray) -> bytes:
    """Ascending integers as planes of the bytes of their differences: what is small compresses well."""
    if not len(sorted_ints):
        return b"\x01"
    gaps = np.diff(sorted_ints.astype(np.uint64), prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def signatures(h: np.ndarray, df: np.ndarray) -> np.ndarray:
    """What a set of tokens with these document frequencies shares at least one of with any similar set; without those that are unique."""
    n = len(h)
    least = -(-NUM * n // DEN)
    if not n or np.count_nonzero(df > 1) < least:
        return h[:0]
    order = np.lexsort((h, df))
    h, df = h[order], df[order]
    need = n - least + 1
    rare = int(np.searchsorted(df, FREQUENT))
    singles = h[: min(rare, need)][df[: min(rare, need)] > 1]
    if rare >= need:
        return _spread(singles)
    found, rest = [_spread(singles)], h[rare:]
    # one level for each size that a similar set may have, so that two similar sets have one in common
    for level in range((-(-NUM * n // DEN)).bit_length() - 1, (n * DEN // NUM).bit_length()):
        if not level:
            found.append(_spread(rest[: need - rare] + np.uint64(1)))
            continue
        kind = (_spread(rest ^ _M) % np.uint64(max(1, 2**level // (DEN * CLASS)))).astype(np.int64)
        by = np.argsort(kind, kind="stable")
        first = np.ones(len(by), bool)
        first[1:] = kind[by][1:] != kind[by][:-1]
        counts = np.empty(len(by), np.int64)
        counts[by] = ~first
        end = int(np.searchsorted(np.cumsum(counts), need - rare)) + 1
        used = by[by < end]
        bounds = np.flatnonzero(np.diff(kind[used], prepend=-1, append=-1))
        for a, b in zip(bounds, bounds[1:]):
            i, j = np.triu_indices(b - a, 1)
            members = rest[used[a:b]]
            found.append(_spread(_spread(members[i]) * _M + members[j] + np.uint64(level)))
    return np.concatenate(found)


def in_common(a: bytes, b: bytes) -> int:
    """How many integers two packed sets share."""
    return len(np.intersect1d(unpacked(a), unpacked(b), assume_unique=True))


def apart_by(centre: bytes, own: bytes, n: int) -> tuple[int, np.ndarray]:
    """What sets a set of n tokens apart from a centre: 4 x what it lacks + 3 x what it has besides, and these tokens.

    Tokens are those found in several documents: own are the set's, centre may be any set. What the set has besides comes
    first, then what it lacks, both by token, so that sets compared with one centre have one order.
    """
    c, x = unpacked(centre), unpacked(own)
    more = x[~np.isin(x, c, assume_unique=True)]
    less = c[~np.isin(c, x, assume_unique=True)]
    return DEN * len(less) + NUM * (n - (len(c) - len(less))), np.concatenate([more, less])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "byte": pa.int8(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


_ASKED = "range int, block int, tokens binary, counts binary"
_TOLD = "block int, range int, places binary, counts binary"
_OUT = "kind byte, key binary, n int, shared int, typical double, signature long, tokens binary"
_APART = "c binary, node binary, own binary, far boolean, size int, v int, tokens array<long>"


def prefixes(texts: DataFrame, block_bytes: int, cell_bytes: int = 20_000) -> DataFrame:
    """_OUT rows of texts (key, text), written: a line _TEXT with the size of each set, and a line _ENTRY for each of its signatures.

    If it has any, its tokens that are in other texts too are with the former; no set shares any other.
    """
    size, longest = (x or 0 for x in texts.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first())
    #: blocks of documents and ranges of tokens: cells of both hold few tokens, and blocks have a limit
    n = max(1, -(-size // block_bytes), math.isqrt(size // cell_bytes))
    n_ranges = -(-n // 4)
    #: tokens are about 2^x for frequencies, so that few meet by chance
    bits = np.uint64(64 - min(64, max(32, size.bit_length() + 8)))
    part = np.uint64(-(-(1 << int(64 - bits)) // n_ranges))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            fresh = []
            for k in b.column("key").to_pylist():
                fresh.append(k not in seen)
                seen.add(k)
            yield b.filter(pa.array(fresh, pa.bool_()))

    blocks = texts.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).select("block", "key", "text").mapInArrow(once, "block int, key binary, text string")
    # a task takes its blocks one by one; more tasks than needed are as many files
    blocks = blocks.repartition(min(n, max(n_partitions(texts.sparkSession), -(-n // 4))), "block")

    def held(table: pa.Table) -> tuple[list[bytes], list[np.ndarray], np.ndarray, np.ndarray]:
        """Keys and token sets of a block, and its shortened tokens with the number of texts that hold them."""
        known: dict[bytes, int] = {}
        sets: dict[bytes, np.ndarray] = {}
        for batch in table.to_batches(max_chunksize=2000):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if key not in sets:
                    sets[key] = tokens(text, known)
        short = [np.unique(h >> bits) for h in sets.values()]
        return list(sets), list(sets.values()), *np.unique(np.concatenate(short) if short else np.empty(0, np.uint64), return_counts=True)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        _, _, short, counts = held(table)
        cuts = np.searchsorted(short, np.arange(n_ranges + 1, dtype=np.uint64) * part)
        cuts[-1] = len(short)
        block = key[0].as_py()
        rows = [(r, block, packed(short[a:b]), np.minimum(counts[a:b], 65535).astype("<u2").tobytes()) for r, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
        return pa.Table.from_batches([_batch(rows, _ASKED)])

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        lists = [unpacked(x) for x in table.column("tokens").to_pylist()]
        counts = [np.frombuffer(x, "<u2").astype(np.int64) for x in table.column("counts").to_pylist()]
        every, at = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts)).astype(np.int64)[at]
        rows, start = [], 0
        for block, own in zip(table.column("block").to_pylist(), lists):
            df = total[start : start + len(own)]
            places = np.flatnonzero(df > 1)
            rows.append((block, key[0].as_py(), packed(places), np.minimum(df[places], 2**31 - 1).astype("<i4").tobytes()))
            start += len(own)
        return pa.Table.from_batches([_batch(rows, _TOLD)])

    def index(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        keys, sets, short, _ = held(table)
        df = np.ones(len(short), np.int64)
        starts = np.searchsorted(short, np.arange(n_ranges, dtype=np.uint64) * part)
        for r, places, counts in zip(*(told.column(c).to_pylist() for c in ("range", "places", "counts"))):
            df[unpacked(places).astype(np.int64) + starts[r]] = np.frombuffer(counts, "<i4")
        rows: list[tuple] = []
        for k, h in zip(keys, sets):
            own = df[np.searchsorted(short, h >> bits)]
            found = signatures(h, own)
            shared = int(np.count_nonzero(own > 1))
            if len(found):
                typical = float(np.log2(own).mean())
                rows += [(_ENTRY, k, len(h), shared, typical, s, None) for s in found.view(np.int64).tolist()]
            rows.append((_TEXT, k, len(h), shared, 0.0, 0, packed(h[own > 1]) if len(found) else None))
        return pa.Table.from_batches([_batch(rows, _OUT)])

    asked = blocks.groupBy("block").applyInArrow(ask, _ASKED)
    told = asked.groupBy("range").applyInArrow(tell, _TOLD)
    out = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(index, _OUT)
    with silent_ended(texts.sparkSession, SILENT_S + (2 * size // n + longest) // SILENT_BYTES):
        return written(out, "op8 prefixes")


def _fits(a: Column, b: Column) -> Column:
    """Whether two sets can be similar: the tokens that each shares with any set are enough."""
    return (NUM + DEN) * F.least(a["shared"], b["shared"]) >= NUM * (a["n"] + b["n"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) of pairs whose sets are similar. sets: (key, n, tokens)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = [-(-NUM * n // (NUM + DEN)) for n in b.column("n").to_pylist()]
            yield b.filter(pa.array([in_common(x, y) >= k for x, y, k in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), least)], pa.bool_())).select(["a", "b"])

    of = lambda key, name: sets.select(F.col("key").alias(key), F.col("tokens").alias(name), F.col("n").alias(f"n_{name}"))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y", (F.col("n_x") + F.col("n_y")).alias("n")).mapInArrow(check, "a binary, b binary")


def _elsewhere(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that may be similar, of members (c, node, own, far) of one centre c that are in different components.

    far: whether the member is outside its centre's component; one of a pair is. A pair of sets is similar if and only if
    7 x (tokens in which both differ from the centre alike) >= v of the one + v of the other - size of the centre, v as
    apart_by() gives it. So similar sets have some of these tokens among the first of both: prefixes of the differences
    are joined by centre and token, and by steps of v, for which prefixes can be the shorter the larger v is. What near copies
    differ in is rarely the same, so few meet, however many share the centre.
    """

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [apart_by(x, y, n) for x, y, n in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("n").to_pylist())]
            columns = [pa.array([v for v, _ in found], pa.int32()), pa.array([t.view(np.int64) for _, t in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("c", "node", "own", "far", "size")), *columns], [f.split()[0] for f in _APART.split(", ")])

    centres = sets.select(F.col("key").alias("c"), F.col("tokens").alias("x"), F.col("held").alias("size"))
    each = members.join(centres, "c").join(sets.select(F.col("key").alias("node"), F.col("tokens").alias("y"), "n"), "node")
    each = written(each.select("c", "node", "own", "far", "size", "x", "y", "n").mapInArrow(differ, _APART), "op8 differences")

    step = lambda v: F.floor(4 * F.log2(v + 1.0))
    lowest = lambda k: F.ceil(F.pow(F.lit(2.0), k / 4) - 1.0 - 1e-6)
    least = lambda v, w: F.greatest(F.ceil((v + w - F.col("size")) / (NUM + DEN)), F.lit(1))
    held = F.size("tokens")
    # tables of their own, so that Spark can split the joins with them where one centre is hot
    ends = each.groupBy("c").agg(F.min("v").alias("any_v"), F.min(F.when(F.col("far"), F.col("v"))).alias("far_v"), F.min(F.struct("v", "node", "own")).alias("middle"))
    each = each.join(written(ends, "op8 bounds"), "c").withColumns({"step": step(F.col("v")), "x": F.col("far") & (least(F.col("v"), F.col("any_v")) <= held), "y": least(F.col("v"), F.col("far_v")) <= held})
    # sets whose v together is not above the centre's size are similar whatever they differ in: a star says the same as all pairs
    close = (F.col("v") + F.col("middle.v") <= F.col("size")) & (F.col("own") != F.col("middle.own"))
    star = each.filter(close).select(F.least("node", "middle.node").alias("a"), F.greatest("node", "middle.node").alias("b"))
    steps = each.groupBy("c").agg(F.collect_set(F.when(F.col("x"), F.col("step"))).alias("far_steps"), F.collect_set(F.when(F.col("y"), F.col("step"))).alias("any_steps"))
    steps = written(steps, "op8 steps")

    def dealt(side: str, others: str, mine: str, theirs: str, name: str) -> DataFrame:
        rows = each.filter(side).join(steps.select("c", others), "c").select("c", "node", "own", "size", "v", "tokens", F.col("step").alias(mine), F.explode(others).alias(theirs))
        first = rows.withColumn("first", held - least(F.col("v"), lowest(F.col(theirs))) + 1).filter("first > 0")
        return first.select("c", mine, theirs, F.explode(F.expr("slice(tokens, 1, int(first))")).alias("token"), F.struct("node", "own", "size", "v", held.alias("held")).alias(name))

    p, q = F.col("p"), F.col("q")
    enough = F.ceil((p["v"] + q["v"] - p["size"]) / (NUM + DEN)) <= F.least(p["held"], q["held"])
    keys = ["c", "far_step", "any_step", "token"]
    right = dealt("y", "far_steps", "any_step", "far_step", "q").select(*(F.col(k).alias(f"_{k}") for k in keys), "q")
    met = dealt("x", "any_steps", "far_step", "any_step", "p").join(right, reduce(Column.__and__, (F.col(k) == F.col(f"_{k}") for k in keys)) & (p["own"] != q["own"]) & enough)
    return met.select(F.least(p["node"], q["node"]).alias("a"), F.greatest(p["node"], q["node"]).alias("b")).unionAll(star).distinct()


def linked(texts: DataFrame, block_bytes: int = 64_000_000) -> tuple[DataFrame, DataFrame]:
    """(key, n): the size of each set of texts (key, text); (node, component): the components of those with links."""
    small_batches(texts.sparkSession)
    out = prefixes(texts, block_bytes)
    sets = out.filter(F.col("kind") == _TEXT)
    entries = out.filter(F.col("kind") == _ENTRY).select("signature", F.struct("typical", "key", "n", "shared").alias("doc"))
    having = sets.filter("tokens is not null").select("key", "n", F.col("shared").alias("held"), "tokens")

    typical = entries.groupBy("signature").agg(F.max("doc").alias("centre"), F.count("*").alias("docs")).filter("docs > 1").drop("docs")
    typical = written(typical, "op8 typical")  # so that Spark can split the join where one signature is hot
    # one row for each document and most typical one of its signatures
    near = entries.join(typical, "signature").groupBy(F.col("centre.key").alias("c"), F.col("doc.key").alias("node")).agg(F.max("centre").alias("centre"), F.max("doc").alias("doc"))
    near = written(near, "op8 near")
    pairs = near.filter((F.col("c") != F.col("node")) & _fits(F.col("centre"), F.col("doc"))).select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b")).distinct()
    edges = written(_verified(pairs, having), "op8 links")
    found = components(edges)

    # documents that a signature's most typical one didn't link, with all others of the signature that are elsewhere
    placed = near.select("c", "node").join(found, "node", "left")
    placed = placed.join(found.select(F.col("node").alias("c"), F.col("component").alias("main")), "c", "left").select("c", "node", F.coalesce("component", "node").alias("own"), (F.coalesce("component", "node") != F.coalesce("main", "c")).alias("far"))
    placed = written(placed, "op8 apart")
    open_centres = placed.filter("far").select("c").distinct()
    more = _elsewhere(placed.join(open_centres, "c", "left_semi"), having).join(pairs, ["a", "b"], "left_anti")
    new = written(_verified(more, having), "op8 links")
    if not new.isEmpty():
        found = joined(found, new)
    return sets.select("key", "n").distinct(), found


def jaccard_classes(docs: DataFrame, block_bytes: int = 64_000_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Rows with equal texts are one text. A row whose text has no words, or is null, links with nothing: its component is its
    own id, however many such rows there are. A null doc_id is never the smallest, unless all are null. Repeated rows give
    their rows. Texts of any length are compared whole. A similarity of just 3/4 links. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", row_key(F.col("text")))
    sizes, found = linked(rows.filter("text is not null").select("key", "text"), block_bytes)
    # a row for each text, however many copies there are; tables of their own, so that Spark can split the joins with them
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("least")).join(sizes.filter("n > 0"), "key").join(found.withColumnRenamed("node", "key"), "key", "left")
    texts = written(texts.select("key", "n", "least", F.coalesce("component", "key").alias("component")), "op8 texts")
    smallest = written(texts.groupBy("component").agg(F.min("least").alias("smallest")), "op8 smallest")
    classes = written(texts.join(smallest, "component").select("key", "n", "smallest"), "op8 classes")
    out = rows.select("doc_id", "key").join(classes, "key", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("n").isNotNull(), F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))
