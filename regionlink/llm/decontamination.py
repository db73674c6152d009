"""Benchmark decontamination (2): SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window is as many words of a document as a benchmark item has. Its fingerprint has 64 bits: running sums of the signed bits
of all shingles give that of every window by one subtraction, and each occurrence of a shingle counts. Fingerprints of the
items are cut into blocks; two within the radius differ by at most radius / blocks bits in some block, so probing all values
that near in every block finds every item within the radius. These are the candidates, and the only ones. They are verified
by the weighted Jaccard similarity of the shingles with their counts.

Windows in which too few places hold a shingle of any item can't be similar to one and get no fingerprint. The radius follows
from the counts: shared counts that make for the least similarity bound the cosine of window and item from below, the cosine
gives the expected distance, and four standard deviations are added.

The items travel to the documents, in groups of bounded size; the documents never move.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, rows_with, small_batches

SHINGLE, BLOCKS, BITS = 5, 8, 64
#: Characters of items that are searched for at once.
GROUP_CHARS = 16_000_000
#: Places of a text whose running sums are held at once.
_STRETCH = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> list[bytes]:
    """Runs of SHINGLE words; of fewer words, the whole."""
    if not words:
        return []
    n = max(1, len(words) - SHINGLE + 1)
    return [b" ".join(words[i : i + SHINGLE]) for i in range(n)]


def fingerprint(counts: dict[bytes, int]) -> int:
    """SimHash: bit i is the sign of the sum of the counts of the shingles whose hash has bit i, less those of the others. Ties give 0."""
    hashes = np.array([xxhash.xxh3_64_intdigest(s) for s in counts], np.uint64)
    weights = np.fromiter(counts.values(), np.int64, len(counts))
    bits = (hashes[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    sums = (weights[:, None] * (2 * bits.astype(np.int64) - 1)).sum(0)
    return int(((sums > 0).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared counts over those of both together."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared) if shared else 0.0


def reach(cosine: float) -> int:
    """Bits by which the fingerprints of two vectors at least so close differ at most, but for four standard deviations."""
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return min(BITS, math.ceil(BITS * p + 4 * math.sqrt(BITS * p * (1 - p))))


def least_square(counts: np.ndarray, need: int) -> int:
    """Least sum of squares of whole numbers, none above its count, that sum to need: the most even ones."""
    counts = np.sort(counts)
    total, left = 0, need
    for i, c in enumerate(counts.tolist()):
        even = left // (len(counts) - i)
        if c > even:
            more = left - even * (len(counts) - i)
            return total + more * (even + 1) ** 2 + (len(counts) - i - more) * even**2
        total += c * c
        left -= c
    return total


class MultiIndex:
    """Finds all fingerprints within a radius: BLOCKS tables by block value, probed with every value that is near enough."""

    def __init__(self, prints: dict[int, int], radius: int) -> None:
        self.radius = radius
        self.items = np.fromiter(prints, np.int64, len(prints))
        self.prints = np.fromiter(prints.values(), np.uint64, len(prints))
        self.tables = []
        for block in self._blocks(self.prints).T:
            order = np.argsort(block, kind="stable")
            self.tables.append((order, np.searchsorted(block[order], np.arange(257))))

    @staticmethod
    def _blocks(prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints.astype("<u8")).view(np.uint8).reshape(-1, BLOCKS)

    def near_all(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the prints, item, distance) of all pairs within the radius."""
        pairs = []
        for (order, bounds), block in zip(self.tables, self._blocks(prints).T):
            for flip in _flips(min(radius // BLOCKS, BITS // BLOCKS)):
                value = block ^ np.uint8(flip)
                first, n = bounds[value], bounds[value.astype(np.int64) + 1] - bounds[value]
                if total := int(n.sum()):
                    which = np.repeat(np.arange(len(prints)), n)
                    at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + first[which]
                    pairs.append(which * len(self.items) + order[at])
        if not pairs:
            return (np.empty(0, np.int64),) * 3
        which, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.items))
        distance = np.bitwise_count(prints[which] ^ self.prints[item]).astype(np.int64)
        ok = distance <= radius
        return which[ok], self.items[item[ok]], distance[ok]

    def near(self, p: int) -> dict[int, int]:
        """Item numbers within the radius, and their distances."""
        _, item, distance = self.near_all(np.array([p], np.uint64), self.radius)
        return dict(zip(item.tolist(), distance.tolist()))


@lru_cache
def _flips(most: int) -> list[int]:
    """Values of a block with so many bits at most."""
    return [x for x in range(1 << BITS // BLOCKS) if x.bit_count() <= most]


@dataclass
class Kin:
    """Items of one number of words whose counts allow for radii alike."""

    size: int
    index: MultiIndex
    counts: list[np.ndarray]

    def radius(self, n: int, norm: float, least: float) -> int:
        """For windows of n shingles and this norm."""
        total = int(self.counts[0].sum())
        need = math.ceil(least * (n + total) / (1 + least) - 1e-9)
        return max(reach(least_square(c, need) / (math.sqrt(float(c @ c)) * norm)) if need <= total else 0 for c in self.counts)


class Benchmark:
    """Items (number: words) ready to be searched for. radius: of the probes, or more where the counts ask for more."""

    def __init__(self, items: dict[int, list[bytes]], radius: int, least: float) -> None:
        self.least, self.radius = least, radius
        self.bags = {i: Counter(shingles(w)) for i, w in items.items()}
        kin: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
        for i, words in items.items():
            c = np.fromiter(self.bags[i].values(), np.int64, len(self.bags[i]))
            own = reach(least_square(c, math.ceil(2 * least * c.sum() / (1 + least) - 1e-9)) / float(c @ c))
            kin[len(words), own // BLOCKS][i] = fingerprint(self.bags[i])
        self.kin = [Kin(size, MultiIndex(prints, radius), [np.fromiter(self.bags[i].values(), np.int64, len(self.bags[i])) for i in prints]) for (size, _), prints in sorted(kin.items())]
        self.sizes = sorted({k.size for k in self.kin})
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for words in items.values() for w in words}), 1)}
        self.known = {s for b in self.bags.values() for s in b}
        self.short = [k for k in self.sizes if k < SHINGLE]
        mixed = [self._mix([np.uint64(self.vocabulary[w]) for w in s.split(b" ")]) for s in self.known if s.count(b" ") == SHINGLE - 1]
        self.table = np.zeros(1 << max(12, (64 * len(mixed)).bit_length()), bool)
        self.table[[int(m) & len(self.table) - 1 for m in mixed]] = True

    @staticmethod
    def _mix(ids: list) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = ids[0] * np.uint64(0x9E3779B97F4A7C15)
            for x in ids[1:]:
                out = ((out ^ (out >> np.uint64(29))) + x) * np.uint64(0xBF58476D1CE4E5B9)
            return out >> np.uint64(13)

    def hits(self, words: list[bytes], width: int) -> np.ndarray:
        """Whether the run of ``width`` words from each place is a shingle of any item."""
        n = len(words) - width + 1
        found = np.zeros(max(0, n), bool)
        if n > 0 and width == SHINGLE:
            known = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(0)), np.uint64, len(words))
            maybe = self.table[(self._mix([known[k : k + n] for k in range(SHINGLE)]) & np.uint64(len(self.table) - 1)).astype(np.int64)]
            for p in np.flatnonzero(maybe).tolist():
                found[p] = b" ".join(words[p : p + SHINGLE]) in self.known
        elif n > 0:
            found[:] = [b" ".join(words[p : p + width]) in self.known for p in range(n)]
        return found

    def windows(self, words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(words of an item, starts, fingerprints, norms) of the windows that hold enough shingles of items to be similar to one of so many words."""
        for width, sizes in [(SHINGLE, [k for k in self.sizes if k >= SHINGLE]), *((k, [k]) for k in self.short)]:
            hits = self.hits(words, width)
            total = np.concatenate([[0], np.cumsum(hits)])
            if not total[-1]:
                continue
            wanted = []
            for size in sizes:
                n, want = min(size, len(words)) - width + 1, size - width + 1  # shingles of a window, and of the item
                need = math.ceil(self.least * (n + want) / (1 + self.least) - 1e-9)
                if need <= min(n, want, total[-1]) and len(starts := np.flatnonzero(total[n:] - total[:-n] >= need)):
                    wanted.append((size, n, starts))
            if not wanted:
                continue
            longest = max(n for _, n, _ in wanted)
            for lo in range(min(s[0] for _, _, s in wanted), max(s[-1] for _, _, s in wanted) + 1, _STRETCH):
                here = [(size, n, s) for size, n, starts in wanted if len(s := starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + _STRETCH)])]
                if not here:
                    continue
                places = range(lo, min(lo + _STRETCH + longest, len(words) - width + 1))
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[p : p + width])) for p in places), np.uint64, len(places))
                once = len(np.unique(hashes)) == len(hashes)
                signed = ((hashes[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signed, axis=0, dtype=np.int32)])
                for size, n, starts in here:
                    at = starts - lo
                    prints = np.packbits(sums[at + n] > sums[at], axis=1, bitorder="little").view("<u8").ravel()
                    squares = np.full(len(at), n) if once else np.array([(np.unique(hashes[a : a + n], return_counts=True)[1].astype(np.int64) ** 2).sum() for a in at])
                    yield size, starts, prints, np.sqrt(squares)

    def search_all(self, texts: list[list[bytes]]) -> list[list[tuple[int, int, float, int]]]:
        """For each text (item, first word, similarity, distance) of each item's best window that is similar enough; of equals those that begin with a shingle of the item, and of these the first."""
        found: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for i, words in enumerate(texts):
            for size, *rest in self.windows(words):
                found[size].append((i, *rest))
        best: list[dict[int, tuple[float, bool, int, int]]] = [{} for _ in texts]
        for kin in self.kin:
            if not (windows := found.get(kin.size)):
                continue
            text = np.concatenate([np.full(len(s), i) for i, s, _, _ in windows])
            start, prints, norms = (np.concatenate([w[k] for w in windows]) for k in (1, 2, 3))
            lengths = np.array([len(texts[i]) for i in text])
            n = np.minimum(lengths, kin.size) - min(SHINGLE, kin.size) + 1
            radii: dict[tuple[int, float], int] = {}
            for pair in set(zip(n.tolist(), norms.tolist())):
                radii[pair] = max(self.radius, kin.radius(*pair, self.least))
            radius = np.array([radii[pair] for pair in zip(n.tolist(), norms.tolist())])
            for r in np.unique(radius):
                own = np.flatnonzero(radius == r)
                bags: dict[int, Counter] = {}
                for w, item, d in zip(*(x.tolist() for x in kin.index.near_all(prints[own], int(r)))):
                    w = int(own[w])
                    i, at = int(text[w]), int(start[w])
                    if w not in bags:
                        bags = {w: Counter(shingles(texts[i][at : at + kin.size]))}
                    if (x := similarity(bags[w], self.bags[item])) >= self.least:
                        first = b" ".join(texts[i][at : at + min(SHINGLE, kin.size)]) in self.bags[item]
                        best[i][item] = max(best[i].get(item, (0.0, False, 0, 0)), (x, first, -at, d))
        return [[(item, -at, x, d) for item, (x, _, at, d) in sorted(b.items())] for b in best]

    def search(self, words: list[bytes]) -> list[tuple[int, int, float, int]]:
        return self.search_all([words])[0]


def _groups(benchmark: DataFrame, group_chars: int) -> list[DataFrame]:
    """The items, dealt by their ids to groups of about group_chars characters."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // group_chars)
    return [benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, radius: int = 23, group_chars: int = GROUP_CHARS) -> DataFrame:
    """(row columns of docs ..., item_id, first_word, similarity, distance): benchmark items found in the rows of docs.

    One row for each row of docs and item of which a window is at least ``least`` similar: its most similar one, of equals
    one that begins with a shingle of the item, then the first. Words are runs
    of anything but ASCII white space, A-Z in lower case; shingles are five words, or all words of a shorter item. A text
    shorter than the item is one window. radius: the index finds every window within so many bits, or more where repeated
    shingles can set similar windows further apart; what is beyond is about 1 of 30,000 windows that are just similar enough,
    fewer of more similar ones. Whole texts of any length are searched, by runs of words. Items without words and texts without words, null or empty, match
    nothing. An item id that stands for several texts gives a row for each text found. Repeated rows give their rows. Empty
    tables give no rows.
    """
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, first_word long, similarity double, distance int"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, found = docs.sparkSession, []
    for group in _groups(benchmark, group_chars):
        rows = sorted({(r.item_id, r.text) for r in group.collect() if words_of(r.text)}, key=repr)
        ids = [i for i, _ in rows]
        sent = spark.sparkContext.broadcast([words_of(t) for _, t in rows])

        def search(batches: Iterator[pa.RecordBatch], ids=ids, sent=sent) -> Iterator[pa.RecordBatch]:
            items = Benchmark(dict(enumerate(sent.value)), radius, least)
            for b in batches:
                texts = [words_of(t) for t in b.column("text").to_pylist()]
                out = [(doc_id, ids[item], start, x, d) for doc_id, found in zip(b.column("doc_id").to_pylist(), items.search_all(texts)) for item, start, x, d in found]
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "first_word", "similarity", "distance"), r)) for r in out], pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("similarity", pa.float64()), ("distance", pa.int32())]))

        found.append(docs.mapInArrow(search, schema))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, radius: int = 23, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, in which leaks() finds nothing.

    Rows whose text is null or empty stay, and so do all if there are no items. Rows with equal text fare alike. An empty table
    stays empty.
    """
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    for group in _groups(benchmark, group_chars):
        sent = docs.sparkSession.sparkContext.broadcast(sorted({tuple(words_of(r.text)) for r in group.collect()} - {()}))

        def searches(sent=sent) -> Callable[[list], list[bool]]:
            items = Benchmark({i: list(w) for i, w in enumerate(sent.value)}, radius, least)
            return lambda texts: [not found for found in items.search_all([words_of(x) for x in texts])]

        docs = rows_with(docs, searches)
    return docs


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
