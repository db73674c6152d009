"""LM scoring (10): Brown class-based bigrams.

P(w | v) = P(class of w | class of v) x P(w | class of w). Classes come from exchange clustering: words move one by one to the
class that raises the likelihood of the corpus' class bigrams most. Three tiers of words, by frequency, differ in where that
is done. The most frequent are exchanged on the driver, sweep by sweep. All others of the head, as many as fit into a table of
bounded size, are exchanged by tasks, from the counts of their neighbours' classes: texts are written as numbers of words
once, and in each sweep all tasks start from the same table of class bigrams. The rest, however many, get their class in a
join, by the classes of the words before them, once for each word; they have classes of their own, so that the head's counts
stand, and stand in one class where they are the word before. No class comes from a word's spelling, and every word of the
training texts has one. A word that is not in them is one more, unseen word of every class.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, written
from .lexicon import OWN, TAIL, counted, head_words, own_word

#: The end of a text, and what stands before its first word. No word holds a line feed.
END = b"\n"
FLOOR = 0.1
#: Counts by which class transitions are drawn towards the class frequencies.
PULL = 5.0
#: Tokens that a task looks at together.
CHUNK = 1_000_000


def tokens_of(text: str | bytes | None) -> list[bytes]:
    """Words, A-Z in lower case, and the end."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = raw.lower().split()
    words.append(END)
    return words


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchanged(table: np.ndarray, own: int, before: np.ndarray, after: np.ndarray, self_count: float, n_open: int | None = None) -> int:
    """The best class of a unit, of the first n_open ones, to which its counts are moved in the table of class bigrams.

    before, after: counts of its neighbours by class, without those of the unit with itself.
    """
    table[:, own] -= before
    table[own] -= after
    table[own, own] -= self_count
    seen, next_ = np.flatnonzero(before), np.flatnonzero(after)
    gain_in = _h(table[seen] + before[seen, None]) - _h(table[seen])
    gain_out = _h(table[:, next_] + after[next_]) - _h(table[:, next_])
    both = table.diagonal()
    gain = gain_in.sum(0) + gain_out.sum(1)
    gain[seen] -= gain_in[np.arange(len(seen)), seen]
    gain[next_] -= gain_out[next_, np.arange(len(next_))]
    gain += _h(both + before + after + self_count) - _h(both)
    # its neighbours' pairs with it count for their classes wherever it is
    rows, columns = table.sum(1) + before, table.sum(0) + after
    gain -= _h(rows + after.sum() + self_count) - _h(rows) + _h(columns + before.sum() + self_count) - _h(columns)
    best = int(np.argmax(gain[:n_open]))
    if gain[best] <= gain[own] + 1e-9:
        best = own
    table[:, best] += before
    table[best] += after
    table[best, best] += self_count
    return best


def exchange(pairs: np.ndarray, n_classes: int, sweeps: int, rest: int = 0) -> np.ndarray:
    """The class of each unit, from pairs[v, w], how often w follows v. The last ``rest`` units stay in a class after the others.

    Units start in turn, the most frequent first, and are then visited in that order. The criterion is the log-likelihood of
    the class bigrams; of equally good classes the first wins.
    """
    pairs = pairs.astype(np.float64)
    n, size = len(pairs) - rest, n_classes + (rest > 0)
    left, right = pairs.sum(0)[:n], pairs.sum(1)[:n]
    order = np.argsort(-(left + right), kind="stable")
    classes = np.full(len(pairs), n_classes, np.int64)
    classes[order] = np.arange(n) % n_classes
    member = np.eye(size)[classes]
    table = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not left[w] + right[w]:
                continue
            own = classes[w]
            before = np.bincount(classes, pairs[:, w], size)
            after = np.bincount(classes, pairs[w], size)
            before[own] -= pairs[w, w]
            after[own] -= pairs[w, w]
            classes[w] = exchanged(table, int(own), before, after, pairs[w, w], n_classes)
            moved += classes[w] != own
        if not moved:
            break
    return classes


def log_likelihood(table: np.ndarray) -> float:
    """Of class bigrams, less what is the same for all classes of the same words."""
    return float(_h(table).sum() - _h(table.sum(0)).sum() - _h(table.sum(1)).sum())


def smoothed(table: np.ndarray) -> np.ndarray:
    """log10 of class transitions, each row drawn towards the class frequencies by PULL counts."""
    overall = (table.sum(0) + 1) / (table.sum() + table.shape[1])
    return np.log10((table + PULL * overall) / (table.sum(1, keepdims=True) + PULL))


def transitions(pairs: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """smoothed() of the class bigrams of units with these pair counts."""
    member = np.eye(n_classes)[classes]
    return smoothed(member.T @ pairs @ member)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of words, of those before and of those after them, of many texts at once. Each text ends with END, which stands before the first one too."""
    held: list[np.ndarray] = []
    size = 0
    for b in batches:
        for text in b.column("numbers").to_pylist():
            held.append(np.frombuffer(text, "<i4"))
            size += len(held[-1])
            if size >= CHUNK:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Since all texts end alike, the end of one can stand before the next one's first word."""
    every = np.concatenate(texts)
    return every, np.roll(every, 1), np.roll(every, -1)


def pair_counts(texts: DataFrame, label: np.ndarray, size: int) -> np.ndarray:
    """table[a, b]: how often a word of label b follows one of label a. The driver gets size squared counts at most."""
    sent = texts.sparkSession.sparkContext.broadcast(label.astype(np.int32))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for tokens, previous, _ in _chunks(batches):
            total += np.bincount(sent.value[previous] * size + sent.value[tokens], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    found = texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size, np.int64)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(size, size)


#: Words whose gains are found together.
_BLOCK = 2048
#: How often a word has neighbours of a class on one side.
_COUNT = np.dtype([("at", "u1"), ("n", "<u4")])


class Sums:
    """Counts of integers, which come in any number of parts. What is held is little more than the distinct ones."""

    def __init__(self, limit: int = 4_000_000) -> None:
        self.limit, self.held = limit, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray, n: np.ndarray | None = None) -> None:
        """n: how often each is there; else codes are one by one."""
        self.parts.append(np.unique(codes, return_counts=True) if n is None else (codes, n))
        self.held += len(self.parts[-1][0])
        if self.held > self.limit:
            self.parts = [self.total()]
            self.held = 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct ones in order, and their counts."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(codes)
        codes = codes[order]
        start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
        return (codes[start], np.add.reduceat(n[order], start)) if len(codes) else (codes, n)


def gains(table: np.ndarray, before: np.ndarray, after: np.ndarray, itself: np.ndarray, n_classes: int, unplaced: np.ndarray) -> np.ndarray:
    """By how much the likelihood rises if words with these counts of neighbours, one a row, come to each class.

    unplaced: whether a word is still in the last class, which isn't open. Of others, what they count for where they are isn't
    taken out of the table.
    """
    out = np.zeros((len(before), n_classes))
    for c in range(before.shape[1]):
        for counts, own, cells in ((before[:, c], after, table[c, :n_classes]), (after[:, c], before, table[:n_classes, c])):
            if len(at := np.flatnonzero(counts)):
                # with those that leave the last class, its pairs with the open ones go
                held = cells - own[at, :n_classes] * unplaced[at, None] if c == n_classes else cells
                out[at] += _h(held + counts[at, None]) - _h(held)
    # where a class follows itself, both sides count in one cell
    b, a, d = before[:, :n_classes], after[:, :n_classes], table.diagonal()[:n_classes]
    out += _h(d + b + a + itself[:, None]) + _h(d) - _h(d + b) - _h(d + a)
    rows, columns = table.sum(1)[:n_classes], table.sum(0)[:n_classes]
    return out - (_h(rows + (after.sum(1) + itself)[:, None]) - _h(rows)) - (_h(columns + (before.sum(1) + itself)[:, None]) - _h(columns))


def moves(texts: DataFrame, classes: np.ndarray, first: int, table: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The head's words from number ``first`` on that change their class, and the new ones. All tasks start from the same table.

    Words without a class as yet are in the last one. The driver gets a row for each that moves.
    """
    sent = texts.sparkSession.sparkContext.broadcast((classes, table.astype(np.float64)))
    n_head, side = len(classes) - 1, n_classes + 2  # a word that is its own neighbour has a place of its own

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = sent.value[0].astype(np.int64)
        sums = Sums()
        for tokens, previous, following in _chunks(batches):
            at = np.flatnonzero((tokens >= first) & (tokens < n_head))
            word = tokens[at].astype(np.int64)
            left = np.where(previous[at] == word, n_classes + 1, classes[previous[at]])
            right = np.where(following[at] == word, n_classes + 1, classes[following[at]])
            sums.add(np.concatenate([word * 2 * side + left, (word * 2 + 1) * side + right]))
        codes, n = sums.total()
        words, start = np.unique(codes // (2 * side), return_index=True)
        packed = np.empty(len(codes), _COUNT)
        packed["at"], packed["n"] = codes % (2 * side), n
        for lo in range(0, len(words), 10_000):
            some, offsets = words[lo : lo + 10_000], np.append(start, len(codes))[lo : lo + 10_001]
            body, offsets = packed[offsets[0] : offsets[-1]], ((offsets - offsets[0]) * _COUNT.itemsize).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(body)])], ["word", "counts"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, table = sent.value
        sums = Sums()
        for b in batches:
            raws = b.column("counts").to_pylist()
            counts = np.frombuffer(b"".join(raws), _COUNT)
            word = np.repeat(b.column("word").to_numpy().astype(np.int64), [len(r) // _COUNT.itemsize for r in raws])
            sums.add(word * 2 * side + counts["at"], counts["n"].astype(np.int64))
        codes, n = sums.total()
        every, row = np.unique(codes // (2 * side), return_inverse=True)
        for lo in range(0, len(every), _BLOCK):
            a, b = np.searchsorted(row, [lo, lo + _BLOCK])
            some = every[lo : lo + _BLOCK]
            held = np.bincount((row[a:b] - lo) * 2 * side + codes[a:b] % (2 * side), n[a:b], len(some) * 2 * side).reshape(len(some), 2, side)
            before, after, itself = held[:, 0, :-1], held[:, 1, :-1], held[:, 0, -1]
            own = classes[some].astype(np.int64)
            best = gains(table, before, after, itself, n_classes, own == n_classes).argmax(1)
            for i in np.flatnonzero((own < n_classes) & (best != own)):
                # staying is judged against a table without the word
                best[i] = exchanged(table.copy(), int(own[i]), before[i], after[i], itself[i], n_classes)
            at = np.flatnonzero(best != own)
            yield pa.RecordBatch.from_arrays([pa.array(some[at].astype(np.int32)), pa.array(best[at].astype(np.int32))], ["word", "class"])

    found = texts.mapInArrow(contexts, "word int, counts binary").repartition("word").mapInArrow(move, "word int, class int").toArrow()
    return found.column("word").to_numpy(), found.column("class").to_numpy()


@dataclass(frozen=True)
class HeadModel:
    """numbers: of the head's words. n: how often each is found. classes: of each, then the one of all other words, the last.

    table[a, b]: how often a word of class b follows one of class a.
    """

    numbers: dict[bytes, int]
    n: np.ndarray
    classes: np.ndarray
    table: np.ndarray
    n_classes: int

    @property
    def steps(self) -> np.ndarray:
        """log10 P(class b | class a) for the classes of the head."""
        wide = np.zeros((self.n_classes + 1, 2 * self.n_classes))
        wide[:, : self.n_classes + 1] = self.table  # all others are seen in the last class here; their own ones are as many as those of the head
        return smoothed(wide)[:, : self.n_classes]

    @property
    def spread(self) -> np.ndarray:
        """log10 of what a word's smoothed count is divided by, for the classes of the head."""
        own = self.classes[:-1]
        return np.log10(np.bincount(own, self.n, self.n_classes) + FLOOR * (np.bincount(own, minlength=self.n_classes) + 1))

    def sequence(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, tokens, itertools.repeat(len(self.numbers))), np.int32, len(tokens))


def fit_head(docs: DataFrame, counts: DataFrame, head: int, n_frequent: int = 768, n_classes: int = 64, sweeps: int = 6, rounds: int = 3) -> HeadModel:
    """Classes of the ``head`` most frequent words of docs, whose word counts are counts.

    The first n_frequent are exchanged on the driver, the others in ``rounds`` sweeps at most by tasks. The first of these
    places them; a later one that doesn't raise the likelihood is dropped.
    """
    if not 0 < n_classes <= 126 or rounds < 1:
        raise ValueError("1 to 126 classes, and at least one round")
    top = dict(head_words(counts, head))
    top |= {END: r["n"] for r in counts.filter(F.col("word") == F.lit(bytearray(END))).collect()}
    numbers, n_frequent = {w: i for i, w in enumerate(top)}, min(n_frequent, len(top))
    n = np.fromiter(top.values(), np.int64, len(top))
    classes = np.full(len(top) + 1, n_classes, np.int8)
    if not len(top):
        return HeadModel(numbers, n, classes, np.zeros((n_classes + 1, n_classes + 1)), n_classes)
    texts = written(in_numbers(docs, numbers), "op10 numbers")
    label = np.minimum(np.arange(len(top) + 1), n_frequent)
    classes[:n_frequent] = exchange(pair_counts(texts, label, n_frequent + 1), n_classes, sweeps, 1)[:-1]
    table = pair_counts(texts, classes, n_classes + 1)
    for k in range(rounds if n_frequent < len(top) else 0):
        word, best = moves(texts, classes, n_frequent, table, n_classes)
        tried = classes.copy()
        tried[word] = best
        found = pair_counts(texts, tried, n_classes + 1)
        if k and log_likelihood(found) <= log_likelihood(table):
            break
        classes, table = tried, found
    return HeadModel(numbers, n, classes, table, n_classes)


def in_numbers(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """The words of each text as numbers, those that have none as the next one."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, other = sent.value, len(sent.value)
        for b in batches:
            found = []
            for text in b.column("text").to_pylist():
                tokens = tokens_of(text)
                found.append(np.fromiter(map(known.get, tokens, itertools.repeat(other)), "<i4", len(tokens)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["numbers"])

    return docs.select("text").mapInArrow(numbered, "numbers binary")


def placed(contexts: DataFrame, model: HeadModel) -> DataFrame:
    """(word, n, class, prev) from (word, prev), one row each time that a word outside the head follows one of class prev.

    Each word gets the class, of as many as the head has, in whose place its own contexts are likeliest. Rows without a word
    give n, how often words of the class follow words of class prev.
    """
    k = model.n_classes
    overall = (model.table.sum(1) + 1) / (model.table.sum() + k + 1)
    likely = np.log((model.table[:, :k] + PULL * overall[:, None]) / (model.table[:, :k].sum(0) + PULL))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            seen = b.column("seen")
            lengths = pc.list_value_length(seen).to_numpy()
            inner = seen.flatten()
            prev, n = inner.field("prev").to_numpy().astype(np.int64), inner.field("n").to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            best = np.concatenate([np.add.reduceat(likely[prev[x]] * n[x, None], np.concatenate([[0], np.cumsum(lengths[r])[:-1]])).argmax(1) for r, x in _stretches(lengths)])
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(best.astype(np.int8)), pa.nulls(len(best), pa.int8())], ["word", "n", "class", "prev"])
            cell, sums = np.unique(best[row] * (k + 1) + prev, return_inverse=True)
            totals = np.bincount(sums, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(cell), pa.binary()), pa.array(totals), pa.array((cell // (k + 1)).astype(np.int8)), pa.array((cell % (k + 1)).astype(np.int8))], ["word", "n", "class", "prev"])

    each = contexts.groupBy("word", "prev").agg(F.count("*").alias("n"))
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("prev", "n")).alias("seen")).mapInArrow(place, "word binary, n long, class byte, prev byte")


def _stretches(lengths: np.ndarray, rows: int = 2000) -> Iterator[tuple[slice, slice]]:
    """Slices of some rows, and of their entries."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for a in range(0, len(lengths), rows):
        b = min(a + rows, len(lengths))
        yield slice(a, b), slice(ends[a], ends[b])


def tail_values(model: HeadModel, table: np.ndarray, n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """value[a, b]: log10 P(class b | class a), less that of what a word's smoothed count is divided by, for classes outside the head.

    table[a, b]: how often a word of class b follows one of class a. n, v: words and distinct words of each class. Every class
    has room for one word more, with a count of 0; unseen words share it, so their value, the last, sums over all classes.
    """
    k = model.n_classes
    steps = smoothed(np.concatenate([model.table[:, :k], table], 1))
    spread = np.log10(n + FLOOR * (v + 1))
    unseen = np.log10((10 ** (steps - np.append(model.spread, spread))).sum(1, keepdims=True))
    return np.concatenate([steps[:, k:] - spread, unseen], 1)


def held_out(doc_id: Column) -> Column:
    """Every tenth document by the CRC of its id; those without an id too."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


_LINES = "kind byte, uid long, word binary, prev byte, train boolean, doc_id long, n_tokens long, known long, logs double, steps double, spread double"
_KINDS = (pa.int8(), pa.int64(), pa.binary(), pa.int8(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())


def _lines(docs: DataFrame, model: HeadModel) -> DataFrame:
    """_LINES: a line OWN for each row of docs (doc_id, train, text) with its sums over words of the head, a line TAIL for each other word.

    uid is the row's own number, by task and place; the lines are to be written before they are used twice.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in _LINES.split(", ")]

    def some(rows: list[tuple], first: int) -> pa.RecordBatch:
        model = sent.value
        words = [w for r in rows for w in r[2]]
        lengths = np.array([len(r[2]) for r in rows])
        start = np.cumsum(lengths) - lengths
        numbers = model.sequence(words)
        own = model.classes[numbers].astype(np.int64)
        previous = np.roll(own, 1)  # every text ends with END, which stands before its first word too
        inside = numbers < len(model.numbers)
        logs = np.append(np.log10(model.n + FLOOR), 0.0)[numbers]
        steps = np.where(inside, np.pad(model.steps, ((0, 0), (0, 1)))[previous, own], 0.0)
        spread = np.append(model.spread, 0.0)[own]
        known, logs, steps, spread = (np.add.reduceat(x, start) for x in (inside.astype(np.int64), logs, steps, spread))
        tail = np.flatnonzero(~inside)
        row = np.repeat(np.arange(len(rows)), lengths)[tail]
        n, m = len(rows), len(tail)
        uid = np.arange(first, first + n)
        train = np.array([r[1] for r in rows])
        columns = [
            np.repeat(np.array([OWN, TAIL], np.int8), [n, m]),
            np.concatenate([uid, uid[row]]),
            [own_word(u.to_bytes(8)) for u in uid.tolist()] + [words[i] for i in tail],
            np.concatenate([np.zeros(n, np.int8), previous[tail].astype(np.int8)]),
            np.concatenate([train, train[row]]),
        ]
        own_columns = ([r[0] for r in rows], lengths, known, logs, steps, spread)
        arrays = [pa.array(c, kind) for c, kind in zip(columns, _KINDS)]
        arrays += [pa.concat_arrays([pa.array(c, kind), pa.nulls(m, kind)]) for c, kind in zip(own_columns, _KINDS[5:])]
        return pa.RecordBatch.from_arrays(arrays, names)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for b in batches:
            held, size = [], 0
            for *row, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "train", "text"))):
                held.append((*row, tokens_of(text)))
                size += len(held[-1][2])
                if size >= CHUNK // 4:
                    yield some(held, first)
                    first += len(held)
                    held, size = [], 0
            if held:
                yield some(held, first)
                first += len(held)

    return docs.select("doc_id", "train", "text").mapInArrow(lines, _LINES)


def score(docs: DataFrame, head: int = 200_000, **options) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows that aren't held out. base_score is the log10 probability by smoothed word counts alone,
    score the model's. A null or empty text is its end alone; a text of any length is scored whole. Repeated rows each count
    in training and give their rows; of words equally frequent, those first by bytes come first into the head. With nothing to
    train on, all words are unknown. head: words that are broadcast, at most lexicon.MAX_BYTES bytes each. Other columns are
    ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    docs = docs.withColumn("train", ~held_out(F.col("doc_id")))
    train = docs.filter("train")
    counts = written(counted(train, ["text"], tokens_of), "op10 words")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    train_tokens, distinct = total["n"] or 0, total["v"]
    model = fit_head(train, counts, head, **options)

    lines = written(_lines(docs, model), "op10 lines")
    found = written(placed(lines.filter((F.col("kind") == TAIL) & F.col("train")).select("word", "prev"), model), "op10 classes")
    k = model.n_classes
    table, n, v = np.zeros((k + 1, k)), np.zeros(k), np.zeros(k)
    for r in found.filter("word IS NULL").groupBy("class", "prev").agg(F.sum("n").alias("n")).collect():
        table[r["prev"], r["class"]] = r["n"]
    for r in found.filter("word IS NOT NULL").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    # one constant of (classes + 1) squared numbers
    value = F.split(F.lit(",".join(map(repr, tail_values(model, table, n, v).ravel().tolist()))), ",").cast("array<double>")

    seen = F.coalesce(F.col("n"), F.lit(0))
    sums = {
        "rare_known": (F.when(seen > 0, 1).otherwise(0), "long"),
        "rare_logs": (F.log10(seen + FLOOR), "double"),
        "rare_score": (F.get(value, F.col("prev") * F.lit(k + 1) + F.coalesce(F.col("class"), F.lit(k))), "double"),
    }
    own = ["doc_id", "n_tokens", "known", "logs", "steps", "spread"]
    looked_up = lines.join(found.filter("word IS NOT NULL").select("word", "n", "class"), "word", "left")
    is_tail = F.col("kind") == TAIL
    sums_of = looked_up.groupBy("uid").agg(*(F.max(c).alias(c) for c in own), *(F.coalesce(F.sum(F.when(is_tail, x)), F.lit(0)).cast(kind).alias(name) for name, (x, kind) in sums.items()))
    logs = F.col("logs") + F.col("rare_logs")
    base_spread = float(np.log10(train_tokens + FLOOR * (distinct + 1)))
    return sums_of.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("rare_known")).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(base_spread)).alias("base_score"),
        (logs + F.col("rare_score") - F.col("spread") + F.col("steps")).alias("score"),
    )


def op10_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
