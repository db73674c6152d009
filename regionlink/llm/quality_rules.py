"""Quality rules (3): a linear-chain conditional random field labels lines as content or boilerplate.

Lines are described by binary features. Weights are trained by gradient ascent on the log-likelihood (forward-backward)
over a bounded sample of labelled documents, whose lines take the document's label, and are drawn towards hand-set prior
weights, which also serve alone where there are no labels. Viterbi decoding gives each line its label; a document stays if
the share of its words in content lines reaches a threshold and the base rules have nothing against it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, rows_with

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Feature, and its prior weight for content (below 0: for boilerplate).
FEATURES = (
    ("blank", 0.0),
    ("one or two words", -0.1),
    ("three to nine words", 0.2),
    ("ten words or more", 0.4),
    ("a symbol in 100 characters", -0.8),
    ("a symbol in 20 characters", -1.5),
    ("a pipe for five words", -2.0),
    ("an exclamation mark for five words", -1.5),
    ("no lower case", -1.5),
    ("ends as a sentence", 0.6),
    ("a digit in five characters", -0.8),
    ("equals an earlier line", -1.0),
    ("words repeat", -0.8),
    ("address or link", -0.2),
    ("bias", 0.6),
)
#: Prior log-potentials [from, to] and of the first label; 0 is boilerplate, 1 content.
TRANSITIONS = ((0.7, -0.7), (-0.7, 0.7))
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1) for k in range(WINDOW)]


def line_features(line: str, seen: set[str]) -> int:
    """Bit i is set if FEATURES[i] holds. seen: the lines before, to which this one is added."""
    words = line.split()
    n, size = len(words), max(1, len(line))
    bits = 1 << 14
    if not n:
        return bits | 1
    bits |= 1 << (1 if n < 3 else 2 if n < 10 else 3)
    symbols = sum(map(line.count, SYMBOLS))
    if symbols:
        bits |= (100 * symbols > size) << 4 | (20 * symbols > size) << 5 | (5 * line.count("|") > n) << 6
    bits |= (5 * line.count("!") > n) << 7 | line.isupper() << 8 | (words[-1][-1] in ".!?") << 9
    bits |= (5 * sum(map(line.count, "0123456789")) > size) << 10
    bits |= (line in seen) << 11 | (n >= 8 and 5 * len(set(words)) < 3 * n) << 12 | ("://" in line or "@" in line) << 13
    seen.add(line)
    return bits


def text_features(text: str | None) -> list[int]:
    seen: set[str] = set()
    return [line_features(x, seen) for x in (text or "").split("\n")]


@dataclass(frozen=True)
class LineModel:
    """weights: of content against boilerplate, by feature. trans: log-potentials [from][to]. start: of both labels."""

    weights: tuple[float, ...]
    trans: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]

    def score(self, bits: int) -> float:
        return sum(w for i, w in enumerate(self.weights) if bits >> i & 1)

    def decode(self, lines: list[int], cache: dict[int, float] | None = None) -> list[int]:
        """The most likely labels (Viterbi); of equally likely ones, content."""
        cache = {} if cache is None else cache
        (t00, t01), (t10, t11) = self.trans
        back, (a, b) = [], self.start
        for k, bits in enumerate(lines):
            if (s := cache.get(bits)) is None:
                s = cache[bits] = self.score(bits)
            if k:
                from0, from1 = b + t10 >= a + t00, b + t11 >= a + t01
                back.append((from0, from1))
                a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01)
            b += s
        labels = [int(b >= a)] if lines else []
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


PRIOR = LineModel(tuple(w for _, w in FEATURES), TRANSITIONS, (0.0, 0.0))


def objective(theta: np.ndarray, feats: np.ndarray, mask: np.ndarray, gold: np.ndarray, share: np.ndarray, prior: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The mean log-probability that all lines of a part have its label, parts weighed by share, less the ridge; and its gradient (forward and backward sums)."""
    size, k, rows = feats.shape[1], feats.shape[2], np.arange(len(gold))
    w, t, s = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
    emit = np.stack([np.zeros_like(mask), feats @ w], 2)
    alpha = np.zeros((size, len(gold), 2))
    beta = np.zeros((size, len(gold), 2))
    alpha[0] = s + emit[:, 0]
    for i in range(1, size):
        live = mask[:, i, None]
        alpha[i] = live * (np.logaddexp(alpha[i - 1][:, :1] + t[0], alpha[i - 1][:, 1:] + t[1]) + emit[:, i]) + (1 - live) * alpha[i - 1]
    for i in range(size - 2, -1, -1):
        nxt = beta[i + 1] + emit[:, i + 1]
        beta[i] = mask[:, i + 1, None] * np.logaddexp(nxt[:, :1] + t[:, 0], nxt[:, 1:] + t[:, 1])
    z = np.logaddexp(*alpha[-1].T)
    p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z).T * mask
    grad = np.zeros_like(theta)
    off = share * mask * (gold[:, None] - p1)
    grad[:k] = np.einsum("ns,nsk->k", off, feats)
    for i in range(1, size):
        live = mask[:, i] * share[:, 0]
        both = np.exp(alpha[i - 1][:, :, None] + t + (emit[:, i] + beta[i])[:, None, :] - z[:, None, None])
        grad[k : k + 4] -= np.ravel((both * live[:, None, None]).sum(0))
        np.add.at(grad, k + 3 * gold, live)
    first = np.exp(alpha[0] + beta[0] - z[:, None])
    grad[k + 4 :] -= (first * share).sum(0)
    np.add.at(grad, k + 4 + gold, share[rows, 0])
    n = len(gold)
    path = (mask * emit[rows, :, gold]).sum(1) + (mask[:, 1:].sum(1)) * t[gold, gold] + s[gold]
    value = (share[:, 0] * (path - z)).sum() / n - ridge * ((theta - prior) ** 2).sum() / (2 * n)
    return float(value), grad / n - ridge * (theta - prior) / n


def train(sequences: list[tuple[list[int], int]], steps: int = 120, rate: float = 0.1, ridge: float = 1.0, longest: int = 64) -> LineModel:
    """Maximum a posteriori weights for (features of a document's lines, its label); PRIOR where either label is missing.

    Documents are cut into sequences of ``longest`` lines, all of which are used.
    """
    if len({y for _, y in sequences}) < 2:
        return PRIOR
    parts = [(x[i : i + longest], y) for x, y in sequences for i in range(0, len(x), longest)]
    size, k = max(len(x) for x, _ in parts), len(FEATURES)
    feats, mask = np.zeros((len(parts), size, k)), np.zeros((len(parts), size))
    for i, (x, _) in enumerate(parts):
        feats[i, : len(x)] = (np.array(x)[:, None] >> np.arange(k)) & 1
        mask[i, : len(x)] = 1
    gold = np.array([y for _, y in parts])
    # each document and each label counts alike
    share = np.array([len(parts) / (2 * sum(1 for _, z in parts if z == y)) for y in gold])[:, None] / mask.sum(1, keepdims=True) * mask.sum(1).mean()
    prior = np.concatenate([PRIOR.weights, np.ravel(TRANSITIONS), (0.0, 0.0)])
    theta, m, v = prior.copy(), np.zeros_like(prior), np.zeros_like(prior)
    for step in range(1, steps + 1):
        _, grad = objective(theta, feats, mask, gold, share, prior, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    theta = np.round(theta, 6)
    return LineModel(tuple(theta[:k].tolist()), ((theta[k], theta[k + 1]), (theta[k + 2], theta[k + 3])), tuple(theta[k + 4 :].tolist()))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000) -> LineModel:
    """A model from at most ``sample`` labelled documents: those with the smallest hashes of their ids, both labels together.

    Labels other than 0 and 1 don't count; a document with several labels counts as good if one is. Of several texts with one
    id, the one with the least digest is taken, so that the driver gets ``sample`` documents at most. Without labels, or with
    one kind only, the model is the prior one. Nulls and empty texts are documents of one blank line.
    """
    labels = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = labels.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
    schema = "doc_id long, quality int, lines array<int>"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = pa.array([text_features(x) for x in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), lines], ["doc_id", "quality", "lines"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.min_by(F.coalesce("text", F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text"))
    rows = one.mapInArrow(features, schema).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lines))
    return train([(r.lines, r.quality) for r in rows])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = sum(ids[k : k + n] * p for k, p in enumerate(_POWERS))
    mixed.sort()
    if (mixed[1:] != mixed[:-1]).all():
        return 0
    windows = list(zip(*(words[k : k + n] for k in range(WINDOW))))
    times = Counter(windows)
    covered, upto = 0, 0
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


def judge(text: str | None, model: LineModel, threshold: float, cache: dict[int, float]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, content_share, labels."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = text.split("\n")
    seen: set[str] = set()
    feats, dup, counts = [], 0, []
    for x in lines:
        bits = line_features(x, seen)
        feats.append(bits)
        if bits >> 11 & 1:
            dup += bool(x.strip(WHITE))
        counts.append(len(x.split()))
    # a line of other white space only has a word here and none for the features
    odd = [x for x in lines if not x.split() and x.strip(WHITE)]
    dup += len(odd) - len(set(odd))
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    labels = model.decode(feats, cache)
    total = sum(counts)
    content = sum(c for c, y in zip(counts, labels) if y) / total if total else 0.0
    return (n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup, repeated, failed, not failed and content >= threshold, len(lines), content, "".join("bc"[y] for y in labels))


_TYPES = (("n_words", pa.int64(), "long"), ("word_chars", pa.int64(), "long"), ("n_symbols", pa.int64(), "long"), ("n_dup_lines", pa.int64(), "long"), ("n_repeat_words", pa.int64(), "long"), ("base_failed", pa.bool_(), "boolean"), ("kept", pa.bool_(), "boolean"), ("n_lines", pa.int64(), "long"), ("content_share", pa.float64(), "double"), ("line_labels", pa.string(), "string"))


def line_quality(docs: DataFrame, model: LineModel, threshold: float = 0.5) -> DataFrame:
    """Per row of docs (doc_id, text): the base counts, base_failed, kept, n_lines, content_share and a label b or c for each line.

    A null or empty text has no words, one blank line, and isn't kept. Texts of any length are labelled whole, line by line; of
    equally likely labels content wins. Null ids, repeated rows and rows with equal text each
    give their row. Other columns are ignored. An empty table gives no rows.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, float] = {}
        for b in batches:
            rows = [judge(x, model, threshold, cache) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(_TYPES))], ["doc_id", *(name for name, _, _ in _TYPES)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judged, "doc_id long, " + ", ".join(f"{name} {kind}" for name, _, kind in _TYPES))


def keep_content(docs: DataFrame, model: LineModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that line_quality() keeps: without rows whose text is null or empty.

    Rows with equal text fare alike, repeated rows and null ids too. Texts of any length are judged whole. An empty table
    stays empty.
    """

    def judges() -> Callable[[list], list[bool]]:
        cache: dict[int, float] = {}
        return lambda texts: [judge(x, model, threshold, cache)[6] for x in texts]

    return rows_with(docs, judges)


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_quality(docs, model).drop("line_labels")
