"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. Its features - length, shares of capitals, symbols, digits and punctuation, how much its
words repeat at all and at once, their number and length, how it ends - are binned, and weights of its own bins and of its two neighbours' bins
and of the label transitions make the field. The labels of documents are the labels of their lines in training (full-batch
gradients of the conditional likelihood, with an L2 prior, on a bounded sample of labelled rows). A document's
score is the mean of its lines' forward-backward marginals, weighted by the lines' lengths.

Null and empty texts are one empty line. Repeated rows are scored each; a document with several labels counts as good if at least
half of them are; null labels are left out. Without any label every score is 1; if all labels agree, scores are that label. An
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gemello.llm.batches import slices

#: Labelled documents (about so many are taken, by hash) and lines that the field is fitted on.
MAX_DOCS, MAX_LINES = 4000, 60_000
BINS, STEPS, RATE, L2 = 12, 120, 0.1, 1e-4
#: Bytes of text whose features are made at once.
BLOCK_BYTES = 4 << 20
THRESHOLD = 0.7

LOWER, UPPER, DIGIT, BLANK, POINT, SYMBOL = range(1, 7)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(97, 123), *range(0xC0, 0x100)]] = LOWER  # a character beyond ASCII counts once, by its first byte
_CLASS[65:91] = UPPER
_CLASS[48:58] = DIGIT
_CLASS[[9, 11, 12, 13, 32]] = BLANK
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = POINT
_CLASS[[c for c in range(33, 127) if not _CLASS[c]]] = SYMBOL
N_FEATURES = 10


@dataclass(frozen=True)
class Field:
    """Weights of the label good by [own, previous, next] line, feature and bin, and of transitions [from, to]."""

    weights: np.ndarray
    transitions: np.ndarray


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(x + 1).astype(np.int64), BINS - 1)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of each line, lines of each text, weight of each line)."""
    raw = [(t or "").encode() for t in texts]
    joined = b"\n".join(raw)
    data = np.frombuffer(joined + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    kinds = _CLASS[data]
    counts = {}
    for k in range(LOWER, SYMBOL + 1):
        run = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
        counts[k] = (run[ends] - run[starts]).astype(float)
    chars = sum(counts.values())
    words = [x.split() for x in joined.split(b"\n")]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    n_distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
    n_twice = np.fromiter((sum(map(eq, w, w[1:])) for w in words), np.int64, len(words))
    letters = counts[LOWER] + counts[UPPER]
    share = lambda a, b, scale: np.minimum((scale * a / np.maximum(b, 1)).astype(np.int64), BINS - 1)
    last = np.where(ends > starts, data[np.maximum(ends - 1, 0)], 0)
    bins = np.stack(
        [
            _log_bin(chars),
            share(counts[UPPER], letters, 10.99),
            share(counts[SYMBOL], chars, 40),
            share(counts[DIGIT], chars, 20),
            np.where(n_words >= 8, share(n_distinct, n_words, 10.99), BINS - 1),
            share(counts[POINT], chars, 40),
            np.isin(last, [ord(c) for c in ".?:"]).astype(np.int64),
            share(chars - counts[BLANK], n_words, 1),
            _log_bin(n_words),
            share(n_twice, n_words, 10.99),
        ],
        axis=1,
    )
    per_text = np.fromiter((r.count(b"\n") + 1 for r in raw), np.int64, len(raw))
    return bins.astype(np.int8), per_text, np.maximum(chars, 1)


class Chains:
    """Lines of several documents laid out so that step t of all documents with more than t lines is one slice."""

    def __init__(self, bins: np.ndarray, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        first = np.cumsum(lengths) - lengths
        self.order, self.lengths = order, lengths[order]
        self.active = np.searchsorted(-self.lengths, -np.arange(1, (self.lengths[0] if len(order) else 0) + 1), "right")
        self.starts = np.concatenate([[0], np.cumsum(self.active)])
        doc = np.arange(len(bins)) - np.repeat(first, lengths)  # the step of each line
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        at = self.starts[doc] + np.repeat(rank, lengths)
        self.place = at  # of each line in step-major order
        own = np.empty_like(bins)
        own[at] = bins
        edge = np.full((1, bins.shape[1]), BINS, bins.dtype)
        before, after = np.empty_like(bins), np.empty_like(bins)
        before[at] = np.where((doc == 0)[:, None], edge, np.concatenate([edge, bins[:-1]]))
        after[at] = np.where((doc == np.repeat(lengths, lengths) - 1)[:, None], edge, np.concatenate([bins[1:], edge]))
        offsets = np.arange(bins.shape[1]) * (BINS + 1)
        size = bins.shape[1] * (BINS + 1)
        self.columns = np.concatenate([x.astype(np.int64) + offsets + k * size for k, x in enumerate((own, before, after))], axis=1)

    def emissions(self, field: Field) -> np.ndarray:
        return field.weights.reshape(-1)[self.columns].sum(axis=1)

    def run(self, e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log odds of good, in step-major order."""
        a, b = e.copy(), np.zeros_like(e)
        steps = len(self.active)
        cut = [slice(self.starts[k], self.starts[k] + self.active[k]) for k in range(steps)]
        for k in range(1, steps):
            p = a[cut[k - 1]][: self.active[k]]
            a[cut[k]] += np.logaddexp(t[0, 1], p + t[1, 1]) - np.logaddexp(t[0, 0], p + t[1, 0])
        for k in range(steps - 2, -1, -1):
            n = self.active[k + 1]
            q = (e[cut[k + 1]] + b[cut[k + 1]])[:n]
            b[self.starts[k] : self.starts[k] + n] = np.logaddexp(t[1, 0], t[1, 1] + q) - np.logaddexp(t[0, 0], t[0, 1] + q)
        return a, b

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of each line that has a previous one, and of that one."""
        now = np.concatenate([np.arange(self.starts[k], self.starts[k] + self.active[k]) for k in range(1, len(self.active))] or [np.zeros(0, np.int64)])
        step = np.repeat(np.arange(1, len(self.active)), self.active[1:])
        return now, now - self.starts[step] + self.starts[step - 1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(bins: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Field:
    """Fit a field to documents whose lines all have the document's label."""
    chains = Chains(bins, lengths)
    y = np.empty(len(bins))
    y[chains.place] = np.repeat(labels, lengths)
    now, prev = chains.pairs()
    w, t = np.zeros((3, bins.shape[1], BINS + 1)), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[prev].astype(int), y[now].astype(int)), 1)
    m, v = np.zeros(w.size + 4), np.zeros(w.size + 4)
    for k in range(1, steps + 1):
        e = w.reshape(-1)[chains.columns].sum(axis=1)
        a, b = chains.run(e, t)
        gap = sigmoid(a + b) - y
        g = np.bincount(chains.columns.reshape(-1), np.repeat(gap, chains.columns.shape[1]), w.size)
        joint = np.stack([i * a[prev] + t[i, j] + j * (e[now] + b[now]) for i in (0, 1) for j in (0, 1)])
        joint = np.exp(joint - joint.max(axis=0, initial=-np.inf)) if len(now) else joint
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2) if len(now) else np.zeros((2, 2))
        grad = np.concatenate([g, (expected - seen).reshape(-1)]) / len(y) + L2 * np.concatenate([w.reshape(-1), t.reshape(-1)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w -= move[:-4].reshape(w.shape)
        t -= move[-4:].reshape(2, 2)
    return Field(w, t)


def score_texts(field: Field, texts: list[str | None]) -> np.ndarray:
    """Length-weighted mean marginals of the texts' lines; texts are taken in blocks of bounded size."""
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < BLOCK_BYTES):
            size += len(texts[end] or "")
            end += 1
        bins, lengths, weight = line_features(texts[at:end])
        chains = Chains(bins, lengths)
        a, b = chains.run(chains.emissions(field), field.transitions)
        p = sigmoid(a + b)[chains.place]
        first = np.cumsum(lengths) - lengths
        out[at:end] = np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)
        at = end
    return out


def held_out(doc_id):
    """Whether a row's labels are never learned from: crc32 of the doc_id's text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Field | float:
    """The field fitted to a bounded sample of rows that aren't held out; a number if the labels are all alike."""
    own = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    n = own.count()
    part = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(10_000)) < max(1, min(10_000, 10_000 * max_docs // max(n, 1)))).limit(2 * max_docs)

    def features(batches):
        for b in slices(batches):
            texts = b.column(0).to_pylist()
            for text, good in zip(texts, b.column(1).to_pylist(), strict=True):
                bins, lengths, _ = line_features([text])
                yield pa.RecordBatch.from_pydict({"bins": [bins.tobytes()], "lines": lengths, "good": [good]})

    sample = docs.select("doc_id", "text").join(F.broadcast(part), "doc_id").select("text", "good")
    rows = sorted((bytes(r.bins), r.lines, r.good) for r in sample.mapInArrow(features, "bins binary, lines long, good long").toLocalIterator())
    rng = np.random.default_rng(7)
    kept, lines = [], 0
    for k in rng.permutation(len(rows)):
        if lines + rows[k][1] <= MAX_LINES:
            kept.append(rows[k])
            lines += rows[k][1]
    good = np.asarray([g for _, _, g in kept], float)
    if not len(good) or good.min() == good.max():
        return float(good[0]) if len(good) else 1.0
    bins = np.frombuffer(b"".join(x for x, _, _ in kept), np.int8).reshape(-1, N_FEATURES)
    return fit(bins, np.asarray([n for _, n, _ in kept]), good)


def scored(docs: DataFrame, field: Field | float, name: str = "score") -> DataFrame:
    """docs with a column of scores; all columns of docs stay but one of that name."""
    docs = docs.drop(name)
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            s = score_texts(field, texts) if isinstance(field, Field) else np.full(len(texts), field)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score is at least the threshold; all columns of docs."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return scored(docs, train(docs, labels), name).filter(F.col(name) >= threshold).drop(name)
