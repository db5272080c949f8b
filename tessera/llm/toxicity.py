"""Toxicity by subword-bag embeddings, averaged into a linear softmax and trained together with it in NumPy.

A word is the mean of the vectors of its character n-grams (3 to 5 bytes, with the word's borders), a document the mean of its words (repeats count as
the square root of their number). A
misspelling that training never met shares most n-grams with the word it bends. As the softmax is linear, a word's share of the margin is one
number, computed once for each different word of a batch.

How good it is depends on the labels: with some 3,000 labelled rows about three in four toxic documents are found, with 12,000 nearly all (figures in
the README). Fewer than some hundred toxic examples teach little.

Defined results: a null or empty text is scored by the intercept alone; ASCII capitals count as small letters; rows without an id are left
out; labels outside 0 and 1, or null, teach nothing; without labels every score is 0.5; rows that repeat an id are scored each; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, batch, joined, stored, sums
from .exact_dedup import LOWER
from .labelled import fold, sample, with_texts
from .tokens import spread

BUCKET_BITS, DIMENSION = 16, 4
LENGTHS = (3, 4, 5)
#: Labelled rows that training reads at most.
SAMPLE_ROWS = 12_000
#: Steps of training, and documents that a bucket must stand in to count.
STEPS, LEAST_DOCS = 768, 3
#: Added to the margin: toxic documents are rare in training, and a missed one is worse than a flagged clean one.
LEANING = 1.0
#: A document's mean times this goes to the softmax, so that a word in a hundred can decide at moderate norms.
SCALE = 100.0


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each different word, and where each word's begin (n + 1 offsets)."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    size = np.diff(offsets)
    at = np.concatenate([[0], np.cumsum(size + 2)])
    b = np.full(int(at[-1]), 0x3C, np.uint64)
    b[at[1:] - 1] = 0x3E
    b[spread(at[:-1] + 1, size)] = LOWER[data[spread(offsets[:-1], size)]]
    found, owners = [], []
    for length in LENGTHS:
        count = np.maximum(size + 2 - length + 1, 0)
        start = spread(at[:-1], count)
        h = np.full(len(start), length, np.uint64)
        for k in range(length):
            h = h * np.uint64(257) + b[start + k]
        found.append((joined(h, h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(np.repeat(np.arange(n), count))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owner[order], np.arange(n + 1))


def bags(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their weights, which add up to 1. A word that stands k times counts as its square root's share."""
    words = texts.words
    if not words.n:
        return [(np.zeros(0, np.int64), np.zeros(0))] * texts.n
    code, different = words.coded
    bucket, ptr = subwords(different)
    size = np.diff(ptr)
    out = []
    for s, e in zip(words.ptr[:-1], words.ptr[1:]):
        own, count = np.unique(code[s:e], return_counts=True)
        share = np.sqrt(count) / max(1.0, np.sqrt(count).sum()) / np.maximum(1, size[own])
        at, back = np.unique(bucket[spread(ptr[own], size[own])], return_inverse=True)
        out.append((at, np.bincount(back, np.repeat(share, size[own]), len(at))))
    return out


class Model:
    """Embeddings of the buckets and the softmax above them, by Adagrad."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = ((rng.random((1 << BUCKET_BITS, DIMENSION)) - 0.5) * 0.01).astype(np.float32)
        self.output = ((rng.random((DIMENSION, 2)) - 0.5) * 0.5).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen = np.full((1 << BUCKET_BITS, 1), 1e-6, np.float32)
        self.seen_output, self.seen_bias = np.full((DIMENSION, 2), 1e-2, np.float32), np.full(2, 1e-2, np.float32)

    def step(self, rows: list[tuple[int, np.ndarray, np.ndarray]], rate: float) -> None:
        """Moves the embeddings, the softmax and its intercept together against the slope of the rows' mean cross-entropy."""
        label = np.array([r[0] for r in rows])
        at = np.concatenate([r[1] for r in rows])
        weight = np.concatenate([r[2] for r in rows]).astype(np.float32)  # times SCALE
        doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        taken = self.embedding[at]
        mean = np.stack([np.bincount(doc, weight * taken[:, d], len(rows)) for d in range(DIMENSION)], 1).astype(np.float32)
        z = mean @ self.output + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), label] -= 1
        p /= len(rows)
        up = p @ self.output.T
        g = np.stack([np.bincount(at, weight * up[:, d][doc], 1 << BUCKET_BITS) for d in range(DIMENSION)], 1).astype(np.float32)
        self.seen += (g * g).mean(1, keepdims=True)
        self.embedding -= np.float32(rate) * g / np.sqrt(self.seen)
        for value, seen, grad in ((self.output, self.seen_output, mean.T @ p), (self.bias, self.seen_bias, p.sum(0))):
            seen += grad * grad
            value -= np.float32(rate) * grad / np.sqrt(seen)

    def margins(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log-odds of class 1, and the intercept."""
        return SCALE * self.embedding.astype(float) @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = STEPS, size: int = 256, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """What each bucket adds, and the intercept. The steps are as many for few rows as for many; the rate falls to nothing in a straight line.
    Buckets of fewer than LEAST_DOCS rows are left out: what one document alone holds says nothing of others."""
    if not rows:
        return np.zeros(1 << BUCKET_BITS), 0.0
    docs = np.zeros(1 << BUCKET_BITS, np.int32)
    for _, at, _ in rows:  # a row holds a bucket once
        docs[at] += 1
    known = docs >= LEAST_DOCS
    for i, (label, at, x) in enumerate(rows):  # in place: a row's bytes go before the next row's are copied
        keep = known[at]
        rows[i] = (label, at[keep], x[keep])
    model, rng = Model(), np.random.default_rng(11)
    rounds = -(-steps // -(-len(rows) // size))
    total, done = rounds * -(-len(rows) // size), 0
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for s in range(0, len(rows), size):
            model.step([rows[i] for i in order[s : s + size]], rate * (1 - done / total))
            done += 1
    adds, intercept = model.margins()
    return np.where(known, adds, 0.0), intercept + LEANING


TAUGHT = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("place", pa.int64()), ("at", pa.binary()), ("x", pa.binary())])


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        each = bags(Texts(b.column("text")))
        yield batch(TAUGHT, at=[a.astype("<u2").tobytes() for a, _ in each], x=[(SCALE * x).astype("<f2").tobytes() for _, x in each], **{c: b.column(c) for c in TAUGHT.names[:3]})


def fit(docs: DataFrame, labels: DataFrame, folds: int, held: int, most: int = SAMPLE_ROWS, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """What each bucket adds, and the intercept; at most so many rows, as sparse bags, reach the driver, a part
    of the stored table at a time."""
    taught = with_texts(docs, sample(labels, label, folds, held, most, id_col), id_col, text_col).mapInArrow(_teach, "doc_id long, label int, place long, at binary, x binary")
    own = [(r["place"], r["doc_id"], r["label"], np.frombuffer(r["at"], "<u2"), np.frombuffer(r["x"], "<f2")) for r in stored(taught, "taught").toLocalIterator()]
    own.sort(key=lambda r: r[:2])
    rows = [r[2:] for r in own]
    own.clear()  # rows alone holds the bytes
    return train(rows)


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of whole texts. The model, of a fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adds, intercept = shared.value
        for b in batches:
            t = Texts(b.column("text"))
            margin = np.full(t.n, intercept)
            if t.words.n:
                code, different = t.words.coded
                bucket, ptr = subwords(different)
                word = sums(adds[bucket], ptr) / np.maximum(1, np.diff(ptr))
                for i, (s, e) in enumerate(zip(t.words.ptr[:-1], t.words.ptr[1:])):
                    own, count = np.unique(code[s:e], return_counts=True)
                    share = np.sqrt(count)
                    margin[i] += share @ word[own] / max(1.0, share.sum())
            yield batch(SCORED, doc_id=b.column("doc_id"), score=1 / (1 + np.exp(-np.clip(margin, -35, 35))))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    return texts.mapInArrow(run, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, held_out, score, predicted (1 from the threshold on)."""
    scored = score(docs, fit(docs, labels, folds, held, id_col=id_col, text_col=text_col), id_col, text_col)
    return scored.select(F.col("doc_id").alias(id_col), (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
