"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

The n-grams are single words, pairs of words, and both again over the words' shapes (runs of capitals, small letters and digits as one sign
each, other signs as they are, and whether a word repeats the one before), which lets words that training never met count. A document is the
sparse vector of its n-grams' shares; its score is the sigmoid of one dot product.

There is no intercept: a text that shares nothing with training scores 0.5.

Defined results: a null or empty text scores 0.5; rows without an id are left out; labels outside 0 and 1, or null, teach
nothing; without labels every score is 0.5; rows that repeat an id are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, batch, hash128, joined, sums
from .labelled import fold, sample, with_texts

DIMENSION_BITS = 18
#: Labelled rows that training reads at most.
SAMPLE_ROWS = 6000
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
RUN = re.compile(rb"(.)\1+", re.S)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of all texts, and where each text's begin (n + 1 offsets)."""
    words = texts.words
    if not words.n:
        return np.zeros(0, np.int64), np.zeros(texts.n + 1, np.int64)
    code, different = words.coded
    spelt = different.to_pylist()
    word = hash128(spelt)[:, 0][code]
    shapes: dict[bytes, int] = {}
    shape_of = np.array([shapes.setdefault(RUN.sub(rb"\1", x.translate(SHAPE)), len(shapes)) for x in spelt])
    shape = hash128([*shapes])[:, 1][shape_of][code]
    follows = np.ones(words.n, bool)
    follows[words.ptr[:-1][words.ptr[:-1] < words.n]] = False
    again = np.zeros(words.n, bool)
    again[1:] = (code[1:] == code[:-1]) & follows[1:]
    shape = np.where(again, joined(shape, np.full_like(shape, 7)), shape)
    end = np.uint64(11)
    before = lambda h: np.where(follows, np.concatenate([h[:1], h[:-1]]), end)
    all_of = np.stack([word, joined(before(word), word), shape, joined(before(shape), joined(shape, np.full_like(shape, 3)))], 1)
    return (all_of >> np.uint64(64 - DIMENSION_BITS)).astype(np.int64).ravel(), words.ptr * 4


def vector(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(places, return_counts=True)
    return at, count / max(1, len(places))


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression."""

    def __init__(self, dimension: int, alpha: float = 4.0, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dimension), np.zeros(dimension)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-float(np.clip(w @ x, -35, 35)))) - label) * x
        n = self.n[at]
        self.n[at] = n + g * g
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 2) -> np.ndarray:
    model = Ftrl(1 << DIMENSION_BITS)
    for _ in range(rounds):
        for label, at, x in rows:
            model.update(at, x, label)
    return model.weights()


TAUGHT = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("place", pa.int64()), ("at", pa.binary()), ("x", pa.binary())])


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        places, ptr = features(Texts(b.column("text")))
        each = [vector(places[s:e]) for s, e in zip(ptr[:-1], ptr[1:])]
        yield batch(TAUGHT, at=[a.astype("<u4").tobytes() for a, _ in each], x=[x.astype("<f4").tobytes() for _, x in each], **{c: b.column(c) for c in TAUGHT.names[:3]})


def fit(docs: DataFrame, labels: DataFrame, folds: int, held: int, most: int = SAMPLE_ROWS, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights; at most so many rows, as sparse vectors, reach the driver."""
    taught = with_texts(docs, sample(labels, label, folds, held, most, id_col), id_col, text_col).mapInArrow(_teach, "doc_id long, label int, place long, at binary, x binary")
    rows = sorted(taught.collect(), key=lambda r: (r["place"], r["doc_id"]))
    return train([(r["label"], np.frombuffer(r["at"], "<u4"), np.frombuffer(r["x"], "<f4")) for r in rows])


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def margins(texts: Texts, weights: np.ndarray) -> np.ndarray:
    places, ptr = features(texts)
    return sums(weights[places], ptr) / np.maximum(1, np.diff(ptr))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose texts score the threshold or more; no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sigmoid(margins(Texts(b.column(text_col)), shared.value)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of whole texts. The weights, of a fixed size, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            yield batch(SCORED, doc_id=b.column("doc_id"), score=sigmoid(margins(Texts(b.column("text")), w)))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    return texts.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, held_out, score, predicted (1 from the threshold on)."""
    scored = score(docs, fit(docs, labels, folds, held, id_col=id_col, text_col=text_col), id_col, text_col)
    return scored.select(F.col("doc_id").alias(id_col), (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
