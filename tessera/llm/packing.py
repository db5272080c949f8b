"""Packing documents into windows of equal length by non-negative least squares over a histogram of lengths.

Documents are encoded and cut into full windows and a remainder. The remainders' lengths, rounded up to bins, make a histogram; all shallow
combinations of bins that fill a window are enumerated, and non-negative least squares finds how often to use each. The counts are rounded
down, and what they leave over is packed greedily, longest first, on the histogram of exact lengths. All of that is of the histogram's size,
which does not grow with the corpus. The pieces then get their place by their rank in order of length, so none of them meets another before
the last step, a window over the pieces of one sequence.

Defined results: a null text counts as empty and holds only the end id; a special token that a text spells has its own id, as the library
gives it; rows without an id are left out; rows that repeat an id are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, batch, running_totals, stored
from .tokens import encoder

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to fill a window of so many bins with 1 to depth parts, largest part first."""
    out: list[tuple[int, ...]] = []

    def fill(left: int, most: int, so_far: tuple[int, ...]) -> None:
        if not left:
            out.append(so_far)
        elif len(so_far) < depth:
            for part in range(min(left, most), 0, -1):
                if part * (depth - len(so_far)) < left:
                    break
                fill(left - part, part, (*so_far, part))

    fill(bins, bins, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """argmin |a x - b| over x >= 0 by an active set: the column of steepest descent enters, blocked steps let columns leave."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        if used.all() or slope.max() <= tolerance:
            break
        used[int(slope.argmax())] = True
        while True:
            cols = np.flatnonzero(used)
            own = a[:, cols]
            try:
                z = np.linalg.solve(own.T @ own, own.T @ b)
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(own, b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            low = z <= 0
            step = np.min(x[cols][low] / np.maximum(x[cols][low] - z[low], 1e-300))
            x[cols] += step * (z - x[cols])
            gone = cols[low & (x[cols] <= 1e-12)] if (low & (x[cols] <= 1e-12)).any() else cols[low][:1]
            x[gone] = 0
            used[gone] = False
    return x


class Plan:
    """Where the piece of each rank goes, ranks counted over all pieces in order of length, document and start."""

    def __init__(self, histogram: dict[int, int], window: int, granule: int, depth: int):
        self.rows: list[tuple[int, int, int, int, int]] = []  # first rank, rows a sequence, first sequence, first slot, rows
        self.sequences = 0
        lengths = np.zeros(window + 1, np.int64)
        for k, v in histogram.items():
            lengths[k] = v
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        bin_of = -(-np.arange(window + 1) // granule)
        bins = -(-window // granule)
        have = np.bincount(bin_of, weights=lengths, minlength=bins + 1)[: bins + 1].astype(np.int64)
        taken = np.zeros(bins + 1, np.int64)
        start = np.array([first[np.argmax(bin_of == k)] for k in range(bins + 1)])
        have[bins] = 0  # the last bin's own lengths: full windows below, the others by the greedy step
        ways = [c for c in combinations(bins, depth) if bins not in c]
        if have.any() and ways:
            a = np.zeros((bins + 1, len(ways)))
            for k, way in enumerate(ways):
                for part in way:
                    a[part, k] += 1
            live = have > 0
            able = np.flatnonzero((a[~live] == 0).all(0))
            times = nnls(a[live][:, able], have[live].astype(float)) if len(able) else []
            for k, x in zip(able, times):
                parts = [(p, len([*same])) for p, same in itertools.groupby(ways[k])]
                n = min([int(x + 1e-9), *((have[p] - taken[p]) // m for p, m in parts)])
                if n > 0:
                    slot = 0
                    for p, m in parts:
                        self.rows.append((int(start[p] + taken[p]), m, self.sequences, slot, int(n * m)))
                        taken[p] += n * m
                        slot += m
                    self.sequences += int(n)
        left, at = lengths.copy(), first.copy()
        for p in range(1, bins):  # the bin's first ranks are taken
            gone = int(taken[p])
            for length in np.flatnonzero(bin_of == p):
                t = min(gone, int(left[length]))
                left[length] -= t
                at[length] += t
                gone -= t
        self.greedy(left, at, window)
        self.rows.sort()

    def greedy(self, left: np.ndarray, at: np.ndarray, window: int) -> None:
        while left.any():
            room, parts, length = window, [], window
            while room:
                fits = np.flatnonzero(left[1 : min(length, room) + 1])
                if not len(fits):
                    break
                length = int(fits[-1]) + 1
                m = min(int(left[length]), room // length)
                parts.append((length, m))
                room -= m * length
                length -= 1
            n, slot = min(int(left[k]) // m for k, m in parts), 0
            for k, m in parts:
                self.rows.append((int(at[k]), m, self.sequences, slot, n * m))
                left[k] -= n * m
                at[k] += n * m
                slot += m
            self.sequences += n

    def places(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int64) for x in zip(*[r[:4] for r in self.rows])) if self.rows else (np.zeros(0, np.int64),) * 4


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Full windows of each document and its remainder, with the checksum of their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        for b in batches:
            t = Texts(b.column("text"))
            ids, at = encode(t)
            rows = []
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                own = np.concatenate([ids[at[i] : at[i + 1]], end])
                rows += [(doc, s, len(part), zlib.crc32(part), len(own)) for s in range(0, len(own), window) for part in [own[s : s + window].astype("<u4")]]
            yield batch(PIECE, **dict(zip(PIECE.names, zip(*rows)))) if rows else pa.RecordBatch.from_pylist([], PIECE)

    return docs.mapInArrow(cut, PIECE_DDL)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, granule: int = 8, depth: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: its document, where it starts there, its length and checksum, its sequence and offset there."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    cut = stored(pieces(texts, tokenizer, end_id, window), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most window rows
    first, rows, sequence, slot = Plan(histogram, window, granule, depth).places()
    names = [*PIECE.names, "sequence_id", "slot"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("before_one").to_numpy()
            k = np.searchsorted(first, rank, side="right") - 1
            nth = rank - first[k]
            yield batch(schema, sequence_id=sequence[k] + nth // rows[k], slot=slot[k] + nth % rows[k], **{n: b.column(n) for n in PIECE.names})

    ranked = running_totals(cut.withColumn("one", F.lit(1)), ["length", "doc_id", "start", "ids_crc32"], ["one"], "ranked")
    placed = ranked.mapInArrow(place, ", ".join(f"{n} long" for n in names))
    w = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))
    return out.select(F.col("doc_id").alias(id_col), *PIECE.names[1:], "sequence_id", "offset")
