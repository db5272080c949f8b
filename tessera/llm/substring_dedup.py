"""Removal of repeated passages: windows of words that also start in a document with a smaller id.

Documents are dealt to parts of a few MB by the hash of their ids; one shuffle of the texts serves all three readings.

1. Each part hashes its windows (96 bits each, from hashes of words) and adds them to a count-min sketch of two rows. A part's share of the
   sketch is sparse, so it travels as sorted, compressed cell numbers, by blocks of cells; each block merges the shares of all parts and
   answers every part with those of its cells that are counted twice or more. A sketch never undercounts, so no repeated window is lost. The
   number of cells grows with the bytes of the corpus, which keeps the share of false positives constant; a block does not grow.
2. Each part sends the windows that both rows estimate repeated to exact grouping by their 96 bits, once a part with its smallest document
   id. A window that half of all documents share is thus one row a part. The grouping answers the parts that do not hold the smallest id.
3. Each part marks the words of the windows that an earlier document holds, within the part or by the answer, and returns what is left.

Defined results: a null text has no words; texts shorter than a window keep everything; rows without an id are left out; rows that repeat an
id do not count against each other; other columns are ignored. Two different windows are taken for equal with a chance of 2^-96 a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, batch, joined, partitions_for, window_hashes, window_starts
from .tokens import spread

#: Bytes of text of a part, cells of a block of the sketch (as a power of two).
PART_BYTES, BLOCK_BITS = 8 << 20, 24
ROWS = 2

SHARE = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("cells", pa.binary())])
WINDOW = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("part", pa.int64()), ("least", pa.int64())])


def pack(cells: np.ndarray) -> bytes:
    """Sorted numbers under 2^32, as differences whose bytes stand by rank."""
    planes = np.diff(cells.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


class Part:
    """The windows of a part's texts."""

    def __init__(self, table: pa.Table, length: int):
        self.doc = table.column("doc_id").to_numpy()
        self.texts = Texts(table.column("text").combine_chunks())
        self.words = self.texts.words
        a, b = self.words.hashes()
        self.length = length
        self.start, self.owner = window_starts(self.words.ptr, length)
        if len(self.start):
            self.h1 = window_hashes(a, length)[self.start]
            self.h2 = (window_hashes(joined(b, b), length)[self.start] >> np.uint64(32)).astype(np.uint32)
        else:
            self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint32)

    def cells(self, row: int, bits: int) -> np.ndarray:
        return (self.h1 if row == 0 else joined(self.h1, self.h2.astype(np.uint64))) >> np.uint64(64 - bits)


def sketch(length: int, bits: int):
    def shares(key: tuple, table: pa.Table) -> pa.Table:
        part, rows = Part(table, length), []
        for row in range(ROWS):
            cells = np.sort(part.cells(row, bits))
            keep = np.ones(len(cells), bool)
            keep[2:] = (cells[2:] != cells[1:-1]) | (cells[1:-1] != cells[:-2])  # a count of two says all
            cells = cells[keep]
            block = (cells >> np.uint64(BLOCK_BITS)).astype(np.int64)
            at = np.flatnonzero(np.diff(block, prepend=-1))
            inner = (cells & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)
            rows += [(ROWS * int(block[s]) + row, key[0].as_py(), pack(inner[s:e])) for s, e in zip(at, [*at[1:], len(cells)])]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), SHARE)], schema=SHARE) if rows else SHARE.empty_table()

    return shares


def merge(key: tuple, table: pa.Table) -> pa.Table:
    """Adds the shares of a block up and answers each part with its cells counted twice or more."""
    count = np.zeros(1 << BLOCK_BITS, np.uint8)
    shares = table.column("cells").to_pylist()
    for data in shares:
        cells = unpack(data)
        again = cells[1:][cells[1:] == cells[:-1]]
        count[cells] = np.minimum(count[cells] + 1, 2)
        count[again] = 2
    rows = []
    for part, data in zip(table.column("part").to_pylist(), shares):
        cells = unpack(data)
        cells = cells[np.diff(cells, prepend=np.uint32((1 << 32) - 1)) != 0]
        if len(cells := cells[count[cells] >= 2]):
            rows.append((key[0].as_py(), part, pack(cells)))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), SHARE)], schema=SHARE) if rows else SHARE.empty_table()


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def by_window(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows stand together, and where each different one begins in it."""
    order = np.argsort(h1)
    a, b = h1[order], h2[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def estimated(length: int, bits: int):
    def windows(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows or not answers.num_rows:
            return WINDOW.empty_table()
        part = Part(texts, length)
        cells: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        for block, data in sorted(zip(answers.column("block").to_pylist(), answers.column("cells").to_pylist())):
            cells[block % ROWS].append(unpack(data).astype(np.uint64) + np.uint64(block // ROWS << BLOCK_BITS))
        keep = np.arange(len(part.h1))
        for row in range(ROWS):
            keep = keep[within(part.cells(row, bits)[keep], np.concatenate(cells[row]) if cells[row] else np.zeros(0, np.uint64))]
        if not len(keep):
            return WINDOW.empty_table()
        order, first = by_window(part.h1[keep], part.h2[keep])
        keep = keep[order]
        least = np.minimum.reduceat(part.doc[part.owner[keep]], first)
        one = keep[first]
        return pa.table([part.h1[one].view(np.int64), part.h2[one].view(np.int32), np.full(len(one), key[0].as_py()), least], schema=WINDOW)

    return windows


def removed(part: Part, earlier1: np.ndarray, earlier2: np.ndarray) -> np.ndarray:
    """Which words go: those of windows that start in a document with a smaller id, of this part or by the answer from elsewhere."""
    edge = np.zeros(part.words.n + 1, np.int32)
    if len(part.h1):
        order, first = by_window(part.h1, part.h2)
        doc = part.doc[part.owner[order]]
        size = np.diff(np.append(first, len(doc)))
        gone = doc > np.repeat(np.minimum.reduceat(doc, first), size)
        if len(earlier1):
            at = np.argsort(earlier1)
            a, b = earlier1[at], earlier2[at]
            one = order[first]
            i = np.searchsorted(a, part.h1[one])
            hit = np.zeros(len(one), bool)
            for step in range(int(np.unique(a, return_counts=True)[1].max())):  # one, but for windows that share 64 bits
                j = np.minimum(i + step, len(a) - 1)
                hit |= (a[j] == part.h1[one]) & (b[j] == part.h2[one])
            gone |= np.repeat(hit, size)
        start = part.start[order[gone]]
        edge += np.bincount(start, minlength=len(edge)).astype(np.int32)
        edge -= np.bincount(start + part.length, minlength=len(edge)).astype(np.int32)
    return np.cumsum(edge)[:-1] > 0


def leaving(length: int, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text)

    def rest(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        part = Part(texts, length)
        w = part.words
        gone = removed(part, answers.column("h1").to_numpy().view(np.uint64), answers.column("h2").to_numpy().view(np.uint32))
        before = np.concatenate([[0], np.cumsum(gone)])
        kept: list[bytes] = []
        for d in range(0, part.texts.n, 64):  # some documents at a time bound the index arrays, which are larger than the texts
            ptr = w.ptr[d : d + 65]
            stay = ptr[0] + np.flatnonzero(~gone[ptr[0] : ptr[-1]])
            size = w.end[stay] - w.start[stay]
            at = np.concatenate([[0], np.cumsum(size + 1)])
            data = part.texts.bytes[np.minimum(spread(w.start[stay], size + 1), len(part.texts.bytes) - 1)] if len(stay) else np.zeros(0, np.uint8)
            data[at[1:] - 1] = 0x20
            first = (ptr - ptr[0]) - (before[ptr] - before[ptr[0]])
            kept += [data[at[s] : max(at[e] - 1, at[s])].tobytes() for s, e in zip(first[:-1], first[1:])]
        more = {"kept_text": [x.decode() for x in kept]} if with_text else {}
        out = batch(schema, doc_id=part.doc, n_words=np.diff(w.ptr), n_removed=np.diff(before[w.ptr]), kept_sha256=[hashlib.sha256(x).hexdigest() for x in kept], **more)
        return pa.Table.from_batches([out])

    return rest


def substring_dedup(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each document: id, n_words, n_removed, kept_sha256 (kept words joined by a space), and with_text the kept text."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = partitions_for(size, PART_BYTES)
    bits = min(56, max(BLOCK_BITS, int(size).bit_length()))  # cells of a row: about 1 to 2 for each byte, so 6 to 12 for each window
    dealt = texts.withColumn("part", F.expr(f"pmod(xxhash64(doc_id), {parts}L)"))
    share = "block long, part long, cells binary"
    shares = dealt.groupBy("part").applyInArrow(sketch(length, bits), share)
    answers = shares.groupBy("block").applyInArrow(merge, share)
    windows = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(estimated(length, bits), "h1 long, h2 int, part long, least long")
    everywhere = F.min("least").over(Window.partitionBy("h1", "h2"))
    earlier = windows.withColumn("first", everywhere).filter("first < least").select("part", "h1", "h2")
    out = dealt.groupBy("part").cogroup(earlier.groupBy("part")).applyInArrow(leaving(length, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return out.withColumnRenamed("doc_id", id_col)
