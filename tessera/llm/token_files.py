"""Token ids as binary blocks: a concatenated id array, with the documents' boundaries in Elias-Fano form.

A block holds whole documents. Boundary i is the number of ids before document i + 1; of each, the low bits stand in a packed array and the
high bits in a bit vector with a one for each boundary, so a boundary costs about 2 + log2(ids / documents) bits. Sampled positions of the
ones make select a short scan. Blocks are rows of a table in the shared folder (shard, number, ids before it in the shard, bytes), so that
they are written and read by Spark's own committers in any store, and any block can be read alone.

Defined results: a null text counts as empty and holds only the end id; a special token that a text spells has its own id, as the library
gives it; rows without an id are left out; rows that repeat an id are written
each, in order of their text; other columns are ignored; an empty table gives no blocks and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, batch, stored
from .tokens import encoder

MAGIC, VERSION, SAMPLE = b"TESSIDS1", 1, 256
HEAD = struct.Struct("<8sHBBIQQQ")
#: Ids of a block, unless one document has more.
BLOCK_IDS = 1 << 21


class EliasFano:
    """A non-decreasing sequence of integers in [0, universe]."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        bits = max(0, int(universe // n).bit_length() - 1) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        where = (values >> bits) + np.arange(n)
        ones = np.zeros(int(universe >> bits) + n + 1 if n else 0, np.uint8)
        ones[where] = 1
        return cls(n, bits, low, np.packbits(ones, bitorder="little"), where[::SAMPLE].astype("<u4"))

    def __getitem__(self, i: int) -> int:
        """Select: from the sample before it, byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, seen = int(self.samples[i // SAMPLE]), i // SAMPLE * SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while seen + word.bit_count() <= i:
            seen += word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(i - seen):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> (first % 8) & ((1 << self.low_bits) - 1)
        return ((one - i) << self.low_bits) | low

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (high << self.low_bits) | (bits << np.arange(self.low_bits)).sum(1)

    def to_bytes(self) -> bytes:
        return struct.pack("<QBxxxIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b, c = struct.unpack_from("<QBxxxIII", data)
        at = struct.calcsize("<QBxxxIII")
        u8 = lambda s, k: np.frombuffer(data, np.uint8, k, s)
        return cls(n, bits, u8(at, a), u8(at + a, b), np.frombuffer(data, "<u4", c, at + a + b))


def write_block(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    """Head, ids of 2 bytes (4 where one needs it), boundaries, document ids as differences."""
    width = 2 if int(ids.max(initial=0)) < 1 << 16 else 4
    ends = EliasFano.of(np.cumsum(lengths), len(ids)).to_bytes()
    docs = zlib.compress(np.diff(np.array(doc_ids, np.int64), prepend=0).astype("<i8").tobytes(), 1)
    return HEAD.pack(MAGIC, VERSION, width, 0, len(ends), len(lengths), len(ids), len(docs)) + ids.astype(f"<u{width}").tobytes() + ends + docs


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, EliasFano]:
    """Document ids, token ids, boundaries."""
    magic, version, width, _, n_ends, n, n_ids, n_docs = HEAD.unpack_from(data)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a block of token ids")
    ids = np.frombuffer(data, f"<u{width}", n_ids, HEAD.size)
    at = HEAD.size + n_ids * width
    docs = np.cumsum(np.frombuffer(zlib.decompress(data[at + n_ends : at + n_ends + n_docs]), "<i8", n))
    return docs, ids, EliasFano.from_bytes(data[at : at + n_ends])


def block_rows(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(document id, start within the block, ids, their CRC-32) of each document; its end is selected from the boundaries, one at a time."""
    docs, ids, ends = read_block(data)
    start = 0
    for i, doc in enumerate(docs.tolist()):
        end = ends[i]
        yield doc, start, end - start, zlib.crc32(ids[start:end].astype("<u4"))
        start = end


BLOCK = pa.schema([("shard", pa.int32()), ("block_no", pa.int64()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())])
ROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the documents in ascending order of their ids and writes the blocks; the table of blocks, read from where it was written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        before, number, shard = 0, 0, 0
        names: list[int] = []
        parts: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal before, number
            ids = np.concatenate(parts)
            out = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, number, before, len(ids), write_block(names, [*map(len, parts)], ids)), BLOCK)], schema=BLOCK)
            before, number = before + len(ids), number + 1
            names.clear()
            parts.clear()
            return out

        held = 0
        for b in batches:
            t = Texts(b.column("text"))
            ids, at = encode(t)
            shard = b.column("shard")[0].as_py() if t.n else shard
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                names.append(doc)
                parts.append(np.concatenate([ids[at[i] : at[i + 1]], end]))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    held = 0
        if parts:
            yield block()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())
    return stored(ordered.mapInArrow(write, "shard int, block_no long, ids_before long, n_ids long, block binary"), "token-blocks")


def read_token_files(blocks: DataFrame) -> DataFrame:
    """One row for each document of the blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    base, before = {}, 0
    for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():  # a row for each shard
        base[r["shard"]] = before
        before += r["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, _, ids_before, _, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                doc, start, n, crc = zip(*block_rows(data))
                yield batch(ROW, doc_id=doc, start=[s + base[shard] + ids_before for s in start], n_tokens=n, ids_crc32=crc)

    return blocks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
