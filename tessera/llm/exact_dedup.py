"""Exact deduplication by composable polynomial fingerprints.

A text is read as a polynomial over several prime fields, three bytes a coefficient. Chunks are hashed side by side and combined by
length-shifted arithmetic, H(AB) = H(A) * base^len(B) + H(B), so a huge document needs no pass of its own. Documents whose length and
fingerprint agree are then compared chunk by chunk with the one that stays, as rows that hold one chunk each.

Defined results: a null text counts as empty, empty texts are equal to each other; ASCII capitals count as small letters; rows without an
id are left out, as no result can name them; rows that repeat an id are judged each by its own text, and those that repeat id and text share
one verdict; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, batch, stored

#: Coefficients (of three bytes each) of a chunk.
CHUNK_UNITS = 1 << 14
#: Coefficients that are hashed at once; each takes some tens of bytes.
AT_ONCE = 1 << 20
#: Primes under 2^31 with a base each; four lanes make a fingerprint of 124 bits.
LANES = ((2147483647, 1103515245), (2147483629, 1812433253), (2147483647, 1664525009), (2147483629, 1566083941))
#: A salted share of a group holds so many documents and so many bytes at most.
SHARE_ROWS, SHARE_BYTES = 256, 16 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(lane: int) -> np.ndarray:
    """base^0 to base^CHUNK_UNITS of a lane."""
    if lane not in _powers:
        p, b = LANES[lane]
        out = [1]
        for _ in range(CHUNK_UNITS):
            out.append(out[-1] * b % p)
        _powers[lane] = np.array(out, np.uint64)
    return _powers[lane]


def combine(lane: int, left: np.ndarray, right: np.ndarray, right_units: np.ndarray) -> np.ndarray:
    """Hash of a concatenation; right_units, at most CHUNK_UNITS, is by how much the left hash is shifted."""
    p = np.uint64(LANES[lane][0])
    return (left * powers(lane)[right_units] + right) % p


def chunk_hashes(texts: Texts, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes by lane, units) of chunks of the bytes, so many at a time that the arrays stay small whatever the texts' length."""
    units = -(-size // 3)
    out = np.zeros((len(LANES), len(start)), np.uint64)
    first = np.concatenate([[0], np.cumsum(units)])
    s = 0
    while s < len(start):
        e = max(s + 1, int(np.searchsorted(first, first[s] + AT_ONCE, side="right")) - 1)
        at = first[s : e + 1] - first[s]
        padded = np.zeros(3 * int(at[-1]), np.uint8)
        for k in range(s, e):
            padded[3 * at[k - s] : 3 * at[k - s] + size[k]] = texts.bytes[start[k] : start[k] + size[k]]
        c = padded.reshape(-1, 3).astype(np.uint64)
        c = (c[:, 0] << np.uint64(16)) | (c[:, 1] << np.uint64(8)) | c[:, 2]
        power = np.repeat(at[1:] - 1, units[s:e]) - np.arange(len(c))
        for lane, (p, _) in enumerate(LANES):
            out[lane, s:e] = np.add.reduceat(c * powers(lane)[power] % np.uint64(p), at[:-1]) % np.uint64(p)
        s = e
    return out, units


def fingerprints(texts: Texts) -> np.ndarray:
    """(n, 2) int64: two lanes of 31 bits in each."""
    step = 3 * CHUNK_UNITS
    size = np.diff(texts.at)
    chunks = -(-size // step)
    first = np.concatenate([[0], np.cumsum(chunks)])
    owner = np.repeat(np.arange(texts.n), chunks)
    within = (np.arange(int(first[-1])) - first[:-1][owner]) * step
    hashed, units = chunk_hashes(texts, texts.at[:-1][owner] + within, np.minimum(step, size[owner] - within))
    out = np.zeros((texts.n, len(LANES)), np.uint64)
    for lane in range(len(LANES)):
        h = np.zeros(texts.n, np.uint64)
        for k in range(int(chunks.max(initial=0))):
            i = np.flatnonzero(chunks > k)
            j = first[:-1][i] + k
            h[i] = combine(lane, h[i], hashed[lane, j], units[j])
        out[:, lane] = h
    return np.stack([(out[:, 0] << np.uint64(31)) | out[:, 1], (out[:, 2] << np.uint64(31)) | out[:, 3]], 1).astype(np.int64)


def normalised(column: pa.Array) -> Texts:
    texts = Texts(column)
    texts.bytes = LOWER[texts.bytes]
    return texts


PRINT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("fp_a", pa.int64()), ("fp_b", pa.int64()), ("text_sha256", pa.string())])
KEY = ["n_bytes", "fp_a", "fp_b"]
CHUNK_DDL = "id long, text_sha256 string, n_bytes long, fp_a long, fp_b long, stays boolean, salt long, chunk_no long, chunk binary"
CHUNKS = pa.schema([("id", pa.int64()), ("text_sha256", pa.string()), *[(k, pa.int64()) for k in KEY], ("stays", pa.bool_()), ("salt", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary())])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = normalised(b.column("text"))
        fp = fingerprints(t)
        yield batch(PRINT, id=b.column("id"), n_bytes=np.diff(t.at), fp_a=fp[:, 0], fp_b=fp[:, 1], text_sha256=[hashlib.sha256(t.text(i)).hexdigest() for i in range(t.n)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of the rows that are meant: an id may have other texts too, which the SHA-256 of the row tells apart."""
    step = 3 * CHUNK_UNITS
    for b in batches:
        t = normalised(b.column("text"))
        rows: list[tuple] = []
        for i, r in enumerate(zip(*(b.column(c).to_pylist() for c in CHUNKS.names[:7]))):
            if hashlib.sha256(t.text(i)).hexdigest() != r[1]:
                continue
            for k, s in enumerate(range(int(t.at[i]), int(t.at[i + 1]), step)):
                rows.append((*r, k, t.bytes[s : min(s + step, int(t.at[i + 1]))].tobytes()))
                if len(rows) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), CHUNKS)], schema=CHUNKS)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), CHUNKS)], schema=CHUNKS)


def differing(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(id, text_sha256) of members whose text is not that of their group's row that stays. One row holds one chunk, a key one share of a
    group. members: id, text_sha256, the fingerprint, stays, shares; a row each for id and text."""
    other = members.filter("not stays").withColumn("salt", F.expr("pmod(xxhash64(id), shares)"))
    stays = members.filter("stays").withColumn("salt", F.explode(F.expr("sequence(0L, shares - 1)")))
    keyed = texts.join(other.unionByName(stays).drop("shares"), "id").select("id", "text_sha256", *KEY, "stays", "salt", "text")
    chunk = keyed.mapInArrow(_chunks, CHUNK_DDL)
    mine = chunk.filter("not stays")
    its = chunk.filter("stays").groupBy(*KEY, "salt", "chunk_no").agg(F.first("chunk").alias("its"))
    return mine.join(its, [*KEY, "salt", "chunk_no"]).filter("chunk <> its").select("id", "text_sha256").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, keep_id (the largest id among equal texts), group_size, kept, text_sha256."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    prints = stored(texts.mapInArrow(_prints, "id long, n_bytes long, fp_a long, fp_b long, text_sha256 string"), "prints")
    many = prints.groupBy(*KEY).agg(F.count("*").alias("group_size"), F.max(F.struct("id", "text_sha256")).alias("first")).filter("group_size > 1")
    many = stored(many.select(*KEY, "group_size", F.col("first.id").alias("keep_id"), F.col("first.text_sha256").alias("keep_sha256")), "groups")
    shares = f"greatest(1L, ceil(group_size / {SHARE_ROWS}), ceil(group_size * n_bytes / {SHARE_BYTES}))"
    stays = (F.col("id") == F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha256"))
    # rows that repeat id and text go first: dealt by id, a large group is spread, dealt by fingerprint it would be one task's
    members = prints.dropDuplicates(["id", "text_sha256"]).join(many, KEY).select("id", "text_sha256", *KEY, stays.alias("stays"), F.expr(shares).alias("shares"))
    differ = stored(differing(texts, members), "differing")
    grouped = prints.join(many, KEY, "left").drop("keep_sha256")
    if not differ.isEmpty():  # fingerprints that agree by chance: their texts are told apart by SHA-256
        classes = grouped.filter("keep_id is not null").join(differ.withColumn("apart", F.lit(True)), ["id", "text_sha256"], "left")
        classes = classes.select("id", "text_sha256", *KEY, F.when(F.col("apart"), F.col("text_sha256")).otherwise("").alias("class"))
        again = classes.groupBy(*KEY, "class").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"))
        names = ["id", "text_sha256", "keep_id", "group_size"]
        grouped = classes.join(again, [*KEY, "class"]).select(*names).unionByName(grouped.filter("keep_id is null").select(*names))
    keep = F.coalesce(F.col("keep_id"), F.col("id"))
    size = F.when(F.col("keep_id").isNull(), 1).otherwise(F.col("group_size")).cast("long")
    return grouped.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), (keep == F.col("id")).alias("kept"), "text_sha256")
