"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint takes for each bit the majority of the 64-bit hashes of its word shingles. Equal fingerprints are one class. Every class
enters a table for each mask of a covering family: bit positions carry non-zero vectors of radius + 1 bits, mask v keeps the positions whose
vector has an odd product with v. Two fingerprints that differ in at most radius positions put radius linear conditions on v, so some v other
than zero meets them all, and that mask keeps no position where they differ: the pair shares that table's bucket, always.

A bucket is never listed in pairs. Its count, least and greatest member are partial aggregates: a bucket of two is compared as it is. Members
of a larger bucket go on to the points that differ from them in at most one position outside the mask; two fingerprints at distance 2 or less
share such a point, and all that share one are within 2 of each other. A point has at most 65 fingerprints, whatever the bucket's size.

Defined results: a null or empty text, or one of white space alone, has fingerprint zero, which links like any other; a text of fewer words
than a shingle is one shingle; rows without an id are left out; rows that repeat an id are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, stored
from .components import components

BITS, RADIUS = 64, 2
#: Shingles whose bits are counted at once: 64 bytes each.
SHINGLES_AT_ONCE = 1 << 15

SIGNED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """One mask for each vector v of radius + 1 bits other than zero; every set of radius positions is missed by one of them."""
    vectors = range(1, 1 << (radius + 1))
    of_position = [vectors[i % len(vectors)] for i in range(bits)]
    return [sum(1 << i for i, a in enumerate(of_position) if (a & v).bit_count() % 2) for v in vectors]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, n: int, seed: int) -> int:
    """Bits that are set in over half the hashes of the text's shingles of n words, as an unsigned number."""
    words = text.translate(LOWER).split()  # bytes.split() cuts at 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = min(n, len(words))
    start, end = start[: len(words) - n + 1].tolist(), end[n - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for s in range(0, len(start), SHINGLES_AT_ONCE):
        part = np.array([h(line[a:b], seed) for a, b in zip(start[s : s + SHINGLES_AT_ONCE], end[s : s + SHINGLES_AT_ONCE])], "<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(start), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long."""

    def sign(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            yield batch(SIGNED, doc_id=b.column("doc_id"), fp=[signed(fingerprint(x.as_py() or b"", n, seed)) for x in texts])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    return texts.mapInArrow(sign, "doc_id long, fp long")


def near(left: str, right: str):
    return F.bit_count(F.col(left).bitwiseXOR(F.col(right))) <= RADIUS


def links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) of fingerprints that connect exactly those within two positions of each other, directly or by way of others of their point."""
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks())]
    placed = classes.select("fp", F.explode(F.array(*tables)).alias("at")).select("at.t", "at.key", "fp")
    buckets = placed.groupBy("t", "key").agg(F.count("*").alias("members"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("members > 1")
    buckets = stored(buckets, "simhash-buckets")
    pairs = buckets.filter("members = 2").filter(near("a", "b")).select("a", "b")
    crowded = placed.join(buckets.filter("members > 2").select("t", "key"), ["t", "key"], "left_semi")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks()])
    points = crowded.select("fp", F.explode(F.element_at(flips, F.col("t") + F.lit(1))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = points.groupBy("point").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1")  # at most 65 by construction
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.unionByName(stars)


def simhash_groups(docs: DataFrame, n: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its fingerprint as 16 hex digits, component_id (the least id of the documents that links connect)."""
    prints = stored(fingerprints(docs, n, seed, id_col, text_col), "simhash")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    whole = components(links(classes)).select(F.col("node").alias("fp"), "component")
    named = classes.join(whole, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = stored(named.join(of, "component").select("fp", "component_id"), "simhash-components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, "fp").select(F.col("doc_id").alias(id_col), hexed.alias("fingerprint"), "component_id")
