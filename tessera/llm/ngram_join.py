"""Jaccard self-join of documents on word n-grams by MinHash banding.

Documents with the same set of n-grams form a class, which its smallest id represents. Representatives are shuffled on the hashes of their
bands; each bucket links its members to its smallest, and the components of these links hold every candidate pair. Within a component all
pairs are verified on the full sets, so banding decides only which documents meet at all. A large component is split into blocks by hash, and
a task verifies a pair of blocks; it returns a row for each document, with its links counted and the least document that it reaches, never
the pairs. Bands and rows are the cheapest that meet the target recall at the threshold.

An n-gram is compared by a 64-bit hash of its words, a set of n-grams by 128 bits.

Defined results: a null text has no words; a document with fewer words than an n-gram has no n-gram, links to nothing and is a class of its
own; rows without an id are left out; rows that repeat an id are documents of their own, linked like any others; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, batch, joined, mixed, stored, window_hashes, window_starts
from .components import components

#: n-grams and documents of a block that a task verifies against another.
BLOCK_NGRAMS, BLOCK_DOCS = 1 << 20, 1024
#: Columns of n-grams in at most so many documents of a block are counted pair by pair, others by a matrix product.
FEW = 16


def banding(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """Bands and rows: of those that keep 1 - (1 - t^r)^b at the recall, the most selective within the given number of hashes."""
    found = [(b, r) for r in range(1, 33) for b in [int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**r))))] if b * r <= most]
    return max(found, key=lambda x: x[1])


class Hashes:
    """The n-gram sets of a batch, their MinHash bands."""

    def __init__(self, n: int, bands: int, rows: int):
        self.n, self.bands, self.rows = n, bands, rows
        rng = np.random.default_rng(20240229)
        self.factor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.seed = mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def sets(self, texts: Texts) -> list[np.ndarray]:
        word, _ = texts.words.hashes()
        start, owner = window_starts(texts.words.ptr, self.n)
        h = window_hashes(word, self.n)[start] if len(start) else np.zeros(0, np.uint64)
        at = np.searchsorted(owner, np.arange(texts.n + 1))
        return [np.unique(h[s:e]) for s, e in zip(at[:-1], at[1:])]

    def of(self, ngrams: np.ndarray) -> bytes:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for s in range(0, len(ngrams), 2048):
            np.minimum(least, (ngrams[s : s + 2048, None] * self.factor).min(0), out=least)
        band = self.seed
        for column in least.reshape(self.bands, self.rows).T:
            band = joined(band, column)
        return band.tobytes()


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.binary())])
BAND = pa.schema([("band", pa.int64()), ("rep", pa.int64())])
SETS = pa.schema([("rep", pa.int64()), ("size", pa.int64()), ("component", pa.int64()), ("blocks", pa.int64()), ("ngrams", pa.binary())])
SETS_DDL = "rep long, size long, component long, blocks long, ngrams binary"
LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("label", pa.int64()), ("component", pa.int64())])


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in sets), "<i8").reshape(-1, 2)


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two of the sets share."""
    m = len(sets)
    row = np.repeat(np.arange(m), [*map(len, sets)])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    degree = np.bincount(column)
    out = np.zeros(m * m, np.int64)
    few = degree[column] <= FEW
    c, r = column[few], row[few]
    for d in range(1, FEW):  # rows ascend within a column
        same = np.flatnonzero(c[d:] == c[:-d]) if len(c) > d else []
        if not len(same):
            break
        out += np.bincount(r[same] * m + r[same + d], minlength=m * m)
    out = out.reshape(m, m)
    out += out.T
    c, r = column[~few], row[~few]
    if len(c):
        edge = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        for s in range(0, len(edge), 4096):
            part = edge[s : s + 4096]
            end = edge[s + 4096] if s + 4096 < len(edge) else len(c)
            dense = np.zeros((m, len(part)), np.float32)
            dense[r[part[0] : end], np.repeat(np.arange(len(part)), np.diff(np.append(part, end)))] = 1
            out += np.rint(dense @ dense.T).astype(np.int64)
    return out


def linked(sets: list[np.ndarray], numerator: int, denominator: int) -> np.ndarray:
    """Which two sets have a Jaccard similarity of numerator / denominator or more: |A and B| * (num + den) >= num * (|A| + |B|)."""
    n = np.array([*map(len, sets)])
    out = shared(sets) * (numerator + denominator) >= numerator * (n[:, None] + n)
    np.fill_diagonal(out, False)
    return out


def least_reached(ids: np.ndarray, link: np.ndarray) -> np.ndarray:
    a, b = np.nonzero(link)
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            return label
        label = new


def verify(numerator: int, denominator: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key[1:])
        comp, rep, size, side = (table.column(c).to_numpy() for c in ("component", "rep", "size", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("ngrams").to_pylist()]
        order = np.lexsort((rep, comp))
        rows = []
        for own in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            own = own[np.unique(rep[own], return_index=True)[1]]  # rows that repeat an id
            link = linked([sets[k] for k in own], numerator, denominator)
            if i < j:  # of two blocks, even if one is empty: pairs within a block are another task's
                link &= side[own][:, None] != side[own]
            rows.append(np.stack([rep[own], link @ size[own], least_reached(rep[own], link), comp[own]]))
        return pa.table([*np.concatenate(rows, 1)], schema=LINKS)

    return run


def ngram_join(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), recall: float = 0.999999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: class_id (the least id of the documents that links connect), copy_of (the least id with the same n-grams),
    n_links (other documents with a similarity of threshold or more)."""
    bands, rows = banding(threshold[0] / threshold[1], recall)
    hashes = Hashes(n, bands, rows)

    def sign(batches):
        for b in batches:
            sets = hashes.sets(Texts(b.column("text")))
            fp = fingerprints(sets)
            yield batch(SIGNED, doc_id=b.column("doc_id"), n=[*map(len, sets)], fp1=fp[:, 0], fp2=fp[:, 1], bands=[hashes.of(x) if len(x) else b"" for x in sets])

    def spread_bands(batches):
        for b in batches:
            keep = [(r, x) for r, x in zip(b.column("rep").to_pylist(), b.column("bands").to_pylist())]
            if keep:
                yield batch(BAND, band=np.frombuffer(b"".join(x for _, x in keep), "<i8"), rep=np.repeat([r for r, _ in keep], bands))

    def full_sets(batches):
        for b in batches:
            sets = hashes.sets(Texts(b.column("text")))
            meant = (fingerprints(sets) == np.stack([b.column("fp1").to_numpy(), b.column("fp2").to_numpy()], 1)).all(1)  # an id may have other texts
            b, sets = b.filter(pa.array(meant)), [x for x, m in zip(sets, meant) if m]
            yield batch(SETS, ngrams=[x.tobytes() for x in sets], **{c: b.column(c) for c in SETS.names if c != "ngrams"})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    signed = stored(texts.mapInArrow(sign, "doc_id long, n long, fp1 long, fp2 long, bands binary"), "signed")
    key = ["n", "fp1", "fp2"]
    classes = signed.filter("n > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "bands")).alias("least"), F.count("*").alias("size"))
    named = classes.select(*key, F.monotonically_increasing_id().alias("rep"), F.col("least.doc_id").alias("doc"), "size", F.col("least.bands").alias("bands"))
    classes = stored(named, "classes")  # written once, so that a class keeps its number

    banded = classes.select("rep", "bands").mapInArrow(spread_bands, "band long, rep long")
    buckets = stored(banded.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("members")).filter("members > 1").select("band", "a"), "buckets")
    candidate = components(banded.join(buckets, "band").filter("rep <> a").select("a", F.col("rep").alias("b")))
    met = stored(candidate.select(F.col("node").alias("rep"), "component").join(classes.select("rep", *key, "doc", "size"), "rep"), "candidates")
    blocks = f"greatest(ceil(sum(n) / {BLOCK_NGRAMS}), ceil(count(*) / {BLOCK_DOCS}))"
    sized = stored(met.groupBy("component").agg(F.expr(blocks).alias("blocks"), F.sum("n").alias("ngrams")), "component-sizes")
    bundles = max(16, -(-(sized.agg(F.sum("ngrams")).first()[0] or 0) // BLOCK_NGRAMS))
    members = met.join(sized.select("component", "blocks"), "component").select(F.col("doc").alias("doc_id"), "rep", "size", "component", "blocks", "fp1", "fp2")
    sets = texts.join(members, "doc_id").select("rep", "size", "component", "blocks", "fp1", "fp2", "text").mapInArrow(full_sets, SETS_DDL)
    side = F.expr("pmod(xxhash64(rep), blocks)")
    pairs = sets.withColumn("side", side).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    own = F.col("blocks") > 1
    keyed = pairs.select(
        "rep", "size", "component", "side", "ngrams",
        F.when(own, F.col("component")).otherwise(F.lit(-1)).alias("group"),
        F.when(own, F.least("side", "other")).otherwise(F.expr(f"pmod(xxhash64(component), {bundles}L)")).alias("i"),
        F.when(own, F.greatest("side", "other")).otherwise(F.lit(0)).alias("j"),  # i < j only for two blocks of a component
    )
    found = stored(keyed.groupBy("group", "i", "j").applyInArrow(verify(*threshold), "rep long, links long, label long, component long"), "links")
    # components of several blocks: what each task connected is connected further
    split = found.join(sized.filter("blocks > 1").select("component"), "component", "left_semi")
    further = components(split.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"), F.min("label").alias("label"))
    grouped = counted.join(further.select(F.col("node").alias("rep"), F.col("component").alias("whole")), "rep", "left").select("rep", "links", F.coalesce("whole", "label").alias("group"))
    grouped = grouped.join(classes.select("rep", "doc"), "rep")
    linked_to = grouped.join(grouped.groupBy("group").agg(F.min("doc").alias("class_id")), "group").select("rep", "links", "class_id")
    result = classes.select(*key, "rep", "doc", "size").join(linked_to, "rep", "left")
    result = stored(result.select(*key, "doc", F.coalesce("class_id", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "classes-linked")
    out = signed.select("doc_id", *key).join(result, key, "left")
    return out.select(F.col("doc_id").alias(id_col), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("doc", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
