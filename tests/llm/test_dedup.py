import collections
import hashlib
import re

import numpy as np
import pyarrow as pa

from tessera.llm import exact_dedup, ngram_join, substring_dedup
from tessera.llm.common import Texts, prepare
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(spark, docs, texts):
    prepare(spark)
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[lower(t)].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        own, r = groups[lower(t)], got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(own), len(own), i == max(own), hashlib.sha256(lower(t).encode()).hexdigest())


def test_exact_dedup_tells_equal_fingerprints_apart(spark, docs, texts, monkeypatch):
    """Fingerprints that are all equal for texts of a length leave the comparison of chunks to decide."""
    rows = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "AAAA"), (4, "bbbb"), (5, "cccc")], "doc_id long, text string")
    same = exact_dedup.fingerprints

    def poor(batches):
        for b in batches:
            t = exact_dedup.normalised(b.column("text"))
            yield exact_dedup.batch(exact_dedup.PRINT, id=b.column("id"), n_bytes=np.diff(t.at), fp_a=np.zeros(t.n, np.int64), fp_b=np.zeros(t.n, np.int64), text_sha256=[hashlib.sha256(t.text(i)).hexdigest() for i in range(t.n)])

    monkeypatch.setattr(exact_dedup, "_prints", poor)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True)}
    assert same is exact_dedup.fingerprints


def test_fingerprints_compose():
    """A text's hash is that of its chunks, combined; chunk borders do not matter."""
    data = bytes(np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8))
    whole = exact_dedup.fingerprints(Texts(pa.array([data])))
    at = 3 * exact_dedup.CHUNK_UNITS
    parts = [data[s : s + at] for s in range(0, len(data), at)]
    for lane, (p, base) in enumerate(exact_dedup.LANES):
        units = [int.from_bytes(data[s : s + 3].ljust(3, b"\0"), "big") for s in range(0, len(data), 3)]
        plain = 0
        for u in units:
            plain = (plain * base + u) % p
        assert plain == int(whole[0, lane // 2] >> (31 * (1 - lane % 2))) & ((1 << 31) - 1)
    assert len(parts) == 5


def brute_passages(texts, n=13):
    seen, out = {}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        gone, mine = [False] * len(w), []
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone[k : k + n] = [True] * n
            mine.append(key)
        for key in mine:
            seen.setdefault(key, i)
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_substring_dedup(spark, docs, texts):
    prepare(spark)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_removed", "kept_sha256", "kept_text")) for r in substring_dedup.substring_dedup(docs, with_text=True).collect()}
    assert got == brute_passages(texts)
    assert sum(x[1] for x in got.values()) > 100


def test_sketch_never_undercounts():
    rng = np.random.default_rng(2)
    shares = [np.sort(rng.integers(0, 5000, 400).astype(np.uint32)) for _ in range(6)]
    assert all((substring_dedup.unpack(substring_dedup.pack(s)) == s).all() for s in shares)
    table = pa.table({"block": [0] * 6, "part": [*range(6)], "cells": [substring_dedup.pack(s) for s in shares]})
    out = substring_dedup.merge((pa.scalar(0),), table)
    count = collections.Counter(x for s in shares for x in s.tolist())
    for part, cells in zip(out["part"].to_pylist(), out["cells"].to_pylist()):
        assert set(substring_dedup.unpack(cells).tolist()) == {x for x in shares[part].tolist() if count[x] > 1}


def test_ngram_join(spark, docs, texts):
    prepare(spark)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, WORD.findall(t or "")) for i, t in texts.items())}
    links = {i: [j for j in sets if j != i and sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))] for i in sets}
    group = {i: i for i in sets}
    for _ in sets:
        group = {i: min([group[i], *(group[j] for j in links[i])]) for i in sets}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {i: (group[i], len(links[i])) for i in sets}
    assert any(n > 1 for _, n in got.values())


def test_large_components_in_blocks(spark, monkeypatch):
    """A component of several blocks counts the same links as one block would."""
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[i] = f"own{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 16)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(df).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    want = {i: sum(j != i and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) for j in sets) for i in sets}
    assert {i: n for i, (_, n) in got.items()} == want
    assert {c for c, _ in got.values()} == {0}


def test_long_copies_beside_an_empty_block(spark, monkeypatch):
    """Near copies that all fall into one of two blocks: the task of both blocks must not count them again."""
    ids = [r["id"] for r in spark.range(40).filter("pmod(xxhash64(id), 2) = 0").collect()][:3]
    for m in (2, 3):
        rows = [(i, " ".join(f"own{k}" if w == k else f"w{w}" for w in range(304))) for k, i in enumerate(ids[:m])]
        monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", 300 * m // 2)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: (min(ids[:m]), m - 1) for i in ids[:m]}


def test_banding_reaches_recall():
    b, r = ngram_join.banding(0.8, 0.999999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999999


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_empty_tables(spark, empty):
    prepare(spark)
    assert exact_dedup.exact_dedup(empty).collect() == []
    assert substring_dedup.substring_dedup(empty).collect() == []
    assert ngram_join.ngram_join(empty).collect() == []
