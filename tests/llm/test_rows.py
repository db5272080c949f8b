"""Rows that repeat an id, with the same text or another, and texts of several chunks, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import bpe, exact_dedup, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, token_files, toxicity
from tessera.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORDS, MULTI = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))


def some_rows():
    rng = random.Random(8)
    some = lambda n: " ".join(f"word{rng.randrange(10**6)}" for _ in range(n))
    long, base, passage = some(12_000), some(60), some(20)
    changed = long.split()
    changed[7000] = "changed"
    near = base.split()
    near[30] = "changed"
    rows = [(5, "same text here"), (5, "other words now"), (9, "same text here"), (1, "Same text here"), (5, "same text here"), (5, "same text here")]
    rows += [(20, long), (21, long.upper()), (22, " ".join(changed)), (20, base), (23, " ".join(near)), (23, base), (24, passage + " " + some(30)), (25, some(12) + " " + passage), (25, passage), (24, passage)]
    rows += [(30, None), (30, ""), (31, None), (32, "a<|endoftext|>b"), (32, "x <|startoftext|> y <|ENDOFTEXT|>"), (33, "<|endoftext|>"), (33, "<|endoftext|>"), (34, "<|endoftext| > not one <|")]
    return rows + [(None, base), (None, base)]


@pytest.fixture(scope="module")
def rows(spark):
    prepare(spark)
    return some_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def named(rows):
    return [(i, t) for i, t in rows if i is not None]


def same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


def test_exact_dedup(docs, rows):
    groups = collections.defaultdict(list)
    for i, t in named(rows):
        groups[lower(t)].append(i)
    want = [(i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), sha(lower(t))) for i, t in named(rows)]
    same([tuple(r) for r in exact_dedup.exact_dedup(docs).collect()], want)


def test_exact_dedup_where_fingerprints_clash(docs, rows, monkeypatch):
    """With one fingerprint for all texts of a length the comparison decides, also between texts of one id."""
    plain = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda t: np.zeros_like(plain(t)))
    groups = collections.defaultdict(list)
    clash = [(4, "aaaa"), (4, "bbbb"), (3, "AAAA"), (2, "cccc"), (1, "bbbb"), (4, "aaaa"), (7, "dddddd"), (4, "eeeeee"), (4, "dddddd")]
    for i, t in clash:
        groups[lower(t)].append(i)
    df = docs.sparkSession.createDataFrame(clash, "doc_id long, text string").repartition(2)
    got = exact_dedup.exact_dedup(df)
    same([tuple(r) for r in got.collect()], [(i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), sha(lower(t))) for i, t in clash])


def test_long_texts_are_hashed_some_chunks_at_a_time(monkeypatch):
    import pyarrow as pa

    from tessera.llm.common import Texts

    data = [bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 49152, 49153, 400_000, 5)]
    whole = exact_dedup.fingerprints(Texts(pa.array(data)))
    monkeypatch.setattr(exact_dedup, "AT_ONCE", 1000)
    assert (exact_dedup.fingerprints(Texts(pa.array(data))) == whole).all()


def test_substring_dedup(docs, rows):
    first = {}
    windows = lambda w: [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
    for i, t in named(rows):
        for k in windows(WORD.findall(t or "")):
            first[k] = min(first.get(k, i), i)
    want = []
    for i, t in named(rows):
        w = WORD.findall(t or "")
        gone = {j for k, x in enumerate(windows(w)) if first[x] < i for j in range(k, k + 13)}
        want.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    same([tuple(r) for r in substring_dedup.substring_dedup(docs).collect()], want)


def test_ngram_join(docs, rows):
    own = named(rows)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (WORD.findall(t or "") for _, t in own)]
    link = [[j for j in range(len(own)) if j != i and sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))] for i in range(len(own))]
    group = [i for i, _ in own]
    for _ in own:
        group = [min([group[i], *(group[j] for j in link[i])]) for i in range(len(own))]
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs).collect()]
    same(got, [(i, group[k], len(link[k])) for k, (i, _) in enumerate(own)])


def test_quality_rules(spark, docs, rows):
    from test_judging import plain_statistics

    labels = spark.createDataFrame([(5, 0), (20, 1)], "doc_id long, quality int")
    got = [(r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in quality_rules.quality_rules(docs, labels).collect()]
    same(got, [(i, *plain_statistics(t)) for i, t in rows])


def library(path, t):
    return np.array([*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1], "<u4")


def test_packing(docs, rows):
    pieces = collections.defaultdict(list)
    out = packing.pack(docs, BYTE).collect()
    want = [(i, library(BYTE, t)) for i, t in named(rows)]
    for r in out:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    expected = collections.defaultdict(list)
    for i, ids in want:
        cut = [ids[s : s + 2048] for s in range(0, len(ids), 2048)]
        expected[i, len(ids)] += [(2048 * k, len(c), zlib.crc32(c)) for k, c in enumerate(cut)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    assert any(len(ids) > 3 * 2048 for _, ids in want)
    assert [*library(BYTE, "a<|endoftext|>b")][:3] == [64, 50256, 65]
    filled = collections.defaultdict(list)
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_token_files(docs, rows, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)  # the long texts are blocks of their own
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(token_files.write_token_files(docs, WORDS)).collect())
    at, want = 0, []
    for i, t in sorted(named(rows), key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode())):
        ids = library(WORDS, t)
        want.append((at, i, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert got == want


def test_byte_bpe(docs, rows):
    e = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    ids = [np.array(e.encode_ordinary(t or ""), "<u4") for _, t in named(rows)]
    same([tuple(r[:4]) for r in bpe.encode_documents(docs, MULTI, public_tokenizers.PATTERN).collect()], [(i, len(x), sha(x.tobytes()), sha(t or "")) for x, (i, t) in zip(ids, named(rows))])


def test_classifiers_score_each_row(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in {i for i, _ in named(rows)}], "doc_id long, quality int, toxic int")
    for f in (quality_classifier.quality_scores, toxicity.toxicity_scores):
        got = [(r["doc_id"], r["score"]) for r in f(docs, labels).collect()]
        assert collections.Counter(i for i, _ in got) == collections.Counter(i for i, _ in named(rows))
        assert len({s for i, s in got if i == 33}) == 1 and len({s for i, s in got if i == 20}) == 2
