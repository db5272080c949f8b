import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, token_files
from tessera.llm.common import prepare

BYTE, WORD, MULTI = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))


def encoded(path, texts):
    t = Tokenizer.from_file(path)
    
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in texts.items()}


def test_packing(spark, docs, texts):
    prepare(spark)
    ids = encoded(BYTE, texts)
    rows = packing.pack(docs, BYTE).collect()
    covered, filled = {i: [] for i in texts}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(covered[i]) == [*range(len(ids[i]))] for i in texts)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(filled) == [*range(len(filled))]


def test_plan_places_every_piece_once_with_little_padding():
    rng = np.random.default_rng(4)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    plan = packing.Plan(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)))), 2048, 8, 3)
    ranks = sorted(r for first, *_, n in plan.rows for r in range(first, first + n))
    assert ranks == [*range(20_000)]
    assert lengths.sum() / (2048 * plan.sequences) > 0.99


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((30, 12)), np.maximum(0, rng.normal(size=12))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


def test_token_files(spark, docs, texts):
    prepare(spark)
    ids, at = encoded(WORD, texts), 0
    got = {r["doc_id"]: r for r in token_files.read_token_files(token_files.write_token_files(docs, WORD)).collect()}
    for i in sorted(texts):
        r = got.pop(i)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids[i]), zlib.crc32(ids[i]))
        at += len(ids[i])
    assert not got


@pytest.mark.parametrize("n,most", [(0, 1), (1, 0), (1, 5), (1000, 3), (777, 50_000), (300, 2**40)])
def test_elias_fano(n, most):
    values = np.sort(np.random.default_rng(n).integers(0, most + 1, n))
    e = token_files.EliasFano.from_bytes(token_files.EliasFano.of(values, most).to_bytes())
    assert (e.all() == values).all() and [e[i] for i in range(n)] == values.tolist()
    with pytest.raises(IndexError):
        e[n]


def test_block_round_trip():
    ids = np.arange(70_000, dtype=np.uint32)
    docs, back, ends = token_files.read_block(token_files.write_block([3, 9, 12], [1, 69_998, 1], ids))
    assert docs.tolist() == [3, 9, 12] and (back == ids).all() and ends.all().tolist() == [1, 69_999, 70_000]


def test_rows_of_a_block_are_read_by_select(monkeypatch):
    lengths = np.random.default_rng(4).integers(1, 9, 700).tolist()
    ids = np.arange(sum(lengths), dtype=np.uint32)
    data = token_files.write_block([*range(700)], lengths, ids)
    monkeypatch.setattr(token_files.EliasFano, "all", None)  # no table of all boundaries
    at = [0, *np.cumsum(lengths).tolist()]
    assert [*token_files.block_rows(data)] == [(i, at[i], n, zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4"))) for i, n in enumerate(lengths)]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def test_encode_documents(spark, docs, texts, reference):
    prepare(spark)
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, MULTI, public_tokenizers.PATTERN, keep_ids=True).collect()}
    for i, t in texts.items():
        ids = reference.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4")).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert got.keys() == texts.keys()


def test_transducer_against_reference(reference):
    ranks = bpe.read_ranks(MULTI)
    t, rng = bpe.Transducer(ranks), random.Random(5)
    tokens = [*ranks]
    for k in range(3000):
        x = b"".join(rng.choice(tokens) for _ in range(3)) if k % 2 else bytes(rng.choice(b"abet hno") for _ in range(rng.randrange(1, 25)))
        assert t.piece(x) == reference._core_bpe.encode_single_piece(x)
        assert len(t.states) <= bpe.STATES + 100


def test_decoder_streams_cut_characters():
    ranks = {bytes([b]): b for b in range(256)}
    d = bpe.Decoder(ranks, block=1)
    for s in ("h\u00e9llo \u65e5\u672c \U0001f600", "", "\u00e9"):
        assert "".join(d.stream(np.frombuffer(s.encode(), np.uint8).astype(np.int64))) == s


def test_empty_tables(spark, empty):
    prepare(spark)
    assert packing.pack(empty, BYTE).collect() == []
    assert token_files.read_token_files(token_files.write_token_files(empty, WORD)).collect() == []
    assert bpe.encode_documents(empty, MULTI, public_tokenizers.PATTERN).collect() == []
