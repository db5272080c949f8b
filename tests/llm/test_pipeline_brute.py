"""Each stage of the pipeline against a plain version of it, on documents that repeat ids, texts and passages."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as c
from tessera.llm.common import prepare
from tessera.llm.quality_classifier import fit, margins, sigmoid
from test_rows import WORD, lower

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, id string, part long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    some = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    passages, out = [some(18) for _ in range(6)], []
    for i in range(120):
        t = some(rng.randrange(3, 80))
        kind = rng.randrange(6)
        if out and kind == 0:
            t = rng.choice(out)[1] or ""
        elif out and kind == 1:
            w = (rng.choice(out)[1] or "").split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = t + "\n" + rng.choice(passages) + "  " + some(4)
        out.append((rng.randrange(70), t.upper() if kind == 0 and rng.random() < 0.3 else t))
    return out + [(3, None), (4, ""), (5, None), (None, passages[0]), (None, None), (71, "#### $$$$ !!!! BUY!!!! %%%% FREE!!!! $$$$ ####")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash", 1) for i, t in rows], SCHEMA).repartition(4)


def result(stage, spark, rows, folder=None):
    out = stage(spark, frame(spark, rows), folder)
    assert out.schema.simpleString() == frame(spark, []).schema.simpleString()
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def ordered(rows):
    """Rows with an id in the order of id and text, as the stages number them; the others."""
    return sorted([r for r in rows if r[0] is not None], key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode())), [r for r in rows if r[0] is None]


def test_quality(spark, rows):
    prepare(spark)
    folder = "/root/testdata/sf0.001"
    labels = spark.createDataFrame([(i, int(i < 70)) for i in range(72)], "doc_id long, quality int")
    import pyarrow as pa

    from tessera.llm.common import Texts

    weights = fit(frame(spark, rows), spark.read.parquet(f"{folder}/labels.parquet"), c.FOLDS, c.HELD).astype(np.float32)
    score = sigmoid(margins(Texts(pa.array([t for _, t in rows], pa.string())), weights))
    assert result(c.quality, spark, rows, folder) == sorted([r for r, s in zip(rows, score) if s >= 0.7], key=repr)
    assert labels.count() == 72


def test_exact_copies(spark, rows):
    own, rest = ordered(rows)
    last = {lower(t): k for k, (_, t) in enumerate(own)}
    assert result(c.exact_copies, spark, rows) == sorted([own[k] for k in last.values()] + rest, key=repr)


def test_near_copies(spark, rows):
    own, rest = ordered(rows)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (WORD.findall(t or "") for _, t in own)]
    group = [*range(len(own))]
    for _ in own:
        new = [min([group[i]] + [group[j] for j in range(len(own)) if sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]) for i in range(len(own))]
        if new == group:
            break
        group = new
    assert any(g != k for k, g in enumerate(group))
    assert result(c.near_copies, spark, rows) == sorted([r for k, r in enumerate(own) if group[k] == k] + rest, key=repr)


def test_repeated_passages(spark, rows):
    own, rest = ordered(rows)
    seen, out = {}, []
    for k, (i, t) in enumerate(own):
        w = WORD.findall(t or "")
        gone = {j for s in range(len(w) - 12) if tuple(w[s : s + 13]) in seen for j in range(s, s + 13)}
        for s in range(len(w) - 12):
            seen.setdefault(tuple(w[s : s + 13]), k)
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        if not gone or left:
            out.append((i, left if gone else t))
    assert len(out) < len(own) and out != own
    # a window of the row itself is in seen only after the row
    assert result(c.repeated_passages, spark, rows) == sorted(out + rest, key=repr)


def test_packing(spark, rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, x in rows:
        if i is not None:
            ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
            want.update((i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048])) for s in range(0, len(ids), 2048))
    got = c.packing(spark, frame(spark, rows), None).collect()
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
