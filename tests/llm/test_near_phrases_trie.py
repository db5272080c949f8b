"""op11 to op13 against brute force: masks, fingerprints and components; phrases and cuts; tries with nulls, ties and long conversations."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
import xxhash

from tessera.llm import collocations, prefix_trie, simhash
from tessera.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- op11


def plain_fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def reach(ids, linked):
    """The least of what each reaches."""
    least = dict.fromkeys(ids)
    for start in sorted(ids):
        todo = [start]
        while todo:
            x = todo.pop()
            if least[x] is None:
                least[x] = start
                todo += [y for y in ids if least[y] is None and linked(x, y)]
    return least


def test_every_two_positions_are_missed_by_a_mask():
    masks = simhash.masks()
    assert len(masks) == 7 and min(m.bit_count() for m in masks) >= 36
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i, j in itertools.combinations(range(64), 2))


def test_fingerprints_and_groups(spark, docs, texts, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 100)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_groups(docs).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    least = reach(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert got == {i: (p, least[i]) for i, p in prints.items()}


def test_links_of_chains_crowds_and_twos(spark, monkeypatch):
    """Balls, chains, far points: components of the links are those of all pairs."""
    rng = random.Random(5)
    seen = {0, 1, 3, 7, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 40])):
            seen.add(at)
            at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64)) if rng.random() < 0.9 else 7 << rng.randrange(60)
    seen |= {at ^ 1 << i for i in range(64)} | {at ^ 3 << i for i in range(63)}
    classes = spark.createDataFrame([(simhash.signed(x), i) for i, x in enumerate(sorted(seen))], "fp long, least long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(classes).collect()]
    assert all((a ^ b).bit_count() <= 2 and a != b for a, b in edges)
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    ids = sorted(seen)
    assert reach(ids, lambda a, b: b in near[a]) == reach(ids, lambda a, b: (a ^ b).bit_count() <= 2)


def test_simhash_of_rows_that_repeat_an_id_and_of_none(spark, empty):
    df = spark.createDataFrame([(4, "a b c d"), (4, "x y z u"), (9, "A B C D"), (2, None), (7, " "), (None, "a b c d")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.simhash_groups(df).collect())
    assert got == collections.Counter([(4, 4), (4, 4), (9, 4), (2, 2), (7, 2)])
    assert simhash.simhash_groups(empty).collect() == []


# --- op12


def plain_collocations(rows, longest, least, most):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = {(lang, p[i : i + k]) for (lang, p), a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * cand[lang, p[i : i + k]]}
    found = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        if (lang, p) not in covered:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in found.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:most])]


def phrase_rows():
    rng = random.Random(2)
    words = ["of", "the", "New", "york", "CITY", "été", " x", "a'b", "-", "\U0001f600"]
    line = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " \t ", ". ", ",", "\n", "; ", " !", "\r\n", "\x0b"]) for _ in range(rng.randrange(60)))
    rows = [(rng.choice(["en", "fr", None, "und", ""]), rng.choice(["", " ", "  of the "]) + line()) for _ in range(120)]
    return rows + [("en", None), ("de", ""), (None, None), ("es", "one two three. one two three? one two"), ("en", "of the new york " * 400), ("en", "of " * 3000)] + [("en", "New York City")] * 20


@pytest.mark.parametrize(("bits", "part"), [(28, 1 << 22), (8, 300)])
def test_collocations(spark, monkeypatch, bits, part):
    """Also with a bitmap too small to tell phrases apart, and with texts cut between pieces: the same rows."""
    prepare(spark)
    monkeypatch.setattr(collocations, "MOST_BITS", bits)
    monkeypatch.setattr(collocations, "PART_BYTES", part)
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, f long, n long").repartition(3)
    got = [tuple(r) for r in collocations.collocations(df, least=5, most=40).collect()]
    assert sorted(got) == sorted(plain_collocations(rows, 4, 5, 40)) and len({x[0] for x in got}) > 3


def test_scores_are_exact_beyond_64_bits(spark):
    big = 7_000_000_000_000_000_003
    grams = spark.createDataFrame([("en", "a", big), ("en", "b", big)], "lang string, phrase string, f long")
    cand = spark.createDataFrame([("en", "a b", ["a", "b"], big)], "lang string, phrase string, words array<string>, a long")
    assert collocations.scored(cand, grams, 2_000_000).first()["score"] == 1_000_000
    assert collocations.uncovered(cand, (80, 100)).count() == 1


def test_no_phrases(spark, empty):
    prepare(spark)
    assert collocations.collocations(empty).collect() == []


# --- op13


def plain_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    convs = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversation_rows():
    rng = random.Random(9)
    said = [("user", "hi"), ("assistant", "héllo \U0001f600"), (None, "hi"), ("", None), ("user", ""), (None, None), ("us", "erhi")]
    rows = []
    for c in [*range(0, 30), 100, 101, 105, 117, 250, 299, 300, 301, -5, -100, -101, 2**62, None]:
        rows += [(c, rng.choice([t, t, None]) if t < 3 else t, *rng.choice(said)) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user", f"t{t % 7}") for c in (400, 401, 402) for t in range(70 + c % 3)] + [(403, 0, "user", "t0")] * 12  # long, and repeated rows
    rows += [(c, 0, "user", "same") for c in range(1000, 1400)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("ids", [4096, 7])
def test_trie(spark, monkeypatch, ids):
    """Also with lines so short that the ids under a node fill many."""
    prepare(spark)
    monkeypatch.setattr(prefix_trie, "LINE_IDS", ids)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", name long, d long, rep long").repartition(4)
    assert sorted(map(repr, map(tuple, prefix_trie.prefix_trie(df).collect()))) == sorted(map(repr, plain_trie(rows)))


def test_trie_of_turnless_conversations_and_of_none(spark):
    prepare(spark)
    alone = [(c, 0, "user", "x") for c in (105, 110, 111) if zlib.crc32(str(c).encode()) % 6 > 0]
    assert alone and sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(alone, SCHEMA)).collect())) == sorted(plain_trie(alone))
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
