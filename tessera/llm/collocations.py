"""Collocations by Apriori: level-wise passes over whole texts count phrases of one word more each time, and cuts are scored from the level tables.

A pass emits a phrase only where both phrases of one word less that overlap in it are frequent. It asks that of a bitmap of the frequent
ones, which is broadcast: its size follows their number up to a fixed most, beyond which it only lets more phrases through. Counting is by
the phrases themselves and the least count is applied after it, so neither the bitmap nor a hash decides a result. Counts are summed for each
few megabytes of text, then for each task, then shuffled.

Every part of a frequent phrase is frequent, so all that a cut needs is in the level tables: candidates are joined to them by their first and
last words. A candidate's cover by a longer one is a maximum over the parts of the longer ones. The first of a language are taken within
shares of its phrases, then among those.

Defined results: a null text is empty, a null language is ``und``; rows need no id, and repeated rows count each time; a phrase's words are
joined by one space; other columns are ignored. No row: no result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, batch, joined, mixed, runs, stored, window_hashes

#: A to Z lower-cased, tab as space, and each byte that separates pieces as a line feed.
FOLD = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text that are counted at once; they end between pieces.
PART_BYTES = 1 << 20
#: The bitmap has at least so many bits a phrase, and at most 2^MOST_BITS in all (32 MB).
BITS_EACH, MOST_BITS = 64, 28
#: Shares of a language whose first phrases are found apart.
SHARES = 64

COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
HASHED = pa.schema([("h", pa.int64())])


def slices(texts: Iterable[tuple[str, bytes | None]]) -> Iterator[tuple[str, bytes]]:
    """Folded texts, long ones cut between pieces."""
    for lang, text in texts:
        text = (text or b"").translate(FOLD)
        at = 0
        while len(text) - at > PART_BYTES:
            cut = text.rfind(b"\n", at, at + PART_BYTES)
            cut = text.find(b"\n", at + PART_BYTES) if cut < 0 else cut
            if cut < 0:
                break
            yield lang, text[at:cut]
            at = cut + 1
        yield lang, text[at:] if at else text


def parts(texts: Iterable[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
    held, size = [], 0
    for lang, text in texts:
        if held and size + len(text) > PART_BYTES:
            yield held
            held, size = [], 0
        held.append((lang, text))
        size += len(text) + 1
    if held:
        yield held


def word_hashes(words: pa.Array) -> np.ndarray:
    """Polynomial hashes of words modulo 2^64, scrambled. They only choose bits of the bitmap."""
    words = Texts(words)
    length = np.diff(words.at)
    power = np.full(int(length.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    at = np.arange(len(words.bytes)) - np.repeat(words.at[:-1], length)
    value = (words.bytes.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[at]
    out = np.zeros(words.n, np.uint64)
    full = length > 0
    if full.any():
        out[full] = np.add.reduceat(value, words.at[:-1][full])
    return mixed(out)


def coded(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 for equal values, and how many there are."""
    found = pa.array(values).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary)


class Part:
    """The words of some folded texts: where they stand, their numbers and hashes, which follow each other in a piece."""

    def __init__(self, texts: list[tuple[str, bytes]]):
        names = sorted({lang for lang, _ in texts})
        number = {lang: i for i, lang in enumerate(names)}
        flat = np.frombuffer(b"\n".join([t for _, t in texts]) + b"\n", np.uint8)
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in texts])])
        space = flat == 32
        again = np.flatnonzero(space[1:] & space[:-1]) + 1
        if len(again):  # one space at most between words
            first = first - np.searchsorted(again, first)
            flat = np.delete(flat, again)
        inside = (flat != 32) & (flat != 10)
        self.start, self.end = runs(inside, np.array([0, len(flat)]))
        self.flat, self.names = flat, names
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside])]).dictionary_encode()
        self.code, self.different = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
        self.hash = word_hashes(words.dictionary)[self.code]
        self.lang = np.array([number[x] for x, _ in texts])[np.searchsorted(first, self.start, "right") - 1]
        self.lang_hash = word_hashes(pa.array(names))[self.lang]
        self.follows = (self.start[1:] == self.end[:-1] + 1) & (flat[self.end[:-1]] == 32)  # whether the next word is of the same piece

    def windows(self, k: int) -> np.ndarray:
        """First words of the phrases of k words."""
        count = max(0, len(self.start) - k + 1)
        whole = np.ones(count, bool)
        for i in range(k - 1):
            whole &= self.follows[i : i + count]
        return np.flatnonzero(whole)

    def hashes(self, k: int) -> np.ndarray:
        h = window_hashes(self.hash, k)
        return joined(self.lang_hash[: len(h)], h)

    def counted(self, first: np.ndarray, k: int) -> pa.RecordBatch:
        """The different phrases of k words at these places, with their numbers."""
        name = self.lang[first] * self.different + self.code[first]
        for i in range(1, k):
            name = coded(name)[0] * self.different + self.code[first + i]
        name, n = coded(name)
        at = np.zeros(n, np.int64)
        at[name] = first
        start, length = self.start[at], self.end[at + k - 1] - self.start[at]
        offsets = np.concatenate([[0], np.cumsum(length)])
        text = self.flat[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)]
        phrases = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)])
        lang = pa.array(self.names, pa.string()).take(pa.array(self.lang[at]))
        return batch(COUNTED, lang=lang, phrase=phrases, f=np.bincount(name, minlength=n))


def frequent(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit that the upper bits of each hash name is set."""
    at = h >> np.uint64(64 - (len(bitmap).bit_length() - 1 + 6))
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap_of(level: DataFrame, k: int) -> np.ndarray:
    """The bitmap of a level's phrases; words of 64 bits are put together by Spark, of which a bounded number reach the driver."""

    def hashed(batches):
        for b in batches:
            words = pa.array([w for x in b.column("phrase").to_pylist() for w in x.split(" ")], pa.string())
            h = window_hashes(word_hashes(words), k)[::k]
            yield batch(HASHED, h=joined(word_hashes(b.column("lang")), h).view(np.int64))

    bits = min(MOST_BITS, max(16, (BITS_EACH * level.count() - 1).bit_length()))
    at = level.select("lang", "phrase").mapInArrow(hashed, "h long").select(F.shiftrightunsigned("h", 64 - bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("w")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("i").to_numpy()] = words.column("w").to_numpy().view(np.uint64)
    return out


def phrase_counts(texts: DataFrame, k: int, below: Broadcast | None) -> DataFrame:
    """(lang, phrase, f) of the phrases of k words that the level below lets through. At level 1 also the number of all words, as the phrase ''."""

    def count(batches):
        rows = (row for b in batches for row in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()))
        for some in parts(slices(rows)):
            part = Part(some)
            first = part.windows(k)
            if below is not None and len(first):
                known = frequent(below.value, part.hashes(k - 1))
                first = first[known[first] & known[first + 1]]
            if len(first):
                yield part.counted(first, k)
            if k == 1:
                all_words = np.bincount(part.lang, minlength=len(part.names))
                yield batch(COUNTED, lang=part.names, phrase=[""] * len(part.names), f=all_words.astype(np.int64))

    return texts.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def levels(docs: DataFrame, longest: int, least: int, lang_col: str, text_col: str) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of each length, and the number of words of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    first = stored(phrase_counts(texts, 1, None).filter(f"f >= {least} or phrase = ''"), "phrases-1")
    found, total = [first.filter("phrase <> ''")], first.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    for k in range(2, longest + 1):
        below = docs.sparkSession.sparkContext.broadcast(bitmap_of(found[-1], k - 1))
        found.append(stored(phrase_counts(texts, k, below).filter(f"f >= {least}"), f"phrases-{k}"))
        below.unpersist()
    return found, total


def words_between(first, count):
    return F.array_join(F.slice("words", first, count), " ")


def uncovered(candidates: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Candidates that no longer one holds which occurs share[0] / share[1] as often."""
    lengths = F.explode(F.expr("sequence(2, size(words) - 1)"))
    inner = candidates.filter("size(words) > 2").select("lang", "words", "a", lengths.alias("k"))
    inner = inner.select("lang", "words", "a", "k", F.explode(F.expr("sequence(1, size(words) - k + 1)")).alias("i"))
    cover = inner.select("lang", words_between("i", F.col("k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = f"longer is null or {share[1]} * cast(longer as decimal(20)) < {share[0]} * cast(a as decimal(20))"
    return candidates.join(cover, ["lang", "phrase"], "left").filter(kept).drop("longer")


def scored(candidates: DataFrame, grams: DataFrame, scale: int) -> DataFrame:
    """Each candidate with its lowest-scoring cut: floor(scale * a / (l + r)), l and r the counts of the words before and after the cut."""
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", words_between(1, F.col("k")).alias("head"), words_between(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(grams.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(grams.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr(f"({scale} * cast(a as decimal(20))) div (cast(l as decimal(20)) + r)").cast("long")
    least = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def first_of_each(df: DataFrame, most: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    some = df.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).filter(f"_rank <= {most}").drop("_rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(f"rank <= {most}")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, cover: tuple[int, int] = (80, 100), scale: int = 2_000_000, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a (its count), l, r (those of the two sides of its cut), n (all words), score."""
    found, total = levels(docs, longest, least, lang_col, text_col)
    grams = found[0]
    for level in found[1:]:
        grams = grams.unionByName(level)
    longer = found[1]
    for level in found[2:]:
        longer = longer.unionByName(level)
    candidates = longer.select("lang", "phrase", F.split("phrase", " ").alias("words"), F.col("f").alias("a"))
    ranked = first_of_each(scored(uncovered(candidates, cover), grams, scale), most)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
