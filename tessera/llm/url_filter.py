"""URL filters by a cascade of Bloom filters: exact membership without a join.

Level 0 holds the listed keys. The keys of the corpus that pass it though they are not listed go to level 1, the listed keys that pass level
1 by mistake to level 2, and so on until nothing passes by mistake. Over the corpus's whole key universe the cascade then answers exactly;
each level is a fraction of the one before. Filters are built by bit_or over words of 64 bits and probed by built-in expressions. The bytes of
a cascade are counted before it is shipped; beyond the limit membership is a semi-join instead.

Defined results: a null url, or one without "://", has an empty host and path and fits no rule; rows that repeat an id are judged each;
other columns are ignored; without rules everything is allowed; of a rule listed with several verdicts the first in their order holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bytes of a cascade that may go to every task, as one constant of the plan for each level.
MOST_BYTES = 16 << 20


@dataclass
class Level:
    seed: int
    n_bits: int
    n_hashes: int
    bits: bytes

    @classmethod
    def of(cls, keys: DataFrame, n: int, seed: int, rate: float) -> Level:
        """A filter of the n keys with so many false positives; at most n_bits / 64 rows reach the driver."""
        n_bits = max(64, -(-int(n * -math.log(rate) / math.log(2) ** 2) // 64) * 64)
        n_hashes = max(1, round(n_bits / max(n, 1) * math.log(2))) if n * 64 > n_bits else 4
        out = cls(seed, n_bits, n_hashes, b"")
        places = keys.select(F.explode(F.array(*out.places(F.col("key")))).alias("at"))
        words = places.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).collect()
        data = bytearray(n_bits // 8)
        for r in words:
            data[r["word"] * 8 : r["word"] * 8 + 8] = (r["set"] % (1 << 64)).to_bytes(8, "little")
        out.bits = bytes(data)
        return out

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed * 64 + k), key), F.lit(self.n_bits).cast("long")) for k in range(self.n_hashes)]

    def holds(self, key: Column) -> Column:
        """The filter's bytes stand once in the expression, whatever the number of hashes."""

        def bit(at: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.lit(self.bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0

        return F.forall(F.array(*self.places(key)), bit)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def bytes(self) -> int:
        return sum(len(x.bits) for x in self.levels)

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES, first: float = 1 / 64, later: float = 1 / 2) -> Cascade | None:
        """Of the listed keys over the universe (both: key), or None if it would be larger than most_bytes."""
        listed = stored(listed.select("key").distinct(), "listed")
        mine, others, levels, size = listed, universe.select("key").distinct().join(listed, "key", "left_anti"), [], 0
        while len(levels) < 64:
            n = mine.count()
            if not n:
                break
            rate = later if levels else first
            size += n * -math.log(rate) / math.log(2) ** 2 / 8
            if size > most_bytes:
                return None
            level = Level.of(mine, n, len(levels), rate)
            levels.append(level)
            mine, others = stored(others.filter(level.holds(F.col("key"))), "passed"), mine
        return cls(levels)

    def contains(self, key: Column) -> Column:
        """For keys of the universe and listed keys: exactly whether the key is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(self.levels[k].holds(key), out).otherwise(F.lit(k % 2 == 1))
        return out


class Verdicts:
    """Which verdict a key is listed with, or none: one cascade over the corpus's keys says whether it is listed, and for each verdict but the
    last one over the listed keys alone whether it is that."""

    def __init__(self, listed: Cascade, among: list[tuple[str, Cascade]], last: str):
        self.listed, self.among, self.last = listed, among, last

    @classmethod
    def build(cls, rules: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES) -> Verdicts | None:
        """Of rules (key, verdict), one row a key; None if the cascades would be larger than most_bytes."""
        names = [r["verdict"] for r in rules.select("verdict").distinct().orderBy("verdict").collect()]
        cascades = [Cascade.build(rules, universe, most_bytes)] + [Cascade.build(rules.filter(F.col("verdict") == v), rules, most_bytes) for v in names[:-1]]
        if any(c is None for c in cascades) or sum(c.bytes for c in cascades) > most_bytes:
            return None
        return cls(cascades[0], [*zip(names[:-1], cascades[1:])], names[-1])

    def of(self, key: Column) -> Column:
        verdict = F.lit(self.last)
        for name, cascade in reversed(self.among):
            verdict = F.when(cascade.contains(key), F.lit(name)).otherwise(verdict)
        return F.when(self.listed.contains(key), verdict)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), capitals, capitals.lower())
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(lengths: list[int]) -> Column:
    """The host and each domain above it, joined to each beginning of the path that has a rule's length."""
    domains = "transform(sequence(1, size(split(host, '[.]', -1))), i -> array_join(slice(split(host, '[.]', -1), i, size(split(host, '[.]', -1))), '.'))"
    paths = f"transform(filter(array({', '.join(map(str, lengths))}), n -> length(path) >= n), n -> substring(path, 1, n))"
    return F.expr(f"CASE WHEN host = '' THEN cast(array() as array<string>) ELSE flatten(transform({domains}, d -> transform({paths}, p -> concat(d, p)))) END")


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each page: id, host, path, rule (the longest that fits, else null), verdict. rules: (verdict, host and path)."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    lengths = sorted({len(r[r.index("/") :]) for _, r in rules})
    if not rules:
        return urls.select(F.col("page_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = urls.withColumn("keys", candidate_keys(lengths))
    universe = stored(urls.select(F.explode("keys").alias("key")).distinct(), "keys")
    spark = pages.sparkSession
    verdicts = {r: v for v, r in sorted(rules, reverse=True)}  # of a rule's verdicts the first in their order
    cascades = Verdicts.build(spark.createDataFrame([*verdicts.items()], "key string, verdict string"), universe, most_bytes)
    if cascades is None:
        places = urls.select("host", "path", "keys").distinct().select("host", "path", F.explode("keys").alias("key"))
        hits = places.join(spark.createDataFrame([*verdicts.items()], "key string, v string"), "key")
        hits = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("key"), F.col("v").alias("verdict"))).alias("hit"))
        best = urls.join(hits, ["host", "path"], "left")
    else:
        judged = urls.withColumn("judged", F.transform("keys", lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), cascades.of(k).alias("verdict"))))
        best = judged.withColumn("hit", F.array_max(F.filter("judged", lambda x: x["verdict"].isNotNull())))
    return best.select(F.col("page_id").alias(id_col), "host", "path", F.col("hit.key").alias("rule"), F.coalesce(F.col("hit.verdict"), F.lit(default)).alias("verdict"))
