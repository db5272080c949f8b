"""Summaries, selections and set relations over keyed rows. Every function maps DataFrames to a DataFrame; tie keys are arguments."""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def histogram_topk(df: DataFrame, key: str, k: int, tie: str | None = None) -> DataFrame:
    """The k most frequent keys with their rank; of equal counts the smaller tie value first."""
    counts = df.groupBy(key).agg(F.count("*").alias("records"), F.min(tie or key).alias("_tie"))
    top = counts.orderBy(F.desc("records"), "_tie").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("records"), "_tie")).cast("long")).drop("_tie")


def argmax(df: DataFrame, key: str, score: list[Column], keep: list[str]) -> DataFrame:
    """For each key the kept columns of the row with the greatest scores, compared in order. Partial results combine before the shuffle."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*score)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in keep])


def coverage(df: DataFrame, group: str, cell: str, first: int = 1) -> DataFrame:
    """Whether the cells of a group are first, first + 1, ... without a hole, and how many rows repeat a cell."""
    g = df.groupBy(group).agg(F.count("*").alias("records"), F.countDistinct(cell).alias("covered"), F.max(cell).alias("_last"))
    expected = (F.col("_last") - first + 1).cast("long")
    return g.select(group, "records", "covered", expected.alias("expected"), (F.col("covered") == expected).alias("complete"), (F.col("records") - F.col("covered")).alias("surplus"))


def set_relations(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys are only left, only right, in both, in either."""
    sides = left.select(*keys).withColumn("_l", F.lit(1)).unionByName(right.select(*keys).withColumn("_l", F.lit(2)))
    seen = sides.groupBy(*keys).agg(F.sum(F.when(F.col("_l") == 1, 1)).alias("l"), F.sum(F.when(F.col("_l") == 2, 1)).alias("r"))
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    has = [F.col("l").isNotNull(), F.col("r").isNotNull()]
    return seen.agg(count(has[0] & ~has[1]).alias("only_left"), count(~has[0] & has[1]).alias("only_right"), count(has[0] & has[1]).alias("both"), F.count("*").alias("either"))


def unordered_pair(a: Column, b: Column) -> Column:
    return F.concat_ws(" <-> ", F.least(a, b), F.greatest(a, b))


def snap(value: Column, step: float) -> Column:
    """To the nearest multiple; halves go to the even one."""
    return F.rint(value / step) * step


def ladder(value: Column, bounds: list[float]) -> Column:
    """Name of the first bound that the value does not exceed."""
    out = F.lit(None).cast("string")
    for b in reversed(bounds):
        out = F.when(value <= b, F.lit(f"<={b:g}")).otherwise(out if b != bounds[-1] else F.lit(f">{b:g}"))
    return F.when(value.isNotNull(), out)


def bits(value: Column, at: int, width: int) -> Column:
    """An unsigned field of a packed integer."""
    return F.shiftright(value.cast("long"), at).bitwiseAND((1 << width) - 1)


def common_prefix(df: DataFrame, group: str, value: str) -> DataFrame:
    """The longest common prefix of a group is that of its least and greatest value, so one small aggregate finds it."""
    g = df.groupBy(group).agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count("*").alias("records"))
    n = F.expr("size(filter(sequence(1, greatest(1, least(length(a), length(b)))), i -> i <= length(a) and substring(a, 1, i) = substring(b, 1, i)))")
    return g.select(group, "records", n.cast("long").alias("prefix_length"), F.col("a").substr(F.lit(1), n).alias("prefix"))


def digest(df: DataFrame, group: str, row: Column) -> DataFrame:
    """SHA-256 of a group's rows in sorted order; a digest is made in one piece, so a group must fit a task."""
    return df.groupBy(group).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256).alias("digest"), F.count("*").alias("records"))


#: Values of a group that a median takes at once, and bins of a histogram of more.
AT_ONCE, BINS = 1 << 16, 1024


def medians(df: DataFrame, group: str | list[str], value: str, at_once: int = AT_ONCE, bins: int = BINS) -> DataFrame:
    """(group, median), exactly, of the values that are finite. A group of more than `at_once` values is not gathered: its range is counted in
    bins, the bin of each middle rank becomes the next range, from its least to its greatest value, and so on until it is one value. Only
    counts travel, and nothing is sorted."""
    keys = [group] if isinstance(group, str) else list(group)
    v = cut(df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v between -1.7976931348623157E308D and 1.7976931348623157E308D"))
    sizes = cut(v.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]  # noqa: E731  a null is a group, too
    few = v.alias("v").join(sizes.filter(F.col("_n") <= at_once).alias("s"), same("v", "s"), "left_semi")
    out = few.groupBy(*keys).agg(F.median("_v").alias("median"))
    ranks = F.explode(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    targets, found = cut(sizes.filter(F.col("_n") > at_once).withColumn("_rank", ranks).select(*keys, "_lo", "_hi", "_rank")), None
    if targets.isEmpty():
        return out
    # Both keep the order: halves, so that the widest range is finite, and in every other round logarithms, 0 for 0, for values of all magnitudes.
    scales = cycle((lambda c: F.col(c) / 2, lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.log(F.abs(c)) + 746))))
    while not targets.isEmpty():
        scale = next(scales)
        settled = targets.filter("_lo = _hi").select(*keys, F.col("_lo").alias("_v"))
        found = settled if found is None else found.unionByName(settled)
        open_ = targets.filter("_lo < _hi")
        inside = v.alias("v").join(open_.select(*keys, "_lo", "_hi").distinct().alias("r"), [*same("v", "r"), F.col("_v").between(F.col("_lo"), F.col("_hi"))])
        place = F.floor(F.try_divide(scale("_v") - scale("_lo"), scale("_hi") - scale("_lo")) * bins)
        place = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), bins - 1).otherwise(F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)))
        counts = inside.select(*[F.col(f"v.{k}").alias(k) for k in keys], "_lo", "_hi", "_v", place.alias("_bin")).groupBy(*keys, "_lo", "_hi", "_bin").agg(F.count("*").alias("_k"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.sum("_k").over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_bin"))  # a row for each bin
        counts = counts.withColumn("_below", upto - F.col("_k")).alias("c")
        at = [*same("t", "c"), F.col("t._lo") == F.col("c._lo"), F.col("t._hi") == F.col("c._hi"), F.col("_rank") >= F.col("_below"), F.col("_rank") < F.col("_below") + F.col("_k")]
        targets = cut(open_.alias("t").join(counts, at).select(*[F.col(f"t.{k}").alias(k) for k in keys], F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_rank") - F.col("_below")).alias("_rank")))
    middle = found.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    return out.unionByName(middle.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") / 2 + F.col("_b") / 2).alias("median")))


def error_stats(df: DataFrame, group: str, error: str) -> DataFrame:
    """Median, mean, root mean square, greatest error, and greatest distance from the group's median."""
    g = df.groupBy(group).agg(F.count("*").alias("records"), F.avg(error).alias("mean"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"), F.max(F.abs(error)).alias("max_abs"), F.min(error).alias("lo"), F.max(error).alias("hi"))
    centre = g.join(medians(df, group, error), group, "left")
    return centre.select(group, "records", "median", "mean", "rmse", "max_abs", F.greatest(F.col("hi") - F.col("median"), F.col("median") - F.col("lo")).alias("max_from_median"))


def before(counts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before): for each of a few keys the sum of the value over all smaller keys, from one row that holds them all."""
    all_of = counts.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).cast("long").alias("v")))).alias("c"))
    sums = F.aggregate("c", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["v"])))
    each = all_of.select("c", sums.alias("s")).select(F.explode(F.transform("c", lambda x, i: F.struct(x["k"].alias("k"), F.get("s", i).alias("b")))).alias("z"))
    return each.select(F.col("z.k").alias(key), F.col("z.b").alias("before"))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds a number from 1 in the given order, which must be total. Rows are dealt out by ranges of the order and numbered within their range; no
    task sees more than one range."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    offsets = before(ranged.groupBy("_range").agg(F.count("*").alias("n")), "_range", "n")
    inner = ranged.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long"))
    return inner.join(offsets, "_range").withColumn(name, F.col(name) + F.col("before")).drop("_range", "before")
