"""Ordered rows: adjacency that never bridges a gap, sessions by markers, runs, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .relational import before


def gap_safe_adjacency(df: DataFrame, lane: str, order: list[str], valid: Column, values: dict[str, Column]) -> DataFrame:
    """Differences between neighbours of the whole series, kept only where both ends are valid: the shift comes before the filter."""
    w = Window.partitionBy(lane).orderBy(*order)
    shifted = df.withColumn("_ok", valid).withColumn("_before", F.lag("_ok").over(w))
    for name, value in values.items():
        shifted = shifted.withColumn(name, value - F.lag(value).over(w))
    return shifted.filter(F.col("_ok") & F.col("_before")).drop("_ok", "_before")


def marker_sessions(df: DataFrame, lane: str, order: list[str], marker: Column) -> DataFrame:
    """Adds session: how many markers have been seen, the row's own included; 0 before the first."""
    w = Window.partitionBy(lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("session", F.sum(F.when(marker, 1).otherwise(0)).over(w).cast("long"))


def last_session(df: DataFrame, lane: str, order: list[str], marker: Column) -> DataFrame:
    """Rows of each lane's last session; a lane without a marker has none. Sessions are never merged."""
    s = marker_sessions(df, lane, order, marker)
    return s.withColumn("_last", F.max("session").over(Window.partitionBy(lane))).filter("session = _last and session > 0").drop("_last")


def islands(df: DataFrame, lane: str, order: list[str], inside: Column) -> DataFrame:
    """Adds island to the rows inside: the number of the unbroken run, from 1."""
    w = Window.partitionBy(lane).orderBy(*order)
    flagged = df.withColumn("_in", inside).withColumn("_new", F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn("island", F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(running).cast("long")).filter("_in").drop("_in", "_new")


def arc_midpoint(df: DataFrame, lane: str, order: list[str], step: Column) -> DataFrame:
    """For each lane the first row whose cumulated steps reach half the total."""
    w = Window.partitionBy(lane).orderBy(*order)
    run = df.withColumn("_run", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = run.withColumn("_total", F.sum(step).over(Window.partitionBy(lane))).filter("_run * 2 >= _total")
    return run.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumnRenamed("_run", "reached").withColumnRenamed("_total", "total")


def interpolated_midpoint(points: DataFrame, lane: list[str], order: str, axes: list[str]) -> DataFrame:
    """For each lane the point at half the length of its line, between two points where it lies there; a line without length begins there.
    Lanes with a coordinate that is not finite have none."""
    w = Window.partitionBy(*lane).orderBy(order)
    d = sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in axes), F.lit(0.0))
    run = points.select(*lane, order, *axes, *[F.lag(a).over(w).alias(f"_b{a}") for a in axes], F.sqrt(d).alias("_s"))
    run = run.withColumn("_to", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = F.sum("_s").over(Window.partitionBy(*lane))
    finite = F.lit(True)
    for a in axes:
        finite = finite & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) != float("inf"))
    run = run.withColumns({"_total": total, "_ok": F.min(finite.cast("int")).over(Window.partitionBy(*lane))}).filter("_ok = 1 and _total is not null")
    hit = run.filter("(_total = 0 and _s is null) or (_total > 0 and _s > 0 and _to >= _total / 2)")
    t = F.when(F.col("_total") > 0, (F.col("_total") / 2 - (F.col("_to") - F.col("_s"))) / F.col("_s"))
    at = [F.when(F.col("_total") == 0, F.col(a)).otherwise(F.col(f"_b{a}") + (F.col(a) - F.col(f"_b{a}")) * t).alias(a) for a in axes]
    best = hit.select(*lane, F.struct(F.col(order), *at).alias("_p")).groupBy(*lane).agg(F.min("_p").alias("_p"))
    return best.select(*lane, *[F.col(f"_p.{a}").alias(a) for a in axes])


def round_robin(df: DataFrame, group: str, order: list[str], turns: int) -> DataFrame:
    """The first rows of every group in turn: adds turn, and place in the interleaved order. A place is the rows of earlier turns, counted by
    turn, and the groups before this one in its own turn: no window spans the rows."""
    first = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("turn") <= turns)
    return first.withColumn("place", F.row_number().over(Window.partitionBy("turn").orderBy(group)).cast("long")).transform(_after_turns)


def _after_turns(df: DataFrame) -> DataFrame:
    """Adds the rows of all earlier turns to place."""
    earlier = before(df.groupBy("turn").agg(F.count("*").alias("n")), "turn", "n")
    return df.join(earlier, "turn").withColumn("place", F.col("place") + F.col("before")).drop("before")


def cross_lane(df: DataFrame, lane: str, position: str, value: str) -> DataFrame:
    """Differences at the same position between a lane and the next lane in order. The lanes' names alone are put in order, by ranges; each
    range's last name knows the next range's first."""
    after = following(df.select(lane).distinct(), lane)
    a = df.select(F.col(lane).alias("lane_a"), position, F.col(value).alias("_a")).join(after.select(F.col(lane).alias("lane_a"), F.col("following").alias("lane_b")), "lane_a")
    b = df.select(F.col(lane).alias("lane_b"), position, F.col(value).alias("_b"))
    return a.join(b, ["lane_b", position]).select("lane_a", "lane_b", position, (F.col("_b") - F.col("_a")).alias("difference"))


def following(names: DataFrame, name: str) -> DataFrame:
    """(name, following): the next greater of different names, null for the last. A task orders one range of them."""
    ranged = cut(names.select(name).repartitionByRange(name).withColumn("_range", F.spark_partition_id()))
    inner = ranged.withColumn("following", F.lead(name).over(Window.partitionBy("_range").orderBy(name)))
    firsts = ranged.groupBy("_range").agg(F.min(name).alias("_first"))  # a row for each range
    ends = firsts.agg(F.sort_array(F.collect_list("_range")).alias("r"), F.map_from_entries(F.collect_list(F.struct("_range", "_first"))).alias("m"))
    next_first = ends.select(F.posexplode("r").alias("k", "_range"), "r", "m").select("_range", F.element_at("m", F.get("r", F.col("k") + 1)).alias("_next"))
    return inner.join(next_first, "_range").select(name, F.coalesce("following", "_next").alias("following"))
