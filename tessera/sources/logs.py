"""Measurements in game logs: runs begin at a marker, and the newest matching run counts whole or not at all.

The texts that begin a marker (`marker`, such as "X_META,") and a record (`record`, such as "X,") are the caller's; they are found anywhere in a
line, as they stand.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the format.
FIELDS = ["index int", "hit int", "x double", "y double", "predicted_z double", "world_id int", "z double", "nx double", "ny double", "nz double", "kind string"]
NAMES = [x.split()[0] for x in FIELDS]
MOST_SAMPLES = 512
#: Lines of a file within which its markers are counted at once.
LINES = 1 << 18


class NoRun(ValueError):
    """A log holds no marker of the run that is asked for."""


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, value) of text files, lines from 1 on. A file is read in ranges that end with a line; a line's number is its place in its range
    and the lines of the ranges before, which are counted in a pass of their own. So no row or task holds a file. Files must not change meanwhile."""
    m = F.col("_metadata")
    at = spark.read.text(paths).select(m["file_path"].alias("file"), m["file_block_start"].alias("range"), F.monotonically_increasing_id().alias("at"), "value")
    counts = at.groupBy("file", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    starts = counts.select("file", "range", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return at.join(starts, ["file", "range"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def fields(lines: DataFrame, marker: str, record: str) -> DataFrame:
    """lines: file, line, value. The markers and records among them, each by itself, so for streams too; a bad one has a reject_reason."""
    at = lines.withColumns({"_m": F.instr("value", marker), "_r": F.instr("value", record)}).filter("_m > 0 or _r > 0")
    is_marker = F.col("_m") > 0
    text = F.trim(F.when(is_marker, F.expr("substring(value, _m)")).otherwise(F.expr("substring(value, _r)")))
    rows = at.select("file", "line", is_marker.alias("is_marker"), text.alias("text")).withColumn("f", F.when(~F.col("is_marker"), F.split("text", ",", 12)))
    named = F.regexp_extract("text", r"^[^,]*,world=(\d+),count=(\d+)$", 0) != ""
    number = lambda k: F.when(F.col("is_marker") & named, F.regexp_extract("text", r"^[^,]*,world=(\d+),count=(\d+)$", k))
    typed = [F.when(F.size("f") == 12, F.expr(f"try_cast(f[{k + 1}] as {t})")).alias(n) for k, (n, t) in enumerate(x.split() for x in FIELDS)]
    out = rows.select("file", "line", "is_marker", number(1).alias("marker_world"), number(2).alias("marker_count"), F.size("f").alias("_n"), *typed)
    finite = F.lit(True)
    for n in ("x", "y", "predicted_z", "z", "nx", "ny", "nz"):
        finite = finite & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    good = (F.col("index") >= 0) & F.col("hit").isin(0, 1) & (F.col("world_id") > 0) & finite
    marked = F.when(F.col("marker_world").isNull(), "marker")
    return out.withColumn("reject_reason", F.when(F.col("is_marker"), marked).when(F.col("_n") != 12, "fields").when(~F.coalesce(good, F.lit(False)), "values")).drop("_n")


def parsed(lines: DataFrame, marker: str, record: str, most: int = LINES) -> DataFrame:
    """Markers and records (fields) with their run: how many markers of the file precede it, itself included. Markers are counted in stretches of so
    many lines, and over the stretches of a file, so a window holds a stretch or a row for each of them."""
    rows = fields(lines, marker, record).withColumns({"_stretch": F.floor(F.col("line") / most), "_m": F.col("is_marker").cast("long")})
    counts = rows.groupBy("file", "_stretch").agg(F.sum("_m").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "_stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.sum("_m").over(Window.partitionBy("file", "_stretch").orderBy("line"))
    return rows.withColumn("run", within).join(counts, ["file", "_stretch"]).withColumn("run", F.col("run") + F.col("_before")).drop("_stretch", "_m", "_before")


def run_states(rows: DataFrame, world: int, count: int) -> DataFrame:
    """For each file of parsed rows the newest run whose marker names the world and count, whole or not: (file, status, run, marker_line, records,
    bad, lines). status: "marker" where a marker of the file names nothing, "none" where none names these, "whole" where the run has every
    record once and none bad, else "broken". lines are those of a whole run's records, in order. A file without markers and records has no row."""
    mine = F.col("is_marker") & (F.col("marker_world") == str(world)) & (F.col("marker_count") == str(count))
    last = F.max(F.when(mine, F.struct("run", "line")))
    files = rows.groupBy("file").agg(last.alias("m"), F.count_if(F.col("is_marker") & F.col("reject_reason").isNotNull()).alias("unnamed"))
    files = files.select("file", "unnamed", F.col("m.run").alias("run"), F.col("m.line").alias("marker_line"))
    records = rows.filter(~F.col("is_marker")).join(files.filter("run is not null").select("file", "run"), ["file", "run"])
    # A run is split by index first, so that one without end is counted in parts; of one that is whole there are `count` records.
    parts = records.groupBy("file", "index").agg(F.count("*").alias("n"), F.count("reject_reason").alias("bad"), F.min("line").alias("line"))
    totals = parts.groupBy("file").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("different"))
    whole = totals.filter((F.col("n") == count) & (F.col("different") == count) & (F.col("bad") == 0))
    lines = parts.join(whole.select("file"), "file", "left_semi").groupBy("file").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    out = files.join(totals, "file", "left").join(lines, "file", "left")
    status = F.when(F.col("unnamed") > 0, "marker").when(F.col("run").isNull(), "none").when(F.col("lines").isNotNull() | F.lit(count == 0) & F.col("n").isNull(), "whole").otherwise("broken")
    counted = lambda c: F.when(F.col("run").isNotNull(), F.coalesce(c, F.lit(0).cast("long")))
    empty = F.array().cast("array<bigint>")
    return out.select("file", status.alias("status"), "run", "marker_line", counted("n").alias("records"), counted("bad").alias("bad"), F.when(status == "whole", F.coalesce("lines", empty)).otherwise(empty).alias("lines"))


def latest_run(rows: DataFrame, world: int, count: int) -> DataFrame:
    """Records of the last run of a file whose marker names the world and count. A newest run that is not whole raises; none older steps in."""
    mine = rows.filter(F.col("is_marker") & (F.col("marker_world") == str(world)) & (F.col("marker_count") == str(count)))
    last = mine.groupBy("file").agg(F.max("run").alias("run"))
    records = rows.filter(~F.col("is_marker")).join(last, ["file", "run"])
    if not rows.filter("is_marker and reject_reason is not null").isEmpty():
        raise ValueError("a marker does not name a world and a count")
    if last.isEmpty():
        raise NoRun(f"no marker names world {world} and {count} records")
    whole = records.agg(F.count("*").alias("n"), F.countDistinct("index").alias("different"), F.count("reject_reason").alias("bad")).first()
    if (whole["n"], whole["different"], whole["bad"]) != (count, count, 0):
        raise ValueError(f"the newest run has {whole['n']} of {count} records, {whole['bad']} of them bad")
    return records.select("file", "line", *NAMES)


def newest_logs(spark: SparkSession, folder: str, pattern: str = "game*.log") -> DataFrame:
    """(path, modified) of the folder's logs, the newest first, equal times by name; only their metadata is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"))
    return files.orderBy(F.desc("modified"), F.desc(F.element_at(F.split("path", "/"), -1)))


def newest_run(spark: SparkSession, folder: str, world: int, count: int, marker: str, record: str) -> DataFrame:
    """The run of the newest log that has one. Logs without a marker of it are passed over, a broken run of a newer log is not."""
    files = [r["path"] for r in newest_logs(spark, folder).collect()]  # names of one folder's logs
    if not files:
        raise ValueError(f"no logs in {folder}")
    for path in files:
        try:
            return latest_run(parsed(read_lines(spark, path), marker, record), world, count)
        except NoRun:
            continue
    raise NoRun(f"none of {len(files)} logs in {folder} holds a run of world {world} with {count} records")


def checked_plan(plan: dict) -> tuple[int, list[dict]]:
    """The world and the samples of a plan of measurements (a JSON document); raises unless it is anchored and every place is its own."""
    number = lambda v: type(v) in (int, float) and math.isfinite(v)
    section = lambda name: plan.get(name) if isinstance(plan, dict) and isinstance(plan.get(name), dict) else {}
    if section("alignment").get("status") != "two_or_more_independent_tunnel_anchors":
        raise ValueError("the plan is not anchored at two tunnels")
    world, samples = plan.get("world_id"), section("critical_edge").get("world_samples")
    if type(world) is not int or world <= 0:
        raise ValueError("the plan names no world")
    if not isinstance(samples, list) or not 1 <= len(samples) <= MOST_SAMPLES:
        raise ValueError(f"a plan has 1 to {MOST_SAMPLES} samples")
    for k, s in enumerate(samples):
        xy = s.get("world_xy") if isinstance(s, dict) else None
        if not (isinstance(xy, (list, tuple)) and len(xy) == 2 and all(map(number, xy)) and number(s.get("estimated_surface_world_z"))):
            raise ValueError(f"sample {k} has no place")
    if len({(float(s["world_xy"][0]), float(s["world_xy"][1])) for s in samples}) < len(samples):
        raise ValueError("two samples share a place")
    return world, samples


def plan_rows(spark: SparkSession, plan: dict) -> DataFrame:
    """The samples of a checked plan: index, lane, fraction, x, y, predicted_z."""
    _, samples = checked_plan(plan)
    rows = [(k, *map(lambda v: None if v is None else float(v), (s.get("lateral_offset_m"), s.get("fraction"), *s["world_xy"], s["estimated_surface_world_z"]))) for k, s in enumerate(samples)]
    return spark.createDataFrame(rows, "index int, lane double, fraction double, x double, y double, predicted_z double")


def write_run(records: DataFrame, path: str, record: str) -> None:
    """A run's records as lines of text again, in the order of their lines."""
    line = F.concat(F.lit(record), F.concat_ws(",", *[F.col(n).cast("string") for n in NAMES]))
    records.orderBy("line").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)
