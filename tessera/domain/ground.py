"""Measured against planned heights: errors, adjacency along lanes, validation by lanes, flat facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components, cut
from ..operators.relational import medians
from ..operators.series import cross_lane
from ..operators.spatial import cells


def compare(plan: DataFrame, seen: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """plan: index, lane, fraction, x, y, predicted_z. Every planned sample with status hit, miss or not_sampled, and its error.

    A measurement that is not of this plan (unknown index, other place or prediction) has status foreign.
    """
    p = plan.select("index", "lane", "fraction", *[F.col(c).alias(f"plan_{c}") for c in ("x", "y", "predicted_z")])
    both = p.join(seen.select("index", "hit", "x", "y", "z", "predicted_z", "nx", "ny", "nz"), "index", "full_outer")
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"plan_{c}")) for c in ("x", "y", "predicted_z")]) > tolerance
    status = F.when(F.col("lane").isNull() | off, "foreign").when(F.col("hit").isNull(), "not_sampled").when(F.col("hit") == 0, "miss").otherwise("hit")
    return both.withColumn("status", status).withColumn("error", F.when(F.col("status") == "hit", F.col("z") - F.col("plan_predicted_z")))


def grades(compared: DataFrame, of: str = "z") -> DataFrame:
    """Grades between neighbours of a lane, on the whole planned track: a sample without a hit ends a run, it is never skipped over."""
    w = Window.partitionBy("lane").orderBy("fraction")
    run = F.hypot(F.col("plan_x") - F.lag("plan_x").over(w), F.col("plan_y") - F.lag("plan_y").over(w))
    c = compared.filter("status <> 'foreign'").withColumns({"_run": run, "_rise": F.col(of) - F.lag(of).over(w), "_before": F.lag("status").over(w)})
    return c.filter("status = 'hit' and _before = 'hit'").select("lane", "fraction", (F.col("_rise") / F.col("_run")).alias("grade"))


def end_to_end(compared: DataFrame) -> DataFrame:
    """Rise from the first to the last planned sample of each lane; null unless both are hits."""
    ends = compared.filter("status <> 'foreign'").groupBy("lane").agg(F.min_by(F.struct("status", "z"), "fraction").alias("a"), F.max_by(F.struct("status", "z"), "fraction").alias("b"))
    return ends.select("lane", F.when((F.col("a.status") == "hit") & (F.col("b.status") == "hit"), F.col("b.z") - F.col("a.z")).alias("rise"))


# Fixed values of the report: what a held-out lane comes to.
UNKNOWN_LANES = "unavailable_track_metadata"
FEW_LANES = "insufficient_distinct_tracks"
NOTHING_LEARNED = "no_scorable_training_candidate"
NOTHING_SCORED = "no_unambiguous_held_out_roots"
SCORED = "scored"


def held_out(models: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """models: model, lane, index, measured, modelled (null: no root). For each lane the model and bias that the other lanes choose, and its error
    beside a flat baseline, the median height of the other lanes' hits, on the same rows of the lane.

    planned (lane, index; else the rows of models) says which hits there should be; those missing are counted apart from missing roots. status
    is "scored" or why nothing is: a sample without a lane, or fewer than three lanes (then of all folds), no root among the other lanes' hits,
    none in this one. Of the models most roots win, then the least error, then the name. Lanes are few: each row is read once for each fold.
    """
    planned = models.select("lane", "index").distinct() if planned is None else planned
    lanes = planned.agg(F.sort_array(F.collect_set("lane")).alias("all"), F.max(F.col("lane").isNull()).alias("unknown"))
    folds = lanes.select(F.explode("all").alias("fold"), "all", F.when(F.col("unknown"), UNKNOWN_LANES).when(F.size("all") < 3, FEW_LANES).alias("_why"))
    others = folds.select("fold", "_why", F.explode("all").alias("lane")).filter("lane <> fold")
    known = models.filter("measured is not null")
    hits = cut(known.select("lane", "index", "measured").distinct())
    counts = planned.groupBy("lane").agg(F.count("*").alias("_p")).join(hits.groupBy("lane").agg(F.count("*").alias("_h")), "lane", "left").fillna(0, "_h")
    own = counts.select(F.col("lane").alias("fold"), F.col("_p").alias("held_out_samples"), F.col("_h").alias("held_out_hits"))
    rest = others.join(counts, "lane").groupBy("fold").agg(F.sum("_p").alias("training_samples"), F.sum("_h").alias("training_hits"))
    teach = others.filter("_why is null").select("fold", "lane")
    e = F.col("modelled") - F.col("measured")
    train = cut(known.join(teach, "lane").select("fold", "model", e.alias("e")).filter("e is not null"))
    ranked = train.groupBy("fold", "model").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("error")).join(medians(train, ["fold", "model"], "e"), ["fold", "model"])
    best = ranked.groupBy("fold").agg(F.min_by(F.struct("model", "n", "error", "median"), F.struct(-F.col("n"), "error", "model")).alias("c"))
    best = best.select("fold", "c.model", F.col("c.n").alias("training_unambiguous"), F.col("c.error").alias("training_rmse"), F.col("c.median").alias("bias"))
    flat = medians(hits.join(teach, "lane").select("fold", "measured"), "fold", "measured").withColumnRenamed("median", "flat")
    test = known.select(F.col("lane").alias("fold"), "model", "measured", "modelled", e.alias("e")).join(best.join(flat, "fold"), ["fold", "model"])
    rmse = lambda c: F.sqrt(F.avg(c * c))
    level = F.when(F.col("e").isNotNull(), F.col("flat") - F.col("measured"))
    errors = test.groupBy("fold").agg(F.count("e").alias("scored"), F.count_if(F.col("e").isNull()).alias("without_root"), rmse(F.col("e")).alias("raw_rmse"), rmse(F.col("e") - F.col("bias")).alias("rmse"), rmse(level).alias("flat_rmse"))
    out = folds.select("fold", "_why").join(own, "fold").join(rest, "fold", "left").join(best, "fold", "left").join(errors, "fold", "left").fillna(0, ["training_samples", "training_hits", "training_unambiguous", "scored"])
    status = F.coalesce("_why", F.when(F.col("model").isNull(), NOTHING_LEARNED).when(F.col("scored") == 0, NOTHING_SCORED).otherwise(SCORED))
    missing = lambda kind: (F.col(f"{kind}_samples") - F.col(f"{kind}_hits")).alias(f"{kind}_missing")
    return out.select(
        "fold", status.alias("status"), "training_samples", "training_hits", missing("training"), "held_out_samples", "held_out_hits", missing("held_out"), "model", "training_unambiguous", "training_rmse", "bias",
        "scored", "without_root", "raw_rmse", "rmse", "flat_rmse", (F.col("flat_rmse") - F.col("rmse")).alias("gain"),
    )


def angle(a: str, b: str) -> Column:
    """Degrees between two normals; infinite where one has no length."""
    n = lambda s: F.sqrt(sum((F.col(f"{c}{s}") ** 2 for c in ("nx", "ny", "nz")), F.lit(0.0)))
    dot = sum((F.col(f"{c}{a}") * F.col(f"{c}{b}") for c in ("nx", "ny", "nz")), F.lit(0.0)) / (n(a) * n(b))
    return F.when((n(a) < 1e-9) | (n(b) < 1e-9), float("inf")).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))))


def near_pairs(a: DataFrame, b: DataFrame, reach: float, keys: list[str]) -> DataFrame:
    """Rows of a (columns with _a) beside those of b (with _b) at most so far from them in x and y: they meet in cells of that size."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in a.columns if c not in keys])
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys])
    for c in "xy":
        left = left.withColumn(f"_{c}", cells(F.col(f"{c}_a") - reach, F.col(f"{c}_a") + reach, reach))
        right = right.withColumn(f"_{c}", F.floor(F.col(f"{c}_b") / reach).cast("long"))
    d = F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b"))
    return left.join(right, [*keys, "_x", "_y"]).withColumn("apart", d).filter(F.col("apart") <= reach)


def facets(hits: DataFrame, reach: float = 0.51, degrees: float = 0.1) -> DataFrame:
    """(index, facet): hits (index, x, y, z, nx, ny, nz) with upward normals, linked where they are near each other, not at one place, and their normals
    nearly equal. A hit without links has none."""
    if not (0 < reach <= 2 and 0 < degrees <= 5):
        raise ValueError("the reach or the angle is out of range")
    h = hits.filter("nz > 0.1").select("index", "x", "y", "z", "nx", "ny", "nz")
    near = near_pairs(h, h, reach, []).filter((F.col("index_a") < F.col("index_b")) & (F.col("apart") > 1e-9) & (angle("_a", "_b") <= degrees))
    return components(near.select(F.col("index_a").alias("a"), F.col("index_b").alias("b"))).select(F.col("node").alias("index"), F.col("component").alias("facet"))


def facet_evidence(hits: DataFrame, found: DataFrame, degrees: float = 0.1, residual: float = 0.001) -> DataFrame:
    """Of each facet, seen from its first hit: hits, whether they span two directions of the plane, the greatest angle, the residuals of the first
    hit's tangent plane, and whether all of that supports one plane.

    Two directions are spanned if some two hits are not on one line with the first. It is enough to look at the hit farthest from the first: if all
    others lie on its line within the limit, no two of them span more than twice the limit.
    """
    own = hits.join(found, "index")
    first = own.groupBy("facet").agg(F.min_by(F.struct("x", "y", "z", "nx", "ny", "nz"), "index").alias("f"))
    rows = own.join(first, "facet").withColumns({f"{c}_f": F.col(f"f.{c}") for c in ("x", "y", "z", "nx", "ny", "nz")}).withColumns({f"{c}_o": F.col(c) for c in ("nx", "ny", "nz")})
    dx, dy = F.col("x") - F.col("x_f"), F.col("y") - F.col("y_f")
    rows = rows.withColumns({"dx": dx, "dy": dy, "r": F.col("z") - F.col("z_f") + (F.col("nx_f") * dx + F.col("ny_f") * dy) / F.col("nz_f"), "angle": angle("_f", "_o")})
    far = rows.groupBy("facet").agg(F.max_by(F.struct("dx", "dy"), F.struct(F.col("dx") ** 2 + F.col("dy") ** 2, -F.col("index"))).alias("far"))
    g = rows.join(far, "facet").groupBy("facet").agg(
        F.count("*").alias("hits"), F.bool_or(F.abs(F.col("dx") * F.col("far.dy") - F.col("dy") * F.col("far.dx")) > 1e-4).alias("spans"), F.max("angle").alias("max_angle"),
        F.max(F.abs("r")).alias("max_residual"), F.sqrt(F.avg(F.col("r") ** 2)).alias("rmse_residual"),
    )
    return g.withColumn("consistent", F.col("spans") & (F.col("max_angle") <= degrees) & (F.col("max_residual") <= residual))


def tangent_held_out(hits: DataFrame, reach: float = 1.0) -> DataFrame:
    """For each lane its heights as the tangent plane of the nearest hit of another lane predicts them, beside that hit's own height and the other
    lanes' median: (lane, hits, scored, unscored, tangent_rmse, nearest_rmse, flat_rmse). hits: lane, index, x, y, z, nx, ny, nz. A prediction
    needs a hit with an upward normal within the reach, the nearest, then of the least index; all three errors are of the same rows."""
    if not 0 < reach <= 4:
        raise ValueError("the reach must be in (0, 4]")
    h = hits.select("lane", "index", "x", "y", "z", "nx", "ny", "nz")
    # Hits of one lane at one place ask once, and of them only the least index can be an answer.
    asking = h.select("lane", "x", "y").distinct()
    least = F.min(F.struct("index", "z", "nx", "ny", "nz")).alias("b")
    asked = h.filter("nz > 0.1").groupBy("lane", "x", "y").agg(least).select("lane", "x", "y", "b.*")
    met = near_pairs(asking, asked, reach, []).filter("lane_a <> lane_b")
    best = met.groupBy(F.col("lane_a").alias("lane"), F.col("x_a").alias("x"), F.col("y_a").alias("y")).agg(F.min(F.struct("apart", "index_b", "x_b", "y_b", "z_b", "nx_b", "ny_b", "nz_b")).alias("n"))
    best = h.select("lane", "index", "x", "y", "z").distinct().join(best, ["lane", "x", "y"])
    tangent = F.col("n.z_b") - (F.col("n.nx_b") * (F.col("x") - F.col("n.x_b")) + F.col("n.ny_b") * (F.col("y") - F.col("n.y_b"))) / F.col("n.nz_b")
    lanes = h.select("lane").distinct()
    others = lanes.agg(F.collect_list("lane").alias("all")).select(F.explode("all").alias("fold"), "all").select("fold", F.explode("all").alias("lane")).filter("lane <> fold")
    flat = medians(h.join(others, "lane").select(F.col("fold").alias("lane"), "z"), "lane", "z").withColumnRenamed("median", "flat")
    rows = best.select("lane", "z", tangent.alias("t"), F.col("n.z_b").alias("near")).join(flat, "lane")
    rmse = lambda c: F.sqrt(F.avg((F.col(c) - F.col("z")) ** 2))
    scored = rows.groupBy("lane").agg(F.count("*").alias("scored"), rmse("t").alias("tangent_rmse"), rmse("near").alias("nearest_rmse"), rmse("flat").alias("flat_rmse"))
    all_of = h.groupBy("lane").agg(F.count("*").alias("hits"))
    return all_of.join(scored, "lane", "left").withColumn("scored", F.coalesce("scored", F.lit(0))).withColumn("unscored", F.col("hits") - F.col("scored"))


def slope_scores(models: DataFrame, plan: DataFrame) -> DataFrame:
    """Of each model the grades along the lanes beside the measured ones: segments, error, and what is left of it without its mean, which a plane's
    tilt would explain. models: as in held_out; plan: index, x, y, fraction. A segment needs a measured and a modelled height at both ends, which
    follow one another on the whole planned lane."""
    w = Window.partitionBy("model", "lane").orderBy("fraction")
    m = models.join(plan.select("index", "x", "y", "fraction"), "index")
    run = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    rise = lambda c: (F.col(c) - F.lag(c).over(w)) / F.nullif(run, F.lit(0.0))
    g = m.select("model", "lane", "fraction", rise("measured").alias("seen"), rise("modelled").alias("made")).filter("seen is not null and made is not null")
    g = g.withColumn("e", F.col("made") - F.col("seen")).withColumn("mean_e", F.avg("e").over(Window.partitionBy("model")))
    return g.groupBy("model").agg(F.count("*").alias("segments"), F.avg("seen").alias("observed_grade"), F.avg("made").alias("model_grade"), F.avg(F.abs("e")).alias("mae"), F.max("mean_e").alias("mean_error"), F.avg(F.abs(F.col("e") - F.col("mean_e"))).alias("mae_without_tilt")).orderBy(F.desc("segments"), "mae", "model")


def cross_grades(compared: DataFrame) -> DataFrame:
    """Grades between a lane and the next at equal fractions, where both were hit."""
    hit = compared.filter("status <> 'foreign'").select("lane", "fraction", F.when(F.col("status") == "hit", F.col("z")).alias("z"))
    out = cross_lane(hit, "lane", "fraction", "z")
    return out.filter("difference is not null").select("lane_a", "lane_b", "fraction", (F.col("difference") / (F.col("lane_b") - F.col("lane_a"))).alias("grade"))
