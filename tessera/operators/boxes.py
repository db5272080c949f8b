"""Axis-aligned boxes: id, x0, x1, y0, y1, z0, z1. Joins meet in cells of the ground plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .grid import meet, wider

AXES = ("x", "y", "z")


def _named(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + suffix) for c in df.columns])


def gap(p: str, lo: str, hi: str) -> Column:
    """How far a coordinate lies outside an interval."""
    return F.greatest(F.col(lo) - F.col(p), F.col(p) - F.col(hi), F.lit(0.0))


def overlaps(boxes: DataFrame, size: float = 64.0, tolerance: float = 1e-6) -> DataFrame:
    """Pairs a < b whose insides overlap on all axes by more than the tolerance; touching is no overlap."""
    own = boxes.select("id", *[f"{x}{k}" for x in AXES for k in (0, 1)])
    plane = lambda s: [(f"{x}0{s}", f"{x}1{s}") for x in "xy"]
    met = meet(_named(own, "_a"), _named(own, "_b"), plane("_a"), plane("_b"), size).filter("id_a < id_b")
    for x in AXES:
        met = met.filter(F.least(f"{x}1_a", f"{x}1_b") - F.greatest(f"{x}0_a", f"{x}0_b") > tolerance)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def near_boxes(points: DataFrame, boxes: DataFrame, tolerance: float, size: float = 64.0) -> DataFrame:
    """Points (point, x, y, z) beside all boxes within the tolerance, inclusive, with their distance and volume."""
    w = wider(tolerance)
    b = boxes.withColumns({f"_{n}{x}": F.col(f"{x}{k}") + d for x in "xy" for n, k, d in (("lo", 0, -w), ("hi", 1, w))})
    p = points.select("point", *AXES)
    met = meet(p, b, [(x, x) for x in "xy"], [(f"_lo{x}", f"_hi{x}") for x in "xy"], size).drop(*[f"_{n}{x}" for n in ("lo", "hi") for x in "xy"])
    distance = F.sqrt(sum((gap(x, f"{x}0", f"{x}1") ** 2 for x in AXES), F.lit(0.0)))
    volume = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0"))
    return met.withColumns({"distance": distance, "volume": volume}).filter(F.col("distance") <= tolerance)


def _nearest(points: DataFrame, boxes: DataFrame, order: list[str], tolerance: float, size: float) -> DataFrame:
    """(point, n): the least of order for each point with a box within the tolerance. Points of one place ask once."""
    places = cut(points.select(*AXES).distinct().withColumn("point", F.monotonically_increasing_id()))
    met = near_boxes(places, boxes, tolerance, size).groupBy("x", "y", "z").agg(F.min(F.struct(*order)).alias("n"))
    return points.select("point", *AXES).join(met, [*AXES]).groupBy("point").agg(F.min("n").alias("n"))


def nearest_box(points: DataFrame, boxes: DataFrame, tolerance: float, size: float = 64.0) -> DataFrame:
    """(point, box, distance) for each point (point, x, y, z) with a box within the tolerance, inclusive; the nearest, then the smallest, then
    the lowest id."""
    bounds = [f"{x}{k}" for x in AXES for k in (0, 1)]
    near = _nearest(points, cut(boxes.groupBy(*bounds).agg(F.min("id").alias("id"))), ["distance", "volume", "id"], tolerance, size)
    return near.select("point", F.col("n.id").alias("box"), F.col("n.distance").alias("distance"))


def nearest_group(points: DataFrame, boxes: DataFrame, group: str, tolerance: float, size: float = 64.0) -> DataFrame:
    """(point, group, distance): the nearest group of boxes within the tolerance; equal distances go to the lowest group."""
    bounds = [f"{x}{k}" for x in AXES for k in (0, 1)]
    near = _nearest(points, cut(boxes.select(group, *bounds).distinct()), ["distance", group], tolerance, size)
    return near.select("point", F.col(f"n.{group}").alias(group), F.col("n.distance").alias("distance"))


def turned_point(x: Column, y: Column, w: Column, d: Column, rotation: Column) -> tuple[Column, Column]:
    """A point of a tile of w by d as it lies in its footprint after so many quarter turns; canonical_point turns it back."""
    r = rotation.bitwiseAND(3)
    return F.when(r == 1, d - y).when(r == 2, w - x).when(r == 3, y).otherwise(x), F.when(r == 1, x).when(r == 2, d - y).when(r == 3, w - x).otherwise(y)


def canonical_point(x: Column, y: Column, w: Column, d: Column, rotation: Column) -> tuple[Column, Column]:
    """A point of a footprint as it lies in the unturned tile of w by d."""
    r = rotation.bitwiseAND(3)
    return F.when(r == 1, y).when(r == 2, w - x).when(r == 3, w - y).otherwise(x), F.when(r == 1, d - x).when(r == 2, d - y).when(r == 3, x).otherwise(y)


def inside(tolerance: float = 1e-6) -> Column:
    """Whether x, y, z lie in x0 to x1 and so on, faces included."""
    out = F.lit(True)
    for x in AXES:
        out = out & F.col(x).between(F.col(f"{x}0") - tolerance, F.col(f"{x}1") + tolerance)
    return out


def ray_exit(rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Adds exit: where a line from x, y, z along dx, dy, dz meets the box's faces first: (distance, face, x, y, z, method). From inside it only
    goes forward ("ray"), from outside both ways ("line"); a line that meets no face has the nearest one ("nearest-fallback") and the point itself."""
    start_inside = inside(tolerance)
    options = []
    for x in AXES:
        for side, bound in (("-", f"{x}0"), ("+", f"{x}1")):
            d = F.col(f"d{x}")
            t = F.when(F.abs(d) > tolerance, (F.col(bound) - F.col(x)) / d)
            at = {y: F.col(y) + t * F.col(f"d{y}") for y in AXES}
            on = F.lit(True)
            for y in AXES:
                on = on & at[y].between(F.col(f"{y}0") - tolerance, F.col(f"{y}1") + tolerance)
            options.append(F.when(on & (~start_inside | (t >= -tolerance)), F.struct(F.abs(t).alias("distance"), F.lit(x + side).alias("face"), *[at[y].alias(y) for y in AXES])))
    hit = F.array_min(F.array_compact(F.array(*options)))
    near = F.array_min(F.array(*[F.struct(F.abs(F.col(x) - F.col(b)).alias("distance"), F.lit(x + s).alias("face")) for x in AXES for s, b in (("-", f"{x}0"), ("+", f"{x}1"))]))
    fallback = F.struct(near["distance"].alias("distance"), near["face"].alias("face"), *AXES, F.lit("nearest-fallback").alias("method"))
    found = F.struct(hit["distance"].alias("distance"), hit["face"].alias("face"), *[hit[y].alias(y) for y in AXES], F.when(start_inside, "ray").otherwise("line").alias("method"))
    return rows.withColumns({"nearest": near, "exit": F.when(hit.isNotNull(), found).otherwise(fallback)})


def faces(point: DataFrame) -> DataFrame:
    """Adds the nearest of a box's six faces to a point inside or near it, ties by name, and where on the face it lies."""
    options = []
    for x in AXES:
        u, v = [o for o in AXES if o != x]
        for side, bound in (("-", f"{x}0"), ("+", f"{x}1")):
            options.append(F.struct(F.abs(F.col(x) - F.col(bound)).alias("distance"), F.lit(x + side).alias("face"), (F.col(u) - F.col(f"{u}0")).alias("u"), (F.col(v) - F.col(f"{v}0")).alias("v")))
    return point.withColumn("_f", F.array_min(F.array(*options))).select("*", "_f.face", "_f.u", "_f.v").drop("_f")
