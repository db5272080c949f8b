"""The graph of a world's underground: regions of overlapping pieces, and tunnels that lead from one to another or end free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.boxes import nearest_group, overlaps
from ..operators.grid import close_components
from ..operators.relational import numbered
from ..operators.spatial import shapes

BOUNDS = [f"{x}{k}" for x in "xyz" for k in (0, 1)]

# Kinds of tunnels that can be walked, and those that are veins.
CORRIDORS = ["TtDefault"]
VEINS = ["MainVein", "CrossVein", "TtVeinRich", "TtVeinT1", "TtVeinT4", "TtVeinSparkstone"]


def tunnel_role(kind: Column) -> Column:
    return F.when(kind.isin(CORRIDORS), "corridor").when(kind.isin(VEINS), "vein").otherwise("unknown")


def checked(value: float, most: float, name: str) -> None:
    if not 0 <= value <= most:
        raise ValueError(f"{name} must be between 0 and {most:g}")


def piece_boxes(pieces: DataFrame) -> DataFrame:
    size = {"x": "width", "y": "depth", "z": "height"}
    return pieces.select(F.col("node").alias("id"), "kind", *[c for x in "xyz" for c in (F.col(x).alias(f"{x}0"), (F.col(x) + F.col(size[x])).alias(f"{x}1"))])


def _shape_components(kinds: DataFrame, members: DataFrame) -> DataFrame:
    """(id, component: its least id) of boxes whose shape has an inside: equal ones overlap, so only shapes are compared."""
    thick = F.lit(True)
    for x in "xyz":
        thick = thick & (F.col(f"{x}1") - F.col(f"{x}0") > 1e-6)
    kinds = kinds.filter(thick)
    met = graph.components(overlaps(kinds.withColumnRenamed("_shape", "id"))).select(F.col("node").alias("_shape"), "component")
    named = kinds.select("_shape").join(met, "_shape", "left").select("_shape", F.coalesce("component", "_shape").alias("_c"))
    own = graph.cut(members.join(named, "_shape"))
    return own.join(own.groupBy("_c").agg(F.min("_member").alias("component")), "_c").select(F.col("_member").alias("id"), "component").distinct()


def region_boxes(boxes: DataFrame) -> DataFrame:
    """boxes (id, kind, x0, ...) with their region: those that overlap, directly or through others; regions are numbered by their least corner
    (z, y, x), then size."""
    kinds, members = shapes(boxes, "id", BOUNDS)
    members = graph.cut(members)
    if members.groupBy("_member").agg(F.countDistinct("_shape").alias("n")).filter("n > 1").isEmpty():
        found = _shape_components(kinds, members)
    else:  # an id with several boxes joins them
        found = graph.components(overlaps(boxes.drop("kind"))).select(F.col("node").alias("id"), "component")
    own = boxes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    order = own.groupBy("component").agg(F.min("z0").alias("z"), F.min("y0").alias("y"), F.min("x0").alias("x"), F.count("*").alias("n"))
    return own.join(numbered(order, ["z", "y", "x", "n", "component"], "region").select("component", "region"), "component").drop("component")


def linked_points(points: DataFrame, tolerance: float) -> DataFrame:
    """Adds group: points (point, x, y, z) that lie within the tolerance of each other, directly or through others; the least point names it."""
    found = close_components(points.select("point", "x", "y", "z"), ["x", "y", "z"], tolerance, "point").select("point", F.col("component").alias("group"))
    return points.join(found, "point")


def free_nodes(points: DataFrame, tolerance: float) -> DataFrame:
    """points with junction: free ends that meet, numbered by their least corner (z, y, x)."""
    grouped = linked_points(points, tolerance)
    g = grouped.groupBy("group").agg(F.min("z").alias("z"), F.min("y").alias("y"), F.min("x").alias("x"))
    return grouped.join(numbered(g, ["z", "y", "x", "group"], "junction").select("group", "junction"), "group").drop("group")


def attached(points: DataFrame, regions: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(region, count) of the points (point, x, y, z) that have a region within the tolerance, and the points that have none."""
    at = nearest_group(points, regions, "region", tolerance)
    return at.groupBy("region").agg(F.count("*").alias("count")), points.join(at.select("point"), "point", "left_anti")


def region_graph(pieces: DataFrame, ends: DataFrame, tunnels: DataFrame, spawners: DataFrame, region_tolerance: float = 4.0, endpoint_tolerance: float = 6.0) -> tuple[DataFrame, DataFrame]:
    """Of one world, nodes (node, kind, x, y, z, region, caves, pockets, spawners) and edges (tunnel_id, tunnel_type, role, a, b, length).

    ends: tunnel_id, end, x, y, z; tunnels: tunnel_id, tunnel_type, length. Regions come first; then junctions, where free ends meet, and terminals.
    """
    checked(region_tolerance, 64, "region_tolerance")
    checked(endpoint_tolerance, 64, "endpoint_tolerance")
    boxes = graph.cut(region_boxes(piece_boxes(pieces)))
    counts, _ = attached(spawners.select(F.col("spawner").alias("point"), "x", "y", "z"), boxes, region_tolerance)
    middle = lambda c: ((F.min(f"{c}0") + F.max(f"{c}1")) / 2).alias(c)
    own = boxes.groupBy("region").agg(*map(middle, "xyz"), F.count_if(F.col("kind") == "cave").alias("caves"), F.count_if(F.col("kind") == "pocket").alias("pockets"))
    own = own.join(counts.withColumnRenamed("count", "spawners"), "region", "left").fillna(0, ["spawners"])
    points = ends.select(F.struct("tunnel_id", "end").alias("point"), "x", "y", "z")
    at = graph.cut(nearest_group(points, boxes, "region", region_tolerance))
    free = graph.cut(free_nodes(points.join(at.select("point"), "point", "left_anti"), endpoint_tolerance))
    shift = boxes.agg(F.coalesce(F.max("region"), F.lit(0)).alias("shift"))
    free = free.withColumn("_one", F.lit(1)).join(shift.withColumn("_one", F.lit(1)), "_one").withColumn("node", F.col("junction") + F.col("shift"))
    j = free.groupBy("node").agg(F.when(F.count("*") > 1, "junction").otherwise("terminal").alias("kind"), *[F.avg(c).alias(c) for c in "xyz"])
    nodes = own.select(F.col("region").alias("node"), F.lit("region").alias("kind"), "x", "y", "z", "region", "caves", "pockets", "spawners").unionByName(j, allowMissingColumns=True).fillna(0, ["caves", "pockets", "spawners"])
    end = at.select("point", F.col("region").alias("node")).unionByName(free.select("point", "node"))
    pair = end.groupBy("point.tunnel_id").agg(F.max(F.when(F.col("point.end") == 0, F.col("node"))).alias("a"), F.max(F.when(F.col("point.end") == 1, F.col("node"))).alias("b"))
    edges = tunnels.join(pair, "tunnel_id").select("tunnel_id", "tunnel_type", tunnel_role(F.col("tunnel_type")).alias("role"), "a", "b", "length")
    return nodes, edges


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, corridors, components, the largest, isolated nodes, dead ends, loops; a loop counts twice in its node's degree."""
    deg = graph.degrees(edges.select("a", "b"))
    d = nodes.select("node").join(deg.select("node", "degree"), "node", "left").fillna(0, ["degree"])
    found = graph.components(edges.filter("a <> b").select("a", "b"))
    parts = nodes.select("node").join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.count("*").alias("size"))
    one = F.lit(1).alias("_one")
    a = d.agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolated"), F.count_if(F.col("degree") == 1).alias("dead_ends"), F.max("degree").alias("most_degree")).select("*", one)
    b = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("role") == "corridor").alias("corridors"), F.count_if(F.col("a") == F.col("b")).alias("loops")).select("*", one)
    return a.join(b, "_one").join(parts.agg(F.count("*").alias("components"), F.max("size").alias("largest")).select("*", one), "_one").drop("_one")
