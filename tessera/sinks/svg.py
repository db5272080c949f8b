"""Maps as SVG. Scaling and opacity are expressions over DataFrames; the driver only writes elements."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Elements of a drawing; a larger one is an error, not a part of a drawing.
MOST_ELEMENTS = 100_000


def projected(points: DataFrame, width: float = 1000.0, margin: float = 20.0) -> DataFrame:
    """Adds sx, sy (y upwards, one scale for both axes) and opacity, which grows with z."""
    e = points.agg(*[f(c).alias(f"_{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    extent = F.greatest(F.col("_hi_x") - F.col("_lo_x"), F.col("_hi_y") - F.col("_lo_y"), F.lit(1e-9))
    scale = (width - 2 * margin) / extent
    out = points.join(F.broadcast(e)).withColumns({"sx": margin + (F.col("x") - F.col("_lo_x")) * scale, "sy": margin + (F.col("_hi_y") - F.col("y")) * scale})
    depth = (F.col("z") - F.col("_lo_z")) / F.greatest(F.col("_hi_z") - F.col("_lo_z"), F.lit(1e-9))
    return out.withColumn("opacity", 0.35 + 0.65 * depth).drop(*e.columns)


def gathered(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} elements")
    return rows


def tunnel_map(points: DataFrame, title: str = "", width: float = 1000.0, most: int = MOST_ELEMENTS) -> str:
    """Polylines of tunnels: tunnel_id, tunnel_type, ord, x, y, z."""
    p = projected(points, width)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sx", "sy"))), lambda q: F.format_string("%.2f,%.2f", q["sx"], q["sy"])), " ")
    lines = p.groupBy("tunnel_id", "tunnel_type").agg(line.alias("points"), F.avg("opacity").alias("opacity"))
    out = [f'<polyline class="{escape(r["tunnel_type"])}" fill="none" stroke="currentColor" stroke-opacity="{r["opacity"]:.2f}" points="{r["points"]}"/>' for r in gathered(lines.orderBy("tunnel_id"), most)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {width:g}"><title>{escape(title)}</title>' + "".join(out) + "</svg>"


def chunk_map(voxels: DataFrame, size: float = 8.0, most: int = MOST_ELEMENTS) -> str:
    """A panel for each level of decoded chunks, highest first. A drawing with gaps would mislead, so rejected records are an error."""
    if not voxels.filter("reject_reason is not null").isEmpty():
        raise ValueError("some records were rejected")
    c = voxels.groupBy("chunk_x", "chunk_y", "chunk_z").agg(F.count("*").alias("records"))
    e = c.agg(F.min("chunk_x").alias("x0"), F.max("chunk_x").alias("x1"), F.max("chunk_y").alias("y1"))
    level = c.select("chunk_z").distinct().withColumn("panel", F.row_number().over(Window.orderBy(F.desc("chunk_z"))) - 1)
    at = c.join(F.broadcast(level), "chunk_z").join(F.broadcast(e))
    at = at.select("chunk_z", "records", ((F.col("panel") * (F.col("x1") - F.col("x0") + 3) + F.col("chunk_x") - F.col("x0")) * size).alias("sx"), ((F.col("y1") - F.col("chunk_y")) * size).alias("sy"))
    rows = gathered(at.orderBy(F.desc("chunk_z"), "sx", "sy"), most)
    return '<svg xmlns="http://www.w3.org/2000/svg">' + "".join(f'<rect data-z="{r["chunk_z"]}" x="{r["sx"]:g}" y="{r["sy"]:g}" width="{size:g}" height="{size:g}"/>' for r in rows) + "</svg>"


def combined_map(pieces: DataFrame, tunnels: DataFrame, spawners: DataFrame, route: DataFrame | None = None, title: str = "", width: float = 1000.0, margin: float = 20.0, most: int = MOST_ELEMENTS) -> str:
    """One world's pieces (kind, x, y, width, depth) as rectangles, tunnels as in tunnel_map, spawners (x, y) as dots, all at one scale, and a route
    (step, x, y) drawn over them."""
    corner = [pieces.select(F.col("x") + d * F.col("width"), F.col("y") + d * F.col("depth")).toDF("x", "y") for d in (0, 1)]
    places = [*corner, tunnels.select("x", "y"), spawners.select("x", "y"), *([route.select("x", "y")] if route is not None else [])]
    every = places[0]
    for p in places[1:]:
        every = every.unionByName(p)
    e = every.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if e["x0"] is None:
        raise ValueError("there is nothing to draw")
    scale = (width - 2 * margin) / max(e["x1"] - e["x0"], e["y1"] - e["y0"], 1e-9)
    sx, sy = (lambda c: margin + (c - e["x0"]) * scale), (lambda c: margin + (e["y1"] - c) * scale)
    boxes = pieces.select("kind", sx(F.col("x")).alias("sx"), sy(F.col("y") + F.col("depth")).alias("sy"), (F.col("width") * scale).alias("w"), (F.col("depth") * scale).alias("h"))
    line = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, sx(F.col("x")).alias("sx"), sy(F.col("y")).alias("sy")))), lambda q: F.format_string("%.2f,%.2f", q["sx"], q["sy"])), " ")
    lines = tunnels.groupBy("tunnel_id", "tunnel_type").agg(line("ord").alias("points"))
    out = [f'<rect class="{escape(r["kind"])}" x="{r["sx"]:.2f}" y="{r["sy"]:.2f}" width="{r["w"]:.2f}" height="{r["h"]:.2f}"/>' for r in gathered(boxes.orderBy("kind", "sx", "sy"), most)]
    out += [f'<polyline class="{escape(r["tunnel_type"])}" fill="none" points="{r["points"]}"/>' for r in gathered(lines.orderBy("tunnel_id"), most)]
    out += [f'<circle cx="{r["sx"]:.2f}" cy="{r["sy"]:.2f}" r="2"/>' for r in gathered(spawners.select(sx(F.col("x")).alias("sx"), sy(F.col("y")).alias("sy")).orderBy("sx", "sy"), most)]
    if route is not None:
        out += [f'<polyline class="route" fill="none" points="{r["points"]}"/>' for r in route.agg(line("step").alias("points")).collect()]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {width:g}"><title>{escape(title)}</title>' + "".join(out) + "</svg>"


def report(df: DataFrame, most: int = MOST_ELEMENTS) -> list[str]:
    """Rows as JSON, in the order of the DataFrame; null fields are written as null."""
    return [r[0] for r in gathered(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})), most)]
