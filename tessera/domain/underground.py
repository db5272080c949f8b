"""Underground layouts from flattened values: pieces, tunnels, tiles, and their grouping into placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import argmax, bits
from ..sources.decode import scripts

CELL, CHUNK = 64.0, 16.0
#: Fixed values of the format: the keys at the top of a value that mark it as terrain.
SIGNALS = ["bounds", "caves", "pockets", "rotation", "spawners", "tileList", "tunnels", "uid", "xOffset", "yOffset"]


def terrain_rows(nodes: DataFrame, script: DataFrame) -> DataFrame:
    """For each world the row whose value has most of the signal keys, then most bytes unpacked; of equal ones the first in scan order, which is
    by packed bytes, most first, then by row id. A row with no signal key or a value that cannot be read whole is none. nodes: of all rows of
    script (row_id, worldId, data), rejections included."""
    own = F.when((F.col("depth") == 1) & F.col("key_str").isin(SIGNALS), F.col("key_str"))
    whole = nodes.groupBy("worldId", "row_id").agg(F.countDistinct(own).alias("signals"), F.count("reject_reason").alias("rejects")).filter("signals > 0 and rejects = 0")
    # Merged, as a broadcast of a row for each script would be the driver's.
    rows = script.join(whole.select("row_id", "signals").hint("merge"), "row_id").select("row_id", "worldId", "signals", "data")
    packed = rows.select("row_id", "signals", F.octet_length("data").alias("packed_size"))
    sized = scripts(rows).filter("reject_reason is null").select("row_id", "worldId", "size").join(packed.hint("merge"), "row_id")
    order = [F.col("signals"), F.col("size"), F.col("packed_size"), -F.col("row_id")]
    return argmax(sized, "worldId", order, ["row_id", "signals", "size", "packed_size"])


def children(nodes: DataFrame, parents: DataFrame, prefix: str) -> DataFrame:
    """Nodes under parents (row_id, p, ...), their key as <prefix>_int and <prefix>_str, their number as p."""
    c = nodes.select("row_id", F.col("parent").alias("p"), F.col("node").alias("_n"), F.col("key_int").alias(f"{prefix}_int"), F.col("key_str").alias(f"{prefix}_str"), F.col("key_kind").alias(f"{prefix}_kind"), F.col("value_kind").alias("kind"), "i", "s", "vector", "worldId")
    return parents.drop("kind", "i", "s", "vector", "worldId").join(c, ["row_id", "p"]).drop("p").withColumnRenamed("_n", "p")


def field(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter((F.col("depth") == 1) & (F.col("key_str") == name) & (F.col("value_kind") == "table")).select("row_id", F.col("node").alias("p"))


def tile_list(nodes: DataFrame) -> DataFrame:
    t = children(nodes, field(nodes, "tileList"), "tile").filter("kind = 'uuid' and tile_kind = 'int'")
    return t.select("row_id", F.col("tile_int").alias("tile_index"), F.col("s").alias("tile_uuid"))


def pieces(nodes: DataFrame) -> DataFrame:
    """Caves and pockets with their places and sizes in metres, unpacked from their integers."""
    out = None
    for kind in ("cave", "pocket"):
        rows = children(nodes, field(nodes, f"{kind}s"), "y").filter("kind = 'table' and y_kind = 'int'")
        cells = children(nodes, rows, "x").filter("kind = 'table' and x_kind = 'int'")
        v = children(nodes, cells, "n").filter("kind = 'int'").withColumn("v", F.col("i").bitwiseAND(0xFFFFFFFF))
        f = lambda at, width: bits(F.col("v"), at, width)
        if kind == "cave":
            at = {"x": F.lit(0), "y": F.lit(0), "z": f(8, 4), "w": F.lit(4), "d": F.lit(4), "h": f(12, 4) + 1, "sx": f(16, 2) * 4, "sy": f(18, 2) * 4, "rotation": f(20, 2)}
        else:
            turned = f(28, 2) % 2 == 1
            w, d = f(16, 2) + 1, f(18, 2) + 1
            at = {"x": f(8, 2), "y": f(10, 2), "z": f(12, 4), "w": F.when(turned, d).otherwise(w), "d": F.when(turned, w).otherwise(d), "h": f(20, 4) + 1, "sx": f(24, 2), "sy": f(26, 2), "rotation": f(28, 2)}
        m: dict[str, Column] = {"x": F.col("x_int") * CELL + at["x"] * CHUNK, "y": F.col("y_int") * CELL + at["y"] * CHUNK, "z": at["z"] * CHUNK, "width": at["w"] * CHUNK, "depth": at["d"] * CHUNK, "height": at["h"] * CHUNK}
        one = v.select("worldId", "row_id", F.col("p").alias("node"), F.lit(kind).alias("kind"), F.col("x_int").alias("cell_x"), F.col("y_int").alias("cell_y"), f(0, 8).alias("tile_index"), *[c.alias(k) for k, c in m.items()], at["rotation"].cast("int").alias("rotation"), at["sx"].cast("int").alias("source_x"), at["sy"].cast("int").alias("source_y"))
        out = one if out is None else out.unionByName(one)
    return out.join(tile_list(nodes), ["row_id", "tile_index"], "left")


def turned(x: Column, y: Column, w: Column, d: Column, rotation: Column) -> tuple[Column, Column]:
    """Where a source offset lies in a tile of w by d that is turned by quarters."""
    return (
        F.when(rotation == 0, x).when(rotation == 1, d - 1 - y).when(rotation == 2, w - 1 - x).otherwise(y),
        F.when(rotation == 0, y).when(rotation == 1, x).when(rotation == 2, d - 1 - y).otherwise(w - 1 - x),
    )


def placements(fragments: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pocket fragments grouped by where their whole tile must begin; complete if they cover it without overlap.

    tiles: tile_uuid, tile_w, tile_d in chunks. The covered cells are counted, never listed.
    """
    p = fragments.filter("kind = 'pocket'").join(tiles, "tile_uuid")
    quarter = F.col("rotation") % 2 == 1
    cw, cd = F.col("width") / CHUNK, F.col("depth") / CHUNK
    sw, sd = F.when(quarter, cd).otherwise(cw), F.when(quarter, cw).otherwise(cd)
    # the fragment's corner that is least after the turn
    ax, ay = turned(F.col("source_x"), F.col("source_y"), F.col("tile_w"), F.col("tile_d"), F.col("rotation"))
    bx, by = turned(F.col("source_x") + sw - 1, F.col("source_y") + sd - 1, F.col("tile_w"), F.col("tile_d"), F.col("rotation"))
    p = p.withColumns({"origin_x": F.col("x") - F.least(ax, bx) * CHUNK, "origin_y": F.col("y") - F.least(ay, by) * CHUNK, "_sw": sw, "_sd": sd})
    key = ["worldId", "row_id", "tile_uuid", "rotation", "origin_x", "origin_y", "z"]
    cells = p.withColumn("_cx", F.explode(F.expr("sequence(cast(source_x as int), cast(source_x + _sw - 1 as int))"))).withColumn("_cy", F.explode(F.expr("sequence(cast(source_y as int), cast(source_y + _sd - 1 as int))")))
    g = cells.groupBy(*key).agg(F.countDistinct("node").alias("fragments"), F.count("*").alias("cells"), F.countDistinct("_cx", "_cy").alias("covered"), (F.max("tile_w") * F.max("tile_d")).cast("long").alias("expected"), F.max("height").alias("height"))
    return g.withColumns({"overlap": F.col("cells") - F.col("covered"), "complete": (F.col("covered") == F.col("expected")) & (F.col("cells") == F.col("covered"))})


def tunnels(nodes: DataFrame) -> DataFrame:
    """Points of each tunnel in order of their keys; tunnels of fewer than two points are dropped."""
    t = children(nodes, field(nodes, "tunnels"), "tunnel").filter("kind = 'table' and tunnel_kind = 'int'")
    parts = children(nodes, t, "part")
    kind = parts.filter("part_str = 'tunnelType' and kind = 'string'").select("row_id", "tunnel_int", F.col("s").alias("tunnel_type"))
    points = children(nodes, parts.filter("part_str = 'positions' and kind = 'table'"), "ord").filter("kind = 'vec3' and ord_kind = 'int'")
    points = points.select("worldId", "row_id", "tunnel_int", F.col("ord_int").alias("ord"), *[F.get("vector", F.lit(k)).alias(c) for k, c in enumerate("xyz")])
    points = points.withColumn("_n", F.count("*").over(Window.partitionBy("row_id", "tunnel_int"))).filter("_n > 1").drop("_n")
    return points.join(kind, ["row_id", "tunnel_int"], "left").withColumn("tunnel_type", F.coalesce("tunnel_type", F.lit("Unknown"))).withColumnRenamed("tunnel_int", "tunnel_id")


def tunnel_lengths(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("row_id", "tunnel_id").orderBy("ord")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in "xyz"), F.lit(0.0)))
    return points.withColumn("_s", step).groupBy("worldId", "row_id", "tunnel_id", "tunnel_type").agg(F.count("*").alias("points"), F.sum("_s").alias("length"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def whole_tunnels(parts: DataFrame) -> DataFrame:
    """Lengths of tunnels whose points lie in several rows, each of which begins with the last point of the one before."""
    ends = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return parts.groupBy("worldId", "tunnel_id", "tunnel_type").agg((F.sum("points") - F.count("*") + 1).alias("points"), F.sum("length").alias("length"), *ends)
