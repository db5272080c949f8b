"""Logical structures of an underground layout: cave cells and pocket fragments grouped into the placements they are pieces of, and what can be
said of a whole layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.relational import histogram_topk
from ..operators.series import interpolated_midpoint
from .topology import role, tile_facts
from .underground import CELL, CHUNK, children, field, placements

WORLD = ["worldId", "row_id"]
#: Chunks along a cave's cell.
SIDE = 4


def spawners(nodes: DataFrame) -> DataFrame:
    """Spawners with their places in the world, tags in the order of their keys; those without a place or a scale are left out."""
    rows = children(nodes, field(nodes, "spawners"), "y").filter("kind = 'table' and y_kind = 'int'")
    cells = children(nodes, rows, "x").filter("kind = 'table' and x_kind = 'int'")
    one = children(nodes, cells, "n").filter("kind = 'table'").select("worldId", "row_id", F.col("p").alias("spawner"), F.col("x_int").alias("cell_x"), F.col("y_int").alias("cell_y"), "p")
    parts = children(nodes, one, "part")
    vector = lambda name: parts.filter((F.col("part_str") == name) & (F.col("kind") == "vec3")).select("row_id", "spawner", F.col("vector").alias(name))
    inner = children(nodes, parts.filter("part_str in ('tags', 'params') and kind = 'table'").withColumn("of", F.col("part_str")), "k")
    tags = inner.filter("of = 'tags' and kind = 'string' and k_kind = 'int'").groupBy("row_id", "spawner").agg(F.array_sort(F.collect_list(F.struct("k_int", "s"))).alias("t"))
    trigger = inner.filter("of = 'params' and k_str = 'triggerName' and kind = 'string'").select("row_id", "spawner", F.col("s").alias("trigger_name"))
    key = ["row_id", "spawner"]
    out = one.drop("p").join(vector("pos"), key).join(vector("scale"), key).join(tags, key, "left").join(trigger, key, "left")
    at = {c: F.get("pos", F.lit(k)) + (F.col(f"cell_{c}") * CELL if c != "z" else 0.0) for k, c in enumerate("xyz")}
    return out.select("worldId", *key, "cell_x", "cell_y", *[v.alias(c) for c, v in at.items()], "scale", F.coalesce(F.transform("t", lambda x: x["s"]), F.array().cast("array<string>")).alias("tags"), "trigger_name")


def known(tiles: DataFrame) -> DataFrame:
    """tiles: tile_uuid, path."""
    return tile_facts(tiles).select("tile_uuid", "name", "family", "tags", "tile_w", "tile_d", "tile_h")


def adjacent_components(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Adds component: cells (id, keys, cell_x, cell_y) connected through neighbours in x or y with equal keys. Null keys equal nothing."""
    at = [*keys, "cell_x", "cell_y"]
    places = graph.cut(cells.groupBy(*at).agg(F.min("id").alias("_least")))  # rows of one cell have the same neighbours
    shifted = places.select(F.col("_least").alias("b"), *keys, F.explode(F.array(F.struct((F.col("cell_x") - 1).alias("cell_x"), "cell_y"), F.struct("cell_x", (F.col("cell_y") - 1).alias("cell_y")))).alias("c"))
    links = places.join(shifted.select("b", *keys, "c.*"), at).select(F.col("_least").alias("a"), "b")
    found = places.join(graph.components(links).select(F.col("node").alias("_least"), "component"), "_least").select(*at, "component")
    return cells.join(found, at, "left").withColumn("component", F.coalesce("component", "id"))


def cave_structures(pieces: DataFrame, tiles: DataFrame) -> DataFrame:
    """Caves as structures. A cell of a known tile belongs to where that tile must begin; other cells to those next to them with the same tile and
    turn. Neighbours of one tile need not be of one structure, so the first way never looks at neighbours."""
    c = pieces.filter("kind = 'cave'").join(known(tiles), "tile_uuid", "left").withColumn("id", F.col("row_id") * (1 << 32) + F.col("node"))
    sx, sy, w, d, r = (F.col(x) for x in ("source_x", "source_y", "tile_w", "tile_d", "rotation"))
    fits = (w >= SIDE) & (d >= SIDE) & (w % SIDE == 0) & (d % SIDE == 0) & (sx % SIDE == 0) & (sy % SIDE == 0) & (sx >= 0) & (sy >= 0) & (sx + SIDE <= w) & (sy + SIDE <= d)
    fits = fits & (F.col("width") == CELL) & (F.col("depth") == CELL) & (F.col("x") == F.col("cell_x") * CELL) & (F.col("y") == F.col("cell_y") * CELL) & r.between(0, 3)
    c = c.withColumn("source_aware", F.coalesce(fits, F.lit(False)))
    ax = F.when(r == 1, d - sy - SIDE).when(r == 2, w - sx - SIDE).when(r == 3, sy).otherwise(sx)
    ay = F.when(r == 1, sx).when(r == 2, d - sy - SIDE).when(r == 3, w - sx - SIDE).otherwise(sy)
    sure = c.filter("source_aware").withColumn("group", F.concat_ws(":", F.lit("at"), F.col("cell_x") * SIDE - ax, F.col("cell_y") * SIDE - ay))
    rest = c.filter("not source_aware").withColumn("tile", F.coalesce("tile_uuid", F.concat(F.lit("#"), "tile_index")))
    rest = adjacent_components(rest, [*WORLD, "tile", "rotation", "z"]).withColumn("group", F.concat_ws(":", F.lit("near"), "component"))
    key = [*WORLD, "tile_uuid", "rotation", "z", "group", "source_aware"]
    both = sure.unionByName(rest.drop("tile", "component"))
    turned_w, turned_d = F.when(r % 2 == 1, d).otherwise(w), F.when(r % 2 == 1, w).otherwise(d)
    g = both.groupBy(*key).agg(
        F.count("*").alias("fragments"), F.countDistinct("source_x", "source_y").alias("sources"), F.min("tile_index").alias("tile_index"), F.first("name").alias("name"), F.first("family").alias("family"),
        F.first("tags").alias("tags"), *box_of(), F.max(F.ceil(w / SIDE) * F.ceil(d / SIDE)).alias("expected_fragments"), F.max(turned_w * CHUNK).alias("expected_width"),
        F.max(turned_d * CHUNK).alias("expected_depth"), F.max(F.col("tile_h") * CHUNK).alias("expected_height"),
    )
    size = {"x": "expected_width", "y": "expected_depth", "z": "expected_height"}
    same = F.lit(True)
    for axis, expected in size.items():
        same = same & (F.abs(F.col(f"{axis}1") - F.col(f"{axis}0") - F.col(expected)) < 1e-6)
    whole = (F.col("sources") == F.col("expected_fragments")) & (F.col("fragments") == F.col("sources"))
    g = g.withColumns({
        "complete": F.when(F.col("expected_fragments").isNotNull(), F.when(F.col("source_aware"), whole).otherwise(F.col("fragments") == F.col("expected_fragments"))),
        "overlap": F.when(F.col("source_aware"), F.col("fragments") - F.col("sources")), "dimensions_match": same, "name": F.coalesce("name", F.lit("<unknown>")), "family": F.coalesce("family", F.lit("unknown")),
    })
    order = Window.partitionBy(*WORLD).orderBy("z0", "y0", "x0", F.coalesce("tile_uuid", F.lit("")), "tile_index", "rotation", "group")
    return g.withColumn("structure_id", F.row_number().over(order)).drop("group", "sources")


def box_of() -> list[Column]:
    out = []
    for axis, size in (("x", "width"), ("y", "depth"), ("z", "height")):
        out += [F.min(axis).alias(f"{axis}0"), F.max(F.col(axis) + F.col(size)).alias(f"{axis}1")]
    return out


def pocket_structures(pieces: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pocket placements, numbered in order of their corner, tile and turn, with their boxes."""
    facts = known(tiles)
    p = placements(pieces, facts.select("tile_uuid", "tile_w", "tile_d").filter("tile_w is not null")).join(facts, "tile_uuid")
    quarter = F.col("rotation") % 2 == 1
    w, d = F.when(quarter, F.col("tile_d")).otherwise(F.col("tile_w")), F.when(quarter, F.col("tile_w")).otherwise(F.col("tile_d"))
    order = Window.partitionBy(*WORLD).orderBy("z", "origin_y", "origin_x", "tile_uuid", "rotation")
    box = {"x0": F.col("origin_x"), "x1": F.col("origin_x") + w * CHUNK, "y0": F.col("origin_y"), "y1": F.col("origin_y") + d * CHUNK, "z0": F.col("z"), "z1": F.col("z") + F.col("tile_h") * CHUNK}
    return p.withColumns(box | {"placement_id": F.row_number().over(order)})


def layout_nodes(structures: DataFrame, pockets: DataFrame) -> DataFrame:
    """Structures, then pocket placements, as the nodes of one topology a world: id, kind, name, family, tags, role, tile, turn, box."""
    box = [f"{c}{k}" for c in "xyz" for k in (0, 1)]
    a = structures.select(*WORLD, F.lit(0).alias("_k"), F.col("structure_id").alias("_n"), F.lit("structure").alias("kind"), "name", "family", F.array().cast("array<string>").alias("tags"), "tile_uuid", "rotation", *box)
    b = pockets.select(*WORLD, F.lit(1).alias("_k"), F.col("placement_id").alias("_n"), F.lit("pocket").alias("kind"), "name", "family", "tags", "tile_uuid", "rotation", *box)
    out = a.unionByName(b).withColumn("id", F.row_number().over(Window.partitionBy(*WORLD).orderBy("_k", "_n")))
    return out.drop("_k", "_n").withColumn("role", role(F.col("family"), F.col("tags")))


def layout_summary(structures: DataFrame, pockets: DataFrame) -> DataFrame:
    """Of each layout: structures by family, how many are whole and of the size of their tile, pockets, split ones, whole ones."""
    n = lambda c: F.count_if(c).alias
    s = structures.groupBy(*WORLD).agg(F.count("*").alias("structures"), F.sum("fragments").alias("cave_fragments"), n(F.col("complete"))("complete_structures"), n(F.col("dimensions_match"))("matching_structures"), n(F.col("source_aware"))("source_aware"))
    p = pockets.groupBy(*WORLD).agg(F.count("*").alias("pockets"), F.sum("fragments").alias("pocket_fragments"), n(F.col("fragments") > 1)("split_pockets"), n(F.col("complete"))("complete_pockets"), F.max("fragments").alias("most_fragments"))
    return s.join(p, WORLD, "full_outer")


def combined_bounds(parts: list[DataFrame]) -> DataFrame:
    """Least and greatest coordinates of each world over boxes (x0, x1, ...) of different kinds; a point is a box without extent."""
    out = None
    for p in parts:
        one = p.select("worldId", *[F.col(f"{c}{k}").cast("double").alias(f"{c}{k}") for c in "xyz" for k in (0, 1)])
        out = one if out is None else out.unionByName(one)
    return out.groupBy("worldId").agg(*[(F.min if k == 0 else F.max)(f"{c}{k}").alias(f"{c}{k}") for c in "xyz" for k in (0, 1)])


def coverage_status(worlds: DataFrame, tunnels: DataFrame, pieces: DataFrame, available: DataFrame) -> DataFrame:
    """(worldId, status, tunnels, caves, pockets): unavailable, no-layout, placements, or tunnels where any are saved."""
    t = tunnels.groupBy("worldId").agg(F.countDistinct("tunnel_id").alias("tunnels"))
    p = pieces.groupBy("worldId").agg(F.count_if(F.col("kind") == "cave").alias("caves"), F.count_if(F.col("kind") == "pocket").alias("pockets"))
    out = worlds.select("worldId", "world_depth").join(t, "worldId", "left").join(p, "worldId", "left").join(available.select("worldId", F.lit(True).alias("_a")).distinct(), "worldId", "left")
    out = out.fillna(0, ["tunnels", "caves", "pockets"])
    status = F.when(F.col("_a").isNull(), "unavailable").when(F.col("tunnels") > 0, "tunnels").when(F.col("caves") + F.col("pockets") > 0, "placements").otherwise("no-layout")
    return out.withColumn("status", status).drop("_a")


def preferred_world(coverage: DataFrame) -> DataFrame:
    """One row: the world to show first: with tunnels before placements before others, then the least depth, then the least id."""
    first = F.when(F.col("status") == "tunnels", 0).when(F.col("status") == "placements", 1).otherwise(2)
    return coverage.agg(F.min_by("worldId", F.struct(first.alias("s"), F.coalesce(F.col("world_depth").cast("double"), F.lit(float("inf"))).alias("d"), F.col("worldId").alias("w"))).alias("worldId"))


def tile_usage(pieces: DataFrame, tiles: DataFrame, top: int = 30) -> tuple[DataFrame, DataFrame]:
    """The most used tiles (index, uuid, kind) with their facts, ties by the first piece, and counts by family and tag."""
    facts = known(tiles).withColumn("is_known", F.lit(True))
    used = pieces.withColumn("tile", F.concat_ws("|", "tile_index", F.coalesce("tile_uuid", F.lit("")), "kind"))
    ranked = histogram_topk(used, "tile", top, "node").join(used.select("tile", "tile_index", "tile_uuid", "kind").distinct(), "tile").join(facts, "tile_uuid", "left").drop("tile").withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    own = pieces.join(facts, "tile_uuid", "left").select(F.coalesce("family", F.lit("unknown")).alias("family"), "tags")
    by = own.select(F.lit("family").alias("of"), F.col("family").alias("name")).unionByName(own.select(F.lit("tag").alias("of"), F.explode("tags").alias("name")))
    return ranked, by.groupBy("of", "name").agg(F.count("*").alias("pieces"))


# Tags of tiles that hold a resource.
RESOURCES = ["deposit", "gold", "sapphire", "sparkstone", "potato", "crystal", "corralium"]


def facets(kind: Column, family: Column, tags: Column) -> Column:
    """Search categories of a saved object, from the names of its tile alone; an object without a known tile is unknown."""
    has = lambda t: F.coalesce(F.array_contains(tags, t), F.lit(False))
    resource = F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, RESOURCES))), F.lit(False))
    options = [F.when(kind == "group", "cave"), F.when(family.isNull(), "unknown"), F.when((family == "elevator") | has("elevator"), "elevator"), F.when(has("passage"), "passage"), F.when(has("deposit"), "deposit"), F.when(resource, "resource"), F.when(kind == "tunnel", "tunnel")]
    return F.array_compact(F.array(*options))


def search_index(structures: DataFrame, pockets: DataFrame, fragments: DataFrame, tunnel_points: DataFrame) -> DataFrame:
    """What can be searched for in a layout: cave groups, pocket groups, pockets of unknown tiles, and tunnels at the middle of their length:
    kind, id, label, search_text, facets, x, y."""
    middle = lambda c: ((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(c)
    real = F.when(F.col("family") != "unknown", F.col("family"))
    text = lambda *parts: F.lower(F.concat_ws(" ", F.when(F.col("name") != "<unknown>", F.col("name")), real, F.array_join("tags", " "), "tile_uuid", *parts))
    entry = lambda df, kind, ident, label, search: df.select("worldId", F.lit(kind).alias("kind"), ident.cast("long").alias("id"), label.alias("label"), search.alias("search_text"), facets(F.lit(kind), real, F.col("tags")).alias("facets"), middle("x"), middle("y"))
    number = F.concat(F.lit("G"), "structure_id")
    groups = entry(structures, "group", F.col("structure_id"), F.when(F.col("name") != "<unknown>", F.col("name")).otherwise(F.concat(F.lit("Unidentified cave group "), number)), text(F.lit("cave group"), number))
    placed = entry(pockets, "pocket-group", F.col("placement_id"), F.col("name"), text(F.lit("pocket group"), F.concat(F.lit("PG"), "placement_id")))
    alone = fragments.filter("kind = 'pocket'").join(pockets.select(*WORLD, "tile_uuid").distinct(), [*WORLD, "tile_uuid"], "left_anti")
    alone = alone.select("worldId", F.col("node").alias("n"), F.lit("<unknown>").alias("name"), F.lit("unknown").alias("family"), F.array().cast("array<string>").alias("tags"), "tile_uuid", "tile_index", F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1"), F.col("y").alias("y0"), (F.col("y") + F.col("depth")).alias("y1"))
    tile = F.concat(F.lit("tile "), "tile_index")
    single = entry(alone, "pocket", F.col("n"), F.concat(F.lit("Unidentified pocket tile #"), "tile_index"), text(F.lit("pocket"), tile))
    mid = interpolated_midpoint(tunnel_points, ["worldId", "row_id", "tunnel_id", "tunnel_type"], "ord", ["x", "y", "z"])
    kind = F.when(F.trim("tunnel_type") != "", F.trim("tunnel_type")).otherwise("Unknown")
    name = F.concat(F.lit("tunnel #"), "tunnel_id")
    t = mid.filter("tunnel_id >= 0").select("worldId", F.lit("tunnel").alias("kind"), F.col("tunnel_id").cast("long").alias("id"), F.concat(F.initcap(name), F.lit(" · "), kind).alias("label"), F.lower(F.concat_ws(" ", F.lit("tunnel"), name, kind)).alias("search_text"), F.array(F.lit("tunnel")).alias("facets"), "x", "y")
    return groups.unionByName(placed).unionByName(single).unionByName(t)
