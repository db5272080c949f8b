"""Layouts as graphs: nodes are boxes, links are shared faces and recorded tunnels; components, roles, templates and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.boxes import faces, nearest_box
from ..operators.relational import snap, unordered_pair
from ..operators.spatial import face_contacts
from .regions import region_boxes

BOX = ["id", "x0", "x1", "y0", "y1", "z0", "z1"]


# What names of tiles say. Families in order of priority (in the name, or a folder of the path), tags in the order of their checks.
ELEVATOR = "elevator"
FOLDERS = [("/tunnelpocket/", "tunnel_pocket"), ("/cave/", "cave"), ("/pocket/", "pocket"), ("/poi/", "poi")]
TAGS = [
    ("passage", "passage"), ("deposit", "deposit"), ("dungeon", "dungeon"), ("minerbot", "minerbot"), ("elevator", "elevator"), ("corralium", "corralium"), ("gold", "gold"),
    ("sapphire", "sapphire"), ("spark", "sparkstone"), ("potato", "potato"), ("crystal", "crystal"), ("cyrstal", "crystal"), ("formation", "formations"),
]
#: Roles that a route may pass through.
TRANSIT = ["elevator", "cave", "passage", "tunnel_pocket"]


def tile_facts(tiles: DataFrame) -> DataFrame:
    """Adds name, family, tags (each once, in the order of their checks) and dimensions in chunks of tiles (path)."""
    path = F.lower(F.translate("path", "\\", "/"))
    low = F.regexp_extract(path, r"([^/]*)$", 1)
    family = F.lit("other")
    for folder, name in reversed(FOLDERS):
        family = F.when(path.contains(folder), name).otherwise(family)
    tags = F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(needle), F.lit(tag)) for needle, tag in TAGS])))
    dims = [F.expr(f"try_cast(regexp_extract(path, '(?i)_([0-9]+)x([0-9]+)x([0-9]+)[.]tile$', {k}) as int)") for k in (1, 2, 3)]
    return tiles.withColumns({"name": F.regexp_extract("path", r"([^/]*)$", 1), "family": F.when(low.contains(ELEVATOR), ELEVATOR).otherwise(family), "tags": tags, "tile_w": dims[0], "tile_d": dims[1], "tile_h": dims[2]})


def role(family: Column, tags: Column) -> Column:
    """What a node is for: elevators and caves by family, passages by tag, then the two kinds of pockets."""
    passage = F.coalesce(F.array_contains(tags, "passage"), F.lit(False))
    return F.when(family.isin(ELEVATOR, "cave"), family).when(passage, "passage").when(family.isin("tunnel_pocket", "pocket"), family).otherwise("other")


def endpoints(tunnels: DataFrame) -> DataFrame:
    """(tunnel_id, end: 0 or 1, x, y, z) of tunnels' points (tunnel_id, ord, x, y, z)."""
    e = tunnels.groupBy("tunnel_id").agg(F.min_by(F.struct(*"xyz"), "ord").alias("first"), F.max_by(F.struct(*"xyz"), "ord").alias("last"))
    return e.select("tunnel_id", F.posexplode(F.array("first", "last")).alias("end", "p")).select("tunnel_id", "end", "p.*")


def topology(nodes: DataFrame, tunnels: DataFrame, lengths: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Links (a, b, evidence, axis, tunnel_id, length, contact): face contacts, and tunnels whose ends lie at different nodes.

    A contact has the length of its nodes' centres and costs one contact; a tunnel has its own length and costs none.
    """
    ends = endpoints(tunnels).withColumn("point", F.struct("tunnel_id", "end"))
    at = nearest_box(ends.select("point", "x", "y", "z"), nodes.select(*BOX), tolerance).select("point.tunnel_id", "point.end", "box")
    pair = at.groupBy("tunnel_id").agg(F.min("box").alias("a"), F.max("box").alias("b"), F.count("*").alias("n")).filter("n = 2 and a <> b")
    t = pair.join(lengths.select("tunnel_id", "length"), "tunnel_id").select("a", "b", F.lit("tunnel").alias("evidence"), F.lit(None).cast("string").alias("axis"), "tunnel_id", "length", F.lit(0).alias("contact"))
    centre = nodes.select("id", *[((F.col(f"{x}0") + F.col(f"{x}1")) / 2).alias(x) for x in "xyz"])
    c = face_contacts(nodes.select(*BOX)).join(centre.select(F.col("id").alias("a"), *[F.col(x).alias(f"{x}a") for x in "xyz"]), "a").join(centre.select(F.col("id").alias("b"), *[F.col(x).alias(f"{x}b") for x in "xyz"]), "b")
    apart = F.sqrt(sum(((F.col(f"{x}a") - F.col(f"{x}b")) ** 2 for x in "xyz"), F.lit(0.0)))
    c = c.select("a", "b", F.lit("contact").alias("evidence"), "axis", F.lit(None).cast(t.schema["tunnel_id"].dataType).alias("tunnel_id"), apart.alias("length"), F.lit(1).alias("contact"))
    return c.unionByName(t)


def regions(nodes: DataFrame) -> DataFrame:
    """(id, region): boxes that overlap, directly or through others; regions numbered by their lowest corner (z, y, x), then size."""
    return region_boxes(nodes.select(*BOX)).select("id", "region")


def summary(nodes: DataFrame, links: DataFrame, horizontal_only: bool = False) -> DataFrame:
    """(component, size, roles) of the links, vertical contacts left out on demand; nodes without links are components too."""
    used = links.filter("axis is null or axis <> 'z'") if horizontal_only else links
    found = graph.components(used.select("a", "b"))
    own = nodes.join(found, nodes["id"] == found["node"], "left").select(F.coalesce("component", "id").alias("component"), "role")
    return own.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_set("role")).alias("roles"))


def pair_types(nodes: DataFrame, links: DataFrame) -> DataFrame:
    r = lambda c: nodes.select(F.col("id").alias(c), F.col("role").alias(f"role_{c}"))
    return links.join(r("a"), "a").join(r("b"), "b").groupBy("evidence", unordered_pair(F.col("role_a"), F.col("role_b")).alias("pair")).agg(F.count("*").alias("links"))


def routes(nodes: DataFrame, links: DataFrame, start_role: str = "elevator") -> DataFrame:
    """(node, contacts, distance, previous) from the only node of the role: recorded tunnels before shorter contacts."""
    start = nodes.filter(F.col("role") == start_role).select(F.col("id").alias("node"))
    if len(start.limit(2).collect()) != 1:
        raise ValueError(f"there is not exactly one {start_role}")
    zero = F.struct(F.lit(0).alias("contacts"), F.lit(0.0).alias("distance"))
    step = F.struct((F.col("cost.contacts") + F.col("contact")).alias("contacts"), (F.col("cost.distance") + F.col("length")).alias("distance"))
    return graph.cheapest(links.select("a", "b", "length", "contact"), start, step, zero).select("node", "cost.contacts", "cost.distance", "previous")


def route_to(nodes: DataFrame, tree: DataFrame, target: str) -> list:
    """Nodes of the route to the nearest node with the tag, or whose name holds the text; ignoring case."""
    t = target.lower()
    hit = nodes.filter(F.exists("tags", lambda x: F.lower(x) == t) | F.lower("name").contains(t)).select(F.col("id").alias("node"))
    best = tree.join(hit, "node").orderBy("contacts", "distance", "node").first()
    if best is None:
        raise ValueError(f"nothing reachable matches {target!r}")
    return graph.path_to(tree, best["node"])


def templates(observed: DataFrame, step: float = 4.0, least: int = 2) -> DataFrame:
    """Places on faces where tunnels were seen to leave tiles. observed: name, placement, x, y, z and the box it leaves.

    A place is kept if different placements of the tile show it; one placement that shows it twice is not enough.
    """
    f = faces(observed)
    g = f.groupBy("name", "face", snap(F.col("u"), step).alias("u"), snap(F.col("v"), step).alias("v")).agg(F.count("*").alias("seen"), F.countDistinct("placement").alias("placements"))
    return g.filter(F.col("placements") >= least)
