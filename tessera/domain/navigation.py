"""Where tunnels leave tiles: endpoints with directions, the faces they leave by, templates learned from them, and contacts that these explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.boxes import AXES, canonical_point, inside, near_boxes, nearest_box, ray_exit, turned_point
from ..operators.grid import nearest_matching
from ..operators.relational import ladder, set_relations, snap, unordered_pair
from .topology import BOX, TRANSIT
from .underground import CHUNK

RAY_BOUNDS = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
CONTACT_BOUNDS = [4.1, 8.0, 16.0, 32.0]
EXACT, APART = 0.05, 1e-6


def directed_ends(points: DataFrame) -> DataFrame:
    """(tunnel_id, end: 0 or 1, x, y, z, dx, dy, dz) of tunnels' points (tunnel_id, ord, x, y, z): both ends, and the unit vector from each to the
    first point that lies apart from it; null where none does."""
    line = points.groupBy("tunnel_id").agg(F.array_sort(F.collect_list(F.struct("ord", *AXES))).alias("l"))  # one tunnel's points
    out = line.select("tunnel_id", F.posexplode(F.array("l", F.reverse("l"))).alias("end", "l")).withColumn("p", F.get("l", F.lit(0)))
    away = lambda q: F.sqrt(sum(((q[c] - F.col(f"p.{c}")) ** 2 for c in AXES), F.lit(0.0)))
    out = out.withColumn("q", F.get(F.filter("l", lambda q: away(q) > APART), F.lit(0)))
    n = F.sqrt(sum(((F.col(f"q.{c}") - F.col(f"p.{c}")) ** 2 for c in AXES), F.lit(0.0)))
    return out.select("tunnel_id", "end", *[F.col(f"p.{c}").alias(c) for c in AXES], *[((F.col(f"q.{c}") - F.col(f"p.{c}")) / n).alias(f"d{c}") for c in AXES])


def size(axis: str) -> Column:
    return F.col(f"tile_{ {'x': 'w', 'y': 'd', 'z': 'h'}[axis] }") * CHUNK


def observed(points: DataFrame, nodes: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Tunnel ends at the nodes (id, name, role, rotation, tile_w, tile_d, tile_h, box) they belong to: by which face they leave, how that was found, and
    where on the unturned tile that is. Ends without a direction, and nodes without known dimensions, are left out."""
    if not 0 <= tolerance <= 64:
        raise ValueError("tolerance must be between 0 and 64")
    ends = directed_ends(points)
    at = nearest_box(ends.select(F.struct("tunnel_id", "end").alias("point"), *AXES), nodes.select(*BOX), tolerance).select("point.tunnel_id", "point.end", F.col("box").alias("id"))
    rows = ends.filter("dx is not null").join(at, ["tunnel_id", "end"]).join(nodes.filter("tile_w is not null"), "id")
    out = ray_exit(rows)
    lx, ly = canonical_point(F.col("exit.x") - F.col("x0"), F.col("exit.y") - F.col("y0"), size("x"), size("y"), F.col("rotation"))
    own = {"x": lx, "y": ly, "z": F.col("exit.z") - F.col("z0")}
    options = []
    for c in AXES:
        u, v = [o for o in AXES if o != c]
        options += [F.struct(F.abs(d).alias("distance"), F.lit(c + s).alias("face"), own[u].alias("u"), own[v].alias("v")) for s, d in (("-", own[c]), ("+", size(c) - own[c]))]
    face = F.array_min(F.array(*options))
    return out.withColumn("_f", face).select("tunnel_id", "end", "id", "name", "role", "rotation", "exit.method", F.col("exit.face").alias("world_face"), F.col("exit.distance").alias("ray_distance"), F.col("nearest.face").alias("nearest_face"), F.col("nearest.distance").alias("nearest_distance"), "_f.face", "_f.u", "_f.v", *AXES)


def portal_profile(seen: DataFrame, step: float = 4.0) -> DataFrame:
    """Of each tile and place on it (face, u, v in steps): how many ends, at how many placements, repeated where two or more."""
    g = seen.groupBy("name", "face", snap(F.col("u"), step).alias("u"), snap(F.col("v"), step).alias("v")).agg(F.count("*").alias("seen"), F.countDistinct("id").alias("placements"))
    return g.withColumn("repeated", F.col("placements") >= 2)


def learned(seen: DataFrame, least: int = 2, step: float = 4.0) -> DataFrame:
    """Templates (name, face, u, v, seen, placements): places on a tile that so many of its placements show."""
    if least < 1 or step <= 0:
        raise ValueError("least and step must be positive")
    return portal_profile(seen, step).filter(F.col("placements") >= least).drop("repeated")


def ray_buckets(seen: DataFrame) -> DataFrame:
    return seen.groupBy("method", ladder(F.col("ray_distance"), RAY_BOUNDS).alias("bucket")).agg(F.count("*").alias("ends"))


def placed(templates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, face, x, y, z): where each node's templates lie in the world, and on which of its faces."""
    t = nodes.filter("tile_w is not null").join(templates.select("name", F.col("face").alias("own_face"), "u", "v"), "name")
    axis, far = F.substring("own_face", 1, 1), F.substring("own_face", 2, 1) == "+"
    side = {c: F.when(far, size(c)).otherwise(0.0) for c in AXES}
    local = {"x": F.when(axis == "x", side["x"]).otherwise(F.col("u")), "y": F.when(axis == "x", F.col("u")).when(axis == "y", side["y"]).otherwise(F.col("v")), "z": F.when(axis == "z", side["z"]).otherwise(F.col("v"))}
    wx, wy = turned_point(local["x"], local["y"], size("x"), size("y"), F.col("rotation"))
    at = t.select("id", "own_face", F.col("u").alias("own_u"), F.col("v").alias("own_v"), *BOX[1:], (F.col("x0") + wx).alias("x"), (F.col("y0") + wy).alias("y"), (F.col("z0") + local["z"]).alias("z"))
    near = F.array_min(F.array(*[F.struct(F.abs(F.col(c) - F.col(b)).alias("distance"), F.lit(c + s).alias("face")) for c in AXES for s, b in (("-", f"{c}0"), ("+", f"{c}1"))]))
    return at.withColumn("face", near["face"]).select("id", "face", "own_face", "own_u", "own_v", *AXES)


def contact_faces(contacts: DataFrame) -> DataFrame:
    """Adds face_a and face_b: the faces by which the nodes of a contact (a, b, axis, direction) touch."""
    sign = lambda forward: F.when((F.col("direction") > 0) == F.lit(forward), "+").otherwise("-")
    return contacts.withColumns({"face_a": F.concat("axis", sign(True)), "face_b": F.concat("axis", sign(False))})


def _sides(contacts: DataFrame, at: DataFrame) -> DataFrame:
    """Contacts beside the templates of both touching faces; a row for each pair, with nulls for a side without."""
    side = lambda s: at.select(F.col("id").alias(s), F.col("face").alias(f"face_{s}"), F.struct(*AXES).alias(f"at_{s}"))
    rows = contact_faces(contacts).join(side("a"), ["a", "face_a"], "left").join(side("b"), ["b", "face_b"], "left")
    apart = F.sqrt(sum(((F.col(f"at_a.{c}") - F.col(f"at_b.{c}")) ** 2 for c in AXES), F.lit(0.0)))
    return rows.withColumn("distance", apart)


def matches(contacts: DataFrame, at: DataFrame, tolerance: float = 4.1) -> DataFrame:
    """(a, b, axis, face_a, face_b, distance): every pair of templates on a contact's faces that lie within the tolerance."""
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    return _sides(contacts, at).filter(F.col("distance") <= tolerance).select("a", "b", "axis", "face_a", "face_b", "distance")


def diagnosed(contacts: DataFrame, nodes: DataFrame, templates: DataFrame) -> DataFrame:
    """Each contact with what its tiles' templates say of it: tiles (both, one or none have any), on_a and on_b (any on the touching face), and
    where both have, the closest pair's distance and bucket; and the roles of its nodes."""
    has = nodes.select("id", "name", "role").join(templates.select("name", F.lit(1).alias("has")).distinct(), "name", "left").select("id", "role", F.coalesce("has", F.lit(0)).alias("has"))
    end = lambda s: has.select(F.col("id").alias(s), F.col("role").alias(f"role_{s}"), F.col("has").alias(f"has_{s}"))
    sides = _sides(contacts, placed(templates, nodes)).groupBy("a", "b", "axis").agg(F.bool_or(F.col("at_a").isNotNull()).alias("on_a"), F.bool_or(F.col("at_b").isNotNull()).alias("on_b"), F.min("distance").alias("closest"))
    out = sides.join(end("a"), "a").join(end("b"), "b")
    n = F.col("has_a") + F.col("has_b")
    return out.select("a", "b", "axis", F.when(n == 2, "both").when(n == 1, "one").otherwise("none").alias("tiles"), "on_a", "on_b", unordered_pair(F.col("role_a"), F.col("role_b")).alias("roles"), "closest", ladder(F.col("closest"), CONTACT_BOUNDS).alias("bucket"))


def diagnosis_totals(rows: DataFrame) -> DataFrame:
    """One row: contacts by whose tiles, and whose touching faces, have templates."""
    n = lambda c, name: F.count_if(c).alias(name)
    t = F.col("tiles")
    return rows.agg(F.count("*").alias("contacts"), n(t == "both", "both_tiles"), n(t == "one", "one_tile"), n(t == "none", "no_tile"), n(F.col("on_a"), "on_a"), n(F.col("on_b"), "on_b"), n(F.col("on_a") & F.col("on_b"), "both_faces"))


def pairs(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidate_graph(contacts: DataFrame, tunnel_links: DataFrame, at: DataFrame, tolerance: float = 4.1) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, evidence: portal, tunnel or both) that may be passed, and how many each kind has."""
    p, t = pairs(matches(contacts, at, tolerance)), pairs(tunnel_links)
    both = p.withColumn("p", F.lit(True)).join(t.withColumn("t", F.lit(True)), ["a", "b"], "full_outer")
    return both.select("a", "b", F.when(F.col("p") & F.col("t"), "both").when(F.col("p"), "portal").otherwise("tunnel").alias("evidence")), set_relations(p, t, ["a", "b"])


def transit(nodes: DataFrame, contacts: DataFrame, tunnel_links: DataFrame, vertical: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, role, component, reachable) of the nodes that a route may pass, reachable if an elevator is in their component; and the edges used
    (a, b, evidence, axis)."""
    own = nodes.filter(F.col("role").isin(TRANSIT)).select("id", "role")
    keep = lambda e: e.join(own.select(F.col("id").alias("a")), "a", "left_semi").join(own.select(F.col("id").alias("b")), "b", "left_semi")
    c = contacts if vertical else contacts.filter("axis <> 'z'")
    edges = keep(c.select("a", "b", F.lit("contact").alias("evidence"), "axis")).unionByName(keep(tunnel_links.select("a", "b", F.lit("tunnel").alias("evidence"), F.lit(None).cast("string").alias("axis"))))
    found = graph.components(edges.filter("a <> b").select("a", "b")).select(F.col("node").alias("id"), "component")
    rows = own.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lifts = rows.filter("role = 'elevator'").select("component", F.lit(True).alias("_l")).distinct()
    return rows.join(lifts, "component", "left").select("id", "role", "component", F.coalesce("_l", F.lit(False)).alias("reachable")), edges


def portal_ends(portals: DataFrame, world: int) -> DataFrame:
    """(point: id and side, x, y, z, rotation) of verified portals that open into the world."""
    sure = portals.filter("matches")
    side = lambda s: sure.filter(F.col(f"world_{s}") == world).select(F.struct("id", F.lit(s).alias("side")).alias("point"), *[F.get(f"position_{s}", F.lit(k)).alias(c) for k, c in enumerate(AXES)], F.col(f"rotation_{s}").alias("rotation"))
    return side("a").unionByName(side("b"))


def portals_inside(ends: DataFrame, nodes: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(id, point, to_centre) for each portal end inside a node."""
    met = near_boxes(ends.select("point", *AXES), nodes.select(*BOX), tolerance).filter(inside(tolerance))
    centre = F.sqrt(sum(((F.col(c) - (F.col(f"{c}0") + F.col(f"{c}1")) / 2) ** 2 for c in AXES), F.lit(0.0)))
    return met.select("id", "point", *AXES, centre.alias("to_centre"))


def start_portals(at: DataFrame) -> DataFrame:
    """The portal of each node that is nearest to its centre, then of the least id and side."""
    return at.groupBy("id").agg(F.min_by(F.struct("point", *AXES), F.struct("to_centre", "point")).alias("p")).select("id", "p.point", *[F.col(f"p.{c}").alias(c) for c in AXES])


def socket_matches(sockets: DataFrame, ends: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(l, r, d, quality): sockets (point, x, y, z) to saved ends (point, x, y, z), closest pair first, each used once."""
    met = nearest_matching(sockets, ends, [*AXES], tolerance, "point")
    return met.withColumn("quality", F.when(F.col("d") <= EXACT, "exact").otherwise("near"))


def aligned(sockets: DataFrame, ends: DataFrame, tolerance: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(tunnel_id, end, socket, residual) of saved ends with exactly one socket within the tolerance, and the verdict: a placement is anchored by two
    sockets and two tunnels."""
    s = sockets.select("point", *[F.col(c).alias(f"{c}{k}") for c in AXES for k in (0, 1)]).withColumnRenamed("point", "id")
    met = near_boxes(ends, s, tolerance).groupBy("point").agg(F.min(F.struct("distance", "id")).alias("n"), F.count("*").alias("within")).filter("within = 1")
    found = met.select("point.tunnel_id", "point.end", F.col("n.id").alias("socket"), F.col("n.distance").alias("residual"))
    v = found.agg(F.countDistinct("socket").alias("distinct_sockets"), F.countDistinct("tunnel_id").alias("distinct_tunnels"), F.max("residual").alias("max_residual"))
    enough = (F.col("distinct_sockets") >= 2) & (F.col("distinct_tunnels") >= 2)
    return found, v.withColumn("status", F.when(enough, "two_or_more_independent_tunnel_anchors").otherwise("insufficient_independent_tunnel_anchors"))
