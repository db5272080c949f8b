"""Layouts on the driver's tables: boxes, points and lines made of rows, and the graphs over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..domain import layout, navigation, regions
from ..functions.surface import register
from ..operators import boxes as B
from ..operators.relational import numbered

AXES = "xyz"

#: Suppliers as boxes of 16 to 80 m, customers as points among them.
BOXES = """SELECT s_suppkey AS id, s_nationkey AS nation, (s_suppkey * 37 % 400)::DOUBLE AS x0, (s_suppkey * 37 % 400 + 16 * (s_nationkey % 5 + 1))::DOUBLE AS x1, (s_suppkey * 53 % 400)::DOUBLE AS y0, (s_suppkey * 53 % 400 + 16 * (s_nationkey % 3 + 1))::DOUBLE AS y1,
    (s_suppkey % 4 * 16)::DOUBLE AS z0, (s_suppkey % 4 * 16 + 32)::DOUBLE AS z1 FROM supplier"""
POINTS = "SELECT c_custkey AS point, (c_custkey * 31 % 500)::DOUBLE AS x, (c_custkey * 17 % 450)::DOUBLE AS y, (c_custkey % 80)::DOUBLE AS z FROM customer"


def supplier_boxes(table) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    at = {"x0": k * 37 % 400, "x1": k * 37 % 400 + 16 * (n % 5 + 1), "y0": k * 53 % 400, "y1": k * 53 % 400 + 16 * (n % 3 + 1), "z0": k % 4 * 16, "z1": k % 4 * 16 + 32}
    return table("supplier").select(k.alias("id"), n.alias("nation"), F.lit("cave").alias("kind"), *[v.cast("double").alias(c) for c, v in at.items()])


def customer_points(table) -> DataFrame:
    k = F.col("c_custkey")
    return table("customer").select(k.alias("point"), *[v.cast("double").alias(c) for c, v in {"x": k * 31 % 500, "y": k * 17 % 450, "z": k % 80}.items()])


OVER = " AND ".join(f"least(a.{c}1, b.{c}1) - greatest(a.{c}0, b.{c}0) > 1e-6" for c in AXES)


@query(f"""WITH RECURSIVE b AS ({BOXES}), x AS (SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.id <> b.id AND {OVER}), r(node, to_) AS (SELECT id, id FROM b UNION SELECT r.node, x.b FROM r JOIN x ON r.to_ = x.a),
    c AS (SELECT node AS id, min(to_) AS component FROM r GROUP BY 1), o AS (SELECT component, min(z0) AS z, min(y0) AS y, min(x0) AS x, count(*) AS n FROM b JOIN c USING (id) GROUP BY 1), k AS (SELECT component, row_number() OVER (ORDER BY z, y, x, n, component) AS region FROM o)
    SELECT id, region FROM c JOIN k USING (component)""")
def overlap_regions(table, spark):
    """Boxes that overlap, directly or through others, as numbered regions."""
    return regions.region_boxes(supplier_boxes(table).drop("nation")).select("id", "region")


NEAR = " + ".join(f"greatest(b.{c}0 - p.{c}, p.{c} - b.{c}1, 0) ** 2" for c in AXES)


@query(f"""SELECT point, nation, round(distance, 6) AS distance FROM (SELECT p.point, b.nation, sqrt({NEAR}) AS distance, row_number() OVER (PARTITION BY p.point ORDER BY sqrt({NEAR}), b.nation) AS k FROM ({POINTS}) p JOIN ({BOXES}) b ON sqrt({NEAR}) <= 8) WHERE k = 1""")
def nearest_region(table, spark):
    """The nearest group of boxes within 8 m of each point, equal distances to the lowest group."""
    at = B.nearest_group(customer_points(table), supplier_boxes(table).drop("kind"), "nation", 8.0)
    return at.select("point", "nation", F.round("distance", 6).alias("distance"))


@query(f"""WITH n AS (SELECT point, min(sqrt({NEAR})) AS d FROM ({POINTS}) p JOIN ({BOXES}) b ON sqrt({NEAR}) <= 8 GROUP BY 1) SELECT count(*) AS points, count(d) AS attached FROM ({POINTS}) LEFT JOIN n USING (point)""")
def attached_points(table, spark):
    """How many points have a region within 8 m."""
    counts, alone = regions.attached(customer_points(table), supplier_boxes(table).select("id", F.col("nation").alias("region"), *[f"{c}{k}" for c in AXES for k in (0, 1)]), 8.0)
    one = F.lit(1).alias("_one")
    both = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("attached")).select("*", one).join(alone.agg(F.count("*").alias("alone")).select("*", one), "_one")
    return both.select((F.col("attached") + F.col("alone")).alias("points"), "attached")


@query(f"""SELECT id, point FROM (SELECT b.id, p.point, row_number() OVER (PARTITION BY b.id ORDER BY sqrt((p.x - (b.x0 + b.x1) / 2) ** 2 + (p.y - (b.y0 + b.y1) / 2) ** 2 + (p.z - (b.z0 + b.z1) / 2) ** 2), p.point) AS k
    FROM ({POINTS}) p JOIN ({BOXES}) b ON p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1 AND p.z BETWEEN b.z0 AND b.z1) WHERE k = 1""")
def central_points(table, spark):
    """The point inside each box that is nearest to its middle, then of the least number."""
    at = navigation.portals_inside(customer_points(table), supplier_boxes(table))
    return navigation.start_portals(at).select("id", "point")


ENDS = "SELECT o_orderkey AS point, (o_orderkey * 13 % 3000)::DOUBLE AS x, (o_custkey * 29 % 3000)::DOUBLE AS y, (o_orderkey % 5 * 3)::DOUBLE AS z FROM orders"


@query(f"""WITH RECURSIVE p AS ({ENDS}), x AS (SELECT a.point AS a, b.point AS b FROM p a JOIN p b ON a.point <> b.point AND abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 6),
    r(node, to_) AS (SELECT a, a FROM x UNION SELECT r.node, x.b FROM r JOIN x ON r.to_ = x.a), c AS (SELECT node AS point, min(to_) AS g FROM r GROUP BY 1), j AS (SELECT coalesce(g, point) AS g, min(z) AS z, min(y) AS y, min(x) AS x, count(*) AS ends FROM p LEFT JOIN c USING (point) GROUP BY 1)
    SELECT row_number() OVER (ORDER BY z, y, x, g) AS junction, ends FROM j""")
def endpoint_junctions(table, spark):
    """Ends of lines within 6 m of each other, directly or through others, as numbered junctions."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = table("orders").select(k.alias("point"), *[v.cast("double").alias(n) for n, v in {"x": k * 13 % 3000, "y": c * 29 % 3000, "z": k % 5 * 3}.items()])
    return regions.free_nodes(p, 6.0).groupBy("junction").agg(F.count("*").alias("ends"))


CELLS = """SELECT p_partkey AS id, (p_partkey % 61)::INT AS cx, (p_partkey // 61 % 211)::INT AS cy, p_partkey % 3 = 0 AS known, (p_partkey % 2)::INT AS tile, (p_size % 2)::INT AS r, (p_size // 2 % 2 * 4)::INT AS sx, (p_size // 4 % 2 * 4)::INT AS sy FROM part"""


@query(f"""WITH RECURSIVE c AS ({CELLS}), f AS (SELECT * FROM c WHERE NOT known), x AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.tile = b.tile AND a.r = b.r AND abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1),
    w(node, to_) AS (SELECT a, a FROM x UNION SELECT w.node, x.b FROM w JOIN x ON w.to_ = x.a), g AS (SELECT node AS id, min(to_) AS m FROM w GROUP BY 1),
    k AS (SELECT *, CASE WHEN known THEN 'at' || (cx * 4 - CASE WHEN r = 1 THEN 8 - sy - 4 ELSE sx END) || ':' || (cy * 4 - CASE WHEN r = 1 THEN sx ELSE sy END) || ':' || tile || ':' || r ELSE 'near' || coalesce(m, id) END AS key FROM c LEFT JOIN g USING (id))
    SELECT source_aware, x0::DOUBLE AS x0, y0::DOUBLE AS y0, tile, rotation, fragments, CASE WHEN source_aware THEN fragments = 4 AND sources = 4 END AS complete FROM (
      SELECT key, known AS source_aware, min(cx) * 64 AS x0, min(cy) * 64 AS y0, any_value(tile) AS tile, any_value(r) AS rotation, count(*) AS fragments, count(DISTINCT (sx, sy)) AS sources FROM k GROUP BY key, known)""")
def cave_structures(table, spark):
    """Cells of caves as structures: by where their tile must begin, or by neighbours where the tile is not known."""
    k, s = F.col("p_partkey"), F.col("p_size")
    cx, cy, tile = k % 61, F.floor(k / 61) % 211, k % 2
    name = F.concat(F.when(k % 3 == 0, "known").otherwise("other"), tile)
    pieces = table("part").select(
        F.lit(1).alias("worldId"), F.lit(1).cast("long").alias("row_id"), k.alias("node"), F.lit("cave").alias("kind"), cx.cast("int").alias("cell_x"), cy.cast("int").alias("cell_y"), tile.cast("int").alias("tile_index"), name.alias("tile_uuid"),
        (cx * 64.0).alias("x"), (cy * 64.0).alias("y"), F.lit(0.0).alias("z"), *[F.lit(64.0).alias(n) for n in ("width", "depth", "height")], (s % 2).cast("int").alias("rotation"), (F.floor(s / 2) % 2 * 4).cast("int").alias("source_x"), (F.floor(s / 4) % 2 * 4).cast("int").alias("source_y"),
    )
    tiles = spark.createDataFrame([(f"known{t}", f"a/cave/room_{t}_8x8x4.tile") for t in (0, 1)], "tile_uuid string, path string")
    found = layout.cave_structures(pieces, tiles)
    return found.select("source_aware", "x0", "y0", F.col("tile_index").cast("int").alias("tile"), "rotation", "fragments", F.when(F.col("source_aware"), F.col("complete")).alias("complete"))


@query("""SELECT p_partkey AS id, CASE r WHEN 1 THEN d - y WHEN 2 THEN w - x WHEN 3 THEN y ELSE x END AS wx, CASE r WHEN 1 THEN x WHEN 2 THEN d - y WHEN 3 THEN w - x ELSE y END AS wy, x, y FROM (
    SELECT p_partkey, p_size % 4 AS r, (p_partkey % 64)::DOUBLE AS x, (p_partkey % 32)::DOUBLE AS y, 64.0::DOUBLE AS w, 32.0::DOUBLE AS d FROM part)""")
def turned_points(table, spark):
    """Points of a tile turned by quarters, and turned back."""
    w, d, r = F.lit(64.0), F.lit(32.0), (F.col("p_size") % 4).cast("int")
    x, y = (F.col("p_partkey") % 64).cast("double"), (F.col("p_partkey") % 32).cast("double")
    wx, wy = B.turned_point(x, y, w, d, r)
    t = table("part").select(F.col("p_partkey").alias("id"), wx.alias("wx"), wy.alias("wy"), r.alias("r"))
    bx, by = B.canonical_point(F.col("wx"), F.col("wy"), w, d, F.col("r"))
    return t.select("id", "wx", "wy", bx.alias("x"), by.alias("y"))


@query("""SELECT event_id, ['x+', 'x-', 'y+', 'y-', 'z+', 'z-'][k + 1] AS face, CASE k WHEN 0 THEN 32 - x WHEN 1 THEN x WHEN 2 THEN 32 - y WHEN 3 THEN y WHEN 4 THEN 32 - z ELSE z END AS distance, 'ray' AS method FROM (
    SELECT event_id, event_id % 6 AS k, (event_id % 31 + 0.5)::DOUBLE AS x, (user_id % 29 + 0.25)::DOUBLE AS y, (event_id % 23 + 1.125)::DOUBLE AS z FROM events)""")
def ray_exits(table, spark):
    """By which face of a box a ray from inside leaves it, and how far off that is."""
    e, k = F.col("event_id"), F.col("event_id") % 6
    at = {"x": e % 31 + 0.5, "y": F.col("user_id") % 29 + 0.25, "z": e % 23 + 1.125}
    way = {f"d{c}": F.when(k == 2 * n, 1.0).when(k == 2 * n + 1, -1.0).otherwise(0.0) for n, c in enumerate(AXES)}
    rows = table("events").select("event_id", *[v.cast("double").alias(c) for c, v in at.items()], *[v.alias(c) for c, v in way.items()], *[F.lit(32.0 * n).alias(f"{c}{n}") for c in AXES for n in (0, 1)])
    return B.ray_exit(rows).select("event_id", "exit.face", "exit.distance", "exit.method")


LINES = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value AS x, (event_id % 100)::DOUBLE AS y, (event_id % 7)::DOUBLE AS z, count(*) OVER (PARTITION BY user_id) AS m FROM events"


@query(f"""WITH l AS ({LINES}), a AS (SELECT * FROM l WHERE n = 1), b AS (SELECT * FROM l WHERE n = 2), y AS (SELECT * FROM l WHERE n = m), z AS (SELECT * FROM l WHERE n = m - 1),
    d AS (SELECT user_id, 0 AS "end", a.x AS px, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM a JOIN b USING (user_id) UNION ALL SELECT user_id, 1, y.x, z.x - y.x, z.y - y.y, z.z - y.z FROM y JOIN z USING (user_id))
    SELECT user_id AS tunnel_id, "end"::INT AS "end", px AS x, round(dx / sqrt(dx * dx + dy * dy + dz * dz), 6) AS dx, round(dz / sqrt(dx * dx + dy * dy + dz * dz), 6) AS dz FROM d""")
def line_directions(table, spark):
    """Both ends of each user's line, and the direction in which it leaves them (neighbouring points never coincide here)."""
    e = table("events").select(F.col("user_id").alias("tunnel_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), (F.col("event_id") % 7).cast("double").alias("z"))
    d = navigation.directed_ends(e).filter("dx is not null")
    return d.select("tunnel_id", F.col("end").cast("int").alias("end"), "x", F.round("dx", 6).alias("dx"), F.round("dz", 6).alias("dz"))


@query(f"""WITH c AS (SELECT p.point, b.id, sqrt({NEAR}) AS d FROM ({POINTS}) p JOIN ({BOXES}) b ON sqrt({NEAR}) <= 1) SELECT point AS tunnel_id, any_value(id) AS socket FROM c GROUP BY point HAVING count(*) = 1""")
def anchored_ends(table, spark):
    """Points with exactly one box within a metre."""
    p = customer_points(table).select(F.struct(F.col("point").alias("tunnel_id"), F.lit(0).alias("end")).alias("point"), *AXES)
    met = B.near_boxes(p, supplier_boxes(table), 1.0).groupBy("point").agg(F.min(F.struct("distance", "id")).alias("n"), F.count("*").alias("within"))
    return met.filter("within = 1").select("point.tunnel_id", F.col("n.id").alias("socket"))


TYPES = "SELECT user_id, user_id % 6 AS s FROM (SELECT DISTINCT user_id FROM events)"


@query(f"""SELECT s::INT AS "worldId", CASE WHEN s = 5 THEN 'unavailable' WHEN t > 0 THEN 'tunnels' WHEN p > 0 THEN 'placements' ELSE 'no-layout' END AS status FROM (
    SELECT s, count(*) FILTER (s < 2) AS t, count(*) FILTER (s = 2 OR s = 3) AS p FROM ({TYPES}) GROUP BY s)""")
def world_coverage(table, spark):
    """What each world's saved layout holds."""
    u = table("events").select("user_id", (F.col("user_id") % 6).cast("int").alias("worldId")).distinct()
    worlds = u.select("worldId", F.lit(1).alias("world_depth")).distinct()
    tunnels = u.filter("worldId < 2").select("worldId", F.col("user_id").alias("tunnel_id"))
    pieces = u.filter("worldId in (2, 3)").select("worldId", F.lit("cave").alias("kind"))
    return layout.coverage_status(worlds, tunnels, pieces, u.filter("worldId <> 5")).select("worldId", "status")


#: Nations as the nodes of a grid of rooms; which may be passed, and what joins them.
ROLES = ["cave", "passage", "pocket", "tunnel_pocket", "other", "cave", "passage"]
ROOMS = "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN 'elevator' ELSE [" + ", ".join(f"'{r}'" for r in ROLES) + "][n_nationkey % 7 + 1] END AS role, n_nationkey % 5 AS i, n_nationkey // 5 AS j FROM nation"
PASSED = f"SELECT * FROM ({ROOMS}) WHERE role IN ('elevator', 'cave', 'passage', 'tunnel_pocket')"
JOINED = f"SELECT a.id AS a, b.id AS b FROM ({PASSED}) a JOIN ({PASSED}) b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 UNION SELECT a.id, b.id FROM ({PASSED}) a JOIN ({PASSED}) b ON a.id <> b.id AND (b.id = (a.id * 7 + 3) % 25 OR a.id = (b.id * 7 + 3) % 25) AND least(a.id, b.id) % 3 = 0"


def rooms(table) -> DataFrame:
    k = F.col("n_nationkey")
    role = F.when(k == 0, "elevator").otherwise(F.element_at(F.array(*map(F.lit, ROLES)), (k % 7 + 1).cast("int")))
    x, y = (k % 5 * 32).cast("double"), (F.floor(k / 5) * 32).cast("double")
    return table("nation").select(k.alias("id"), F.col("n_name").alias("name"), F.array(role).alias("tags"), role.alias("role"), x.alias("x0"), (x + 32).alias("x1"), y.alias("y0"), (y + 32).alias("y1"), F.lit(0.0).alias("z0"), F.lit(32.0).alias("z1"))


def room_links(table) -> tuple[DataFrame, DataFrame]:
    from ..operators.spatial import face_contacts

    contacts = face_contacts(rooms(table).select("id", *[f"{c}{k}" for c in AXES for k in (0, 1)]))
    t = table("nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("int").alias("b")).filter("a <> b and least(a, b) % 3 = 0")
    t = t.join(table("nation").select(F.col("n_nationkey").alias("b")), "b", "left_semi")
    return contacts, t.select((F.col("a") * 25 + F.col("b")).alias("tunnel_id"), F.lit("TtDefault").alias("tunnel_type"), "a", "b", (10.0 + F.col("a")).alias("length"))


@query(f"""WITH RECURSIVE x AS ({JOINED}), r(node) AS (SELECT id FROM ({PASSED}) WHERE role = 'elevator' UNION SELECT x.b FROM r JOIN x ON r.node = x.a) SELECT id, role, id IN (SELECT node FROM r) AS reachable FROM ({PASSED})""")
def transit_reach(table, spark):
    """Rooms that may be passed, and whether an elevator is connected to them by shared faces and tunnels."""
    contacts, tunnels = room_links(table)
    return navigation.transit(rooms(table), contacts, tunnels)[0].select("id", "role", "reachable")


@query(f"""WITH c AS (SELECT a.id AS a, b.id AS b FROM ({ROOMS}) a JOIN ({ROOMS}) b ON a.id < b.id AND abs(a.i - b.i) + abs(a.j - b.j) = 1), t AS (SELECT DISTINCT least(n_nationkey, (n_nationkey * 7 + 3) % 25) AS a, greatest(n_nationkey, (n_nationkey * 7 + 3) % 25) AS b FROM nation WHERE n_nationkey <> (n_nationkey * 7 + 3) % 25 AND least(n_nationkey, (n_nationkey * 7 + 3) % 25) % 3 = 0 AND (n_nationkey * 7 + 3) % 25 IN (SELECT n_nationkey FROM nation))
    SELECT a, b, CASE WHEN c.a IS NOT NULL AND t.a IS NOT NULL THEN 'both' WHEN c.a IS NOT NULL THEN 'portal' ELSE 'tunnel' END AS evidence FROM c FULL JOIN t USING (a, b)""")
def navigation_pairs(table, spark):
    """Pairs of rooms by what says that one can pass between them; every face has a template here, in its middle."""
    contacts, tunnels = room_links(table)
    nodes = rooms(table).withColumns({"tile_w": F.lit(2), "tile_d": F.lit(2), "tile_h": F.lit(2), "rotation": F.lit(0)})
    sides = F.array(*[F.struct(F.lit(c + s).alias("face"), F.lit(16.0).alias("u"), F.lit(16.0).alias("v")) for c in "xy" for s in "+-"])
    templates = nodes.select("name", F.explode(sides).alias("t")).select("name", "t.*")
    return navigation.candidate_graph(contacts, tunnels, navigation.placed(templates, nodes))[0]


@query(f"""WITH c AS (SELECT a.id AS a, b.id AS b, a.role AS ra, b.role AS rb, a.id % 2 = 0 AS ta, b.id % 2 = 0 AS tb FROM ({ROOMS}) a JOIN ({ROOMS}) b ON a.id < b.id AND abs(a.i - b.i) + abs(a.j - b.j) = 1)
    SELECT count(*) AS contacts, count(*) FILTER (ta AND tb) AS both_tiles, count(*) FILTER (ta <> tb) AS one_tile, count(*) FILTER (NOT ta AND NOT tb) AS no_tile, count(*) FILTER (ta) AS on_a, count(*) FILTER (tb) AS on_b, count(*) FILTER (ta AND tb) AS both_faces FROM c""")
def contact_coverage(table, spark):
    """How many shared faces the templates of the rooms' tiles explain; rooms of even numbers have templates on all sides."""
    contacts, _ = room_links(table)
    nodes = rooms(table).withColumns({"tile_w": F.lit(2), "tile_d": F.lit(2), "tile_h": F.lit(2), "rotation": F.lit(0)})
    sides = F.array(*[F.struct(F.lit(c + s).alias("face"), F.lit(16.0).alias("u"), F.lit(16.0).alias("v")) for c in "xy" for s in "+-"])
    templates = nodes.filter("id % 2 = 0").select("name", F.explode(sides).alias("t")).select("name", "t.*")
    return navigation.diagnosis_totals(navigation.diagnosed(contacts, nodes, templates))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def numbered_rows(table, spark):
    """A dense number in a total order, by ranges."""
    return numbered(table("orders").select("o_orderkey", (-F.col("o_totalprice")).alias("p")), ["p", "o_orderkey"], "place").select("o_orderkey", "place")


HITS = "SELECT event_id, (event_id % 37 - 2)::DOUBLE AS x, (user_id % 29 + 0.25)::DOUBLE AS y, (event_id % 23 + 1.125)::DOUBLE AS z FROM events"
SIX = ", ".join(f"('{a}{s}', {u} - 0.0, {v} - 0.0, abs({a} - {at}))" for a, u, v in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y")) for s, at in (("-", "0.0"), ("+", "32.0")))


@query(f"""SELECT event_id, face, u, v, d AS distance, CASE WHEN d <= 0.5 THEN '<=0.5' WHEN d <= 1 THEN '<=1' WHEN d <= 2 THEN '<=2' WHEN d <= 4 THEN '<=4' WHEN d <= 8 THEN '<=8' WHEN d <= 16 THEN '<=16' WHEN d <= 32 THEN '<=32' ELSE '>32' END AS ray,
    CASE WHEN d <= 4.1 THEN '<=4.1' WHEN d <= 8 THEN '<=8' WHEN d <= 16 THEN '<=16' WHEN d <= 32 THEN '<=32' ELSE '>32' END AS contact, greatest(0 - x, x - 32, 0) AS outside
    FROM (SELECT * FROM ({HITS}), LATERAL (SELECT * FROM (VALUES {SIX}) AS f(face, u, v, d) ORDER BY d, face LIMIT 1))""")
def sql_nearest_faces(table, spark):
    """The face of a box nearest to a point and how far the point lies outside, with both ladders of distances, as SQL text."""
    register(spark)
    return spark.sql(
        f"""WITH p AS (SELECT event_id, CAST(event_id % 37 - 2 AS DOUBLE) AS x, CAST(user_id % 29 + 0.25 AS DOUBLE) AS y, CAST(event_id % 23 + 1.125 AS DOUBLE) AS z FROM {{events}}),
        f AS (SELECT event_id, nearest_face(x, y, z, {BOX32}) AS f, box_distance(x, y, z, {BOX32}) AS outside FROM p)
        SELECT event_id, f.face, f.u, f.v, f.distance, ray_bucket(f.distance) AS ray, contact_bucket(f.distance) AS contact, outside FROM f""",
        events=table("events"),
    )


BOX32 = "0D, 32D, 0D, 32D, 0D, 32D"
