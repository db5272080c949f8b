"""Measured ground, voxel fields and unknown payloads on the driver's tables: rows become samples, blocks and payloads with planted properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..domain import caverns, fields, ground, probes
from ..operators import voxel
from ..sinks import formats as W
from .saves import SHARES, records

PLAN = """SELECT event_id AS i, user_id % 5 AS lane, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) / 10.0 AS fraction, value AS z, event_type AS t FROM events"""


def plan_and_seen(table) -> tuple[DataFrame, DataFrame]:
    n = F.row_number().over(Window.partitionBy(F.col("user_id") % 5).orderBy("event_id"))
    e = table("events").select("event_id", (F.col("user_id") % 5).cast("double").alias("lane"), (n / 10.0).alias("fraction"), "value", "event_type")
    plan = e.select(F.col("event_id").alias("index"), "lane", "fraction", F.col("fraction").alias("x"), F.lit(0.0).alias("y"), F.lit(100.0).alias("predicted_z"))
    seen = e.filter("event_type <> 'signup'").select(F.col("event_id").alias("index"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("hit"), (F.col("fraction") + F.when(F.col("event_type") == "click", 0.005).otherwise(0.0)).alias("x"), F.lit(0.0).alias("y"), F.col("value").alias("z"), F.lit(100.0).alias("predicted_z"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return plan, seen


STATUS = "CASE WHEN t = 'signup' THEN 'not_sampled' WHEN t = 'error' THEN 'miss' ELSE 'hit' END"


@query(f"SELECT i AS \"index\", {STATUS} AS status, CASE WHEN {STATUS} = 'hit' THEN z - 100 END AS error FROM ({PLAN})")
def plan_comparison(table, spark):
    """Planned samples beside what was measured: hit, miss or not sampled, and the error of a hit."""
    return ground.compare(*plan_and_seen(table)).select("index", "status", "error")


@query(f"""SELECT lane::DOUBLE AS lane, n AS segments, round(least, 4) AS least, round(most, 4) AS most FROM (SELECT lane, count(*) AS n, min(g) AS least, max(g) AS most FROM (
    SELECT lane, (z - lag(z) OVER w) / 0.1 AS g, s = 'hit' AND lag(s) OVER w = 'hit' AS ok FROM (SELECT *, {STATUS} AS s FROM ({PLAN})) WINDOW w AS (PARTITION BY lane ORDER BY fraction)) WHERE ok GROUP BY lane)""")
def lane_grades(table, spark):
    """Grades between neighbours of a lane that were both hit; a sample that was not ends the run."""
    g = ground.grades(ground.compare(*plan_and_seen(table)))
    return g.groupBy("lane").agg(F.count("*").alias("segments"), F.round(F.min("grade"), 4).alias("least"), F.round(F.max("grade"), 4).alias("most"))


@query(f"""SELECT lane::DOUBLE AS lane, CASE WHEN arg_min(s, fraction) = 'hit' AND arg_max(s, fraction) = 'hit' THEN arg_max(z, fraction) - arg_min(z, fraction) END AS rise FROM (SELECT *, {STATUS} AS s FROM ({PLAN})) GROUP BY lane""")
def lane_rise(table, spark):
    """Rise from the first to the last sample of a lane, where both were hit."""
    return ground.end_to_end(ground.compare(*plan_and_seen(table)))


@query(f"""WITH p AS (SELECT *, {STATUS} AS s FROM ({PLAN})) SELECT a.lane::DOUBLE AS lane_a, b.lane::DOUBLE AS lane_b, a.fraction::DOUBLE AS fraction, b.z - a.z AS grade FROM p a JOIN p b ON b.lane = a.lane + 1 AND a.fraction = b.fraction WHERE a.s = 'hit' AND b.s = 'hit'""")
def lane_to_lane_grades(table, spark):
    """Grades between neighbouring lanes at equal fractions."""
    return ground.cross_grades(ground.compare(*plan_and_seen(table)))


HITS = "SELECT event_id AS i, (user_id % 5)::DOUBLE AS lane, value AS x, (user_id % 5) * 0.25 AS y, (event_id % 50) / 10.0 AS z, ((event_id % 3) - 1) * 0.1 AS nx FROM events"


def hits(table) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return table("events").select(e.alias("index"), (u % 5).cast("double").alias("lane"), F.col("value").alias("x"), (u % 5 * 0.25).alias("y"), (e % 50 / 10.0).alias("z"), ((e % 3 - 1) * 0.1).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))


@query(f"""WITH h AS ({HITS}), m AS (SELECT a.lane, a.i, a.z, b.z AS bz, b.z - b.nx * (a.x - b.x) AS t, row_number() OVER (PARTITION BY a.i ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.i) AS k FROM h a JOIN h b ON a.lane <> b.lane AND abs(a.x - b.x) <= 1 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1),
    f AS (SELECT l.lane, median(h.z) AS flat FROM (SELECT DISTINCT lane FROM h) l JOIN h ON h.lane <> l.lane GROUP BY 1), s AS (SELECT m.lane, count(*) AS scored, round(sqrt(avg((t - z) ** 2)), 6) AS tangent_rmse, round(sqrt(avg((bz - z) ** 2)), 6) AS nearest_rmse, round(sqrt(avg((flat - z) ** 2)), 6) AS flat_rmse FROM m JOIN f USING (lane) WHERE k = 1 GROUP BY 1)
    SELECT lane, hits, coalesce(scored, 0) AS scored, hits - coalesce(scored, 0) AS unscored, tangent_rmse, nearest_rmse, flat_rmse FROM (SELECT lane, count(*) AS hits FROM h GROUP BY 1) LEFT JOIN s USING (lane)""")
def tangent_held_out(table, spark):
    """Heights of each lane as the tangent plane at the nearest hit of another lane gives them, beside two baselines on the same rows."""
    t = ground.tangent_held_out(hits(table))
    return t.select("lane", "hits", "scored", "unscored", *[F.round(c, 6).alias(c) for c in ("tangent_rmse", "nearest_rmse", "flat_rmse")])


FLAT = "SELECT s_suppkey AS i, (s_suppkey % 40) * 0.4 AS x, (s_suppkey // 40) * 0.4 AS y, (s_suppkey // 40 % 3) * 0.05 AS nx FROM supplier"


@query(f"""WITH RECURSIVE h AS ({FLAT}), e AS (SELECT a.i AS a, b.i AS b FROM h a JOIN h b ON a.i <> b.i AND a.nx = b.nx AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) BETWEEN 1e-9 AND 0.51), r(node, to_) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.to_ = e.a),
    g AS (SELECT node AS i, min(to_) AS facet FROM r GROUP BY 1) SELECT facet, count(*) AS hits, count(DISTINCT y) > 1 AND count(DISTINCT x) > 1 AS spans FROM g JOIN h USING (i) GROUP BY facet""")
def facet_groups(table, spark):
    """Hits that lie on one plane: rows of a grid, each third row tilted alike, so that only hits of one row meet."""
    k = F.col("s_suppkey")
    row = F.floor(k / 40)
    h = table("supplier").select(k.alias("index"), (k % 40 * 0.4).alias("x"), (row * 0.4).alias("y"), F.lit(0.0).alias("z"), (row % 3 * 0.05).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return ground.facet_evidence(h, ground.facets(h)).select("facet", "hits", "spans")


DIMS = (16, 16, 16)


#: Events as measurements in five lanes, of which some are missing, and three models, of which one leads to no root in two lanes.
LANE_MODELS = """SELECT lane, i, m AS model, value AS measured, CASE m WHEN 'near' THEN CASE WHEN i % 11 <> 0 THEN value + i % 7 * 0.25 END WHEN 'far' THEN CASE WHEN i % 11 <> 0 THEN value + i % 5 * 3 END ELSE CASE WHEN lane < 2 THEN value END END AS modelled
    FROM (SELECT user_id % 5 AS lane, event_id AS i, value FROM events WHERE event_id % 13 <> 0 AND event_id % 500 <> 0), (SELECT unnest(['near', 'far', 'rare']) AS m)"""
HELD_OUT = f"""WITH p AS (SELECT user_id % 5 AS lane FROM events WHERE event_id % 500 <> 0), x AS ({LANE_MODELS}), f AS (SELECT DISTINCT lane AS fold FROM p),
    r AS (SELECT fold, model, count(modelled) AS n, sqrt(avg((modelled - measured) ** 2)) AS error, median(modelled - measured) AS bias FROM f JOIN x ON lane <> fold GROUP BY ALL HAVING n > 0),
    c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, error, model) = 1), l AS (SELECT fold, median(measured) AS flat FROM f JOIN (SELECT DISTINCT lane, i, measured FROM x) ON lane <> fold GROUP BY 1),
    t AS (SELECT c.fold, any_value(c.model) AS model, any_value(n) AS n, any_value(bias) AS bias, count(modelled) AS scored, count(*) - count(modelled) AS without_root, sqrt(avg((modelled - measured - bias) ** 2)) AS rmse, sqrt(avg((flat - measured) ** 2) FILTER (modelled IS NOT NULL)) AS flat_rmse
      FROM c JOIN l USING (fold) JOIN x ON lane = c.fold AND x.model = c.model GROUP BY 1)
    SELECT fold, 'scored' AS status, (SELECT count(*) FROM p WHERE lane <> fold) AS training_samples, (SELECT count(*) FROM p WHERE lane = fold) - (SELECT count(*) FROM x WHERE lane = fold AND model = 'near') AS held_out_missing, model, n AS training_unambiguous, round(bias, 6) AS bias, scored, without_root,
      round(rmse, 6) AS rmse, round(flat_rmse, 6) AS flat_rmse FROM t"""


@query(HELD_OUT)
def lane_hold_out(table, spark):
    """The model that all other lanes choose, scored on a lane, beside a flat height."""
    e = table("events").select((F.col("user_id") % 5).alias("lane"), F.col("event_id").alias("index"), F.col("value").alias("measured")).filter("index % 500 <> 0")
    modelled = {"near": "if(index % 11 <> 0, measured + index % 7 * 0.25D, null)", "far": "if(index % 11 <> 0, measured + index % 5 * 3, null)", "rare": "if(lane < 2, measured, null)"}
    models = e.filter("index % 13 <> 0").withColumn("m", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.expr(x).alias("modelled")) for n, x in modelled.items()]))).select("lane", "index", "measured", "m.*")
    out = ground.held_out(models, e.select("lane", "index"))
    return out.select("fold", "status", "training_samples", "held_out_missing", "model", "training_unambiguous", *[F.round(c, 6).alias(c) for c in ("bias", "rmse", "flat_rmse")], "scored", "without_root")


#: Suppliers whose hits lie in one tile.
HITS_EACH = 20
MANY = f"concat('t', floor(s_suppkey / {HITS_EACH}))"


def slope_blocks(table, tile: str = "'t'") -> DataFrame:
    """Tiles of one block whose bytes fall by one a voxel from 15 at the bottom."""
    data = bytes(max(0, 15 - z) for _ in range(256) for z in range(16))
    return table("supplier").select(F.expr(tile).alias("tile")).distinct().select("tile", *[F.lit(0).alias(b) for b in ("bx", "by", "bz")], F.lit(data).alias("data"))


def slope_samples(table, tile: str = "'t'") -> DataFrame:
    """Suppliers as hits around the height at which four bits cross their midpoint."""
    k = F.col("s_suppkey")
    return table("supplier").select(
        F.expr(tile).alias("tile"), k.cast("int").alias("index"), (k % 3).cast("double").alias("lane"), (k % 11 + 1.25).alias("x"), (k % 7 + 2.25).alias("y"), (7.0 + k % 9 / 8.0 + 0.0625).alias("z"), F.lit(7.5).alias("predicted_z"),
        F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), F.lit(0).alias("rotation"),
    )


MODELS = "SELECT * FROM (SELECT unnest([4, 5]) AS bits), (SELECT unnest([0.0, 0.5]::DOUBLE[]) AS shift_x), (SELECT unnest([0.0, 0.5]::DOUBLE[]) AS shift_y), (SELECT unnest([0.0, 0.5]::DOUBLE[]) AS shift_z)"
SLOPE = "SELECT s_suppkey AS i, 7.0 + s_suppkey % 9 / 8.0 + 0.0625 AS z FROM supplier"


@query(f"""WITH m AS ({MODELS}), e AS (SELECT m.*, CASE WHEN bits = 4 THEN 7 + shift_z - z END AS e FROM m, ({SLOPE})), b AS (SELECT bits, shift_x, shift_y, shift_z, median(e) AS bias FROM e GROUP BY ALL)
    SELECT bits, shift_x, shift_y, shift_z, count(e) AS single_candidates, count(*) - count(e) AS no_candidates, round(any_value(bias), 6) AS bias, round(sqrt(avg(e * e)), 6) AS rmse, round(sqrt(avg((e - bias) ** 2)), 6) AS rmse_after_bias FROM e JOIN b USING (bits, shift_x, shift_y, shift_z) GROUP BY ALL""")
def field_hypotheses(table, spark):
    """How well readings of bytes as densities put a floor where rays hit; only four bits cross their midpoint here."""
    s = fields.hypothesis_scores(fields.readings(slope_blocks(table, MANY), slope_samples(table, MANY), DIMS))
    return s.select(*fields.MODEL, "single_candidates", "no_candidates", *[F.round(c, 6).alias(c) for c in ("bias", "rmse", "rmse_after_bias")])


@query(f"""WITH d AS (SELECT m.*, (15 - (z - shift_z)) / ((1 << bits) - 1) AS v FROM ({MODELS}) m, ({SLOPE})), b AS (SELECT bits, shift_x, shift_y, shift_z, median(v) AS m FROM d GROUP BY ALL)
    SELECT bits, shift_x, shift_y, shift_z, count(*) AS scored, count(*) AS falling, 0::BIGINT AS rising, round(any_value(m), 6) AS median_density, round(avg(abs(v - m)), 6) AS spread FROM d JOIN b USING (bits, shift_x, shift_y, shift_z) GROUP BY ALL""")
def isovalue_spread(table, spark):
    """Densities at the hits, of each reading."""
    s = fields.isovalue_spread(fields.readings(slope_blocks(table, MANY), slope_samples(table, MANY), DIMS))
    return s.select(*fields.MODEL, "scored", "falling", "rising", F.round("median_density", 6).alias("median_density"), F.round("spread", 6).alias("spread"))


@query(f"""SELECT bits, shift_x, shift_y, shift_z, (SELECT count(*) FROM supplier) AS scored, 0.0::DOUBLE AS mean_angle, 0::BIGINT AS not_falling, (SELECT count(DISTINCT (s_suppkey // {HITS_EACH}, floor(s_suppkey % 11 + 1.25 - shift_x), floor(s_suppkey % 7 + 2.25 - shift_y))) FROM supplier) AS cells FROM ({MODELS}) AS m""")
def normal_angles(table, spark):
    """Angles between the fields' and the measured normals, which agree here, and over how many cells of the lattice."""
    s = fields.normal_scores(fields.readings(slope_blocks(table, MANY), slope_samples(table, MANY), DIMS))
    return s.select(*fields.MODEL, "scored", "mean_angle", "not_falling", "cells")


@query("""WITH s AS (SELECT s_suppkey AS i, s_suppkey % 11 + 1.25 AS x, s_suppkey % 7 + 2.25 AS y, 7.0 + s_suppkey % 9 / 8.0 + 0.0625 AS z FROM supplier), a AS (SELECT *, unnest([-1, 0, 1]) AS dx FROM s), b AS (SELECT *, unnest([-1, 0, 1]) AS dy FROM a),
    c AS (SELECT floor(x)::INT + dx AS vx, floor(y)::INT + dy AS vy, i, z, (floor(x) + dx + 0.5 - x) ** 2 + (floor(y) + dy + 0.5 - y) ** 2 AS d FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY vx, vy ORDER BY d, i) AS k FROM c WHERE vx BETWEEN 0 AND 15 AND vy BETWEEN 0 AND 15)
    SELECT vx::BIGINT AS vx, vy::BIGINT AS vy, i::INT AS "index", 15 - floor(z)::INT AS below, 14 - floor(z)::INT AS above, 'recorded_pair' AS status FROM n WHERE k = 1""")
def column_byte_pairs(table, spark):
    """Bytes below and above the ground in the voxel columns around hits, each column once."""
    columns = fields.nearby_columns(slope_samples(table), DIMS, 1)
    return fields.byte_pairs(slope_blocks(table), columns, DIMS, 0.0).select("vx", "vy", "index", "below", "above", "status")


@query("""SELECT b AS bits, count(*) FILTER (x & m >= h AND y & m < h) AS falls, count(*) FILTER (x & m < h AND y & m >= h) AS rises, count(*) FILTER (x & m >= h AND y & m >= h) AS both_above, count(*) FILTER (x & m < h AND y & m < h) AS both_below FROM (
    SELECT event_id % 256 AS x, user_id % 256 AS y, b, (1 << b) - 1 AS m, 1 << (b - 1) AS h FROM events, (SELECT unnest([4, 5, 6]) AS b)) GROUP BY b""")
def midpoint_checks(table, spark):
    p = table("events").select((F.col("event_id") % 256).cast("int").alias("below"), (F.col("user_id") % 256).cast("int").alias("above"))
    return fields.midpoint_checks(p)


@query("""SELECT user_id % 8 AS below, event_id % 4 AS above, count(*) AS count FROM events GROUP BY ALL ORDER BY count DESC, below, above LIMIT 12""")
def common_byte_pairs(table, spark):
    """The twelve most frequent pairs (a report of the first)."""
    return fields.common_pairs(table("events").select((F.col("user_id") % 8).alias("below"), (F.col("event_id") % 4).alias("above")))


@query("""SELECT p AS placement, round(sqrt(min((fx + 0.5 - x) ** 2 + (fy + 0.5 - y) ** 2 + (0.5 - z) ** 2)), 6) AS distance FROM (SELECT c_custkey AS p, (c_custkey * 31 % 500)::DOUBLE AS x, (c_custkey * 17 % 450)::DOUBLE AS y, (c_custkey % 8)::DOUBLE AS z FROM customer),
    (SELECT s_suppkey * 7 % 500 AS fx, s_suppkey * 11 % 450 AS fy FROM supplier) WHERE sqrt((fx + 0.5 - x) ** 2 + (fy + 0.5 - y) ** 2 + (0.5 - z) ** 2) <= 20 GROUP BY p""")
def placements_near_path(table, spark):
    """Placements within 20 m of a path's feet, and how far they are."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    p = table("customer").select(F.lit("t").alias("tile"), k.alias("placement"), (k * 31 % 500).cast("double").alias("x"), (k * 17 % 450).cast("double").alias("y"), (k % 8).cast("double").alias("z"))
    q = table("supplier").select(F.lit("t").alias("tile"), (s * 7 % 500).cast("int").alias("fx"), (s * 11 % 450).cast("int").alias("fy"), F.lit(0).alias("fz"))
    return caverns.near_path(p, q, 20.0).select("placement", F.round("distance", 6).alias("distance"))


def room_blocks(table) -> DataFrame:
    """A block of each part: solid up to a height, free above it. Rows are few bytes and blocks many, so rows are dealt out to all cores first; an
    expression makes the blocks, so that none travels from Python."""
    floor = (F.col("p_size") % 10 + 1).cast("int")
    column = F.concat(F.repeat(F.lit("08"), floor), F.repeat(F.lit("00"), F.lit(16) - floor))
    p = table("part").select(F.col("p_partkey").cast("string").alias("tile"), "p_size")
    p = p.repartition(SHARES * p.sparkSession.sparkContext.defaultParallelism)
    return p.select("tile", *[F.lit(0).alias(b) for b in ("bx", "by", "bz")], F.unhex(F.repeat(column, F.lit(256))).alias("data"))


@query("SELECT p_partkey::VARCHAR AS tile, 1 AS component, 256 * (15 - p_size % 10)::BIGINT AS cells, (p_size % 10 + 1)::INT AS min_z, 15 AS max_z FROM part")
def tile_voids(table, spark):
    """Connected free space of each tile."""
    return voxel.tile_components(room_blocks(table), DIMS, 15, 8).select("tile", "component", "cells", "min_z", "max_z")


@query("SELECT p_partkey::VARCHAR AS tile, 1 AS component, 256::BIGINT AS cells, (p_size % 10 + 1)::INT AS min_z FROM part")
def tile_floors(table, spark):
    """Connected places to stand, with two voxels of headroom."""
    return voxel.tile_components(room_blocks(table), DIMS, 15, 8, walkable=2).select("tile", "component", "cells", "min_z")


def room_sockets(table) -> DataFrame:
    s = table("part").select(F.col("p_partkey").cast("string").alias("tile"), (F.col("p_size") % 10 + 1.5).alias("z"), F.explode(F.array(F.struct(F.lit("a").alias("socket"), F.lit(0.25).alias("x")), F.struct(F.lit("b").alias("socket"), F.lit(15.75).alias("x")))).alias("s"))
    return s.select("tile", "s.socket", "s.x", F.col("s.x").alias("y"), "z")


@query("SELECT p_partkey::VARCHAR AS tile, s AS socket, 1 AS component, round(sqrt(0.125), 6) AS distance FROM part, (SELECT unnest(['a', 'b']) AS s)")
def socket_voids(table, spark):
    """The void next to each tunnel's end."""
    v = caverns.socket_voids(room_blocks(table), room_sockets(table), DIMS)
    return v.select("tile", "socket", "component", F.round("distance", 6).alias("distance"))


@query("SELECT p_partkey::VARCHAR AS tile, 'walk' AS status, 31 AS cells, 30.0::DOUBLE AS length, 0.0::DOUBLE AS max_grade, 30.0::DOUBLE AS surface_length, 'candidate_air_path_found' AS air, 30 AS air_steps, 31 AS air_with_foot, 'clear_centreline' AS sight FROM part")
def socket_walks(table, spark):
    """Walks between two tunnels' ends of a tile, with their profile, the air between them, and the line of sight."""
    w = caverns.socket_walks(room_blocks(table), room_sockets(table), DIMS)
    return w.select("tile", "status", "cells", "length", "max_grade", "surface_length", "air", "air_steps", "air_with_foot", "sight")


@query("SELECT p_partkey::VARCHAR AS tile, s AS socket, CASE s WHEN 'a' THEN 'x-' ELSE 'x+' END AS face, 0 AS first_open, false AS reblocked FROM part, (SELECT unnest(['a', 'b']) AS s)")
def socket_openings(table, spark):
    """What lies straight inward of a tunnel's end."""
    return caverns.socket_openings(room_blocks(table), room_sockets(table), DIMS).select("tile", "socket", "face", "first_open", "reblocked")


def payload_of(ident: int) -> bytes:
    body = (b"\x03\x00\x00", b"\xff\xff\xff" + bytes(12), b"\x01")[ident % 3]
    return bytes([4 + ident % 2]) + len(body).to_bytes(2, "big") + body


def payloads(table) -> DataFrame:
    p = records(table("events").select(F.col("event_id").alias("id")), payload_of, ["id"], "payload")
    return p.select("id", F.lit(1).alias("worldId"), F.lit(None).cast("string").alias("reject_reason"), (F.col("id") % 100).cast("int").alias("chunk_x"), F.floor(F.col("id") / 100).cast("int").alias("chunk_y"), F.lit(0).alias("chunk_z"), "payload")


@query("""SELECT CASE WHEN m = 2 THEN 'all' WHEN m = 0 THEN '04' ELSE '05' END AS mode, depth, count(*) AS records, count(*) FILTER (event_id % 3 <> 2) AS nontrivial, count(*) FILTER (event_id % 3 = 0) AS exact FROM events, (SELECT unnest([0, 1, 2]) AS m), (SELECT unnest(range(1, 7))::INT AS depth) WHERE m = 2 OR event_id % 2 = m GROUP BY ALL""")
def octree_readings(table, spark):
    """Bodies that are octrees of masks, where a one has a child; a third of them is planted."""
    return probes.tree_scan(payloads(table)).filter("ones").select("mode", "depth", "records", "nontrivial", "exact")


@query("""SELECT CASE WHEN m = 2 THEN 'all' WHEN m = 0 THEN '04' ELSE '05' END AS mode, count(*) FILTER (event_id % 3 < 2) AS candidates, count(*) FILTER (event_id % 3 = 1) AS records FROM events, (SELECT unnest([0, 1, 2]) AS m) WHERE m = 2 OR event_id % 2 = m GROUP BY ALL""")
def mask_readings(table, spark):
    """Bodies that are a mask of 24 bits and four bits for each one of it; a third of them is planted."""
    return probes.mask_scan(payloads(table), want=24, offsets=range(1)).filter("ones and bits = 4").select("mode", "candidates", "records")


@query("""WITH p AS (SELECT event_id AS id, event_id % 100 AS x, event_id // 100 AS y FROM events), s AS (SELECT a.id FROM p a JOIN p b ON (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1) AND a.id % 2 = b.id % 2)
    SELECT CASE WHEN id % 2 = 0 THEN '04' ELSE '05' END AS mode, count(*) AS face_pairs, count(*) * 289 AS samples FROM s GROUP BY 1""")
def density_readings(table, spark):
    """Faces of touching chunks, every voxel of them, under one reading as a stream of six bits."""
    d = probes.density_scan(payloads(table), 0, range(probes.SIDE)).filter("bit_offset = 5 and bit_order = 'msb' and fill = 0")
    return d.select("mode", "face_pairs", "samples")


@query("""SELECT event_id % 4 AS id, 0 AS "offset", count(*) AS blobs, 4913::BIGINT - CASE WHEN event_id % 4 = 0 THEN 4913 ELSE 0 END AS dense FROM events GROUP BY event_id % 4""")
def block_candidates(table, spark):
    """Offsets at which a block of exactly one chunk's voxels begins; every offset of a record is looked at."""
    blob = records(table("events").select(F.col("event_id").alias("id")), lambda i: W.lz4(bytes([i % 4 * 65]) * 17**3), ["id"])
    found = probes.lz4_starts(blob, None)
    return found.groupBy((F.col("id") % 4).alias("id"), "offset").agg(F.count("*").alias("blobs"), F.max("dense").alias("dense"))
