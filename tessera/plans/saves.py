"""The save's formats on the driver's tables: rows become records as a save holds them, and are decoded again by the library's sources."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalogue import SQL, query
from ..domain import layout, probes, terrain, underground
from ..functions.surface import register
from ..operators.series import interpolated_midpoint
from ..sinks import formats as W
from ..sources import decode

UNRESOLVED = 65535


#: Shares of a core in the rows that become records.
SHARES = 2


def records(df: DataFrame, build: Callable[..., bytes], inputs: list[str], name: str = "data") -> DataFrame:
    """df with the bytes that build makes of each row. Rows are few bytes and records many, so rows are dealt out to all cores first."""
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"{name} binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in decode.slices(batches):
            made = pa.array([build(*row) for row in zip(*(b.column(c).to_pylist() for c in inputs))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, name])

    return df.repartition(SHARES * df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, ddl)


KINDS = ["Overworld", "DungeonWorld", "WarehouseWorld", "UndergroundWorldDeep", "CreativeWorld"]


def world_record(key: int, name: str, nation: int) -> bytes:
    kind = KINDS[key % 5]
    terrain = {2: {"warehouseIndex": nation, "level": 1, "maxLevels": 4}, 3: {"path": f"a/b/{name}.world", "depth": nation}}.get(key % 5, {})
    blob = W.world(key % 60000 + (key % 11 == 0), kind, json.dumps(terrain))
    return blob[:40] if key % 17 == 0 else blob


WORLDS = """SELECT c_custkey % 60000 AS "worldId", c_custkey % 5 AS k, c_name, c_nationkey AS n, c_custkey % 17 = 0 AS cut, c_custkey % 11 = 0 AS other FROM customer WHERE c_custkey % 13 <> 0"""


def saved_worlds_of(table) -> DataFrame:
    c = table("customer").select("c_custkey", "c_name", "c_nationkey")
    rows = records(c, world_record, ["c_custkey", "c_name", "c_nationkey"])
    g = rows.select(F.lit(W.MARKER).alias("uid"), (F.col("c_custkey") % 60000).cast("int").alias("worldId"), F.when(F.col("c_custkey") % 13 == 0, 2).otherwise(3).alias("flags"), "data")
    return decode.worlds(g, W.MARKER)


@query(f"""SELECT "worldId", CASE WHEN cut THEN 'lz4:truncated literals' WHEN other THEN 'world mismatch' END AS reject_reason,
    CASE WHEN cut THEN 'other' WHEN k = 0 THEN 'overworld' WHEN k = 1 THEN 'dungeon' WHEN k = 2 THEN 'warehouse' WHEN k = 3 THEN 'underground' ELSE 'other' END AS kind,
    CASE WHEN k = 3 AND NOT cut THEN n END AS depth,
    CASE WHEN cut THEN 'World ' || "worldId" WHEN k = 2 THEN 'Warehouse ' || n || ' L1/4' WHEN k = 3 THEN 'D' || n || ' ' || c_name WHEN k = 0 THEN 'Overworld' WHEN k = 1 THEN 'DungeonWorld' ELSE 'CreativeWorld' END AS label FROM ({WORLDS})""")
def saved_worlds(table, spark):
    """World records: envelope, block, payload, kind, depth and label."""
    return saved_worlds_of(table).select("worldId", "reject_reason", "kind", F.col("world_depth").alias("depth"), "label")


def voxel_record(ident: int, cx: int, cy: int, cz: int, event: str) -> bytes:
    body = event.encode()
    payload = bytes([4 + ident % 2]) + (len(body) + (ident % 23 == 0)).to_bytes(2, "big") + body
    magic = b"xxx" if ident % 29 == 0 else b"\x0c\x00\x01"
    return W.voxel(ident + (ident % 17 == 0), cx, cy, cz, magic, payload)


VOXELS = """SELECT event_id AS id, (user_id % 5)::INT AS "worldId", (user_id % 8 - 4)::INT AS x, (user_id // 8 % 8)::INT AS y, ((user_id % 8 - 4) * 4 + event_id % 4 + CASE WHEN event_id % 19 = 0 THEN 4 ELSE 0 END)::INT AS cx,
    (user_id // 8 % 8 * 4 + event_id // 4 % 4)::INT AS cy, (event_id % 200 - 130)::INT AS cz, event_type FROM events"""
VOXEL_REJECT = """CASE WHEN id % 29 = 0 THEN 'magic' WHEN id % 17 = 0 THEN 'id' WHEN id % 19 = 0 THEN 'cell_x' WHEN cz NOT BETWEEN -125 AND 63 THEN 'chunk_z' END"""


def voxel_rows(table) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    x, y = (u % 8 - 4), F.floor(u / 8) % 8
    at = {"id": e, "worldId": u % 5, "x": x, "y": y, "cx": x * 4 + e % 4 + F.when(e % 19 == 0, 4).otherwise(0), "cy": y * 4 + F.floor(e / 4) % 4, "cz": e % 200 - 130}
    rows = table("events").select(*[c.cast("long" if n == "id" else "int").alias(n) for n, c in at.items()], "event_type")
    return records(rows, voxel_record, ["id", "cx", "cy", "cz", "event_type"])


def saved_voxels_of(table) -> DataFrame:
    return decode.voxels(voxel_rows(table))


@query(f"""SELECT id, r AS reject_reason, CASE WHEN r IS NULL THEN cx END AS chunk_x, CASE WHEN r IS NULL THEN cy END AS chunk_y, CASE WHEN r IS NULL THEN cz END AS chunk_z, CASE WHEN r IS NULL THEN 34 + length(event_type)::INT END AS size
    FROM (SELECT *, {VOXEL_REJECT} AS r FROM ({VOXELS}))""")
def saved_voxels(table, spark):
    """Voxel records, decoded or with the first reason why not."""
    return saved_voxels_of(table).select("id", "reject_reason", "chunk_x", "chunk_y", "chunk_z", "size")


@query(f"""WITH v AS (SELECT *, {VOXEL_REJECT} AS r FROM ({VOXELS})), d AS (SELECT "worldId", cx, cy, cz, count(*) AS n FROM v WHERE r IS NULL GROUP BY ALL),
    s AS (SELECT "worldId", sum(n - 1)::BIGINT AS surplus, min(cz) AS min_chunk_z, max(cz) AS max_chunk_z, min(cx) AS min_chunk_x FROM d GROUP BY 1)
    SELECT "worldId", decoded, rejected, surplus, min_chunk_x, min_chunk_z, max_chunk_z FROM (SELECT "worldId", count(*) FILTER (r IS NULL) AS decoded, count(*) FILTER (r IS NOT NULL) AS rejected FROM v GROUP BY 1) LEFT JOIN s USING ("worldId")""")
def saved_chunk_summary(table, spark):
    return terrain.chunk_summary(saved_voxels_of(table)).select("worldId", "decoded", "rejected", "surplus", "min_chunk_x", "min_chunk_z", "max_chunk_z")


@query(f"""WITH v AS (SELECT *, {VOXEL_REJECT} AS r FROM ({VOXELS})), e AS (
      SELECT "worldId", 'chunk_z' AS aspect, cz::VARCHAR AS value FROM v WHERE r IS NULL UNION ALL SELECT "worldId", 'size', (34 + length(event_type))::VARCHAR FROM v WHERE r IS NULL UNION ALL
      SELECT "worldId", 'prefix', lower(hex(chr((4 + id % 2)::INT)) || lpad(lower(hex(length(event_type) + CASE WHEN id % 23 = 0 THEN 1 ELSE 0 END)), 4, '0')) || lower(hex(left(event_type, 5))) FROM v WHERE r IS NULL UNION ALL SELECT "worldId", 'reason', r FROM v WHERE r IS NOT NULL)
    SELECT "worldId", aspect, value, count(*) AS records FROM e GROUP BY ALL""")
def saved_chunk_details(table, spark):
    """Histograms of heights, sizes, beginnings and reasons (fewer than the 30 beginnings that are shown at most)."""
    return terrain.chunk_details(saved_voxels_of(table))


@query(f"""SELECT mode, count(*) AS records, min(n)::INT AS least, max(n)::INT AS most, round_even(avg(n), 2) AS mean, count(*) FILTER (id % 23 <> 0) AS exact_frames, 0::BIGINT AS single_zeros
    FROM (SELECT id, CASE WHEN id % 2 = 0 THEN '04' ELSE '05' END AS mode, length(event_type) AS n, {VOXEL_REJECT} AS r FROM ({VOXELS})) WHERE r IS NULL GROUP BY mode""")
def payload_frame_modes(table, spark):
    return probes.payload_frames(saved_voxels_of(table))


@query(f"""WITH v AS (SELECT id, CASE WHEN id % 2 = 0 THEN '04' ELSE '05' END AS mode, length(event_type) + 3 AS n, lpad(lower(hex(length(event_type) + CASE WHEN id % 23 = 0 THEN 1 ELSE 0 END)), 4, '0') AS l, event_type FROM (SELECT *, {VOXEL_REJECT} AS r FROM ({VOXELS})) WHERE r IS NULL),
    e AS (SELECT id, n, 'size' AS aspect, n::VARCHAR AS value FROM v UNION ALL SELECT id, n, 'first_byte', mode FROM v UNION ALL SELECT id, n, 'group', mode || left(l, 2) FROM v UNION ALL SELECT id, n, 'first_u16', ((mode::INT) * 256)::VARCHAR FROM v UNION ALL
      SELECT id, n, 'prefix', mode || l || lower(hex(left(event_type, 5))) FROM v UNION ALL SELECT id, n, 'body_first_byte', mode || ':' || lower(hex(left(event_type, 1))) FROM v)
    SELECT aspect, value, records, least, most, row_number() OVER (PARTITION BY aspect ORDER BY records DESC, f)::INT AS rank FROM (SELECT aspect, value, count(*) AS records, min(n)::INT AS least, max(n)::INT AS most, min(id) AS f FROM e GROUP BY ALL)""")
def payload_aspects(table, spark):
    return probes.payload_profile(saved_voxels_of(table)).drop("mean")


@query(f"""SELECT false AS little, 'zyx' AS axes, 4 AS factor, 19 AS "offset", count(*) FILTER (id % 19 <> 0) AS exact, count(*) FILTER (id % 19 <> 0 AND cz BETWEEN -128 AND 128) AS plausible FROM ({VOXELS})""")
def best_coordinate_layout(table, spark):
    """The reading of three integers that explains most records (a report of the best one); the records' own is planted."""
    raw = voxel_rows(table).select("x", "y", F.expr("substring(data, 3)").alias("data"))  # a literal block's bytes begin after two of its own
    return probes.layout_scan(raw, range(16, 24), (2, 4)).limit(1)


@query(f"""SELECT count(*) AS records, count(*) FILTER (id % 29 <> 0) AS markers, 0::BIGINT AS minus_ones FROM ({VOXELS})""")
def record_structure(table, spark):
    """Records with their marker where it should be, and with minus one after their own id."""
    raw = voxel_rows(table).select("id", "x", "y", F.expr("substring(data, 3)").alias("data"))
    return probes.structure_profile(probes.structure(raw)).select("records", "markers", "minus_ones")


@query(f"""WITH v AS (SELECT *, id % 2 AS m FROM (SELECT *, {VOXEL_REJECT} AS r FROM ({VOXELS})) WHERE r IS NULL AND id % 23 <> 0),
    last AS (SELECT "worldId", cx, cy, cz, arg_max(m, id) AS m FROM v GROUP BY ALL), s AS (SELECT *, unnest(['x', 'y', 'z']) AS axis FROM v)
    SELECT CASE WHEN s.m = 0 THEN '04' ELSE '05' END AS mode, axis, count(*) AS pairs FROM s JOIN last l ON l."worldId" = s."worldId" AND l.m = s.m
      AND l.cx = s.cx + (axis = 'x')::INT AND l.cy = s.cy + (axis = 'y')::INT AND l.cz = s.cz + (axis = 'z')::INT GROUP BY ALL""")
def touching_chunks(table, spark):
    """Chunks of equal modes that touch, by axis."""
    return probes.neighbours(saved_voxels_of(table)).groupBy("mode", "axis").agg(F.count("*").alias("pairs"))


def portal_record(ident: int, wa: int, xa: int, ya: int, wb: int, xb: int, yb: int) -> bytes:
    shift = 64.0 if ident % 13 == 0 else 0.0
    header = W.portal_header(ident + (ident % 11 == 0), (wa, xa, ya), (wb, xb, yb))
    b = None if wb == UNRESOLVED else (xb * 64 + 9.0, yb * 64 + 1.5, 2.0)
    blob = W.portal(wa, (xa * 64 + 5.0 + shift, ya * 64 + 7.25, 3.5), None if b is None else wb, b, header)
    return blob[:40] if ident % 17 == 0 else blob


PORTALS = """SELECT o_orderkey AS id, (o_custkey % 40 + 1)::INT AS wa, (o_orderkey % 50 - 25)::INT AS xa, (o_custkey % 30 - 15)::INT AS ya, CASE WHEN o_orderkey % 7 = 0 THEN 65535 ELSE (o_orderkey % 45 + 1)::INT END AS wb,
    CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (o_orderkey % 9 - 4)::INT END AS xb, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (o_orderkey % 5)::INT END AS yb FROM orders"""


def portal_rows(table) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lost = k % 7 == 0
    at = {"worldIdA": c % 40 + 1, "xA": k % 50 - 25, "yA": c % 30 - 15, "worldIdB": F.when(lost, UNRESOLVED).otherwise(k % 45 + 1), "xB": F.when(lost, 0).otherwise(k % 9 - 4), "yB": F.when(lost, 0).otherwise(k % 5)}
    return table("orders").select(k.alias("id"), *[v.cast("int").alias(n) for n, v in at.items()])


@query(f"""SELECT id, CASE WHEN id % 17 = 0 THEN 'portal:short' END AS reject_reason, CASE WHEN id % 17 <> 0 THEN id % 13 <> 0 END AS matches, CASE WHEN id % 17 <> 0 THEN id % 11 <> 0 END AS header_matches,
    CASE WHEN id % 17 <> 0 THEN xa * 64 + 5.0::DOUBLE + CASE WHEN id % 13 = 0 THEN 64 ELSE 0 END END AS x, CASE WHEN id % 17 <> 0 AND wb <> 65535 THEN wb END AS world_b, CASE WHEN id % 17 <> 0 THEN length(t)::INT END AS tail FROM (SELECT *, CASE WHEN wb = 65535 THEN '000000' ELSE '0000' END AS t FROM ({PORTALS}))""")
def saved_portals(table, spark):
    """Portal records: header, transforms, what is left of the bits, and the two checks against the row's columns, which are null where nothing
    could be read."""
    rows = records(portal_rows(table), portal_record, ["id", "worldIdA", "xA", "yA", "worldIdB", "xB", "yB"])
    return decode.portals(rows).select("id", "reject_reason", "matches", "header_matches", F.get("position_a", F.lit(0)).alias("x"), "world_b", F.length("tail_bits").alias("tail"))


def known_worlds(spark, table) -> DataFrame:
    """Worlds 1 to 30 as saved."""
    ids = table("supplier").select((F.col("s_suppkey") % 30 + 1).cast("int").alias("worldId")).distinct()
    return ids.select("worldId", F.lit(None).cast("string").alias("reject_reason"), F.concat(F.lit("W"), "worldId").alias("label"), F.lit("underground").alias("kind"), F.lit(1).alias("world_depth"))


KNOWN = "SELECT DISTINCT (s_suppkey % 30 + 1)::INT AS w FROM supplier"


@query(f"""WITH k AS ({KNOWN}), p AS (SELECT *, wa IN (SELECT w FROM k) AS ka, wb IN (SELECT w FROM k) AS kb FROM ({PORTALS}))
    SELECT count(*) AS portals, count(*) FILTER (ka AND kb) AS resolved, count(*) FILTER (wb = 65535) AS unresolved, (count(*) FILTER (NOT ka) + count(*) FILTER (NOT kb AND wb <> 65535))::BIGINT AS missing_references FROM p""")
def portal_references(table, spark):
    return terrain.reference_counts(portal_rows(table), known_worlds(spark, table))


@query(f"""WITH s AS (SELECT wa AS "worldId", id, xa AS cell_x, ya AS cell_y, 'A' AS side, CASE WHEN wb <> 65535 THEN wb END AS o FROM ({PORTALS}) UNION ALL SELECT wb, id, xb, yb, 'B', wa FROM ({PORTALS}) WHERE wb <> 65535)
    SELECT "worldId", id, cell_x, cell_y, string_agg(side, '/' ORDER BY side) AS sides, arg_min_null(o, side) AS other_world FROM s GROUP BY ALL""")
def portal_cells(table, spark):
    return terrain.portal_cells(portal_rows(table))


PIECES = """SELECT p_partkey AS k, (p_partkey % 5)::INT AS "worldId", CASE WHEN p_size % 2 = 0 THEN 'cave' ELSE 'pocket' END AS kind, (p_partkey // 5 % 9 - 4)::INT AS cell_x, (p_partkey // 45 % 9)::INT AS cell_y,
    (p_partkey * 2654435761 % 1073741824)::BIGINT AS v FROM part"""


#: Parts whose pieces share a record: bounds what a record holds, whatever the size of the table.
PARTS_EACH = 1000


def sound(df: DataFrame) -> DataFrame:
    """df, which has no rejection; one stops the query."""
    bad = F.raise_error(F.concat(F.lit("a record was rejected: "), F.col("reject_reason")))
    return df.filter(F.when(F.col("reject_reason").isNotNull(), bad.cast("boolean")).otherwise(F.lit(True)))


def piece_tables(table) -> DataFrame:
    """Script records of a world's caves, pockets, tile list and spawners, a thousand parts at a time."""
    k = F.col("p_partkey")
    rows = table("part").select((k % 5).cast("int").alias("worldId"), (F.col("p_size") % 2).cast("int").alias("pocket"), (F.floor(k / 5) % 9 - 4).cast("int").alias("x"), (F.floor(k / 45) % 9).cast("int").alias("y"), k.alias("k"), (k * 2654435761 % 1073741824).alias("v"))
    rows = rows.withColumn("block", F.floor(F.col("k") / PARTS_EACH))
    g = rows.groupBy("worldId", "block").agg(F.sort_array(F.collect_list(F.struct("k", "pocket", "x", "y", "v"))).alias("p"))

    def script(world: int, pieces: list[dict]) -> bytes:
        value = {"tileList": {i: W.Uuid(bytes([i]) * 16) for i in range(0, 256, 3)}, "caves": {}, "pockets": {}, "spawners": {}, "seed": world}
        for p in pieces:
            cell = value["pockets" if p["pocket"] else "caves"].setdefault(p["y"], {}).setdefault(p["x"], {})
            cell[len(cell) + 1] = p["v"]
            if p["k"] % 4 == 0:
                cell = value["spawners"].setdefault(p["y"], {}).setdefault(p["x"], {})
                cell[len(cell) + 1] = {"pos": (float(p["k"] % 64), 2.0, float(p["k"] % 7)), "scale": (1.0, 1.0, 1.0), "tags": {1: f"t{p['k'] % 3}", 2: "all"}, "params": {"triggerName": f"n{p['k'] % 5}"}}
        return W.script(world, value)

    return records(g, script, ["worldId", "p"]).select("worldId", (F.col("block") * 5 + F.col("worldId")).alias("row_id"), "data")


def piece_nodes(table) -> DataFrame:
    from ..operators.graph import cut

    return cut(sound(decode.lua_nodes(piece_tables(table), same_world=True)))


UNPACKED = f"""SELECT *, (v & 255) AS tile_index, CASE WHEN kind = 'cave' THEN cell_x * 64.0 ELSE cell_x * 64.0 + (v >> 8 & 3) * 16 END AS x, CASE WHEN kind = 'cave' THEN cell_y * 64.0 ELSE cell_y * 64.0 + (v >> 10 & 3) * 16 END AS y,
    CASE WHEN kind = 'cave' THEN (v >> 8 & 15) * 16.0 ELSE (v >> 12 & 15) * 16.0 END AS z, CASE WHEN kind = 'cave' THEN 64.0 WHEN (v >> 28 & 3) % 2 = 1 THEN ((v >> 18 & 3) + 1) * 16.0 ELSE ((v >> 16 & 3) + 1) * 16.0 END AS width,
    CASE WHEN kind = 'cave' THEN 64.0 WHEN (v >> 28 & 3) % 2 = 1 THEN ((v >> 16 & 3) + 1) * 16.0 ELSE ((v >> 18 & 3) + 1) * 16.0 END AS depth, CASE WHEN kind = 'cave' THEN ((v >> 12 & 15) + 1) * 16.0 ELSE ((v >> 20 & 15) + 1) * 16.0 END AS height,
    CASE WHEN kind = 'cave' THEN v >> 20 & 3 ELSE v >> 28 & 3 END AS rotation FROM ({PIECES})"""


@query(f"""SELECT "worldId", kind, cell_x, cell_y, tile_index, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, width::DOUBLE AS width, depth::DOUBLE AS depth, height::DOUBLE AS height, rotation::INT AS rotation, tile_index % 3 = 0 AS has_tile FROM ({UNPACKED})""")
def saved_pieces(table, spark):
    """Caves and pockets out of packed integers in a value tree, with the tile that their index names."""
    p = underground.pieces(piece_nodes(table))
    return p.select("worldId", "kind", F.col("cell_x").cast("int").alias("cell_x"), F.col("cell_y").cast("int").alias("cell_y"), "tile_index", "x", "y", "z", "width", "depth", "height", "rotation", F.col("tile_uuid").isNotNull().alias("has_tile"))


@query(f"""SELECT "worldId", min(x)::DOUBLE AS x0, max(x + width)::DOUBLE AS x1, min(y)::DOUBLE AS y0, max(y + depth)::DOUBLE AS y1, min(z)::DOUBLE AS z0, max(z + height)::DOUBLE AS z1 FROM (
      SELECT "worldId", x, y, z, width, depth, height FROM ({UNPACKED}) UNION ALL SELECT "worldId", cell_x * 64 + k % 64, cell_y * 64 + 2, k % 7, 0, 0, 0 FROM ({PIECES}) WHERE k % 4 = 0) GROUP BY 1""")
def combined_bounds(table, spark):
    """Bounds over pieces, which have extents, and spawners, which have none."""
    nodes = piece_nodes(table)
    boxes = underground.pieces(nodes).select("worldId", *[c for a, s in (("x", "width"), ("y", "depth"), ("z", "height")) for c in (F.col(a).alias(f"{a}0"), (F.col(a) + F.col(s)).alias(f"{a}1"))])
    s = layout.spawners(nodes).select("worldId", *[F.col(c).alias(f"{c}{k}") for c in "xyz" for k in (0, 1)])
    return layout.combined_bounds([boxes, s])


@query(f"""SELECT "worldId", tag, count(*) AS spawners, min(x)::DOUBLE AS least_x FROM (SELECT "worldId", cell_x * 64.0 + k % 64 AS x, unnest(['t' || (k % 3), 'all']) AS tag FROM ({PIECES}) WHERE k % 4 = 0) GROUP BY ALL""")
def spawner_tags(table, spark):
    s = layout.spawners(piece_nodes(table))
    return s.select("worldId", "x", F.explode("tags").alias("tag")).groupBy("worldId", "tag").agg(F.count("*").alias("spawners"), F.min("x").alias("least_x"))


@query(f"""SELECT tile_index, kind, records, is_known, row_number() OVER (ORDER BY records DESC, f)::BIGINT AS rank FROM (SELECT tile_index, kind, count(*) AS records, tile_index % 6 = 0 AS is_known, min("worldId" * 0 + n) AS f FROM (
      SELECT *, dense_rank() OVER (ORDER BY tile_index, kind) AS n FROM ({UNPACKED})) GROUP BY ALL) ORDER BY rank LIMIT 10""")
def tile_usage(table, spark):
    """The tiles most used (a report of the first ten); of equal counts the lower index, caves first. Every other listed tile is in the catalogue."""
    import uuid

    tiles = spark.createDataFrame([(str(uuid.UUID(bytes=bytes([i]) * 16)), f"a/cave/tile_{i}_4x4x1.tile") for i in range(0, 256, 6)], "tile_uuid string, path string")
    p = underground.pieces(piece_nodes(table)).withColumn("node", F.col("tile_index") * 2 + F.when(F.col("kind") == "cave", 0).otherwise(1))
    return layout.tile_usage(p, tiles, 10)[0].select("tile_index", "kind", "records", "is_known", "rank")


LINES = "SELECT user_id AS tunnel_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS ord, value::FLOAT::DOUBLE AS x, (event_id % 100)::DOUBLE AS y, (event_id % 7)::DOUBLE AS z FROM events"


#: Points of a tunnel that one record holds at most, without the one that it takes over from the record before.
POINTS = 1000


def tunnel_records(table) -> DataFrame:
    """Script records of users, whose events are the points of a tunnel: a record for each POINTS of them, which begins with the last point of the one
    before, so that no step is lost between records. The user's number is the row's upper half, as a value's keys have 32 bits."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table("events").select("user_id", "event_id", F.col("value").cast("float").alias("v"), F.row_number().over(order).alias("k"))
    last = F.floor((F.col("k") - 1) / POINTS).cast("int")
    e = e.withColumn("part", F.explode(F.when(F.col("k") % POINTS == 0, F.array(last, last + 1)).otherwise(F.array(last))))
    g = e.groupBy("user_id", "part").agg(F.sort_array(F.collect_list(F.struct("k", "event_id", "v"))).alias("p"))
    g = g.select("user_id", (F.col("user_id") % 16).cast("int").alias("worldId"), "part", *[F.col(f"p.{c}").alias(c) for c in ("k", "event_id", "v")])

    def script(world: int, user: int, k: list[int], events: list[int], v: list[float]) -> bytes:
        line = {"tunnelType": ("TtDefault", "MainVein", "Odd")[user % 3], "positions": {n: (x, float(e % 100), float(e % 7)) for n, e, x in zip(k, events, v)}}
        return W.script(world, {"tunnels": {user: line}})

    row = F.shiftleft(F.col("user_id").cast("long"), 32) + F.col("part")
    return records(g, script, ["worldId", "user_id", "k", "event_id", "v"]).select("worldId", row.alias("row_id"), "data")


def tunnel_nodes(table) -> DataFrame:
    from ..operators.graph import cut

    return cut(sound(decode.lua_nodes(tunnel_records(table))))


@query(f"""WITH p AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS s FROM ({LINES}) WINDOW w AS (PARTITION BY tunnel_id ORDER BY ord))
    SELECT tunnel_id, CASE WHEN tunnel_id % 3 = 0 THEN 'corridor' WHEN tunnel_id % 3 = 1 THEN 'vein' ELSE 'unknown' END AS role, count(*) AS points, round(sum(s), 3) AS length, min(x) AS min_x, max(y) AS max_y FROM p GROUP BY 1 HAVING count(*) > 1""")
def saved_tunnels(table, spark):
    """Tunnels out of a value tree: points in order, length, bounds, and what kind of way they are."""
    from ..domain.regions import tunnel_role

    t = underground.whole_tunnels(underground.tunnel_lengths(underground.tunnels(tunnel_nodes(table))))
    return t.select("tunnel_id", tunnel_role(F.col("tunnel_type")).alias("role"), "points", F.round("length", 3).alias("length"), "min_x", "max_y")


@query(f"""WITH p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS s FROM ({LINES}) WINDOW w AS (PARTITION BY tunnel_id ORDER BY ord)),
    r AS (SELECT *, sum(s) OVER (PARTITION BY tunnel_id ORDER BY ord) AS t, sum(s) OVER (PARTITION BY tunnel_id) AS total FROM p)
    SELECT tunnel_id, round(px + (x - px) * (total / 2 - (t - s)) / s, 4) AS x, round(py + (y - py) * (total / 2 - (t - s)) / s, 4) AS y FROM r WHERE s > 0 AND t >= total / 2 QUALIFY row_number() OVER (PARTITION BY tunnel_id ORDER BY ord) = 1""")
def line_midpoints(table, spark):
    """Points at half the length of each user's line, between two of its points."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table("events").select(F.col("user_id").alias("tunnel_id"), F.row_number().over(w).alias("ord"), F.col("value").cast("float").cast("double").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    m = interpolated_midpoint(e, ["tunnel_id"], "ord", ["x", "y"])
    return m.select("tunnel_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), c AS (SELECT conv_id, count(*) AS turns FROM t GROUP BY 1)
    SELECT 1 AS depth, 'conv' AS key, 'int' AS value_kind, count(*) AS records FROM c UNION ALL SELECT 1, 'turns', 'table', count(*) FROM c UNION ALL SELECT 1, 'open', 'bool', count(*) FROM c UNION ALL SELECT 2, '#int', 'table', count(*) FROM t
    UNION ALL SELECT 3, 'role', 'string', count(*) FROM t UNION ALL SELECT 3, 'chars', CASE WHEN n % 2 = 0 THEN 'int' ELSE 'float' END, count(*) FROM t GROUP BY n % 2 UNION ALL SELECT 0, NULL, 'table', count(*) FROM c""")
def value_key_profile(table, spark):
    """Kinds of values by key and depth, over value trees of conversations."""
    g = table("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("t"))

    def script(conv: int, turns: list[dict]) -> bytes:
        rows = {k + 1: {"role": r["role"], "chars": r["n"] if r["n"] % 2 == 0 else float(r["n"])} for k, r in enumerate(turns)}
        return W.script(conv % 1000, {"conv": conv, "turns": rows, "open": conv % 2 == 0})

    rows = records(g, script, ["conv_id", "t"]).select(F.col("conv_id").alias("row_id"), (F.col("conv_id") % 1000).cast("int").alias("worldId"), "data")
    return probes.key_profile(decode.lua_nodes(rows)).select("depth", "key", "value_kind", "records")


@query("""SELECT CASE WHEN c % 9 = 0 THEN 'envelope:truncated' WHEN c % 8 = 0 THEN 'envelope:trailing' WHEN c % 7 = 0 THEN 'world mismatch' ELSE 'decoded' END AS reason, count(*) AS records FROM (SELECT DISTINCT conv_id AS c FROM conversations) GROUP BY 1""")
def script_reject_reasons(table, spark):
    """Script records by why they cannot be read; a record of another world is one of the reasons."""

    def script(conv: int) -> bytes:
        blob = W.script(conv % 1000 + (conv % 7 == 0), conv)
        return blob[:-1] if conv % 9 == 0 else blob + b"x" if conv % 8 == 0 else blob

    rows = records(table("conversations").select("conv_id").distinct(), script, ["conv_id"])
    nodes = decode.lua_nodes(rows.select(F.col("conv_id").alias("row_id"), (F.col("conv_id") % 1000).cast("int").alias("worldId"), "data"), same_world=True)
    return decode.reject_tally(nodes)


def tile_record(key: int, size: int) -> bytes:
    cell = {"harvestable": (size % 3, W.objects_body([(float(key % 64), float(k), 1.5) for k in range(size % 3)]))} if size % 3 else {}
    if size % 4 == 0:
        cell["node"] = (1, W.nodes_body([((float(key % 32), 2.0, 3.0), {"tunnel": {"type": f"T{size}"}})]))
    if size % 5 == 0:
        cell["voxel_terrain"] = (1, W.blocks_body([((key % 4, 0, 1), bytes([size]) * 4096)]))
    blob = W.tile_of([{}, cell], 2)
    return blob[:20] if key % 31 == 0 else blob


def tile_files(table) -> DataFrame:
    return records(table("part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey", "p_size"), tile_record, ["p_partkey", "p_size"], "content").select("path", "content")


PACKED = "CASE WHEN n < 15 THEN n + 1 ELSE n + 2 + (n - 15) // 255 END"


@query(f"""SELECT kind, count(*) AS chunks, 0::BIGINT AS outside, sum({PACKED})::BIGINT AS packed, sum(n)::BIGINT AS "full" FROM (
      SELECT 'harvestable' AS kind, p_size % 3 * 65 AS n FROM part WHERE p_size % 3 > 0 AND p_partkey % 31 > 0 UNION ALL SELECT 'node', 1 + 40 + 47 + 4 + length('{{"tunnel": {{"type": "T' || p_size || '"}}}}') FROM part WHERE p_size % 4 = 0 AND p_partkey % 31 > 0
      UNION ALL SELECT 'voxel_terrain', 4108 FROM part WHERE p_size % 5 = 0 AND p_partkey % 31 > 0) GROUP BY kind""")
def tile_chunk_totals(table, spark):
    """Chunks of tile files by kind, out of the directories of their cells."""
    return decode.chunk_totals(decode.tile_chunks(tile_files(table)))


@query("""SELECT p_partkey::VARCHAR AS path, k AS number, 64.0 + p_partkey % 64 AS x, k::DOUBLE AS y FROM part, unnest(range(0, p_size % 3)) AS t(k) WHERE p_partkey % 31 > 0""")
def tile_placements(table, spark):
    """Objects placed in tile files, in the tile's coordinates."""
    return decode.tile_objects(tile_files(table)).filter("reject_reason is null").select("path", F.col("number").cast("long").alias("number"), "x", "y")


@query("""SELECT p_partkey::VARCHAR AS path, 'T' || p_size AS tunnel_type, 64.0 + p_partkey % 32 AS x FROM part WHERE p_size % 4 = 0 AND p_partkey % 31 > 0""")
def tile_tunnel_nodes(table, spark):
    n = decode.tile_nodes(tile_files(table)).filter("reject_reason is null")
    return n.select("path", F.get_json_object("parameters", "$.tunnel.type").alias("tunnel_type"), "x")


@query("""SELECT p_size::INT AS value, count(*) * 4096 AS count FROM part WHERE p_size % 5 = 0 AND p_partkey % 31 > 0 GROUP BY 1""")
def tile_byte_histogram(table, spark):
    """Bytes of all voxel blocks of tile files."""
    return decode.byte_histogram(decode.tile_voxels(tile_files(table)).filter("reject_reason is null"), [])


@query("""SELECT (p_size % 3 * 65)::INT AS size, 1 AS texts, count(*) AS chunks FROM part WHERE p_size % 3 > 0 AND p_partkey % 31 > 0 GROUP BY 1""")
def tile_chunk_dumps(table, spark):
    """What chunks of an unknown format show: their sizes, and how many different readable texts."""
    d = decode.tile_dump(tile_files(table), "harvestable").filter("reject_reason is null")
    return d.groupBy("size").agg(F.size(F.array_distinct(F.flatten(F.collect_set("texts")))).alias("texts"), F.count("*").alias("chunks"))


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
    SELECT user_id::VARCHAR AS file, run::BIGINT AS run, count(*) FILTER (event_type <> 'signup' AND event_type <> 'error') AS good, count(*) FILTER (event_type = 'error') AS bad FROM e GROUP BY ALL""")
def log_runs(table, spark):
    """Lines of logs, a file a user: markers begin runs, records are good or have a reason why not."""
    from ..sources import logs

    e, kind = F.col("event_id"), F.col("event_type")
    record = F.concat(F.lit("12:00 X_RUN,"), F.concat_ws(",", e, F.lit(1), F.lit("1.0"), F.lit("2.0"), F.lit("3.0"), F.lit(9), F.col("value"), F.lit("0,0,1"), kind))
    line = F.when(kind == "signup", F.lit("[x] X_RUN_META,world=9,count=3")).when(kind == "error", F.lit("X_RUN,broken")).otherwise(record)
    rows = logs.parsed(table("events").select(F.col("user_id").cast("string").alias("file"), e.alias("line"), line.alias("value")), "X_RUN_META,", "X_RUN,")
    good = ~F.col("is_marker") & F.col("reject_reason").isNull()
    return rows.groupBy("file", "run").agg(F.count_if(good).alias("good"), F.count_if(F.col("reject_reason").isNotNull()).alias("bad"))


#: Lines of a log for each user; some markers name another world, some nothing, and indices repeat.
LOG_KIND = "CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 97 = 0 THEN 'unnamed' WHEN event_id % 5 = 0 THEN 'other' ELSE 'mine' END WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'bad' ELSE 'good' END"
LOG_STATES = f"""WITH e AS (SELECT user_id::VARCHAR AS file, event_id AS line, event_id % 40 AS ix, {LOG_KIND} AS kind FROM events WHERE user_id IS NOT NULL),
    n AS (SELECT *, sum(CASE WHEN kind IN ('mine', 'other', 'unnamed') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS run FROM e),
    f AS (SELECT file, max(run) FILTER (kind = 'mine') AS run, max(line) FILTER (kind = 'mine') AS marker_line, count(*) FILTER (kind = 'unnamed') AS unnamed FROM n GROUP BY file),
    r AS (SELECT file, count(*) AS records, count(*) FILTER (n.kind = 'bad') AS bad, count(DISTINCT CASE WHEN n.kind = 'bad' THEN -1 ELSE ix END) AS different, string_agg(line, ',' ORDER BY line) AS lines FROM n JOIN f USING (file, run) WHERE n.kind IN ('good', 'bad') GROUP BY file),
    s AS (SELECT f.*, coalesce(records, 0) AS records, coalesce(bad, 0) AS bad, lines, CASE WHEN unnamed > 0 THEN 'marker' WHEN f.run IS NULL THEN 'none' WHEN records = 3 AND different = 3 AND bad = 0 THEN 'whole' ELSE 'broken' END AS status FROM f LEFT JOIN r USING (file))
    SELECT file, status, run::BIGINT AS run, marker_line, CASE WHEN run IS NOT NULL THEN records END AS records, CASE WHEN run IS NOT NULL THEN bad END AS bad, CASE WHEN status = 'whole' THEN lines ELSE '' END AS lines FROM s"""


def event_lines(table) -> DataFrame:
    e = table("events").filter("user_id is not null").withColumn("kind", F.expr(LOG_KIND))
    meta = F.when(F.col("kind") == "unnamed", "X_RUN_META,world=x").when(F.col("kind") == "other", "X_RUN_META,world=8,count=3").when(F.col("kind") == "mine", "[x] X_RUN_META,world=9,count=3")
    record = F.concat(F.lit("12:00 X_RUN,"), F.concat_ws(",", F.col("event_id") % 40, F.lit(1), F.lit("1.0"), F.lit("2.0"), F.lit("3.0"), F.lit(9), F.lit("4.5"), F.lit("0,0,1"), F.coalesce("event_type", F.lit("-"))))
    return e.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line"), F.coalesce(meta, F.when(F.col("kind") == "bad", "X_RUN,broken").otherwise(record)).alias("value"))


def shown_states(states: DataFrame) -> DataFrame:
    return states.select("file", "status", "run", "marker_line", "records", "bad", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query(LOG_STATES)
def log_states(table, spark):
    """Of each log the newest run that a marker names, and whether it is whole."""
    from ..sources import logs

    return shown_states(logs.run_states(logs.parsed(event_lines(table), "X_RUN_META,", "X_RUN,", 64), 9, 3))


@query(LOG_STATES)
def streamed_log_states(table, spark):
    """The same from a stream over three pieces of every log, a batch a piece, which stops after each and goes on from its checkpoint."""
    from ..operators.graph import _shared_folder, transient
    from ..streaming.runs import run_states

    lines, folder = event_lines(table), transient(spark, _shared_folder(spark), "stream")
    most = lines.agg(F.max("line")).first()[0] or 0
    answers = f"{folder}/answers"

    def follow() -> None:
        stream = spark.readStream.schema(lines.schema).parquet(f"{folder}/lines")
        states = run_states(stream, "X_RUN_META,", "X_RUN,", 9, 3)
        sink = states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        sink.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{answers}/batch={n}")).start().awaitTermination()

    for k in range(3):
        piece = lines.filter((F.col("line") >= most * k / 3) & (F.col("line") < most * (k + 1) / 3 if k < 2 else F.lit(True)))
        piece.write.mode("append").parquet(f"{folder}/lines")
        follow()
    states = spark.read.parquet(answers)
    newest = states.groupBy("file").agg(F.max_by(F.struct(*[c for c in states.columns if c not in ("file", "batch", "seen")]), F.struct("seen", "batch")).alias("s"))
    return shown_states(newest.select("file", "s.*"))


TERRAIN_ROWS = """SELECT *, 13 + list_sum([10 + length(k) FOR k IN ['caves', 'tunnels', 'uid'][1:n]]) + 15 * extra + 114 + pad AS size FROM (
    SELECT c_custkey::BIGINT AS row_id, (c_custkey // 8 % 60000)::INT AS w, c_custkey % 4 AS n, c_custkey * 7919 % 5 AS extra, c_custkey * 104729 % 3 = 0 AS squeezed, c_custkey * 31 % 13 * 100 AS pad FROM customer) WHERE row_id % 23 <> 0 AND n > 0"""


def terrain_script(row: int, world: int) -> bytes:
    """Up to three signal keys, others that do not count, and a text that is packed or only wrapped; some values are cut short."""
    value = dict.fromkeys(("caves", "tunnels", "uid")[: row % 4], 1) | {f"seed{k}": k for k in range(row * 7919 % 5)} | {"text": "a" * (100 + row * 31 % 13 * 100)}
    if row % 23 == 0:
        value = value | dict.fromkeys(("bounds", "rotation", "xOffset", "yOffset"), 0)
        return W.script(world, value, cut=9)
    return W.script(world, value, squeezed=row * 104729 % 3 == 0)


@query(f"""SELECT w AS "worldId", row_id, n AS signals, size::BIGINT AS size FROM ({TERRAIN_ROWS}) QUALIFY row_number() OVER (PARTITION BY w ORDER BY n DESC, size DESC, squeezed, row_id) = 1""")
def best_terrain_row(table, spark):
    """The script record that holds a world's terrain: most signal keys, most bytes unpacked, most bytes packed, least row id."""
    row = F.col("c_custkey").cast("long")
    made = records(table("customer").select(row.alias("row_id"), (F.floor(row / 8) % 60000).cast("int").alias("worldId")), terrain_script, ["row_id", "worldId"])
    return underground.terrain_rows(decode.lua_nodes(made), made).select("worldId", "row_id", "signals", "size")


#: Turns of a conversation that share a record.
TURNS_EACH = 64


def turn_table(n: int) -> dict:
    if n % 7 == 0:
        return {}
    return {1: n, 2: 0} if n % 5 == 0 else {"role": n} | ({"size": n} if n % 2 else {}) | ({"kind": "x"} if n % 3 == 0 else {})


@query(f"""WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, role = 'user' AS u FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    s AS (SELECT *, CASE WHEN n % 7 = 0 THEN '<no string keys; >' WHEN n % 5 = 0 THEN '<no string keys; int>' ELSE CASE WHEN n % 3 = 0 THEN 'kind, ' ELSE '' END || 'role' || CASE WHEN n % 2 = 1 THEN ', size' ELSE '' END END AS signature FROM t),
    k AS (SELECT CASE WHEN u THEN 'asked' ELSE 'said' END AS key, signature, count(*) AS tables, min((conv_id * 1000000 + turn // {TURNS_EACH}, turn)) AS first FROM s GROUP BY ALL)
    SELECT key, row_number() OVER (PARTITION BY key ORDER BY tables DESC, first)::BIGINT AS rank, signature, tables FROM k QUALIFY rank <= 20""")
def nested_signatures(table, spark):
    """Conversations as values, whose turns are tables of several shapes: the shapes below each key, commonest first, then first met."""
    t = table("conversations").filter("conv_id is not null and turn is not null")
    t = t.select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.coalesce(F.col("role") == "user", F.lit(False)).alias("u"), F.floor(F.col("turn") / TURNS_EACH).alias("block"))
    g = t.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "n", "u"))).alias("t"))

    def script(turns: list[dict]) -> bytes:
        value: dict = {"seed": 1, "asked": {}, "said": {}}
        for x in turns:
            value["asked" if x["u"] else "said"][x["turn"]] = turn_table(x["n"])
        return W.script(1, value)

    made = records(g.withColumn("row_id", F.col("conv_id") * 1000000 + F.col("block")), script, ["t"])
    return probes.nested_signatures(sound(decode.lua_nodes(made.select("row_id", F.lit(1).alias("worldId"), "data"))))


@query(SQL["tile_chunk_totals"])
def sql_tile_chunks(table, spark):
    """Chunks of tile files by kind, as SQL text over the table function."""
    register(spark)
    return spark.sql(
        """SELECT kind, count(*) AS chunks, count_if(NOT in_file) AS outside, sum(CAST(packed AS BIGINT)) AS packed, sum(CAST(full AS BIGINT)) AS full
        FROM {tiles} t, LATERAL tile_chunks(t.content) WHERE present GROUP BY kind""",
        tiles=tile_files(table),
    )


@query("""SELECT CASE WHEN c % 9 = 0 THEN 'envelope:truncated' WHEN c % 8 = 0 THEN 'envelope:trailing' ELSE 'decoded' END AS reason, count(*) AS records, CASE WHEN c % 9 > 0 AND c % 8 > 0 THEN sum(c)::BIGINT END AS total
    FROM (SELECT DISTINCT conv_id AS c FROM conversations) GROUP BY 1, c % 9 > 0 AND c % 8 > 0""")
def sql_value_nodes(table, spark):
    """Values in script records and why they cannot be read, as SQL text over the table function."""
    register(spark)

    def script(conv: int) -> bytes:
        blob = W.script(1, conv)
        return blob[:-1] if conv % 9 == 0 else blob + b"x" if conv % 8 == 0 else blob

    rows = records(table("conversations").select("conv_id").distinct(), script, ["conv_id"])
    return spark.sql("SELECT coalesce(n.reject_reason, 'decoded') AS reason, count(*) AS records, sum(n.i) AS total FROM {scripts} s, LATERAL value_nodes(s.data) n GROUP BY 1", scripts=rows)


@query("""SELECT k, lead AS "offset", count(*) AS blobs, CASE WHEN k = 0 THEN 0 ELSE 4913 END::BIGINT AS dense FROM (SELECT s_suppkey % 4 AS k, (s_nationkey % 5)::INT AS lead FROM supplier) GROUP BY ALL""")
def sql_block_starts(table, spark):
    """Where a block of a chunk's voxels begins behind up to four bytes that begin none, all offsets searched, as SQL text."""
    register(spark)
    p = table("supplier").select((F.col("s_suppkey") % 4).alias("k"), (F.col("s_nationkey") % 5).cast("int").alias("lead"))
    blobs = records(p, lambda k, lead: b"\xff" * lead + W.lz4(bytes([k * 65]) * 17**3), ["k", "lead"])
    return spark.sql("SELECT k, b.offset, count(*) AS blobs, max(b.dense) AS dense FROM {blobs} s, LATERAL block_starts(s.data) b WHERE b.packed + b.offset = length(s.data) GROUP BY k, b.offset", blobs=blobs)
