import os
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import fixtures as X

from tessera.domain import terrain, underground
from tessera.sources import codecs, decode, logs, savedb

TILE = X.Uuid(bytes(range(16)))
TREE = {
    "tileList": [TILE],
    "caves": {2: {3: {1: 1 | 2 << 8 | 1 << 12 | 1 << 16 | 3 << 20}}},
    # two halves of a 2 x 1 pocket
    "pockets": {0: {0: {1: 1 | 3 << 8 | 0 << 16, 2: True}, 1: {1: 1 | 0 << 8 | 0 << 16 | 1 << 24}}},
    "tunnels": {7: {"tunnelType": "Vein", "positions": [(0.0, 0.0, 0.0), (3.0, 4.0, 0.0), (3.0, 4.0, 12.0)]}, 8: {"positions": [(1.0, 1.0, 1.0)]}},
}


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    return X.save(
        tmp_path_factory.mktemp("save") / "a.db",
        worlds=[(1, X.world(1, "Overworld", "{}")), (13, X.world(13, "UndergroundWorldX", '{"path": "a/b/Deep.world", "depth": 1.0}')), (5, X.world(6, "DungeonWorld", "")), (9, b"short"), (4, X.world(4, "WarehouseWorld", '{"warehouseIndex": 2, "level": 1, "maxLevels": 4}'))],
        scripts=[(13, X.script(13, TREE)), (13, X.script(13, {"seed": 5})), (13, b"broken"), (13, None)],
        voxels=[(1, 13, 0, 0, X.voxel(1, 0, 3, 5)), (2, 13, 0, 0, X.voxel(2, 4, 0, 5)), (3, 13, -1, 0, X.voxel(3, -1, 0, 64)), (4, 13, 0, 0, X.voxel(5, 0, 0, 0)), (5, 13, 0, 0, b"\x10"), (6, 13, 0, 0, X.voxel(6, 0, 3, 5)), (7, 2, 1, 1, X.voxel(7, 4, 4, 0, b"xxx"))],
        portals=[(1, 1, 0, 1, 13, 0, 0, X.portal(1, (5, 70, 0), 13, (1, 1, 1))), (2, 1, 0, 0, 65535, 0, 0, X.portal(1, (5, 5, 0))), (3, 1, 9, 9, 13, 0, 0, X.portal(1, (5, 5, 0), 13, (1, 1, 1))), (4, 1, 0, 0, 1, 0, 0, b"tiny")],
    )


def read(spark, path, table, **o):
    return savedb.read_table(spark, path, table, **o)


def test_source_splits_and_filters(spark, path, tmp_path):
    df = read(spark, path, "VoxelTerrain", rows=2)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 7
    spark.conf.set(savedb.PUSHDOWN, True)
    try:
        pushed = read(spark, path, "VoxelTerrain").filter("worldId = 2 and y >= 1 and data is not null")
        assert [r["id"] for r in pushed.collect()] == [7]
        assert read(spark, path, "VoxelTerrain").filter("worldId = 2 or x < 0").count() == 2  # what cannot be pushed stays
    finally:
        spark.conf.set(savedb.PUSHDOWN, False)
    assert savedb.tables(path) == ["GenericData", "Portal", "ScriptData", "VoxelTerrain"]
    other = tmp_path / "x.db"
    other.write_bytes(b"not a database")
    with pytest.raises(ValueError):
        savedb.tables(str(other))


def test_pushed_filters_run_in_the_database(path):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, LessThan

    r = savedb.PushingReader({"path": path, "table": "VoxelTerrain", "rows": "100"})
    kept = [EqualTo(("data",), b"x"), In(("x",), (1, 2)), IsNotNull(("data",))]
    assert [*r.pushFilters([EqualTo(("worldId",), 13), LessThan(("row_id",), 4), *kept])] == kept
    assert [row[0] for part in r.partitions() for row in r.read(part)] == [1, 2, 3]


def test_short_files_and_inspection(spark, path, tmp_path):
    short = tmp_path / "short.db"
    short.write_bytes(savedb.MAGIC)
    with pytest.raises(ValueError):
        savedb.tables(str(short))
    counts, facts = savedb.inspect(spark, path)
    assert {r["table_name"]: r["records"] for r in counts.collect()} == {"GenericData": 5, "Portal": 4, "ScriptData": 4, "VoxelTerrain": 7} and facts["signal"] == "4/6"
    rows = savedb.preview(read(spark, path, "VoxelTerrain"), 2, "id").collect()
    assert len(rows) == 2 and rows[0]["data"]["size"] > 32 and len(rows[0]["data"]["hex_prefix"]) == 64
    with pytest.raises(ValueError):
        savedb.preview(read(spark, path, "VoxelTerrain"), 101)
    for k, name in enumerate(("b", "A", "c")):
        at = tmp_path / f"user{k}" / "Save" / "Survival"
        at.mkdir(parents=True)
        (at / f"{name}.db").write_bytes(b"x" * (k + 1))
        os.utime(at / f"{name}.db", (1000 + k // 2, 1000 + k // 2))
    assert [(r["name"], r["size_bytes"]) for r in savedb.discover(spark, f"file://{tmp_path}").collect()] == [("c", 3), ("b", 1), ("A", 2)]
    assert savedb.discover(spark, f"file://{tmp_path}/none").count() == 0


def test_gaps_in_rowids_make_no_empty_ranges(spark, tmp_path):
    far = X.save(tmp_path / "far.db", voxels=[(k, 1, 0, 0, b"x") for k in (1, 2, 10**12, -(10**12), 3)])
    df = read(spark, far, "VoxelTerrain", rows=2)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 5


def test_prefixes_of_blocks():
    block = bytes([0x1F]) + b"a" + b"\x01\x00" + bytes([5]) + bytes([0x10]) + b"b"
    assert codecs.lz4_prefix(block + b"more", 26) == (b"a" * 25 + b"b", len(block))
    assert codecs.lz4_exact(block, 26) == b"a" * 25 + b"b"
    for data, size in ((block + b"x", 26), (block, 25), (block, 27), (b"", 1)):
        with pytest.raises(codecs.Reject):
            codecs.lz4_exact(data, size)


def test_worlds(spark, path):
    got = {r["worldId"]: r for r in decode.worlds(read(spark, path, "GenericData"), X.MARKER).collect()}
    assert (got[13]["kind"], got[13]["label"], got[13]["seed"]) == ("underground", "D1 Deep", 77)
    assert got[4]["label"] == "Warehouse 2 L1/4" and got[1]["label"] == "Overworld"
    assert got[5]["reject_reason"] == "world mismatch" and got[9]["reject_reason"] == "envelope:short"


def test_voxels_and_their_reject_reasons(spark, path):
    df = decode.voxels(read(spark, path, "VoxelTerrain"))
    assert {r["id"]: r["reject_reason"] for r in df.collect()} == {1: None, 2: "cell_x", 3: "chunk_z", 4: "id", 5: "lz4:truncated literals", 6: None, 7: "magic"}
    s = {r["worldId"]: r for r in terrain.chunk_summary(df).collect()}
    assert (s[13]["decoded"], s[13]["rejected"], s[13]["surplus"], s[13]["min_chunk_z"]) == (2, 4, 1, 5)
    assert (s[2]["decoded"], s[2]["min_chunk_x"]) == (0, None)


def test_terrain_summary(spark, path):
    worlds = decode.worlds(read(spark, path, "GenericData"), X.MARKER)
    got = {r["worldId"]: r for r in terrain.terrain_summary(read(spark, path, "VoxelTerrain"), worlds).collect()}
    assert (got[13]["records"], got[13]["cells"], got[13]["label"], got[13]["records_per_cell"]) == (6, 2, "D1 Deep", 3.0)
    assert got[2]["label"] == "unknown"


def test_portals_and_world_graph(spark, path):
    df = decode.portals(read(spark, path, "Portal"))
    got = {r["id"]: r for r in df.collect()}
    assert [got[k]["matches"] for k in (1, 2, 3, 4)] == [True, True, False, None]
    assert got[1]["position_a"] == [5.0, 70.0, 0.0] and got[4]["reject_reason"] == "portal:short"
    worlds = decode.worlds(read(spark, path, "GenericData"), X.MARKER)
    g = terrain.world_graph(df, worlds)
    assert {r["id"]: (r["labelA"], r["labelB"]) for r in g.collect()}[2] == ("Overworld", "unresolved")
    assert {r["id"] for r in terrain.world_graph(df, worlds, underground=True).collect()} == {1, 3}


def test_layout(spark, path):
    script = read(spark, path, "ScriptData")
    nodes = decode.lua_nodes(script)
    assert {r["reason"]: r["records"] for r in decode.reject_tally(nodes).collect()}.keys() == {"decoded", "envelope:short", "not_blob"}
    assert [(r["worldId"], r["row_id"], r["signals"]) for r in underground.terrain_rows(nodes, script).collect()] == [(13, 1, 4)]
    nodes = nodes.filter("reject_reason is null")
    p = {(r["kind"], r["cell_x"]): r for r in underground.pieces(nodes).collect()}
    cave = p["cave", 3]
    assert (cave["x"], cave["y"], cave["z"], cave["height"], cave["rotation"], cave["source_x"]) == (192.0, 128.0, 32.0, 32.0, 3, 4)
    assert cave["tile_uuid"] == "00010203-0405-0607-0809-0a0b0c0d0e0f" and len(p) == 3
    tiles = spark.createDataFrame([(cave["tile_uuid"], 2, 1)], "tile_uuid string, tile_w int, tile_d int")
    placed = underground.placements(underground.pieces(nodes), tiles).collect()
    assert [(r["fragments"], r["complete"], r["overlap"], r["origin_x"]) for r in placed] == [(2, True, 0, 48.0)]
    lengths = underground.tunnel_lengths(underground.tunnels(nodes)).collect()
    assert [(r["tunnel_id"], r["tunnel_type"], r["points"], r["length"]) for r in lengths] == [(7, "Vein", 3, 17.0)]


def test_repeated_keys_keep_their_place():
    rows = [*codecs.lua_nodes(X.lua(X.Pairs([(1, "a"), ("k", "b"), (1.0, "c"), (True, "d")])))]
    assert [(r["key_int"], r["key_str"], r["s"]) for r in rows[1:]] == [(1, None, "d"), (None, "k", "b")]


def test_lz4():
    assert codecs.lz4_block(X.lz4(b"x" * 700), 1000) == b"x" * 700
    assert codecs.lz4_block(bytes([0x1F]) + b"a" + b"\x01\x00" + bytes([5]) + bytes([0x10]) + b"b", 100) == b"a" * 25 + b"b"
    for bad in (b"", b"\xf0", b"\x10", bytes([0x10]) + b"a\x05\x00", bytes([0x10]) + b"a\x09\x00\x00"):
        with pytest.raises(codecs.Reject):
            codecs.lz4_block(bad, 100)
    with pytest.raises(codecs.Reject):
        codecs.lz4_block(X.lz4(b"x" * 700), 100)


def test_tiles(spark, tmp_path):
    (tmp_path / "a.tile").write_bytes(X.tile([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]))
    (tmp_path / "b.tile").write_bytes(b"junk")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}").select("path", "content")
    chunks = decode.tile_chunks(files)
    assert chunks.filter("present").select("kind", "count", "in_file").collect() == [("harvestable", 2, True)]
    assert chunks.filter("reject_reason = 'tile:short'").count() == 1
    got = decode.tile_objects(files).filter("reject_reason is null").orderBy("number").collect()
    assert [(r["x"], r["y"], r["z"], r["tail_hex"]) for r in got] == [(1.0, 2.0, 3.0, b"123456789".hex()), (4.0, 5.0, 6.0, b"123456789".hex())]


MARKER, RECORD = "X_GROUND_META,", "X_GROUND,"


def log(world, count, rows, extra=""):
    return [f"12:00 {MARKER}world={world},count={count}", *[f"x {RECORD}{k},1,1.0,2.0,3.0,{world},4.0,0,0,1,terrain{extra}" for k in rows], "noise", "[ui] BACKGROUND,loaded"]


def test_latest_run(spark, tmp_path):
    frame = lambda lines: spark.createDataFrame([("f", k, v) for k, v in enumerate(lines)], "file string, line long, value string")
    parsed = lambda lines: logs.parsed(frame(lines), MARKER, RECORD)
    rows = parsed(log(3, 2, [0, 1]) + log(4, 1, [0]) + log(3, 2, [0, 1], ",new"))
    assert [r["kind"] for r in logs.latest_run(rows, 3, 2).orderBy("index").collect()] == ["terrain,new"] * 2
    with pytest.raises(ValueError):  # a broken newest run does not give way to an older one
        logs.latest_run(parsed(log(3, 2, [0, 1]) + log(3, 2, [0])), 3, 2)
    with pytest.raises(logs.NoRun):
        logs.latest_run(rows, 5, 2)
    with pytest.raises(ValueError):
        logs.latest_run(parsed([f"{MARKER}world=x"] + log(3, 2, [0, 1])), 3, 2)
    bad = parsed([f"{RECORD}1,2", f"{RECORD}-1,1,1,2,3,4,5,6,7,8,k"])
    assert [r["reject_reason"] for r in bad.orderBy("line").collect()] == ["fields", "values"]


def test_newest_log(spark, tmp_path):
    for k, (name, lines) in enumerate({"game1.log": log(3, 2, [0, 1]), "game2.log": log(3, 2, [0, 1], ",new"), "game3.log": log(9, 1, [0]), "other.log": ["x"]}.items()):
        (tmp_path / name).write_text("\n".join(lines))
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    folder = f"file://{tmp_path}"
    got = logs.newest_run(spark, folder, 3, 2, MARKER, RECORD)
    assert {r["kind"] for r in got.collect()} == {"terrain,new"}
    logs.write_run(got, f"{folder}/run", RECORD)
    assert [r["value"][:11] for r in spark.read.text(f"{folder}/run").collect()] == [f"{RECORD}0,", f"{RECORD}1,"]
    (tmp_path / "game4.log").write_text("\n".join(log(3, 2, [0])))
    with pytest.raises(ValueError):  # the newest run is broken
        logs.newest_run(spark, folder, 3, 2, MARKER, RECORD)
    with pytest.raises(logs.NoRun):
        logs.newest_run(spark, folder, 8, 2, MARKER, RECORD)


def test_plans():
    sample = lambda x: {"world_xy": [x, 1.0], "estimated_surface_world_z": 2}
    plan = {"world_id": 3, "alignment": {"status": "two_or_more_independent_tunnel_anchors"}, "critical_edge": {"world_samples": [sample(1), sample(2)]}}
    assert logs.checked_plan(plan) == (3, plan["critical_edge"]["world_samples"])
    for broken in ({}, [], plan | {"world_id": True}, plan | {"alignment": {}}, plan | {"critical_edge": {"world_samples": []}}, plan | {"critical_edge": {"world_samples": [sample(1), sample(1.0)]}}, plan | {"critical_edge": {"world_samples": [sample(float("nan"))]}}):
        with pytest.raises(ValueError):
            logs.checked_plan(broken)


def test_the_terrain_row_of_a_world(spark):
    """Signal keys first, then bytes unpacked, then bytes packed, then the row id; keys that are none and values cut short do not count."""
    rng = random.Random(4)
    noise = bytes(rng.randrange(33, 126) for _ in range(400)).decode()
    rows = [
        (10, 1, {"tunnels": {}, "data": 1, "seed": 2}, False),
        (11, 1, {"tunnels": {}, "caves": {}}, False),
        (20, 2, {"caves": {}, "x": noise}, True),  # more bytes packed
        (21, 2, {"caves": {}, "x": "a" * 401}, True),  # more bytes unpacked
        (30, 3, {"uid": 1, "x": "ab" * 200}, True),
        (31, 3, {"uid": 1, "x": noise}, True),  # as many unpacked, more packed
        (32, 3, {"uid": 1, "x": noise}, True),
        (40, 4, {"data": 1}, False),
        (50, 5, {"bounds": 1}, False),
        (51, 5, {"bounds": 1, "caves": 2, "uid": "a" * 300}, False),
        (60, 6, ["caves", "uid"], False),
    ]
    made = [(r, w, X.script(w, v, squeezed)) for r, w, v, squeezed in rows]
    made = [(r, w, b[:-20] if r == 51 else b) for r, w, b in made] + [(70, 7, None)]
    made += [(52, 5, X.script(5, {"bounds": 1, "caves": 2, "uid": "a" * 90}, cut=30))]
    script = spark.createDataFrame(made, "row_id long, worldId int, data binary").repartition(3)
    got = underground.terrain_rows(decode.lua_nodes(script), script).collect()
    assert sorted((r["worldId"], r["row_id"], r["signals"]) for r in got) == [(1, 11, 2), (2, 21, 1), (3, 31, 1), (5, 50, 1)]
