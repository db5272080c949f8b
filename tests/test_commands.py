"""The commands on a synthetic save and tile, and the command line's words."""

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import fixtures as X

from tessera import commands as C
from tessera.__main__ import arguments
from tessera.sinks import formats as W

TILE = X.Uuid(bytes(range(16)))
UUID = "00010203-0405-0607-0809-0a0b0c0d0e0f"


@pytest.fixture(scope="module")
def save(tmp_path_factory, spark):
    at = tmp_path_factory.mktemp("save")
    lift = X.Uuid(bytes(range(16, 32)))
    tree = {
        "tileList": {0: TILE, 1: lift}, "caves": {0: {0: {1: 1 | 1 << 8 | 3 << 12}, 1: {1: 0 | 1 << 8 | 3 << 12}}},
        "tunnels": {7: {"tunnelType": "TtDefault", "positions": [(60.0, 32.0, 48.0), (70.0, 32.0, 48.0)]}, 8: {"tunnelType": "MainVein", "positions": [(128.0, 32.0, 48.0), (200.0, 32.0, 48.0)]}},
        "spawners": {0: {0: {1: {"pos": (3.0, 4.0, 20.0), "scale": (1.0, 1.0, 1.0), "tags": {1: "a"}}}}},
    }
    path = X.save(at / "a.db", worlds=[(13, X.world(13, "UndergroundWorld", '{"path": "x/Deep.world", "depth": 1}'))], scripts=[(13, X.script(13, tree))], voxels=[(1, 13, 0, 0, X.voxel(1, 0, 3, 5))], portals=[(1, 13, 0, 0, 65535, 0, 0, X.portal(13, (20.0, 20.0, 20.0), header=W.portal_header(1, (13, 0, 0), (65535, 0, 0))))])
    catalog = str(at / "catalog")
    spark.createDataFrame([(UUID, "x/Cave/Room_4x4x4.tile"), ("10111213-1415-1617-1819-1a1b1c1d1e1f", "x/Cave/Elevator_4x4x4.tile")], "tile_uuid string, path string").write.parquet(catalog)
    return path, catalog, at


def rows(out):
    return {k: [r.asDict(True) for r in v.collect()] for k, v in out.items()}


def test_reading_commands(spark, save):
    path, _, at = save
    assert {r["table_name"] for r in rows(C.COMMANDS["inspect"](spark, path))["tables"]} == {"GenericData", "ScriptData", "VoxelTerrain", "Portal"}
    assert rows(C.COMMANDS["schema"](spark, path, "Portal"))["columns"][0]["pk"]
    assert rows(C.COMMANDS["worlds"](spark, path, X.MARKER.hex()))["worlds"][0]["label"] == "D1 Deep"
    g = rows(C.COMMANDS["graph"](spark, path, X.MARKER.hex()))
    assert g["counts"][0]["unresolved"] == 1 and g["cells"][0]["sides"] == "A"
    p = rows(C.COMMANDS["portal-probe"](spark, path, world=13))
    assert p["portals"][0]["header_matches"] and p["floats"]
    assert rows(C.COMMANDS["terrain-chunks"](spark, path, 13))["summary"][0]["decoded"] == 1
    assert rows(C.COMMANDS["terrain-data"](spark, path, 13))["rows"][0]["signals"] == 4
    with pytest.raises(ValueError):
        C.COMMANDS["terrain-chunks"](spark, path, 13, limit=5001)


def test_layout_commands(spark, save):
    path, catalog, at = save
    own = rows(C.COMMANDS["underground-layout"](spark, path, 13, catalog))
    assert [(r["family"], r["complete"], r["dimensions_match"]) for r in own["structures"]] == [("elevator", True, True), ("cave", True, True)]
    assert {r["kind"] for r in own["search"]} == {"group", "tunnel"}
    g = rows(C.COMMANDS["underground-graph"](spark, path, 13))
    assert g["summary"][0]["nodes"] == 3 and g["summary"][0]["edges"] == 2
    r = rows(C.COMMANDS["underground-route"](spark, path, 13, catalog, node=2))
    assert r["report"][0]["tunnel_segments"] == 1 and r["report"][0]["contact_segments"] == 0
    C.COMMANDS["underground-route-map"](spark, path, 13, str(at / "route.svg"), catalog, node=2)
    drawn = (at / "route.svg").read_text()
    assert drawn.count("<rect") == 2 and drawn.count("<polyline") == 3 and 'class="route"' in drawn and drawn.count("<circle") == 1
    n = rows(C.COMMANDS["underground-navigation"](spark, path, 13, catalog, least=1))
    assert n["diagnosis"][0]["contacts"] == 1 and n["counts"][0]["either"] == 1


def test_tile_commands(spark, tmp_path):
    solid = bytes(8 if z < 3 else 0 for _ in range(256) for z in range(16))
    tile = tmp_path / "Room_1x1x1.tile"
    tile.write_bytes(W.tile_of([{"voxel_terrain": (1, W.blocks_body([((0, 0, 0), solid)])), "node": (2, W.nodes_body([((0.2, 8.0, 3.5), {"tunnel": {}}), ((15.8, 8.0, 3.5), {"tunnel": {}})]))}]))
    # two nodes of one group: the count is that of the directory
    space = rows(C.COMMANDS["tile-voxel-space"](spark, str(tile)))
    assert space["groups"][0]["sockets"] == ["cell0:node0", "cell0:node1"] and space["components"][0]["cells"] == 256 * 13
    walk = rows(C.COMMANDS["tile-voxel-walk"](spark, str(tile)))
    assert walk["walks"][0]["status"] == "walk" and walk["walks"][0]["length"] == 15.0
    assert {r["kind"] for r in rows(C.COMMANDS["tile-probe"](spark, str(tile)))["totals"]} == {"node", "voxel_terrain"}
    plan = {
        "world_id": 3, "alignment": {"status": "two_or_more_independent_tunnel_anchors"}, "world_bounds": {"min": [100.0, 50.0, 20.0], "max": [116.0, 66.0, 36.0]}, "layout_rotation_quarter_turns": 0, "tile_dimensions_m": [16, 16, 16],
        "critical_edge": {"world_samples": [{"world_xy": [107.0 + lane + 0.1, 57.0 + k / 2], "estimated_surface_world_z": 22.5, "fraction": k / 4, "lateral_offset_m": float(lane)} for lane in range(3) for k in range(5)]},
    }
    (tmp_path / "plan.json").write_text(json.dumps(plan))
    lines = ["X_META,world=3,count=15"] + [f"X,{k},1,{s['world_xy'][0]},{s['world_xy'][1]},22.5,3,22.4,0,0,1,terrain" for k, s in enumerate(plan["critical_edge"]["world_samples"])]
    (tmp_path / "game.log").write_text("\n".join(lines))
    args = {"plan": str(tmp_path / "plan.json"), "mark": "X"}
    assert len(rows(C.COMMANDS["tile-ground-extract"](spark, logs_dir=f"file://{tmp_path}", **args))["records"]) == 15
    c = rows(C.COMMANDS["tile-ground-compare"](spark, log=f"file://{tmp_path}/game.log", **args))
    assert {r["status"] for r in c["samples"]} == {"hit"} and len(c["grades"]) == 12 and len(c["across"]) == 10
    a = rows(C.COMMANDS["tile-ground-audit"](spark, log=f"file://{tmp_path}/game.log", tile=str(tile), **args))
    assert len(a["hypotheses"]) == 16 and len(a["held_out"]) == 3 and {(r["hits"], r["spans"]) for r in a["facets"]} == {(5, False)}
    assert {(r["below"], r["above"]) for r in a["pairs_0.0"]} == {(8, 0)}
    grid = rows(C.COMMANDS["tile-ground-grid-plan"](spark, log=f"file://{tmp_path}/game.log", tile=str(tile), out=str(tmp_path / "new.json"), size=3, **args))["grid"]
    assert len(grid) == 9 and json.loads((tmp_path / "new.json").read_text())["tile_dimensions_m"] == [16, 16, 16]


def test_words():
    assert arguments(C.underground_route, ["--save", "a.db", "--world", "3", "--vertical", "--tag", "gold"]) == {"save": "a.db", "world": 3, "vertical": True, "tag": "gold"}
    for bad in (["--nothing", "1"], ["--world"], ["world", "1"]):
        with pytest.raises(SystemExit):
            arguments(C.underground_route, bad)
