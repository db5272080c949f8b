"""Table functions and scalar functions by name in SQL text, against the DataFrame forms."""

import math

import pytest

from tessera.domain import probes
from tessera.functions.surface import register, scalars
from tessera.operators import boxes as B
from tessera.operators.relational import ladder
from tessera.sinks.formats import lz4, script, tile_of
from tessera.sources import decode


@pytest.fixture(scope="module")
def named(spark):
    assert {"value_nodes", "nearest_face", *scalars()} <= set(register(spark)) == set(register(spark))  # a second time is no error
    return spark


def test_table_functions(named):
    value = {"a": 1, "b": {"c": "x", 2: True}}
    blobs = [(1, script(5, value)), (2, script(5, value)[:-1]), (3, None), (4, b"")]
    df = named.createDataFrame(blobs, "row_id long, data binary").selectExpr("row_id", "5 as worldId", "data")
    got = named.sql("SELECT s.row_id, 5 AS worldId, n.* FROM {s} s, LATERAL value_nodes(s.data) n", s=df)
    want = decode.lua_nodes(df)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    files = named.createDataFrame([("t", tile_of([{}, {}], 2)), ("short", b"TILE"), ("none", None)], "path string, content binary")
    got = named.sql("SELECT t.path, c.* FROM {t} t, LATERAL tile_chunks(t.content) c", t=files)
    assert sorted(map(str, got.collect())) == sorted(map(str, decode.tile_chunks(files).collect()))


def test_block_starts(named):
    df = named.createDataFrame([(1, b"\xff" + lz4(bytes([70]) * 17**3)), (2, b"nothing"), (3, b"")], "id long, data binary")
    got = named.sql("SELECT s.id, b.offset, b.packed, b.sha256, b.dense, b.materials FROM {s} s, LATERAL block_starts(s.data) b WHERE b.reject_reason IS NULL", s=df)
    want = {tuple(map(str, r)) for r in probes.lz4_starts(df).collect()}
    assert want and {tuple(map(str, r)) for r in got.collect()} == want


def test_scalar_functions(named):
    rows = [(k, float(k % 7 - 1), float(k % 5), float(k % 11) / 2) for k in range(80)] + [(99, None, 1.0, 1.0)]
    box = ", ".join(f"{lo}D AS {a}0, {hi}D AS {a}1" for a, lo, hi in (("x", 0, 4), ("y", 1, 3), ("z", -1, 3)))
    points = named.createDataFrame(rows, "id long, x double, y double, z double").selectExpr("*", *[f"{c}" for c in box.split(", ")])
    at = "x, y, z, x0, x1, y0, y1, z0, z1"
    got = {r["id"]: r for r in named.sql(f"SELECT id, f.*, box_distance({at}) AS d, contact_bucket(f.distance) AS b FROM (SELECT *, nearest_face({at}) AS f FROM {{p}})", p=points).collect()}
    want = {r["id"]: r for r in B.faces(points.filter("x is not null")).withColumn("b", ladder(points["x"], [4.1])).collect()}
    assert got.keys() - want.keys() == {99} and got[99]["d"] is None and got[99]["face"] is None and got[99]["b"] is None
    for k, w in want.items():
        assert (got[k]["face"], got[k]["u"], got[k]["v"]) == (w["face"], w["u"], w["v"])
        out = [max(lo - v, v - hi, 0) for v, lo, hi in ((w["x"], 0, 4), (w["y"], 1, 3), (w["z"], -1, 3))]
        assert got[k]["d"] == pytest.approx(math.sqrt(sum(d * d for d in out)))
    buckets = named.sql("SELECT ray_bucket(0.5), ray_bucket(0.6), ray_bucket(33), contact_bucket(4.1), contact_bucket(CAST(NULL AS DOUBLE))").first()
    assert tuple(buckets) == ("<=0.5", "<=1", ">32", "<=4.1", None)
