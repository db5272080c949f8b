import random

import pytest
from pyspark.sql import functions as F

from tessera.domain import topology as T
from tessera.operators import boxes as B

NODE = "id int, name string, tags array<string>, role string, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"


def cube(i, x, role, y=0.0, z=0.0):
    return (i, f"{role}_{i}", [role], role, x, x + 32, y, y + 32, z, z + 32)


@pytest.fixture(scope="module")
def layout(spark):
    """Elevator, passage and pocket in a row; a tunnel from the elevator to the pocket, longer than the two contacts; a cave apart."""
    nodes = spark.createDataFrame([cube(0, 0.0, "elevator"), cube(1, 32.0, "passage"), cube(2, 64.0, "pocket"), cube(3, 500.0, "cave"), cube(4, 64.0, "ramp", z=32.0)], NODE)
    points = spark.createDataFrame([(7, 0, 16.0, 34.0, 16.0), (7, 1, 80.0, 36.0, 16.0), (8, 0, 0.0, 0.0, 0.0), (8, 1, 300.0, 0.0, 0.0)], "tunnel_id int, ord int, x double, y double, z double")
    lengths = spark.createDataFrame([(7, 100.0), (8, 300.0)], "tunnel_id int, length double")
    return nodes, T.topology(nodes, points, lengths)


def test_topology(layout):
    nodes, links = layout
    got = sorted((r["a"], r["b"], r["evidence"], r["axis"], r["length"]) for r in links.collect())
    assert got == [(0, 1, "contact", "x", 32.0), (0, 2, "tunnel", None, 100.0), (1, 2, "contact", "x", 32.0), (2, 4, "contact", "z", 32.0)]
    sizes = lambda h: sorted(r["size"] for r in T.summary(nodes, links, h).collect())
    assert sizes(False) == [1, 4] and sizes(True) == [1, 1, 3]
    assert {r["pair"]: r["links"] for r in T.pair_types(nodes, links).filter("evidence = 'tunnel'").collect()} == {"elevator <-> pocket": 1}


def test_routes_prefer_recorded_tunnels(layout):
    nodes, links = layout
    tree = T.routes(nodes, links)
    got = {r["node"]: (r["contacts"], r["distance"]) for r in tree.collect()}
    assert got == {0: (0, 0.0), 2: (0, 100.0), 1: (1, 32.0), 4: (1, 132.0)}
    assert T.route_to(nodes, tree, "RAMP") == [0, 2, 4]
    with pytest.raises(ValueError):
        T.route_to(nodes, tree, "cave")
    with pytest.raises(ValueError):
        T.routes(nodes.filter("id > 0"), links)


def test_regions_and_overlaps_of_random_boxes(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        x, y, z = (rng.uniform(-200, 200), rng.uniform(-200, 200), rng.uniform(0, 60))
        rows.append((i, x, x + rng.uniform(5, 90), y, y + rng.uniform(5, 90), z, z + rng.uniform(5, 40)))
    df = spark.createDataFrame(rows, "id int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and all(min(a[k + 1], b[k + 1]) - max(a[k], b[k]) > 1e-6 for k in (1, 3, 5))}
    got = [(r["a"], r["b"]) for r in B.overlaps(df).collect()]
    assert len(got) == len({*got}) and {*got} == want
    label = {r["id"]: r["region"] for r in T.regions(df).collect()}
    assert all(label[a] == label[b] for a, b in want) and sorted({*label.values()}) == [*range(1, len({*label.values()}) + 1)]


def test_nearest_box_ties(spark):
    boxes = spark.createDataFrame([(5, 0.0, 10.0, 0.0, 10.0, 0.0, 10.0), (2, 0.0, 20.0, 0.0, 20.0, 0.0, 20.0), (9, 100.0, 101.0, 0.0, 1.0, 0.0, 1.0)], "id int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    points = spark.createDataFrame([("in", 1.0, 1.0, 1.0), ("edge", 105.0, 0.5, 0.5), ("far", 105.1, 0.5, 0.5)], "point string, x double, y double, z double")
    assert {r["point"]: (r["box"], r["distance"]) for r in B.nearest_box(points, boxes, 4.0).collect()} == {"in": (5, 0.0), "edge": (9, 4.0)}


def test_tiles_templates_and_turns(spark):
    paths = ["$A\\TunnelPocket\\Passage_Gold_2x3x4.TILE", "x", "a/Cave/Cyrstal_Crystal_spark.tile", "a/cave/Elevator_1x1x1.tile", "a/pocket/b.tile", "a/POI/formation.tile"]
    t = [tuple(r) for r in T.tile_facts(spark.createDataFrame([(p,) for p in paths], "path string")).withColumn("role", T.role(F.col("family"), F.col("tags"))).select("family", "tags", "tile_w", "tile_d", "tile_h", "role").collect()]
    assert t == [
        ("tunnel_pocket", ["passage", "gold"], 2, 3, 4, "passage"), ("other", [], None, None, None, "other"), ("cave", ["sparkstone", "crystal"], None, None, None, "cave"),
        ("elevator", ["elevator"], 1, 1, 1, "elevator"), ("pocket", [], None, None, None, "pocket"), ("poi", ["formations"], None, None, None, "other"),
    ]
    box = (0.0, 32.0, 0.0, 32.0, 0.0, 32.0)
    seen = [("n", 1, 0.5, 15.0, 9.0, *box), ("n", 2, 0.2, 17.0, 7.0, *box), ("n", 2, 31.9, 16.0, 8.0, *box), ("n", 2, 31.8, 16.0, 8.0, *box)]
    df = spark.createDataFrame(seen, "name string, placement int, x double, y double, z double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    assert [(r["face"], r["u"], r["v"], r["seen"], r["placements"]) for r in T.templates(df).collect()] == [("x-", 16.0, 8.0, 2, 2)]
