"""Crowded grids: equal results, and what a cell or block compares is bounded."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import boxes, grid, spatial

AXES = ("x", "y", "z")


def crowd(rng, n):
    """Half of the boxes in one small place, of which many lie in the same; others far and wide, some large."""
    out = []
    for i in range(n):
        if i % 2:
            x, y, z, w = rng.choice([rng.random() * 4, 1.0, 2.0]), rng.choice([rng.random() * 4, 1.0]), rng.randrange(3), rng.choice([0.5, 0.5, 1.0])
        else:
            x, y, z, w = rng.random() * 2000 - 1000, rng.random() * 2000 - 1000, rng.randrange(3), rng.choice([1.0, 30.0, 200.0])
        out.append((i, x, x + w, y, y + w, float(z), z + 1.0))
    return out


SCHEMA = "id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"


@pytest.fixture(scope="module")
def some():
    return crowd(random.Random(3), 300)


@pytest.mark.parametrize("most", [1 << 22, 60])
def test_overlaps_and_contacts(spark, some, monkeypatch, most):
    monkeypatch.setattr(grid, "MOST_PAIRS", most)
    df = spark.createDataFrame(some, SCHEMA)
    over = lambda a, b, i: min(a[i + 1], b[i + 1]) - max(a[i], b[i])
    pairs = [(a, b) for a in some for b in some if a[0] < b[0]]
    assert sorted(map(tuple, boxes.overlaps(df).collect())) == sorted((a[0], b[0]) for a, b in pairs if all(over(a, b, i) > 1e-6 for i in (1, 3, 5)))
    touch = {(a[0], b[0]) for a, b in pairs for i in (1, 3, 5) if abs(over(a, b, i)) <= 1e-6 and (a[i + 1] <= b[i + 1]) != (b[i + 1] <= a[i + 1]) and all(over(a, b, j) > 1e-6 for j in (1, 3, 5) if j != i)}
    assert {(r["a"], r["b"]) for r in spatial.face_contacts(df).collect()} == touch


@pytest.mark.parametrize("most", [1 << 22, 40])
def test_near_boxes_and_nearest(spark, some, monkeypatch, most):
    monkeypatch.setattr(grid, "MOST_PAIRS", most)
    rng = random.Random(8)
    points = [(i, rng.random() * 5, rng.random() * 5, 1.0) if i % 3 else (i, rng.random() * 2000 - 1000, 1.0, 0.5) for i in range(150)]
    p, b = spark.createDataFrame(points, "point long, x double, y double, z double"), spark.createDataFrame(some, SCHEMA)
    gap = lambda q, a: sum(max(a[i] - q[k], q[k] - a[i + 1], 0.0) ** 2 for k, i in ((1, 1), (2, 3), (3, 5))) ** 0.5
    got = sorted((r["point"], r["id"]) for r in boxes.near_boxes(p, b, 0.25).collect())
    assert got == sorted((q[0], a[0]) for q in points for a in some if gap(q, a) <= 0.25)
    near = spatial.nearest_within(p.select("point", "x", "y"), p.select("point", "x", "y"), "point", ["x", "y"], 0.5)
    d2 = lambda q, o: (q[1] - o[1]) ** 2 + (q[2] - o[2]) ** 2
    want = {}
    for q in points:
        close = sorted((d2(q, o), o[0]) for o in points if o[0] != q[0] and d2(q, o) <= 0.25)
        if close:
            want[q[0]] = (close[0][1], len(close))
    assert {r["point"]: (r["nearest"], r["within"]) for r in near.collect()} == want


def test_no_cell_or_block_compares_more_than_the_most(spark, monkeypatch):
    """Half of the rows in one point, half spread over one cell."""
    rng = random.Random(1)
    rows = [(i, 5.0, 5.0) if i % 2 else (i, rng.random() * 60, rng.random() * 60) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    a, b = (df.select(*[F.col(c).alias(c + s) for c in df.columns]) for s in "ab")
    most = 10_000
    plan = grid.Plan(a, b, [], [("xa", "xa"), ("ya", "ya")], [("xb", "xb"), ("yb", "yb")], 64.0, most)
    assert plan.splits and not plan.blocks.isEmpty()
    l = plan.dealt(plan.place(a, [("xa", "xa"), ("ya", "ya")]), "_left", "_right", a.columns)
    r = plan.dealt(plan.place(b, [("xb", "xb"), ("yb", "yb")]), "_right", "_left", b.columns)
    at = [*plan.at, "_level", "_of_left", "_of_right"]
    n = l.groupBy(*at).agg(F.count("*").alias("l")).join(r.groupBy(*at).agg(F.count("*").alias("r")), at)
    assert n.agg(F.max(F.col("l") * F.col("r"))).first()[0] < 2.5 * most  # blocks are dealt by a hash, so about evenly
    met = grid.meet(a, b, [("xa", "xa"), ("ya", "ya")], [("xb", "xb"), ("yb", "yb")], 64.0, most=most).filter("xa = xb and ya = yb")
    assert met.count() == 1000 * 1000 + 1000


def test_interval_overlaps_with_keys(spark, monkeypatch):
    monkeypatch.setattr(grid, "MOST_PAIRS", 50)
    rng = random.Random(6)
    rows = [(i % 3, i, x, x + rng.choice([0.1, 5.0])) for i in range(120) for x in [rng.choice([rng.random() * 3, 7.0])]]
    df = spark.createDataFrame(rows, "k int, id int, lo double, hi double")
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and max(a[2], b[2]) < min(a[3], b[3]))
    assert sorted(tuple(r)[:3] for r in spatial.interval_overlaps(df, ["k"], "id", "lo", "hi", 4.0).collect()) == want


def plain_groups(points, tolerance):
    label = {p[0]: p[0] for p in points}
    changed = True
    while changed:
        changed = False
        for a in points:
            for b in points:
                if sum((x - y) ** 2 for x, y in zip(a[1:], b[1:])) ** 0.5 <= tolerance and label[b[0]] < label[a[0]]:
                    label[a[0]], changed = label[b[0]], True
    return label


@pytest.mark.parametrize(("d", "finest"), [(1, 24), (2, 24), (3, 24), (2, 0), (2, 1)])
def test_components_of_close_points(spark, monkeypatch, d, finest):
    """Clusters, points in one place, chains with steps of exactly the tolerance, pairs just beyond it; also where parts are cut to points at once."""
    monkeypatch.setattr(grid, "FINEST", finest)
    rng = random.Random(d)
    at = [tuple(rng.random() * 12 for _ in range(d)) for _ in range(60)] + [tuple([3.0] * d)] * 20
    at += [(20.0 + k, *[0.0] * (d - 1)) for k in range(8)] + [(40.0 + k * 1.0000001, *[0.0] * (d - 1)) for k in range(4)]
    points = [(i, *x) for i, x in enumerate(rng.sample(at, len(at)))]
    df = spark.createDataFrame(points, "id long, " + ", ".join(f"{a} double" for a in AXES[:d]))
    got = {r["id"]: (r["component"], r["members"]) for r in grid.close_components(df, list(AXES[:d]), 1.0).collect()}
    want = plain_groups(points, 1.0)
    assert got == {i: (c, list(want.values()).count(c)) for i, c in want.items()}


def test_close_points_of_no_tolerance_and_none(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.6)], "id long, x double")
    assert sorted(map(tuple, grid.close_components(df, ["x"], 0.0).collect())) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
    assert grid.close_components(df.limit(0), ["x"], 1.0).collect() == []


def plain_matching(left, right, tolerance):
    pairs = sorted((sum((x - y) ** 2 for x, y in zip(a[1:], b[1:])) ** 0.5, a[0], b[0]) for a in left for b in right)
    used, out = set(), []
    for d, l, r in pairs:
        if d <= tolerance and ("l", l) not in used and ("r", r) not in used:
            used |= {("l", l), ("r", r)}
            out.append((l, r))
    return sorted(out)


@pytest.mark.parametrize(("d", "most"), [(1, 1 << 22), (2, 20)])
def test_nearest_matching_is_the_greedy_one(spark, monkeypatch, d, most):
    """Points in one place, equal distances to both sides, chains of ever nearer pairs; also on a crowded grid."""
    monkeypatch.setattr(grid, "MOST_PAIRS", most)
    rng = random.Random(d)
    some = lambda n, at: [(at + i, *[rng.choice([float(rng.randrange(6)), 2.0, rng.random() * 6]) for _ in range(d)]) for i in range(n)]
    left, right = some(40, 100), some(50, 500)
    left += [(1, 7.0, *[0.0] * (d - 1)), (2, 7.0, *[0.0] * (d - 1)), (9, 9.0, *[0.0] * (d - 1))]
    right += [(3, 8.0, *[0.0] * (d - 1)), (4, 6.0, *[0.0] * (d - 1)), (5, 8.0, *[0.0] * (d - 1))]
    schema = "id long, " + ", ".join(f"{a} double" for a in AXES[:d])
    got = grid.nearest_matching(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), list(AXES[:d]), 1.5)
    assert sorted((x["l"], x["r"]) for x in got.collect()) == plain_matching(left, right, 1.5)
    assert grid.nearest_matching(spark.createDataFrame(left, schema), spark.createDataFrame([], schema), list(AXES[:d]), 1.5).collect() == []
