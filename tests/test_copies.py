"""Tables in which few different rows are repeated often: what is compared must grow with the different rows, what is shuffled with the table."""

import random

from pyspark.sql import functions as F

from tessera.domain import caverns, ground, layout, regions
from tessera.operators import boxes, graph, spatial, voxel
from tessera.plans import geometry, measurements, saves


def shuffled(spark, df):
    """The rows of df and how many bytes were shuffled for them."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    return df.count(), written() - before


BOX = ["x0", "x1", "y0", "y1", "z0", "z1"]


def test_contacts_of_copies_are_not_shuffled_as_pairs(spark):
    at = F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0)
    boxes = spark.range(3000).select("id", at.alias("x0"), (at + 1).alias("x1"), *[F.lit(float(c[1])).alias(c) for c in BOX[2:]])
    n, moved = shuffled(spark, spatial.face_contacts(boxes, size=4.0))
    assert n == 1500 * 1500 and moved < 2_000_000


def test_contacts_match_all_pairs(spark):
    rng = random.Random(3)
    kinds = [(x, x + rng.choice([0, 1, 2]), y, y + rng.choice([1, 2]), z, z + 1) for x, y, z in (tuple(rng.randrange(4) for _ in range(3)) for _ in range(25))]
    rows = [(i, *map(float, rng.choice(kinds))) for i in [*range(120), 5, 9]]  # two ids have two boxes
    want = {}
    for a in rows:
        for b in rows:
            over = [min(a[2 + 2 * k], b[2 + 2 * k]) - max(a[1 + 2 * k], b[1 + 2 * k]) for k in range(3)]
            for n in range(3):
                o = [over[k] for k in range(3) if k != n]
                if a[0] != b[0] and a[2 + 2 * n] == b[1 + 2 * n] and min(o) > 1e-6:
                    pair, c = (min(a[0], b[0]), max(a[0], b[0])), (n, "xyz"[n], o[0] * o[1], 1 if a[0] < b[0] else -1)
                    want[pair] = min(want.get(pair, c), c)
    got = spatial.face_contacts(spark.createDataFrame(rows, ["id", *BOX]), size=4.0).collect()
    assert sorted((r["a"], r["b"], r["axis"], r["area"], r["direction"]) for r in got) == sorted((*p, *c[1:]) for p, c in want.items())


def test_touching_segments_are_counted_without_a_list(spark):
    s = spark.range(4000).select(*[F.lit(v).alias(c) for c, v in {"x": 0.0, "y": 0.0, "xx": 1.0, "yy": 1.5}.items()])
    b = spark.range(3000).select("id", *[F.lit(v).alias(c) for c, v in {"x0": 0.5, "x1": 2.0, "y0": 1.0, "y1": 2.0}.items()])
    found = spatial.touch_counts(s, b, "id", 20.0)
    n, moved = shuffled(spark, found)
    assert n == 3000 and moved < 2_000_000 and found.agg(F.sum("touching")).first()[0] == 12_000_000


def test_equal_tiles_are_solved_once(spark):
    solid, room = bytes([8]) * 4096, (bytes([8]) * 4 + bytes(12)) * 256
    tiles = [(t, 0, 0, 0, room if t is None or int(t) % 2 else solid) for t in [None, *map(str, range(60))]]
    blocks = spark.createDataFrame(tiles, "tile string, bx int, by int, bz int, data binary")
    seen = []

    def solve(b, _):
        seen.append(b.count())
        return b.select("tile", F.length("data").alias("n"))

    assert voxel.once(blocks, None, solve).count() == 61 and seen == [2]
    found = {r["tile"]: r["cells"] for r in voxel.tile_components(blocks, (16, 16, 16), 15, 8).collect()}
    assert found == {t: 12 * 256 for t in [None, *map(str, range(1, 60, 2))]}
    sockets = spark.createDataFrame([(str(t), "s", 8.5, 8.5, z) for t in range(60) for z in [4.5 + t % 4]] + [(None, "s", 8.5, 8.5, 5.0), ("no blocks", "s", 8.5, 8.5, 5.0)], "tile string, socket string, x double, y double, z double")
    near = {r["tile"]: r["distance"] for r in caverns.socket_voids(blocks, sockets, (16, 16, 16)).collect()}
    assert near == {str(t): 0.0 if t % 2 else None for t in range(60)} | {None: 0.5, "no blocks": None}


def test_voxels_are_digested_before_tiles_are_gathered(spark, monkeypatch):
    """Lists of more groups than a few are made by sorting whole rows: these may hold digests, not voxels."""
    cut, plans = voxel.cut, []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(voxel, "cut", kept)
    blocks = spark.createDataFrame([(str(t), 0, 0, 0, bytes([t])) for t in range(3)], "tile string, bx int, by int, bz int, data binary")
    assert voxel.once(blocks, None, lambda b, _: b.select("tile")).count() == 3
    gathered = [line for line in plans[0].splitlines() if "Aggregate" in line]
    assert gathered and not [line for line in gathered if "sha2(data" in line]


def test_blocks_of_rows_are_made_without_python(spark):
    """Blocks are a thousand times what their rows are: they may not travel to Python and back before most of them are found to be equal."""
    part = spark.createDataFrame([(k, k) for k in range(1, 51)], "p_partkey long, p_size int")
    blocks = measurements.room_blocks(lambda _: part)
    assert {(r["tile"], bytes(r["data"])) for r in blocks.collect()} == {(str(k), (bytes([8]) * (k % 10 + 1) + bytes(15 - k % 10)) * 256) for k in range(1, 51)}
    assert "MapInArrow" not in blocks._jdf.queryExecution().optimizedPlan().toString() and blocks.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_held_out_tangents_of_copies_meet_once_a_place(spark):
    at = {"lane": F.col("index") % 2, "x": F.floor(F.col("index") % 4 / 2) * 0.5, "y": F.lit(0.0), "z": F.col("index") % 4, "nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)}
    hits = spark.range(40_000).withColumnRenamed("id", "index").select("index", *[c.cast("double").alias(n) for n, c in at.items()])
    got = ground.tangent_held_out(hits).orderBy("lane").collect()
    assert [(r["hits"], r["scored"], r["tangent_rmse"]) for r in got] == [(20_000, 20_000, 1.0)] * 2


def test_terrain_rows_broadcast_no_script(spark):
    table = lambda name: spark.range(2000).withColumnRenamed("id", "c_custkey")
    df = saves.best_terrain_row(table, spark)
    assert len(df.collect()) > 100 and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_nearest_of_copies_is_asked_once_a_place(spark):
    at = (F.col("id") % 2).cast("double")
    p = spark.range(6000).select("id", at.alias("x"), F.lit(0.0).alias("y"))
    got = spatial.nearest_within(p, p, "id", ["x", "y"], 1.0)
    n, moved = shuffled(spark, got)
    assert n == 6000 and moved < 3_000_000
    assert [tuple(r) for r in got.filter("id in (0, 1, 2, 5)").orderBy("id").collect()] == [(0, 2, 0.0, 5999), (1, 3, 0.0, 5999), (2, 0, 0.0, 5999), (5, 1, 0.0, 5999)]


def test_nearest_matches_all_pairs_where_ids_are_elsewhere_and_twice(spark):
    rng = random.Random(5)
    some = lambda n: [(rng.randrange(40), float(rng.randrange(6)), float(rng.randrange(6))) for _ in range(n)]
    left, right = some(60), some(60)
    want = []
    for i in sorted({r[0] for r in left}):
        met = [((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, b[0]) for a in left if a[0] == i for b in right if b[0] != i]
        near = [m for m in met if m[0] <= 2.25]
        if near:
            want.append((i, min(near)[1], min(near)[0], len(near)))
    df = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    for l, r in ((left, right),):
        assert sorted(map(tuple, spatial.nearest_within(df(l), df(r), "id", ["x", "y"], 1.5).collect())) == want


def test_lists_of_contacts_travel_once_a_pair_of_shapes(spark):
    """40 shapes in a grid of two rows, all of the one touching all of the other, with 600 boxes each: 400 pairs of shapes of 4,800 bytes a list. Lists that
    many shapes touch are dealt out in shares, and all pairs are there."""
    k = F.col("id") % 40
    low = (k % 2).cast("double")
    boxes = spark.range(24_000).select("id", low.alias("x0"), (low + 1).alias("x1"), (-k / 100).alias("y0"), (k / 100 + 1).alias("y1"), F.lit(0.0).alias("z0"), F.lit(1.0).alias("z1"))
    n, moved = shuffled(spark, spatial.face_contacts(boxes, size=4.0))
    assert n == 400 * 600 * 600 and moved < 1_600_000
    got = spatial.face_contacts(boxes.filter("id < 4000 and id % 40 < 4"), size=4.0).collect()
    assert len({(r["a"], r["b"]) for r in got}) == len(got) == 4 * 100 * 100 and all(r["axis"] == "x" and r["a"] % 2 != r["b"] % 2 for r in got)


def test_nearest_sorts_no_pairs(spark):
    """Of 3,000 points at different places, with some 90 near each: no aggregate sorts the pairs, and all rows are those of all pairs."""
    rng = random.Random(9)
    rows = [(i, rng.randrange(2000) / 100, rng.randrange(1000) / 100) for i in range(3000)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    got = spatial.nearest_within(p, p, "id", ["x", "y"], 1.5)
    found = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    for i, x, y in rows[::10]:
        near = [(d2, j) for j, u, v in rows if j != i and (d2 := (x - u) * (x - u) + (y - v) * (y - v)) <= 2.25]
        assert found[i] == (min(near)[1], min(near)[0], len(near))


def test_unambiguous_nearest_sorts_no_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), rng.randrange(2000) / 100) for i in range(300)]
    table = lambda name: spark.createDataFrame(rows, "event_id long, user_id long, value double")
    df = geometry.unambiguous_nearest(table, spark)
    got = {r[0]: tuple(r[1:]) for r in df.collect()}
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    at, want = [(i, u % 50 * 10.0 + i % 100 / 10.0, y) for i, u, y in rows], {}
    for i, x, y in at:
        near = [(j, d2) for j, u, v in at if j != i and (d2 := (x - u) * (x - u) + (y - v) * (y - v)) <= 2.25]
        if len(near) == 1:
            want[i] = near[0]
    assert want and got == want


def test_boxes_and_points_of_one_place_meet_once(spark):
    p = spark.range(3000).select(F.col("id").alias("point"), *[F.lit(0.5).alias(c) for c in "xyz"])
    b = spark.range(3000).select("id", F.lit("cave").alias("kind"), *[F.lit(float(c[1])).alias(c) for c in BOX])
    near = boxes.nearest_box(p, b, 4.0)
    n, moved = shuffled(spark, near)
    assert n == 3000 and moved < 2_000_000 and near.filter("box <> 0 or distance <> 0").isEmpty()
    n, moved = shuffled(spark, regions.region_boxes(b).filter("region = 1"))
    assert n == 3000 and moved < 2_000_000
    spots = spark.range(3000).select(F.lit("t").alias("tile"), F.col("id").alias("placement"), *[F.lit(0.5).alias(c) for c in "xyz"])
    feet = spark.range(1000).select(F.lit("t").alias("tile"), F.col("id").cast("int").alias("fx"), F.lit(0).alias("fy"), F.lit(0).alias("fz"))
    df = caverns.near_path(spots, feet, 20.0)
    assert df.filter("distance = 0").count() == 3000 and df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 4


def test_cells_of_copies_are_linked_once(spark):
    place = F.when(F.col("id") % 3 == 2, 9).otherwise(F.col("id") % 3)  # two neighbours and one alone
    cells = spark.range(4500).select("id", F.lit("t").alias("tile"), place.alias("cell_x"), F.lit(0).cast("long").alias("cell_y"))
    n, moved = shuffled(spark, layout.adjacent_components(cells, ["tile"]))
    got = {r["id"]: r["component"] for r in layout.adjacent_components(cells, ["tile"]).collect()}
    assert n == 4500 and moved < 1_000_000 and got == {i: i if i % 3 == 2 else 0 for i in range(4500)}


def test_components_links_shrink_from_round_to_round(spark, monkeypatch):
    """A grid without a third of its links, its nodes numbered at random, and a chain that winds: nodes that are not ends are not read again."""
    rng, side = random.Random(2), 60
    name = [*range(side * side)]
    rng.shuffle(name)
    edges = [(name[k], name[k + d]) for k in range(side * side) for d in (1, side) if k + d < side * side and (d > 1 or (k + 1) % side) and rng.random() < 0.66]
    edges += [(10_000 + k, 10_001 + k) for k in range(500)] + [(7, 7), (90_000, 90_000)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    rows, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        rows.extend([out.count()] * (out.columns == ["a", "b"]))
        return out

    monkeypatch.setattr(graph, "cut", counted)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {n: find(n) for n in root} and got.count() == len(root)
    assert rows[0] <= len(edges) and rows[-1] == 0 and sum(rows[1:]) < rows[0]
