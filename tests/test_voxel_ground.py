import random

import numpy as np
import pytest

from tessera.domain import ground
from tessera.operators import voxel as V


def plain_components(inside):
    label, n = np.zeros(inside.shape, int), 0
    for start in np.argwhere(inside):
        if label[tuple(start)]:
            continue
        n += 1
        todo = [tuple(start)]
        while todo:
            p = todo.pop()
            if all(0 <= c < d for c, d in zip(p, inside.shape)) and inside[p] and not label[p]:
                label[p] = n
                todo += [tuple(np.add(p, d)) for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    return label


def test_flood_fill_of_random_volumes():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.35, 0.6):
        inside = rng.random((9, 8, 7)) < share
        assert (V.components(inside) == plain_components(inside)).all()


def test_volume_rejects_overlap_and_size():
    block = bytes(4096)
    raw, written = V.volume([(0, 0, 0, block)], (20, 16, 16))
    assert written.sum() == 4096 and raw[19, 0, 0] == 255 and not written[19].any()
    with pytest.raises(ValueError):
        V.volume([(0, 0, 0, block), (0, 0, 0, block)], (16, 16, 16))
    with pytest.raises(ValueError):
        V.volume([], (1000, 1000, 1000))


def stairs():
    """A floor that rises by one every four cells, free above."""
    free = np.zeros((12, 4, 8), bool)
    for x in range(12):
        free[x, :, 1 + x // 4 :] = True
    return free, np.ones(free.shape, bool)


def test_walks():
    free, written = stairs()
    stand = V.feet(free, written, 2)
    assert stand.sum() == 48 and stand[0, 0, 1] and stand[11, 0, 3]
    links = V.steps(stand, free, 2, 1)
    assert V.components(stand, links).max() == 1 and V.components(stand, V.steps(stand, free, 2, 0)).max() == 3
    at = lambda x, y, z: (x * 4 + y) * 8 + z
    grade, length, cells = V.walk(links, 8, at(0, 0, 1), at(11, 0, 3))
    assert grade == 1 and len(cells) == 12 and length == pytest.approx(9 + 2 * 2**0.5)
    assert V.walk(links, 8, at(0, 0, 1), at(11, 0, 3), most_grade=0.5) is None


def test_minimax_prefers_the_gentle_detour():
    level = {0: 0.0, 1: 5.0, 2: 0.0, 3: 0.5, 4: 0.5}
    links = [(np.array([0, 1, 0, 3, 4]), np.array([1, 2, 3, 4, 2]))]
    heights = np.array([level[k] for k in range(5)])
    grade, _, cells = V.walk(links, 1, 0, 2, minimax=True, level=heights)
    assert (grade, cells) == (0.5, [0, 3, 4, 2])


def test_missing_is_not_zero():
    raw, written = np.zeros((2, 2, 2), np.uint8), np.ones((2, 2, 2), bool)
    raw[1] = 10
    assert V.sample(raw, written, 0.25, 0, 0) == 2.5
    written[1, 0, 0] = False
    assert V.sample(raw, written, 0.25, 0, 0) is None and V.sample(raw, written, 0, 0, 0) == 0 and V.sample(raw, written, 1.5, 0, 0) is None
    assert V.crossings(np.array([200, 100, 0, 200, 0]), np.array([True, True, True, True, False]), 128) == [0.72]


def test_tile_components(spark):
    rng = random.Random(4)
    data = bytes(rng.choice((0, 255)) for _ in range(4096))
    df = spark.createDataFrame([("a", 0, 0, 0, bytearray(data)), ("b", 0, 0, 0, bytearray(4096))], "tile string, bx int, by int, bz int, data binary")
    got = V.tile_components(df, (16, 16, 16)).collect()
    inside = np.frombuffer(data, np.uint8).reshape(16, 16, 16) < 128
    assert [r["cells"] for r in got if r["tile"] == "b"] == [4096]
    assert sorted(r["cells"] for r in got if r["tile"] == "a") == sorted(np.bincount(plain_components(inside).ravel())[1:].tolist())


@pytest.fixture(scope="module")
def compared(spark):
    plan = spark.createDataFrame([(k, k // 4, (k % 4) / 4, float(k % 4), float(k // 4), 10.0) for k in range(8)], "index int, lane int, fraction double, x double, y double, predicted_z double")
    seen = [(k, int(k != 2), float(k % 4), float(k // 4), 10.0 + k / 10, 10.0, 0.0, 0.0, 1.0) for k in range(7)] + [(99, 1, 0.0, 0.0, 1.0, 10.0, 0.0, 0.0, 1.0)]
    return ground.compare(plan, spark.createDataFrame(seen, "index int, hit int, x double, y double, z double, predicted_z double, nx double, ny double, nz double"))


def test_compare_and_gaps(compared):
    assert {r["index"]: r["status"] for r in compared.collect()} == {0: "hit", 1: "hit", 2: "miss", 3: "hit", 4: "hit", 5: "hit", 6: "hit", 7: "not_sampled", 99: "foreign"}
    got = sorted((r["lane"], r["fraction"], round(r["grade"], 9)) for r in ground.grades(compared).collect())
    assert got == [(0, 0.25, 0.1), (1, 0.25, 0.1), (1, 0.5, 0.1)]
    assert {r["lane"]: r["rise"] and round(r["rise"], 9) for r in ground.end_to_end(compared).collect()} == {0: 0.3, 1: None}


def test_held_out_lanes_choose_nothing(spark):
    rows = [(m, lane, k, float(k), (float(k) + bias if m == "good" else k * 3.0)) for m, bias in (("good", 2.0), ("bad", 0.0)) for lane in range(3) for k in range(4)]
    rows = [r if r[:3] != ("good", 1, 0) else (*r[:4], None) for r in rows]
    got = {r["fold"]: r for r in ground.held_out(spark.createDataFrame(rows, "model string, lane int, index int, measured double, modelled double")).collect()}
    assert got[1]["model"] == "good" and got[1]["rmse"] == pytest.approx(0) and (got[1]["scored"], got[1]["without_root"]) == (3, 1)
    assert got[1]["flat_rmse"] == pytest.approx(((0.5**2 + 0.5**2 + 1.5**2) / 3) ** 0.5)


def test_what_a_held_out_lane_comes_to(spark):
    ddl, plan = "model string, lane int, index int, measured double, modelled double", "lane int, index int"
    frame = lambda rows, lanes: ground.held_out(spark.createDataFrame(rows, ddl), spark.createDataFrame(lanes, plan))
    lanes = [(k % 4, k) for k in range(16)]
    rows = [("m", lane, k, k * 1.0, None if lane == 3 else k + 1.0 + (k == 0) * 8) for lane, k in lanes if k != 5]
    got = {r["fold"]: r for r in frame(rows, lanes).collect()}
    assert {f: r["status"] for f, r in got.items()} == {0: "scored", 1: "scored", 2: "scored", 3: "no_unambiguous_held_out_roots"}
    assert (got[1]["training_samples"], got[1]["training_missing"], got[1]["held_out_samples"], got[1]["held_out_hits"], got[1]["held_out_missing"]) == (12, 0, 4, 3, 1)
    assert (got[3]["training_missing"], got[3]["training_unambiguous"], got[3]["scored"], got[3]["without_root"], got[3]["rmse"]) == (1, 11, 0, 4, None)
    assert got[1]["bias"] == 1.0 and got[1]["rmse"] == 0.0 and got[1]["raw_rmse"] == 1.0
    flat = 7.5  # the median of 0, 2, 3, 4, 6, 7, 8, 10, 11, 12, 14, 15, whose mean is another
    assert got[1]["flat_rmse"] == pytest.approx((((flat - 1) ** 2 + (flat - 9) ** 2 + (flat - 13) ** 2) / 3) ** 0.5) and got[1]["gain"] == got[1]["flat_rmse"]
    assert {r["status"] for r in frame([r for r in rows if r[1] == 3], lanes).collect()} == {"no_scorable_training_candidate"}
    assert [(r["status"], r["model"]) for r in frame([r for r in rows if r[1] < 2], [x for x in lanes if x[0] < 2]).collect()] == [("insufficient_distinct_tracks", None)] * 2
    assert {r["status"] for r in frame(rows, [*lanes, (None, 16)]).collect()} == {"unavailable_track_metadata"}
    assert frame([], []).collect() == []


def test_facets(spark):
    hits = [(0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 0.5, 0.0, 0.0, 0.0, 0.0, 1.0), (2, 1.0, 0.0, 0.0, 0.0, 0.6, 0.8), (3, 1.2, 0.0, 0.0, 0.0, 0.6, 0.8), (5, 1.1, 0.0, 0.0, 0.0, 1.0, 0.0), (4, 9.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    got = {r["index"]: r["facet"] for r in ground.facets(spark.createDataFrame(hits, "index int, x double, y double, z double, nx double, ny double, nz double")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}
