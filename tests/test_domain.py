"""Layouts, regions, portals, routes, fields and caverns against plain Python."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.domain import caverns, fields, ground, layout, navigation, regions, routes
from tessera.operators import boxes as B
from tessera.operators.spatial import face_contacts, segment_contacts

BOX = "id int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"


def test_regions_and_junctions(spark):
    pieces = spark.createDataFrame([(1, "cave", 0.0, 0.0, 0.0, 64.0, 64.0, 32.0), (2, "pocket", 60.0, 0.0, 0.0, 16.0, 16.0, 16.0), (3, "cave", 300.0, 0.0, 0.0, 64.0, 64.0, 32.0)], "node int, kind string, x double, y double, z double, width double, depth double, height double")
    ends = spark.createDataFrame([(1, 0, 10.0, 10.0, 10.0), (1, 1, 302.0, 10.0, 10.0), (2, 0, 500.0, 0.0, 0.0), (2, 1, 76.0, 10.0, 20.0), (3, 0, 505.0, 0.0, 0.0), (3, 1, 900.0, 0.0, 0.0), (4, 0, 1.0, 1.0, 1.0), (4, 1, 2.0, 1.0, 1.0)], "tunnel_id int, end int, x double, y double, z double")
    tunnels = spark.createDataFrame([(1, "TtDefault", 100.0), (2, "MainVein", 50.0), (3, "Odd", 5.0), (4, "TtDefault", 1.0)], "tunnel_id int, tunnel_type string, length double")
    spawners = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 999.0, 0.0, 0.0)], "spawner int, x double, y double, z double")
    nodes, edges = regions.region_graph(pieces, ends, tunnels, spawners)
    n = {r["node"]: r for r in nodes.collect()}
    assert {k: (r["kind"], r["caves"], r["pockets"], r["spawners"]) for k, r in n.items()} == {1: ("region", 1, 1, 1), 2: ("region", 1, 0, 0), 3: ("junction", 0, 0, 0), 4: ("terminal", 0, 0, 0)}
    assert n[3]["x"] == 502.5
    assert {r["tunnel_id"]: (r["a"], r["b"], r["role"]) for r in edges.collect()} == {1: (1, 2, "corridor"), 2: (3, 1, "vein"), 3: (3, 4, "unknown"), 4: (1, 1, "corridor")}
    s = regions.graph_summary(nodes, edges).first()
    assert (s["nodes"], s["edges"], s["isolated"], s["dead_ends"], s["loops"], s["components"], s["largest"], s["most_degree"]) == (4, 4, 0, 2, 1, 1, 4, 4)
    with pytest.raises(ValueError):
        regions.region_graph(pieces, ends, tunnels, spawners, 65)


PIECE = "worldId int, row_id long, node int, kind string, cell_x int, cell_y int, tile_index int, x double, y double, z double, width double, depth double, height double, rotation int, source_x int, source_y int, tile_uuid string"


def cave(node, cx, cy, sx, sy, rotation, uuid, index=0):
    return (1, 1, node, "cave", cx, cy, index, cx * 64.0, cy * 64.0, 0.0, 64.0, 64.0, 64.0, rotation, sx, sy, uuid)


@pytest.mark.parametrize("rotation", range(4))
def test_cave_cells_find_their_tile(spark, rotation):
    """All cells of an 8 x 4 tile, laid out by turning it, are one whole structure; its double next to it is another."""
    w, d = 8, 4
    rows = []
    for copy, (sx, sy) in itertools.product((0, 1), itertools.product((0, 4), (0,))):
        fx, fy = {0: (sx, sy), 1: (d - sy - 4, sx), 2: (w - sx - 4, d - sy - 4), 3: (sy, w - sx - 4)}[rotation]
        rows.append(cave(len(rows), 10 + fx // 4 + copy * (2 if rotation % 2 == 0 else 1), -3 + fy // 4, sx, sy, rotation, "u"))
    rows += [cave(20, 50, 50, 0, 0, 0, "v"), cave(21, 51, 50, 0, 0, 0, "v"), cave(22, 52, 51, 0, 0, 0, "v"), cave(23, 51, 51, 0, 0, 1, "v"), cave(24, 60, 60, 0, 0, 0, None, 3), cave(25, 60, 61, 0, 0, 0, None, 4)]
    tiles = spark.createDataFrame([("u", "x/Cave/Room_8x4x4.tile"), ("w", "none")], "tile_uuid string, path string")
    got = layout.cave_structures(spark.createDataFrame(rows, PIECE), tiles).collect()
    sure = [r for r in got if r["source_aware"]]
    assert [(r["fragments"], r["complete"], r["overlap"], r["dimensions_match"], r["family"]) for r in sure] == [(2, True, 0, True, "cave")] * 2
    assert sorted(r["fragments"] for r in got if not r["source_aware"]) == [1, 1, 1, 1, 2]
    assert sorted(r["structure_id"] for r in got) == [*range(1, len(got) + 1)]
    pockets = layout.pocket_structures(spark.createDataFrame(rows, PIECE).filter("kind = 'pocket'"), tiles)
    nodes = layout.layout_nodes(layout.cave_structures(spark.createDataFrame(rows, PIECE), tiles), pockets)
    assert nodes.count() == len(got) and {r["role"] for r in nodes.collect()} == {"cave", "other"}
    points = spark.createDataFrame([(1, 1, 7, "TtDefault", 0, 0.0, 0.0, 0.0), (1, 1, 7, "TtDefault", 1, 0.0, 10.0, 0.0), (1, 1, 7, "TtDefault", 2, 30.0, 10.0, 0.0)], "worldId int, row_id long, tunnel_id int, tunnel_type string, ord int, x double, y double, z double")
    index = layout.search_index(layout.cave_structures(spark.createDataFrame(rows, PIECE), tiles), pockets, spark.createDataFrame(rows, PIECE), points).collect()
    t = next(r for r in index if r["kind"] == "tunnel")
    assert (t["x"], t["y"], t["search_text"]) == (10.0, 10.0, "tunnel tunnel #7 ttdefault")
    assert {tuple(r["facets"]) for r in index} == {("cave",), ("cave", "unknown"), ("tunnel",)}
    assert layout.layout_summary(layout.cave_structures(spark.createDataFrame(rows, PIECE), tiles), pockets).first()["complete_structures"] == 2


def test_turning_there_and_back(spark):
    q = spark.range(4).select(F.col("id").cast("int").alias("r"))
    wx, wy = B.turned_point(F.lit(1.0), F.lit(0.5), F.lit(4.0), F.lit(2.0), F.col("r"))
    t = q.withColumns({"wx": wx, "wy": wy})
    bx, by = B.canonical_point(F.col("wx"), F.col("wy"), F.lit(4.0), F.lit(2.0), F.col("r"))
    rows = t.withColumns({"bx": bx, "by": by}).collect()
    assert {(r["bx"], r["by"]) for r in rows} == {(1.0, 0.5)}
    assert {r["r"]: (r["wx"], r["wy"]) for r in rows} == {0: (1.0, 0.5), 1: (1.5, 1.0), 2: (3.0, 1.5), 3: (0.5, 3.0)}


def plain_exit(p, d, box):
    inside = all(lo - 1e-6 <= c <= hi + 1e-6 for c, (lo, hi) in zip(p, box))
    found = []
    for axis, (lo, hi) in enumerate(box):
        for sign, bound in (("-", lo), ("+", hi)):
            if abs(d[axis]) <= 1e-6:
                continue
            t = (bound - p[axis]) / d[axis]
            q = [a + t * b for a, b in zip(p, d)]
            if (not inside or t >= -1e-6) and all(a - 1e-6 <= c <= b + 1e-6 for c, (a, b) in zip(q, box)):
                found.append((abs(t), "xyz"[axis] + sign))
    if found:
        return (*min(found), "ray" if inside else "line")
    return (*min((abs(p[a] - b), "xyz"[a] + s) for a in range(3) for s, b in zip("-+", box[a])), "nearest-fallback")


def test_rays_leave_boxes(spark):
    rng, rows = random.Random(5), []
    for k in range(200):
        p = [rng.uniform(-3, 13) if k % 2 else rng.uniform(0, 10) for _ in range(3)]
        d = [rng.uniform(-1, 1) for _ in range(3)]
        n = math.sqrt(sum(c * c for c in d))
        rows.append((k, *p, *(c / n for c in d), 0.0, 10.0, 0.0, 8.0, 0.0, 6.0))
    df = spark.createDataFrame(rows, "k int, x double, y double, z double, dx double, dy double, dz double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    for r in B.ray_exit(df).collect():
        want = plain_exit(rows[r["k"]][1:4], rows[r["k"]][4:7], [(0, 10), (0, 8), (0, 6)])
        assert abs(r["exit"]["distance"] - want[0]) < 1e-9 and (r["exit"]["face"], r["exit"]["method"]) == want[1:]


ROOM = "id int, name string, role string, tags array<string>, rotation int, tile_w int, tile_d int, tile_h int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"


def room(i, x, role, y=0.0, z=0.0, name=None, rotation=0):
    return (i, name or f"{role}_{i}", role, [role], rotation, 2, 2, 2, x, x + 32, y, y + 32, z, z + 32)


@pytest.fixture(scope="module")
def rooms(spark):
    """An elevator, three caves of one tile, one of them turned, and a pocket that no route may pass; tunnels out of the caves."""
    nodes = spark.createDataFrame([room(1, 0.0, "elevator"), room(2, 32.0, "cave", name="C_2x2x2.tile"), room(3, 64.0, "cave", name="C_2x2x2.tile"), room(4, 200.0, "cave", name="C_2x2x2.tile", rotation=1), room(5, 32.0, "pocket", y=32.0), room(6, 64.0, "passage", z=32.0)], ROOM)
    lines = {10: [(70.0, 31.0, 16.0), (70.0, 40.0, 16.0), (201.0, 40.0, 16.0), (201.0, 10.0, 16.0)], 11: [(40.0, 16.0, 16.0), (48.0, 16.0, 16.0), (80.0, 16.0, 16.0)], 12: [(500.0, 0.0, 0.0), (510.0, 0.0, 0.0)]}
    points = spark.createDataFrame([(t, k, *p) for t, l in lines.items() for k, p in enumerate(l)], "tunnel_id int, ord int, x double, y double, z double")
    lengths = spark.createDataFrame([(10, "TtDefault", 170.0), (11, "MainVein", 40.0), (12, "TtDefault", 10.0)], "tunnel_id int, tunnel_type string, length double")
    contacts = face_contacts(nodes.select("id", "x0", "x1", "y0", "y1", "z0", "z1"))
    links = routes.tunnel_links(points, lengths, nodes)
    return nodes, points, contacts, links, lines


def test_observed_portals(spark, rooms):
    nodes, points, contacts, links, _ = rooms
    seen = {(r["tunnel_id"], r["end"]): r for r in navigation.observed(points, nodes).collect()}
    assert set(seen) == {(10, 0), (10, 1), (11, 0), (11, 1)}
    first, last = seen[10, 0], seen[10, 1]
    assert (first["id"], first["world_face"], first["method"], first["face"], first["u"], first["v"]) == (3, "y+", "ray", "y+", 6.0, 16.0)
    assert (last["id"], last["world_face"], last["face"], last["u"], last["v"]) == (4, "y+", "x+", 31.0, 16.0)  # a quarter turn: y+ of the world is x+ of the tile
    assert (seen[11, 0]["world_face"], seen[11, 1]["world_face"]) == ("x+", "x-")
    t = navigation.learned(navigation.observed(points, nodes), least=1)
    assert {(r["name"], r["face"]) for r in t.collect()} == {("C_2x2x2.tile", "y+"), ("C_2x2x2.tile", "x+"), ("C_2x2x2.tile", "x-")}
    at = navigation.placed(t, nodes)
    assert {(r["id"], r["face"]) for r in at.filter("own_face = 'x+'").collect()} >= {(2, "x+"), (3, "x+"), (4, "y+")}
    m = navigation.matches(contacts, at, 100.0)
    assert {(r["a"], r["b"]) for r in m.collect()} == {(2, 3)}
    d = navigation.diagnosis_totals(navigation.diagnosed(contacts, nodes, t)).first()
    assert (d["contacts"], d["both_tiles"], d["one_tile"], d["both_faces"]) == (4, 1, 3, 1)
    with pytest.raises(ValueError):
        navigation.learned(navigation.observed(points, nodes), 0)


def test_transit(rooms):
    nodes, _, contacts, links, _ = rooms
    got = {r["id"]: r["reachable"] for r in navigation.transit(nodes, contacts, links)[0].collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 6: False}
    assert {r["id"]: r["reachable"] for r in navigation.transit(nodes, contacts, links, vertical=True)[0].collect()}[6]
    edges = {(r["a"], r["b"], r["kind"]) for r in routes.transit_edges(nodes, contacts, links).collect()}
    assert edges == {(1, 2, "contact"), (2, 3, "contact"), (3, 4, "tunnel"), (2, 3, "tunnel")}


def plain_route(anchors, edges, start):
    near = {}
    for e in edges:
        for a, b in ((e["a"], e["b"]), (e["b"], e["a"])):
            near.setdefault(a, []).append((b, e["contact"], e["weight"]))
    best, queue = {start: (0, 0.0)}, [((0, 0.0), start)]
    while queue:
        cost, n = heapq.heappop(queue)
        if cost > best[n]:
            continue
        for m, c, w in near.get(n, []):
            new = (cost[0] + c, cost[1] + w)
            if m not in best or new < best[m]:
                best[m] = new
                heapq.heappush(queue, (new, m))
    return best


def test_routes(spark, rooms):
    nodes, points, contacts, links, _ = rooms
    portals = navigation.portals_inside(spark.createDataFrame([(("9", "a"), 3.0, 3.0, 3.0), (("8", "a"), 1.0, 1.0, 1.0)], "point struct<id: string, side: string>, x double, y double, z double"), nodes)
    g = routes.RouteGraph(nodes, contacts, links, points, navigation.start_portals(portals))
    start, node = g.start()
    assert node == 1
    tree = g.tree(start)
    rows, anchors = g.edges.collect(), {r["anchor"]: r for r in g.anchors.collect()}
    assert anchors[start]["kind"] == "saved_portal" and anchors[start]["x"] == 3.0
    want = plain_route(anchors, rows, start)
    got = {r["node"]: (r["contacts"], r["distance"]) for r in tree.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    target = g.target(tree, links, tunnel_type="mainvein")
    assert (target["tunnel_id"], target["node"]) == (11, 2)
    by_node = g.target(tree, links, node=4)
    way = g.segments(tree, by_node["anchor"])
    assert routes.node_path(way) == [1, 2, 3, 4]
    report = routes.route_report(way).first()
    assert report["contact_segments"] == 1 and report["tunnel_segments"] == 2 and abs(report["total_cost"] - by_node["distance"]) < 1e-9
    assert report["route_evidence"].endswith("candidate face contacts")
    for bad in ({}, {"node": 1, "tag": "x"}, {"tag": "nowhere"}, {"node": 5}):
        with pytest.raises(ValueError):
            g.target(tree, links, **bad)


def test_socket_matches_and_anchors(spark):
    s = spark.createDataFrame([("s1", 0.0, 0.0, 0.0), ("s2", 1.0, 0.0, 0.0), ("s3", 50.0, 0.0, 0.0)], "point string, x double, y double, z double")
    e = spark.createDataFrame([((1, 0), 0.9, 0.0, 0.0), ((1, 1), 1.5, 0.0, 0.0), ((2, 0), 50.0, 0.0, 0.04)], "point struct<tunnel_id: int, end: int>, x double, y double, z double")
    got = {(r["l"], r["r"]["tunnel_id"], r["r"]["end"]): r["quality"] for r in navigation.socket_matches(s, e).collect()}
    assert got == {("s2", 1, 0): "near", ("s1", 1, 1): "near", ("s3", 2, 0): "exact"}
    found, verdict = navigation.aligned(s, e)
    assert {r["socket"] for r in found.collect()} == {"s2", "s3"}  # the first end has two sockets within a metre
    assert verdict.first()["status"] == "two_or_more_independent_tunnel_anchors"


def test_lines_that_touch_boxes(spark):
    rng = random.Random(7)
    boxes = [(k % 9, *itertools.chain(*[(a, a + rng.uniform(3, 30)) for a in (rng.uniform(-100, 100), rng.uniform(-100, 100), rng.uniform(0, 30))])) for k in range(40)]
    lines = [(k % 12, *(rng.uniform(-120, 120) for _ in range(2)), rng.uniform(0, 40), *(rng.uniform(-120, 120) for _ in range(2)), rng.uniform(0, 40)) for k in range(60)]

    def meets(p, q, box, axes):
        lo, hi = 0.0, 1.0
        for a in axes:
            d = q[a] - p[a]
            t = sorted(((box[2 * a] - p[a]) / d, (box[2 * a + 1] - p[a]) / d))
            lo, hi = max(lo, t[0]), min(hi, t[1])
        return lo <= hi

    want = {}
    for n, *l in lines:
        for g, *b in boxes:
            if meets(l[:3], l[3:], b, (0, 1)):
                want[n, g] = want.get((n, g), False) or meets(l[:3], l[3:], b, (0, 1, 2))
    b = spark.createDataFrame(boxes, "g int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    s = spark.createDataFrame(lines, "line int, x double, y double, z double, xx double, yy double, zz double")
    assert {(r["line"], r["g"]): r["xyz"] for r in segment_contacts(s, b, "line", "g").collect()} == want


DIMS = (16, 16, 16)


def sloped():
    """Densities that fall by two a voxel upward and by one a voxel in x, and a hole in what is written."""
    data = np.fromfunction(lambda x, y, z: np.clip(40 - 2 * z - x, 0, 31), DIMS).astype(np.uint8)
    return [(0, 0, 0, data.tobytes())]


def test_fields(spark):
    from tessera.operators.voxel import volume

    raw, written = volume(sloped(), DIMS)
    f = fields.Field(raw, written, 5, (0.0, 0.5, 0.0))
    assert f.at(4.5, 3.25, 8.25) == pytest.approx(40 - 16.5 - 4.5)
    assert f.floors(4.5, 3.0, 6.0, 12.0) == [pytest.approx((40 - 4.5 - 16) / 2)]
    assert f.gradient((4.5, 3.2, 8.5)) == pytest.approx((-1, 0, -2))
    written[4, 3, 8] = False
    assert f.at(4.5, 3.25, 8.25) is None and f.at(15.5, 3, 3) is None
    n = math.sqrt(5)
    assert fields.normal_error(fields.Field(*volume(sloped(), DIMS), 5, (0.0, 0.0, 0.0)), (4.5, 3.5, 8.5), (1 / n, 0, 2 / n), 0)["angle"] == pytest.approx(0, abs=1e-5)
    turned = fields.normal_error(fields.Field(*volume(sloped(), DIMS), 5, (0.0, 0.0, 0.0)), (4.5, 3.5, 8.5), (0, 1 / n, 2 / n), 1)
    assert turned["status"] == "sampled" and turned["angle"] == pytest.approx(0, abs=1e-5)
    blocks = spark.createDataFrame([("t", 0, 0, 0, bytearray(sloped()[0][3]))], "tile string, bx int, by int, bz int, data binary")
    hits = [("t", k, float(k % 3), 2.0 + k % 5, 3.0 + k % 4, (40 - (2.0 + k % 5) - 16) / 2 + 0.1, 10.0, 1 / n, 0.0, 2 / n, 0) for k in range(12)]
    read = fields.readings(blocks, spark.createDataFrame(hits, fields.SAMPLE), DIMS)
    best = fields.hypothesis_scores(read).first()
    assert (best["bits"], best["shift_x"], best["shift_z"], best["single_candidates"]) == (5, 0.0, 0.0, 12) and best["bias"] == pytest.approx(-0.1) and best["rmse_after_bias"] == pytest.approx(0, abs=1e-6)
    assert fields.isovalue_spread(read).count() == fields.normal_scores(read).count() == 16
    assert ground.held_out(fields.held_out_models(read)).count() == 3


def test_nearby_columns_and_profiles(spark):
    blocks = spark.createDataFrame([("t", 0, 0, 0, bytearray(sloped()[0][3]))], "tile string, bx int, by int, bz int, data binary")
    s = spark.createDataFrame([("t", 1, 4.4, 3.5, 8.2), ("t", 2, 4.6, 3.5, 9.2)], "tile string, index int, x double, y double, z double")
    got = {(r["vx"], r["vy"]): r["index"] for r in fields.nearby_columns(s, DIMS, 1).collect()}
    assert len(got) == 9 and got[3, 3] == 1 and got[5, 3] == 2 and got[4, 3] == 1
    prof = fields.density_profile(blocks, s, DIMS, 1)
    assert {r["height"]: r["raw"] for r in prof.collect()} == {h: 40 - 2 * h - 4 for h in range(7, 12)} and prof.count() == 5
    assert [r["crossing"] for r in fields.column_crossings(prof, 5).collect()] == [10.0]
    pairs = fields.byte_pairs(blocks, fields.nearby_columns(s, DIMS, 0), DIMS, 0.0).collect()
    assert [(r["below"], r["above"], r["status"]) for r in pairs] == [(20, 18, "recorded_pair")]


def test_expanded_plan(spark):
    hits = spark.createDataFrame([(k, 8.0 + k % 2, 8.0 + k // 2, 100.0 + k % 2, 50.0 + k // 2, 7.0 + k) for k in range(4)], "index int, x double, y double, wx double, wy double, wz double")
    got = fields.expanded_plan(hits, DIMS, 0, 3)
    rows = {(r["lane"], r["step"]): r for r in got.collect()}
    assert len(rows) == 9 and (rows[0, 0]["wx"], rows[0, 0]["wy"], rows[0, 0]["source_index"], rows[0, 0]["predicted_z"]) == (99.31, 49.31, 0, 7.0)
    assert (rows[2, 2]["wx"], rows[2, 2]["source_index"], rows[2, 2]["lateral_offset_m"], rows[2, 2]["fraction"]) == (101.31, 3, 1.0, 1.0)
    from tessera.sources.logs import checked_plan

    assert len(checked_plan(fields.plan_document(3, got))[1]) == 9
    for bad in (hits.limit(3), hits.withColumn("x", F.col("x") + 8)):
        with pytest.raises(ValueError):
            fields.expanded_plan(bad, DIMS, 0, 3).collect()


def corridor():
    """Two rooms with a floor at different heights, a wall with a high gap between them."""
    raw = np.full(DIMS, 8, np.uint8)
    raw[1:7, 1:15, 3:10] = 0
    raw[9:15, 1:15, 6:12] = 0
    raw[7:9, 7, 8:10] = 0
    return [(0, 0, 0, raw.tobytes())]


def test_caverns(spark):
    c = caverns.Cavern(corridor(), DIMS)
    label, _ = c.floors()
    a, b = label[2, 2, 3], label[10, 2, 6]
    assert a and b and a != b
    near = c.near_foot((0.5, 7.5, 3.5), label, 5.0, 20)
    assert near[0] == a and near[2] == (1, 7, 3)
    bridge = c.air_bridge((2, 7, 3), (10, 7, 6))
    assert bridge["status"] == "candidate_air_path_found" and bridge["steps"] == 8 + 3 + 4 and bridge["max_z"] == 8
    assert c.air_bridge((0, 0, 0), (2, 2, 3))["status"] == "start_not_candidate_free" and c.air_bridge((2, 2, 3), (99, 0, 0))["status"] == "outside_tile"
    assert c.sight((2, 2, 3), (5, 9, 3)) == "clear_centreline" and c.sight((2, 2, 3), (10, 2, 6)) == "candidate_solid_intersection"
    assert c.inward((0.2, 7.5, 3.5)) == {"face": "x-", "first_open": 1, "reblocked": True, "samples": 9}
    assert c.surface((2, 2, 3)) == 2.0 and c.surface((0, 0, 0)) is None
    flat = c.profile([(2, 2, 3), (3, 2, 3), (4, 2, 3)])
    assert flat["length"] == 2.0 and flat["max_grade"] == 0.0 and c.profile([(0, 0, 5)])["status"].startswith("no_supported")
    samples = c.edge_samples((2, 2, 3), (3, 2, 3))
    assert len(samples) == 15 and {s["z"] for s in samples} == {2.0} and samples[0]["x"] == 2.5 and samples[0]["y"] == 2.0
    step = np.full(DIMS, 8, np.uint8)
    step[1:8, 1:8, 3:12], step[8:15, 1:8, 5:12] = 0, 0
    two = caverns.Cavern([(0, 0, 0, step.tobytes())], DIMS)
    lab, _ = two.floors()
    assert two.gap(lab, lab[2, 2, 3], lab[10, 2, 5]) == {"step_exceeds_limit": 7}
    low = step.copy()
    low[1:8, 1:8, 5:] = 8  # a ceiling of two voxels over the lower room
    low[8:15, 1:8, 4] = 0
    three = caverns.Cavern([(0, 0, 0, low.tobytes())], DIMS)
    lab, _ = three.floors()
    assert three.gap(lab, lab[2, 2, 3], lab[10, 2, 4]) == {"low_side_headroom_blocked": 7}
    blocks = spark.createDataFrame([("t", 0, 0, 0, bytearray(corridor()[0][3]))], "tile string, bx int, by int, bz int, data binary")
    sockets = spark.createDataFrame([("t", "west", 0.5, 7.5, 3.5), ("t", "east", 15.5, 7.5, 6.5), ("t", "far", 0.5, 7.5, 14.5), ("none", "x", 0.0, 0.0, 0.0)], "tile string, socket string, x double, y double, z double")
    got = {r["socket"]: r["component"] for r in caverns.socket_voids(blocks, sockets.filter("tile = 't'"), DIMS).collect()}
    assert got["west"] == got["east"] and got["far"] is None
    groups = caverns.socket_groups(caverns.socket_voids(blocks, sockets.filter("tile = 't'"), DIMS)).collect()
    assert [r["sockets"] for r in groups] == [["east", "west"]]
    walks = {(r["a"], r["b"]): r for r in caverns.socket_walks(blocks, sockets.filter("tile = 't'"), DIMS).collect()}
    assert walks["east", "west"]["status"] == "no_walk" and walks["east", "west"]["air"] == "candidate_air_path_found" and walks["east", "far"]["status"] == "no_floor"


def test_facets_need_a_plane(spark):
    rows = [(1, 0.0, 0.0, 0.0), (2, 0.5, 0.0, 0.0), (3, 0.5, 0.5, 0.0), (10, 10.0, 0.0, 0.0), (11, 10.5, 0.0, 0.0), (12, 11.0, 0.0, 0.0), (20, 20.0, 0.0, 0.0), (21, 20.5, 0.0, 0.0), (22, 20.5, 0.5, 0.1), (30, 30.0, 0.0, 0.0)]
    hits = spark.createDataFrame([(*r, 0.0, 0.0, 1.0) for r in rows] + [(31, 30.4, 0.0, 0.0, 0.0, 0.0, 0.05)], "index int, x double, y double, z double, nx double, ny double, nz double")
    got = {r["facet"]: (r["hits"], r["spans"], r["consistent"]) for r in ground.facet_evidence(hits, ground.facets(hits)).collect()}
    assert got == {1: (3, True, True), 10: (3, False, False), 20: (3, True, False)}
