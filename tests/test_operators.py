import collections
import heapq
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, grid, relational, series, spatial
from tessera.operators.search import interleaved, search, terms
from tessera.plans import graphs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_topk_ties_take_the_smaller_key(spark):
    df = spark.createDataFrame([(x,) for x in "bbaacd"], "k string")
    assert rows(relational.histogram_topk(df, "k", 2), "rank", "k", "records") == [(1, "a", 2), (2, "b", 2)]


def test_coverage(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 3)], "g int, c int")
    assert rows(relational.coverage(df, "g", "c"), "g", "expected", "complete", "surplus") == [(1, 2, True, 1), (2, 3, False, 0)]


def test_snap_rounds_halves_to_even_and_ladder_is_inclusive(spark):
    df = spark.createDataFrame([(2.0,), (6.0,), (0.5,), (33.0,), (None,)], "v double")
    out = df.select("v", relational.snap(F.col("v"), 4).alias("s"), relational.ladder(F.col("v"), [0.5, 32.0]).alias("l")).collect()
    assert [(r["s"], r["l"]) for r in out] == [(0.0, "<=32"), (8.0, "<=32"), (0.0, "<=0.5"), (32.0, ">32"), (None, None)]


def test_set_relations_of_nothing(spark):
    df = spark.createDataFrame([], "k int")
    assert rows(relational.set_relations(df, df, ["k"]), "only_left", "only_right", "both", "either") == [(0, 0, 0, 0)]


def test_adjacency_never_bridges_a_gap(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([1.0, None, 3.0, 4.0])], "lane int, t int, v double")
    out = series.gap_safe_adjacency(df, "lane", ["t"], F.col("v").isNotNull(), {"d": F.col("v")})
    assert rows(out, "t", "d") == [(3, 1.0)]


def test_last_session_is_never_merged(spark):
    df = spark.createDataFrame([(1, t, m) for t, m in enumerate([0, 1, 0, 1, 0, 0])] + [(2, 0, 0)], "lane int, t int, m int")
    assert rows(series.last_session(df, "lane", ["t"], F.col("m") == 1), "lane", "t", "session") == [(1, 3, 2), (1, 4, 2), (1, 5, 2)]


def test_islands(spark):
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate([True, True, False, True])], "lane int, t int, x boolean")
    assert rows(series.islands(df, "lane", ["t"], F.col("x")), "t", "island") == [(0, 1), (1, 1), (3, 2)]


def test_touching_intervals_do_not_overlap(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (2, 2.0, 3.0), (3, 1.0, 9.5), (4, 9.0, 9.1)], "i int, lo double, hi double").withColumn("k", F.lit(1))
    assert rows(spatial.interval_overlaps(df, ["k"], "i", "lo", "hi", 2.0), "a", "b") == [(1, 3), (2, 3), (3, 4)]


def test_faces_touch_edges_do_not(spark):
    box = lambda i, x, y: (i, x, x + 1.0, y, y + 1.0, 0.0, 1.0)
    df = spark.createDataFrame([box(1, 0.0, 0.0), box(2, 1.0, 0.0), box(3, 1.0, 1.0)], "id int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    assert rows(spatial.face_contacts(df), "a", "b", "axis", "area") == [(1, 2, "x", 1.0), (2, 3, "y", 1.0)]


def test_nearest_within_is_inclusive_and_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, -1.0, 0.0), (4, 5.0, 5.0)], "i int, x double, y double")
    assert rows(spatial.nearest_within(df, df, "i", ["x", "y"], 1.0), "i", "nearest", "within") == [(1, 2, 2), (2, 1, 1), (3, 1, 1)]


def plain_components(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain_components(edges)


def test_a_loop_has_degree_two_and_one_neighbour(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "a int, b int")
    assert rows(graph.degrees(df), "node", "degree", "neighbours") == [(1, 4, 2), (2, 2, 1)]


def test_evidence_first_path_prefers_fewer_contacts(spark):
    e = spark.createDataFrame([(0, 1, 100, 0), (0, 2, 1, 1), (2, 1, 1, 1)], "a int, b int, length int, contact int")
    start = spark.createDataFrame([(0,)], "node int")
    zero = F.struct(F.lit(0).alias("contacts"), F.lit(0).alias("distance"))
    step = F.struct((F.col("cost.contacts") + F.col("contact")).alias("contacts"), (F.col("cost.distance") + F.col("length")).alias("distance"))
    tree = graph.cheapest(e, start, step, zero)
    assert rows(tree.select("node", "cost.*"), "node", "contacts", "distance") == [(0, 0, 0), (1, 0, 100), (2, 1, 1)]
    assert graph.path_to(tree, 1) == [0, 1]
    with pytest.raises(ValueError):
        graph.path_to(tree, 9)


def heap_tree(edges, start):
    """Costs (contacts, distance) and the node before each, in the order in which a heap settles nodes."""
    near = collections.defaultdict(list)
    for a, b, length, contact in edges:
        near[a].append((b, length, contact))
        near[b].append((a, length, contact))
    cost, before, heap = {start: (0, 0)}, {start: None}, [((0, 0), start)]
    while heap:
        c, n = heapq.heappop(heap)
        if c != cost[n]:
            continue
        for m, length, contact in near[n]:
            new = (c[0] + contact, c[1] + length)
            if m not in cost or new < cost[m]:
                cost[m], before[m] = new, n
                heapq.heappush(heap, (new, m))
    return {n: (cost[n], before[n]) for n in cost}


def tree_of(spark, edges, start):
    e = spark.createDataFrame(edges, "a int, b int, length int, contact int")
    zero = F.struct(F.lit(0).alias("contacts"), F.lit(0).alias("distance"))
    step = F.struct((F.col("cost.contacts") + F.col("contact")).alias("contacts"), (F.col("cost.distance") + F.col("length")).alias("distance"))
    return graph.cheapest(e, spark.createDataFrame([(start,)], "node int"), step, zero)


@pytest.mark.parametrize("seed", range(3))
def test_predecessors_on_ties_are_those_of_a_heap(spark, seed):
    rng = random.Random(seed)
    edges = [(0, 5, 2, 0), (5, 9, 2, 0), (0, 1, 1, 0), (1, 2, 1, 0), (2, 9, 2, 0)]
    edges += [(rng.randrange(10, 30), rng.randrange(10, 30), rng.randrange(1, 4), rng.randrange(3) // 2) for _ in range(60)] + [(9, 10, 1, 0), (9, 10, 1, 0)]
    got = {r["node"]: ((r["contacts"], r["distance"]), r["previous"]) for r in tree_of(spark, edges, 0).select("node", "cost.*", "previous").collect()}
    assert got == heap_tree(edges, 0) and got[9] == ((0, 4), 2)


def test_edges_that_cost_nothing_never_make_a_cycle(spark):
    edges = [(0, 9, 1, 0), (9, 4, 0, 0), (4, 3, 0, 0), (3, 9, 0, 0), (3, 2, 0, 0), (2, 1, 0, 0), (2, 2, 0, 0), (0, 7, 0, 0)]
    got = {r["node"]: r["previous"] for r in tree_of(spark, edges, 0).collect()}
    assert got == {0: None, 9: 0, 4: 9, 3: 9, 2: 3, 1: 2, 7: 0}


def test_greedy_matching(spark):
    rng = random.Random(2)
    pairs = [(a, b, rng.random()) for a in range(8) for b in range(8) if rng.random() < 0.5]
    used, want = set(), []
    for d, l, r in sorted((d, l, r) for l, r, d in pairs):
        if ("l", l) not in used and ("r", r) not in used:
            used |= {("l", l), ("r", r)}
            want.append((l, r))
    assert rows(graph.mutual_nearest(spark.createDataFrame(pairs, "l int, r int, d double")), "l", "r") == sorted(want)


def test_assignment_pairs_all_values_within_the_tolerance(spark):
    """Against brute force, also across the borders of cells."""
    rng = random.Random(8)
    events = [(k, rng.choice(["click", "purchase", "view"]), rng.uniform(-3, 9)) for k in range(90)]
    events += [(100, "click", 20.001), (101, "purchase", 19.999), (102, "click", 30.0), (103, "purchase", 30.5), (104, "click", 40.0), (105, "purchase", 40.51), (106, "click", None)]
    df = spark.createDataFrame(events, "event_id long, event_type string, value double")
    near = [(abs(v - w), l, r) for l, t, v in events if t == "click" and v is not None for r, u, w in events if u == "purchase" and abs(v - w) <= 0.5]
    want, used = [], set()
    for _, l, r in sorted(near):
        if not {l, r} & used:
            used |= {l, r}
            want.append((l, r))
    assert rows(graphs.greedy_assignment(lambda name: df, spark), "l", "r") == sorted(want) and {(100, 101), (102, 103)} < {*want}


def greedy(left, right, tolerance):
    """(l, r) by brute force, in the order of (d, l, r)."""
    used, out = set(), []
    for _, l, r in sorted((abs(v - w), l, r) for l, v in left for r, w in right if abs(v - w) <= tolerance):
        if ("l", l) not in used and ("r", r) not in used:
            used |= {("l", l), ("r", r)}
            out.append((l, r))
    return sorted(out)


def test_tied_places_are_matched_together(spark, monkeypatch):
    """Places as near to two others, of many points each: rounds do not grow with the points."""
    pairs, calls = grid.Plan.pairs, []
    monkeypatch.setattr(grid.Plan, "pairs", lambda self, l, r: calls.append(1) or pairs(self, l, r))
    left = [(k * 7 % 31, 0.0) for k in range(24)] + [(40 + k, 0.5) for k in range(5)]
    right = [(k * 5 % 37, (-0.25, 0.25)[k % 2]) for k in range(30)]
    points = lambda rows: spark.createDataFrame(rows, "id long, value double")
    got = grid.nearest_matching(points(left), points(right), ["value"], 0.5)
    assert rows(got, "l", "r") == greedy(left, right, 0.5) and len(calls) <= 8


@pytest.mark.parametrize("seed, most", [(1, None), (2, 3)])
def test_tied_places_match_brute_force(spark, seed, most):
    """On a lattice most distances are tied, and some places wait for nearer ones; also where a group is taken in parts."""
    rng = random.Random(seed)
    ids = rng.sample(range(1000), 160)
    sides = [[(i, rng.randrange(16) * 0.125 + rng.choice([0, 0, 0.0625])) for i in ids[s::2]] for s in (0, 1)]
    points = lambda rows: spark.createDataFrame(rows, "id long, value double")
    assert rows(grid.nearest_matching(points(sides[0]), points(sides[1]), ["value"], 0.3, most=most), "l", "r") == greedy(*sides, 0.3)


def test_search(spark):
    df = spark.createDataFrame([(1, "Red Cave", "a"), (2, "red pocket", "b"), (3, "blue cave", "a")], "i int, t string, g string")
    assert rows(search(df, " RED  ca", F.col("t")), "i") == [(1,)]
    assert rows(search(df, "", F.col("t")), "i") == []
    assert rows(search(df, "", F.col("t"), {"g": ["a"]}), "i") == [(1,), (3,)]
    assert terms("x" * 200) == ["x" * 100]
    assert rows(interleaved(df, "g", ["i"]), "place", "i") == [(1, 1), (2, 2), (3, 3)]
