"""Graph operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import graph as G
from ..operators.grid import close_components, nearest_matching
from .summaries import nation_pairs

#: Nations are nodes; a supplier's and a customer's nation that trade more than most pairs do are joined, at a length of whole numbers.
FLOW = """SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL"""
EDGES = f"SELECT a, b, (1 + (a * 7 + b * 13) % 11)::BIGINT AS length, (a + b) % 2 = 0 AS contact FROM ({FLOW}), (SELECT avg(n) AS m FROM ({FLOW}) WHERE a <> b) WHERE a <> b AND n > 2 * m"


def flow(table):
    lines = table("lineitem").select("l_orderkey", "l_suppkey")
    s, o, c = table("supplier").select("s_suppkey", "s_nationkey"), table("orders").select("o_orderkey", "o_custkey"), table("customer").select("c_custkey", "c_nationkey")
    j = lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.count("*").alias("n"))


def edges(table):
    f = G.cut(flow(table).filter("a <> b"))  # a row for each two nations
    mean = f.agg(F.avg("n")).first()[0] or 0.0
    return f.filter(F.col("n") > 2 * mean).select("a", "b", F.expr("cast(1 + (a * 7 + b * 13) % 11 as bigint)").alias("length"), F.expr("(a + b) % 2 = 0").alias("contact"))


@query(f"""WITH e AS (SELECT a, b FROM ({FLOW})), x AS (SELECT a AS node, b AS t FROM e UNION ALL SELECT b, a FROM e) SELECT node, count(*) AS degree, count(DISTINCT t) AS neighbours FROM x GROUP BY node""")
def degree_histogram(table, spark):
    return G.degrees(flow(table))


NEAR = """SELECT e.user_id AS a, f.user_id AS b FROM (SELECT user_id, max(value) AS v FROM events GROUP BY 1) e JOIN (SELECT user_id, max(value) AS v FROM events GROUP BY 1) f ON e.user_id < f.user_id AND abs(e.v - f.v) <= 0.2"""


@query(f"""WITH RECURSIVE e AS ({NEAR}), x AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, to_) AS (SELECT a, a FROM x UNION SELECT r.node, x.b FROM r JOIN x ON r.to_ = x.a)
    SELECT node, min(to_) AS component FROM r GROUP BY node""")
def components(table, spark):
    """Users whose greatest values lie close together."""
    v = table("events").groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("v"))
    found = close_components(v, ["v"], 0.2)
    return found.filter("members > 1").select(F.col("id").alias("node"), "component")


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM ({EDGES})), x AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node) AS (SELECT 1 UNION SELECT x.b FROM r JOIN x ON r.node = x.a)
    SELECT n_nationkey AS node, n_nationkey IN (SELECT node FROM r) AS reached FROM nation""")
def reachable_split(table, spark):
    some = edges(table)
    start = table("nation").filter("n_nationkey = 1").select(F.col("n_nationkey").alias("node"))
    hit = G.reachable(some, start).select("node", F.lit(True).alias("hit"))
    return table("nation").select(F.col("n_nationkey").alias("node")).join(hit, "node", "left").select("node", F.coalesce("hit", F.lit(False)).alias("reached"))


#: The least costs of ways of each number of edges, up to as many as there are nations; the least of these is that of the cheapest path.
WAYS = """WITH RECURSIVE e AS (%s), x AS (SELECT a, b, length, contact FROM e UNION ALL SELECT b, a, length, contact FROM e),
    r(node, cost, hops) AS (SELECT 0, {zero}, 0 UNION ALL SELECT b, min({step}), any_value(hops) + 1 FROM r JOIN x ON node = a WHERE hops < (SELECT count(*) FROM nation) GROUP BY b)""" % EDGES


@query(WAYS.format(zero="{'c': 0::BIGINT, 'd': 0::BIGINT}", step="{'c': cost.c + contact::BIGINT, 'd': cost.d + length}") + " SELECT node, min(cost).c AS contacts, min(cost).d AS distance FROM r GROUP BY node")
def shortest_path_lexicographic(table, spark):
    """Fewest contact edges first, then distance."""
    start = table("nation").filter("n_nationkey = 0").select(F.col("n_nationkey").alias("node"))
    zero = F.struct(F.lit(0).cast("long").alias("contacts"), F.lit(0).cast("long").alias("distance"))
    step = F.struct((F.col("cost.contacts") + F.col("contact").cast("long")).alias("contacts"), (F.col("cost.distance") + F.col("length")).alias("distance"))
    return G.cheapest(edges(table), start, step, zero).select("node", "cost.contacts", "cost.distance")


@query(WAYS.format(zero="{'c': 0::BIGINT, 'd': 0::BIGINT}", step="{'c': cost.c + contact::BIGINT, 'd': cost.d + length}") + """, k AS (SELECT node, min(cost) AS cost FROM r GROUP BY node),
    p AS (SELECT k.node, x.a AS previous, u.cost AS before FROM k JOIN x ON x.b = k.node JOIN k u ON u.node = x.a WHERE k.node <> 0 AND k.cost = {'c': u.cost.c + contact::BIGINT, 'd': u.cost.d + length})
    SELECT k.node, p.previous FROM k LEFT JOIN (FROM p QUALIFY row_number() OVER (PARTITION BY node ORDER BY before, previous) = 1) p USING (node)""")
def shortest_path_tree(table, spark):
    """The node before each on its cheapest path; of equally cheap ones the one that is settled first."""
    start = table("nation").filter("n_nationkey = 0").select(F.col("n_nationkey").alias("node"))
    zero = F.struct(F.lit(0).cast("long").alias("contacts"), F.lit(0).cast("long").alias("distance"))
    step = F.struct((F.col("cost.contacts") + F.col("contact").cast("long")).alias("contacts"), (F.col("cost.distance") + F.col("length")).alias("distance"))
    return G.cheapest(edges(table), start, step, zero).select("node", "previous")


@query(WAYS.format(zero="0::BIGINT", step="greatest(cost, length)") + " SELECT node, min(cost) AS grade FROM r GROUP BY node")
def minimax_path(table, spark):
    """The path whose longest edge is shortest."""
    start = table("nation").filter("n_nationkey = 0").select(F.col("n_nationkey").alias("node"))
    return G.cheapest(edges(table), start, F.greatest("cost", "length"), F.lit(0).cast("long")).select("node", F.col("cost").alias("grade"))


CELLS = "SELECT DISTINCT user_id AS x, hour(ts)::BIGINT AS y FROM events WHERE value > 150"


@query(f"""WITH RECURSIVE c AS (SELECT x, y, x * 24 + y AS id FROM ({CELLS})), x AS (SELECT p.id AS a, q.id AS b FROM c p JOIN c q ON abs(p.x - q.x) + abs(p.y - q.y) = 1), r(node, to_) AS (SELECT id, id FROM c UNION SELECT r.node, x.b FROM r JOIN x ON r.to_ = x.a)
    SELECT component, count(*) AS cells FROM (SELECT node, min(to_) AS component FROM r GROUP BY node) GROUP BY component""")
def grid_components(table, spark):
    """Flood fill of an occupancy grid over its four neighbours; a cell without neighbours is a component too."""
    c = table("events").filter("value > 150").select(F.col("user_id").alias("x"), F.hour(F.col("ts").cast("timestamp")).cast("long").alias("y")).distinct().withColumn("id", F.expr("x * 24 + y"))
    shifted = c.select(F.col("x"), (F.col("y") - 1).alias("y"), F.col("id").alias("b")).unionByName(c.select(F.col("x") - 1, F.col("y"), F.col("id").alias("b")).toDF("x", "y", "b"))
    links = c.join(shifted, ["x", "y"]).select(F.col("id").alias("a"), "b")
    found = G.components(links)
    whole = c.select(F.col("id").alias("node")).join(found, "node", "left").select(F.coalesce("component", "node").alias("component"))
    return whole.groupBy("component").agg(F.count("*").alias("cells"))


#: How far the values of a click and a purchase may differ.
TOLERANCE = 0.5


@query(f"""WITH RECURSIVE p AS (SELECT a.event_id AS l, b.event_id AS r, abs(a.value - b.value) AS d FROM events a JOIN events b ON a.event_type = 'click' AND b.event_type = 'purchase' AND abs(a.value - b.value) <= {TOLERANCE}),
    r(l, r, d, taken) AS (
      SELECT l, r, d, false FROM p
      UNION ALL
      SELECT l, r, d, row_number() OVER (PARTITION BY l ORDER BY d, l, r) = 1 AND row_number() OVER (PARTITION BY r ORDER BY d, l, r) = 1
      FROM (SELECT *, bool_or(taken) OVER (PARTITION BY l) OR bool_or(taken) OVER (PARTITION BY r) AS gone FROM r) WHERE NOT gone)
    SELECT l, r, round(d, 6) AS d FROM r WHERE taken""")
def greedy_assignment(table, spark):
    """Purchases to clicks whose values differ by the tolerance at most, closest pair first, each used once."""
    side = lambda t: table("events").filter(F.col("event_type") == t).select(F.col("event_id").alias("id"), "value")
    return nearest_matching(side("click"), side("purchase"), ["value"], TOLERANCE).withColumn("d", F.round("d", 6))
