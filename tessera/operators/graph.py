"""Graphs as edges (a, b): degrees, components, reach, and cheapest paths under several ideas of cost.

Everything iterates over DataFrames until nothing changes, which each round brings nearer, with the frontier stored in between; nothing but
counters reaches the driver.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only where none is set and Spark is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder belongs to it
        pass


def transient(spark: SparkSession, base: str, name: str) -> str:
    """A new folder's path below base, deleted when the driver ends."""
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the cluster's shared folder and read again: cuts the lineage, survives lost executors. It goes with the driver.

    Unlike a checkpoint it is computed once, and its size is that of its files: a checkpoint hands on the estimate of its plan, which in a loop of
    joins is multiplied in each round, until planning takes longer than the work.
    """
    spark = df.sparkSession
    path = transient(spark, _shared_folder(spark), "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree: a loop counts twice, neighbours: different nodes it is joined to, itself included)."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.countDistinct("to").alias("neighbours"))


def both_ways(edges: DataFrame) -> DataFrame:
    swapped = edges.select(*[F.col({"a": "b", "b": "a"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(swapped)


def components(edges: DataFrame) -> DataFrame:
    """(node, component: its least node). Each node points to its least neighbour below it, pointers are followed to their ends, and the links that are
    left between different ends are those of the next round. An end has no neighbour below it, so at most half of the linked nodes are ends: nodes
    and links shrink from round to round, and only the first ones read all."""
    known = edges.select("a", "b").filter("a is not null and b is not null")
    between = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    nodes = known.select(F.col("a").alias("node")).unionByName(known.select(F.col("b").alias("node"))).distinct()
    links, folds = cut(between(known)), []
    while not links.isEmpty():
        to = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")))
        while True:  # each time pointers are four times as long
            far = to
            for here, there in (("to", "_1"), ("_1", "_2"), ("_2", "_3")):
                far = far.join(to.select(F.col("node").alias(here), F.col("to").alias(there)), here, "left")
            far = cut(far.select("node", F.coalesce("_3", "_2", "_1", "to").alias("to"), F.col("_1").isNotNull().alias("_moved")))
            if far.filter("_moved").isEmpty():
                break
            to = far.drop("_moved")
        folds.append(to)
        for c in "ab":
            links = links.join(folds[-1].withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        links = cut(between(links))
    found = None
    for to in reversed(folds):  # an end is a node of a later round, or the least of its component
        if found is None:
            found = to.withColumnRenamed("to", "component")
            continue
        above = found.select(F.col("node").alias("to"), "component")
        found = cut(found.unionByName(to.join(above, "to", "left").select("node", F.coalesce("component", "to").alias("component"))))
    if found is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def cheapest(edges: DataFrame, start: DataFrame, step: Column, zero: Column) -> DataFrame:
    """(node, cost, previous): the least cost from the start nodes (node) over edges (a, b, ...), which lead both ways.

    step combines the cost so far (column cost) with an edge's columns; costs are compared as Spark compares them, so a struct is compared
    field by field: (contacts, distance) prefers fewer contacts, and a step of greatest(cost, grade) finds the least steep path. Each round
    moves the frontier by one edge; only nodes that became cheaper are in the next. A step must never lower a cost, as Dijkstra's too; then the
    frontier empties after as many rounds as the longest cheapest path has edges. previous is chosen after that, see predecessors.
    """
    links = cut(both_ways(edges))
    best = cut(start.select("node", zero.alias("cost")))
    frontier = best
    while True:
        reached = frontier.join(links, frontier["node"] == links["a"]).select(F.col("b").alias("node"), step.alias("cost"))
        reached = reached.groupBy("node").agg(F.min("cost").alias("cost"))
        old = best.select("node", F.col("cost").alias("old"))
        frontier = cut(reached.join(old, "node", "left").filter("old is null or cost < old").drop("old"))
        if frontier.isEmpty():
            return predecessors(links, best, start, step)
        best = cut(best.join(frontier.select("node"), "node", "left_anti").unionByName(frontier))


def predecessors(links: DataFrame, best: DataFrame, start: DataFrame, step: Column) -> DataFrame:
    """best (node, cost) with previous: of the neighbours from which a node's cost is met exactly the one that is settled first, which is the
    cheapest, then the smallest node; null at the start.

    A node that is met only from neighbours of its own cost, over edges that cost nothing, takes the smallest of those with a predecessor, in
    rounds outwards from the nodes that were met from a lower cost; so no two nodes ever name each other.
    """
    known = best.join(start.select("node").distinct(), "node", "left_anti")
    ends = known.select(F.col("node").alias("b"), F.col("cost").alias("_least"))
    met = best.join(links, best["node"] == links["a"]).select("a", "b", "cost", step.alias("_new")).join(ends, "b").filter("_new = _least")
    met = cut(met.select("b", "a", "cost", (F.col("cost") < F.col("_least")).alias("lower")))
    done = met.filter("lower").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("cost", "a")).alias("n")).select("node", F.col("n.a").alias("previous"))
    done = cut(done)
    open_ = cut(met.join(done, met["b"] == done["node"], "left_anti"))
    begun = cut(done.select("node").unionByName(start.select("node")).distinct())
    while not open_.isEmpty():
        next_ = cut(open_.join(begun, open_["a"] == begun["node"]).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("previous")))
        done, begun = cut(done.unionByName(next_)), next_.select("node")
        open_ = cut(open_.join(next_, open_["b"] == next_["node"], "left_anti"))
    return best.join(done, "node", "left").select("node", "cost", "previous")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, steps): nodes that the start nodes reach, and in how few edges."""
    return cheapest(edges.select("a", "b"), start, F.col("cost") + 1, F.lit(0)).select("node", F.col("cost").alias("steps"))


def path_to(tree: DataFrame, target) -> list:
    """The nodes of one cheapest path, from start to target. The tree's rows know the ancestor 1, 2, 4, ... steps up, so a path of n edges takes
    about log n joins; only the path reaches the driver."""
    up = tree.select("node", F.col("previous").alias("to"))
    path = cut(up.filter(F.col("node") == target).select(F.lit(0).alias("steps"), "node"))
    if path.isEmpty():
        raise ValueError(f"no path to {target!r}")
    step = 1
    while True:
        far = path.join(up, "node").filter("to is not null").select((F.col("steps") + step).alias("steps"), F.col("to").alias("node"))
        if far.isEmpty():
            return [r["node"] for r in path.orderBy(F.desc("steps")).collect()]
        path = cut(path.unionByName(far))
        next_up = up.select(F.col("node").alias("to"), F.col("to").alias("_f"))
        up = cut(up.join(next_up, "to").select("node", F.col("_f").alias("to")))
        step *= 2


def mutual_nearest(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one matching of pairs (l, r, d): (l, r, d) in the order of (d, l, r), each side used once.

    A pair that is the least at both of its ends is what the greedy order takes sooner or later, so all of them are taken at once. The least of all
    pairs is such a pair, so every round takes one at least.
    """
    left, out = cut(pairs.select("l", "r", "d")), None
    while True:
        key = F.struct("d", "l", "r")
        by_l, by_r = left.groupBy("l").agg(F.min(key).alias("k")).select("k.*"), left.groupBy("r").agg(F.min(key).alias("k")).select("k.*")
        taken = cut(by_l.intersect(by_r))
        if taken.isEmpty():
            return left.filter(F.lit(False)) if out is None else out
        out = taken if out is None else cut(out.unionByName(taken))
        left = cut(left.join(taken.select("l"), "l", "left_anti").join(taken.select("r"), "r", "left_anti"))
