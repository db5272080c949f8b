"""Routes through a layout: anchors at centres, tunnel ends and contacts, edges between them, and the cheapest way, by recorded tunnels first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.boxes import AXES, nearest_box
from ..operators.relational import numbered
from .topology import BOX, TRANSIT, endpoints

KINDS = ["tunnel", "intra_tile", "contact"]


def tunnel_links(points: DataFrame, lengths: DataFrame, nodes: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """(tunnel_id, tunnel_type, a, b, length): tunnels with a node within the tolerance at either end; a is where it begins."""
    ends = endpoints(points).select(F.struct("tunnel_id", "end").alias("point"), *AXES)
    at = nearest_box(ends, nodes.select(*BOX), tolerance).select("point.tunnel_id", "point.end", "box")
    pair = at.groupBy("tunnel_id").agg(F.max(F.when(F.col("end") == 0, F.col("box"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("box"))).alias("b"))
    return lengths.select("tunnel_id", "tunnel_type", "length").join(pair.filter("a is not null and b is not null"), "tunnel_id").select("tunnel_id", "tunnel_type", "a", "b", "length")


def transit_edges(nodes: DataFrame, contacts: DataFrame, links: DataFrame, vertical: bool = False) -> DataFrame:
    """(a, b, kind, weight, axis, tunnel_id): links between different nodes that a route may pass; a contact is as long as from centre to centre."""
    centre = [((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(c) for c in AXES]
    own = nodes.filter(F.col("role").isin(TRANSIT)).select("id", *centre)
    end = lambda s: own.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in AXES])
    both = lambda df: df.filter("a <> b").join(end("a"), "a").join(end("b"), "b")
    apart = F.sqrt(sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in AXES), F.lit(0.0)))
    t = both(links).select("a", "b", F.lit("tunnel").alias("kind"), F.col("length").alias("weight"), F.lit(None).cast("string").alias("axis"), "tunnel_id")
    c = both(contacts if vertical else contacts.filter("axis <> 'z'")).select("a", "b", F.lit("contact").alias("kind"), apart.alias("weight"), "axis", F.lit(None).cast(t.schema["tunnel_id"].dataType).alias("tunnel_id"))
    return t.unionByName(c)


def contact_points(contacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds x, y, z: the middle of the shared part of two nodes' faces (a, b, axis, direction)."""
    end = lambda s: nodes.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in BOX[1:]])
    met = contacts.join(end("a"), "a").join(end("b"), "b")
    at = {}
    for c in AXES:
        touching = F.when(F.col("direction") > 0, F.col(f"{c}1_a")).otherwise(F.col(f"{c}0_a"))
        at[c] = F.when(F.col("axis") == c, touching).otherwise((F.greatest(f"{c}0_a", f"{c}0_b") + F.least(f"{c}1_a", f"{c}1_b")) / 2)
    return met.select("a", "b", "axis", *[v.alias(c) for c, v in at.items()])


class RouteGraph:
    """anchors: anchor, node, kind, tunnel_id, x, y, z. edges: a, b, kind, weight, contact (1 for a contact, else 0), tunnel_id."""

    def __init__(self, nodes: DataFrame, contacts: DataFrame, links: DataFrame, points: DataFrame, portals: DataFrame | None = None, vertical: bool = False):
        own = nodes.filter(F.col("role").isin(TRANSIT))
        self.nodes = own
        known = own.select(F.col("id").alias("node"))
        middle = [((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(c) for c in AXES]
        none = F.lit(None).cast("long")
        centres = own.select(F.lit(0).alias("k"), F.col("id").cast("long").alias("n"), F.lit(0).alias("side"), F.col("id").alias("node"), F.lit("center").alias("kind"), none.alias("tunnel_id"), *middle)
        ends = endpoints(points).join(links.select("tunnel_id", "a", "b"), "tunnel_id").withColumn("node", F.when(F.col("end") == 0, F.col("a")).otherwise(F.col("b")))
        tunnel = ends.select(F.lit(1).alias("k"), F.col("tunnel_id").cast("long").alias("n"), F.col("end").alias("side"), "node", F.lit("tunnel_endpoint").alias("kind"), F.col("tunnel_id").cast("long").alias("tunnel_id"), *AXES)
        used = contacts if vertical else contacts.filter("axis <> 'z'")
        used = used.join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi")
        used = graph.cut(numbered(contact_points(used, own), ["a", "b"], "n"))
        at = used.select(F.lit(2).alias("k"), "n", F.posexplode(F.array("a", "b")).alias("side", "node"), F.lit("contact").alias("kind"), none.alias("tunnel_id"), *AXES)
        parts = centres.unionByName(tunnel).unionByName(at)
        if portals is not None:  # id, point, x, y, z of the nodes' start portals
            parts = parts.unionByName(portals.select(F.lit(3).alias("k"), F.col("id").cast("long").alias("n"), F.lit(0).alias("side"), F.col("id").alias("node"), F.lit("saved_portal").alias("kind"), none.alias("tunnel_id"), *AXES))
        anchors = graph.cut(numbered(parts.join(known, "node", "left_semi"), ["k", "n", "side", "node"], "anchor"))
        two = anchors.filter("k in (1, 2)").groupBy("k", "n").agg(F.min(F.struct("side", "anchor", "node")).alias("p"), F.max(F.struct("side", "anchor", "node")).alias("q")).filter("p.side <> q.side")
        lengths = links.select(F.col("tunnel_id").cast("long").alias("n"), "length")
        through = two.filter("k = 1 and p.node <> q.node").join(lengths, "n").select(F.col("p.anchor").alias("a"), F.col("q.anchor").alias("b"), F.lit("tunnel").alias("kind"), F.col("length").alias("weight"), F.lit(0).alias("contact"), F.col("n").alias("tunnel_id"))
        across = two.filter("k = 2").select(F.col("p.anchor").alias("a"), F.col("q.anchor").alias("b"), F.lit("contact").alias("kind"), F.lit(0.0).alias("weight"), F.lit(1).alias("contact"), none.alias("tunnel_id"))
        left, right = (anchors.select("node", F.col("anchor").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in AXES]) for s in "ab")
        apart = F.sqrt(sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in AXES), F.lit(0.0)))
        inner = left.join(right, "node").filter("a < b").select("a", "b", F.lit("intra_tile").alias("kind"), apart.alias("weight"), F.lit(0).alias("contact"), none.alias("tunnel_id"))
        self.anchors, self.edges = anchors, graph.cut(through.unionByName(across).unionByName(inner))

    def start(self) -> tuple[int, int]:
        """The anchor to begin at and its node: the only elevator's portal, or its centre where it has none."""
        lifts = self.nodes.filter("role = 'elevator'").select("id").limit(2).collect()
        if len(lifts) != 1:
            raise ValueError("there is not exactly one elevator")
        node = lifts[0]["id"]
        own = self.anchors.filter((F.col("node") == node) & F.col("kind").isin("center", "saved_portal")).orderBy(F.desc("k")).first()
        return own["anchor"], node

    def tree(self, start: int) -> DataFrame:
        """(node: an anchor, contacts, distance, previous) from an anchor: fewest contacts first, then the shortest."""
        zero = F.struct(F.lit(0).alias("contacts"), F.lit(0.0).alias("distance"))
        step = F.struct((F.col("cost.contacts") + F.col("contact")).alias("contacts"), (F.col("cost.distance") + F.col("weight")).alias("distance"))
        first = self.anchors.filter(F.col("anchor") == start).select(F.col("anchor").alias("node"))
        return graph.cut(graph.cheapest(self.edges.select("a", "b", "weight", "contact"), first, step, zero).select("node", "cost.contacts", "cost.distance", "previous"))

    def target(self, tree: DataFrame, links: DataFrame, node: int | None = None, tag: str | None = None, tunnel_type: str | None = None) -> dict:
        """The anchor to go to, exactly one way of naming it: a node's centre; of nodes with a tag or in whose name the text is, ignoring case, the
        cheapest, then the least; of tunnels of a type the end that is cheapest to reach."""
        if sum(x is not None for x in (node, tag, tunnel_type)) != 1:
            raise ValueError("name exactly one target")
        at = self.anchors.join(tree, self.anchors["anchor"] == tree["node"]).drop(tree["node"])
        if tunnel_type is not None:
            kind = links.filter(F.lower("tunnel_type") == tunnel_type.strip().lower()).select(F.col("tunnel_id").cast("long").alias("tunnel_id"), "tunnel_type", F.col("length").alias("tunnel_length"))
            hit = at.filter("kind = 'tunnel_endpoint'").join(kind, "tunnel_id").orderBy("contacts", "distance", "tunnel_id", "node", "anchor")
        else:
            centre = at.filter("kind = 'center'")
            if node is not None:
                hit = centre.filter(F.col("node") == node)
            else:
                t = tag.strip().lower()
                named = self.nodes.filter(F.exists("tags", lambda x: F.lower(x) == t) | F.lower("name").contains(t)).select(F.col("id").alias("node"))
                hit = centre.join(named, "node").orderBy("contacts", "distance", "node")
        best = hit.first()
        if best is None:
            raise ValueError("nothing that can be reached matches the target")
        return best.asDict()

    def segments(self, tree: DataFrame, target: int) -> DataFrame:
        """(step, a, b, kind, weight, tunnel_id, node_a, node_b) of the way to an anchor."""
        path = graph.path_to(tree, target)
        spark = self.anchors.sparkSession
        steps = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(path, path[1:]))], "step int, a long, b long")
        both = graph.both_ways(self.edges)
        best = steps.join(both, ["a", "b"]).groupBy("step", "a", "b").agg(F.min(F.struct("contact", "weight", "kind", "tunnel_id")).alias("e"))
        end = lambda s: self.anchors.select(F.col("anchor").alias(s), F.col("node").alias(f"node_{s}"))
        return best.join(end("a"), "a").join(end("b"), "b").select("step", "a", "b", "e.kind", "e.weight", "e.tunnel_id", "node_a", "node_b").orderBy("step")


def route_report(segments: DataFrame) -> DataFrame:
    """One row: cost, contacts, segments and cost by kind, and on what evidence the route rests."""
    n = lambda k: F.count_if(F.col("kind") == k)
    cost = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("weight"))), F.lit(0.0))
    r = segments.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_cost"), *[n(k).alias(f"{k}_segments") for k in KINDS], *[cost(k).alias(f"{k}_cost") for k in KINDS])
    evidence = F.when(F.col("contact_segments") > 0, "saved tunnels + intra-tile proxies + candidate face contacts").when(F.col("intra_tile_segments") > 0, "saved tunnels + intra-tile proxies").otherwise("saved tunnel geometry only")
    return r.withColumn("route_evidence", evidence)


def node_path(segments: DataFrame) -> list:
    """The nodes a route passes, each once where it stays in one."""
    out = []
    for r in segments.orderBy("step").select("node_a", "node_b").collect():
        for n in (r["node_a"], r["node_b"]):
            if out[-1:] != [n]:
                out.append(n)
    return out
