"""Joins of rows whose boxes meet, and components of close points, on grids that are finer where they are crowded.

Only counts decide where: a cell whose two sides would make too many pairs is halved along each axis while that at least halves its pairs,
and what no halving thins out (boxes that all lie in one place) is dealt out in blocks of either side. So no task compares more than a
bounded number of pairs, whatever a cell holds, and each pair is made once.
"""

from __future__ import annotations

from itertools import product
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, cut
from .relational import numbered

#: Pairs that one cell or block compares at most, and how often a cell is halved at most.
MOST_PAIRS, DEEPEST = 1 << 22, 8
#: How often parts of cells are cut finer before they are cut to points: so often that a double has no more digits.
FINEST = 24

Axis = tuple[str, str]


def wider(tolerance: float) -> float:
    """The tolerance with room for rounding: the grid finds all within it, an exact predicate decides."""
    return tolerance * (1 + 1e-9) + 1e-9


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def _names(axes: list[Axis]) -> list[str]:
    return [f"_c{i}" for i in range(len(axes))]


def _spread(df: DataFrame, axes: list[Axis], size: float) -> DataFrame:
    for c, (lo, hi) in zip(_names(axes), axes):
        df = df.withColumn(c, F.explode(F.sequence(_cell(F.col(lo), size), _cell(F.col(hi), size))))
    return df


def _halved(df: DataFrame, axes: list[Axis], size: float) -> DataFrame:
    """Rows in their cells of half the width; size is that of the new cells."""
    for c, (lo, hi) in zip(_names(axes), axes):
        first, last = F.col(c) * 2, F.col(c) * 2 + 1
        df = df.withColumn(c, F.explode(F.sequence(F.greatest(first, _cell(F.col(lo), size)), F.least(last, _cell(F.col(hi), size)))))
    return df


def _counted(left: DataFrame, right: DataFrame, at: list[str]) -> DataFrame:
    """(at, l, r, pairs) of the cells that have both sides."""
    one = lambda df, l, r: df.select(*at, F.lit(l).cast("long").alias("l"), F.lit(r).cast("long").alias("r"))
    n = one(left, 1, 0).unionByName(one(right, 0, 1)).groupBy(*at).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return n.withColumn("pairs", F.col("l").cast("double") * F.col("r")).filter("pairs > 0")


class Plan:
    """Which cells are halved, level by level, and which are dealt out in blocks: (at, level, blocks of the left, blocks of the right)."""

    def __init__(self, left: DataFrame, right: DataFrame, keys: list[str], left_axes: list[Axis], right_axes: list[Axis], size: float, most: int):
        self.at, self.size, self.splits = [*keys, *_names(left_axes)], size, []
        self.keys, self.left_axes, self.right_axes = keys, left_axes, right_axes
        self.blocks: DataFrame | None = None
        l, r = (_spread(df.select(*keys, *{c for a in axes for c in a}), axes, size) for df, axes in ((left, left_axes), (right, right_axes)))
        level = 0
        hot = cut(_counted(l, r, self.at).filter(F.col("pairs") > most))
        while not hot.isEmpty():
            good = hot.limit(0)
            if level < DEEPEST:
                width = size / 2 ** (level + 1)
                l, r = (_halved(df.join(hot.select(*self.at), self.at, "left_semi"), axes, width) for df, axes in ((l, left_axes), (r, right_axes)))
                below = cut(_counted(l, r, self.at))
                parent = [F.shiftright(c, 1).alias(c) if c.startswith("_c") else F.col(c) for c in self.at]
                thinned = below.select(*parent, F.col("pairs").alias("less")).groupBy(*self.at).agg(F.sum("less").alias("less"))
                good = cut(hot.join(thinned, self.at, "left").filter("coalesce(less, 0) <= pairs / 2").select(*self.at))
            each = sqrt(most)
            full = hot.join(good.select(*self.at), self.at, "left_anti").select(*self.at, F.lit(level).alias("_level"), F.ceil(F.col("l") / each).alias("_left"), F.ceil(F.col("r") / each).alias("_right"))
            self.blocks = full if self.blocks is None else self.blocks.unionByName(full)
            if level == DEEPEST or good.isEmpty():
                break
            self.splits.append(good)
            level += 1
            up = good.select(*[F.col(c).alias(f"{c}_up") for c in self.at])
            inside = [(F.shiftright(c, 1) if c.startswith("_c") else F.col(c)) == F.col(f"{c}_up") for c in self.at]
            l, r = (df.join(up, inside, "left_semi") for df in (l, r))
            hot = cut(below.join(up, inside, "left_semi").filter(F.col("pairs") > most))
        self.blocks = None if self.blocks is None else cut(self.blocks)

    def place(self, df: DataFrame, axes: list[Axis]) -> DataFrame:
        """df in the cells of the plan: at, _level."""
        now, out = _spread(df, axes, self.size), None
        for level, good in enumerate(self.splits):
            leaf = now.join(good, self.at, "left_anti").withColumn("_level", F.lit(level))
            out = leaf if out is None else out.unionByName(leaf)
            now = _halved(now.join(good, self.at, "left_semi"), axes, self.size / 2 ** (level + 1))
        now = now.withColumn("_level", F.lit(len(self.splits)))
        return now if out is None else out.unionByName(now)

    def dealt(self, df: DataFrame, own: str, other: str, columns: list[str]) -> DataFrame:
        """Each row in one block of its own side, once for each block of the other."""
        df = df.join(self.blocks, [*self.at, "_level"], "left")
        df = df.withColumn(f"_of{own}", F.pmod(F.xxhash64(*columns), F.coalesce(own, F.lit(1))))
        return df.withColumn(f"_of{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))).drop("_left", "_right")


    def pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """What meet returns; the sides may be those that the plan was made of, or rows of them."""
        l, r, on = self.place(left, self.left_axes), self.place(right, self.right_axes), [*self.at, "_level"]
        if self.blocks is not None:
            l, r = self.dealt(l, "_left", "_right", left.columns), self.dealt(r, "_right", "_left", right.columns)
            on += ["_of_left", "_of_right"]
        met = l.join(r, on)
        width = F.lit(self.size) / F.expr("shiftleft(1L, _level)")
        if all(lo == hi for lo, hi in self.left_axes):  # a point is in one cell, so its pairs are made once as they are
            return met.select(*self.keys, *[c for df in (left, right) for c in df.columns if c not in self.keys])
        for c, (lo, _), (lo_r, _) in zip(_names(self.left_axes), self.left_axes, self.right_axes):
            met = met.filter(F.floor(F.greatest(lo, lo_r) / width).cast("long") == F.col(c))
        return met.select(*self.keys, *[c for df in (left, right) for c in df.columns if c not in self.keys])


def meet(left: DataFrame, right: DataFrame, left_axes: list[Axis], right_axes: list[Axis], size: float, keys: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """All columns of both sides for each pair of rows with equal keys whose boxes meet, and maybe of some whose boxes do not: a predicate of the
    caller decides. Axes are (least, greatest) columns of a side; apart from keys the sides have no name in common. A pair is made in the cell of its
    boxes' common lower corner alone."""
    return Plan(left, right, [*keys], left_axes, right_axes, size, most or MOST_PAIRS).pairs(left, right)


def _bounds(axes: list[str]) -> list[Column]:
    return [f(a).alias(f"{n}{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))]


def close_components(points: DataFrame, axes: list[str], tolerance: float, ident: str = "id") -> DataFrame:
    """(ident, component, members): points within the tolerance of each other, inclusive, directly or through others, with the component's least
    ident and its number of points.

    Points of a cell as wide as the tolerance over the root of the axes are all within it, so a cell is one node, and the pairs of its points are never
    made. Two cells near each other are linked if any two of their points are: the bounds of their parts tell, and where they leave it open the parts
    are cut four times finer along each axis, and again, until they are points. A pair of cells that is linked is not looked at again.
    """
    p = points.select(F.col(ident).alias("_id"), *[F.col(a).cast("double").alias(a) for a in axes])
    side = tolerance / sqrt(len(axes)) * (1 - 1e-9) if tolerance > 0 else 1.0
    cells = [f"_c{i}" for i in range(len(axes))]
    where = [(_cell(F.col(a), side) if tolerance > 0 else F.col(a)).alias(c) for a, c in zip(axes, cells)]
    at = p.select("_id", *axes, *where)
    nodes = cut(at.groupBy(*cells).agg(F.min("_id").alias("_rep"), F.count("*").alias("_n"), *_bounds(axes)))
    placed = cut(at.join(nodes.select(*cells, "_rep"), cells).select("_rep", "_id", *axes))
    links = _linked_cells(placed, nodes, axes, cells, side, tolerance) if tolerance > 0 else None
    own = nodes.select("_rep", "_n")
    if links is not None:
        found = components(links).select(F.col("node").alias("_rep"), "component")
        own = own.join(found, "_rep", "left")
    else:
        own = own.withColumn("component", F.col("_rep"))
    own = own.select("_rep", "_n", F.coalesce("component", "_rep").alias("component"))
    total = own.groupBy("component").agg(F.sum("_n").alias("members"))
    return placed.select("_rep", "_id").join(own.select("_rep", "component"), "_rep").join(total, "component").select(F.col("_id").alias(ident), "component", "members")


def _linked_cells(placed: DataFrame, nodes: DataFrame, axes: list[str], cells: list[str], side: float, tolerance: float) -> DataFrame:
    """(a, b) by the least points of the cells."""
    reach = int(sqrt(len(axes))) + 1
    steps = [d for d in product(range(-reach, reach + 1), repeat=len(axes)) if d > (0,) * len(axes)]
    step = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(d, cells)]) for d in steps]))
    part, bounds = [f"_k{i}" for i in range(len(axes))], [f"{n}{a}" for a in axes for n in ("lo", "hi")]
    own = nodes.select("_rep", *bounds, *[F.col(c).alias(k) for c, k in zip(cells, part)])
    side_of = lambda s: own.select(*[F.col(c).alias(c + s) for c in own.columns])
    asked = side_of("a").select("*", step.alias("_d")).select("*", *[(F.col(k + "a") + F.col(f"_d.{c}")).alias(k + "b") for k, c in zip(part, cells)]).drop("_d")
    pairs = asked.join(side_of("b"), [k + "b" for k in part])

    def span(kind: str) -> Column:
        """The least or the greatest distance of two parts."""
        total = F.lit(0.0)
        for a in axes:
            gap = F.greatest(F.col(f"lo{a}a") - F.col(f"hi{a}b"), F.col(f"lo{a}b") - F.col(f"hi{a}a"), F.lit(0.0))
            far = F.greatest(F.col(f"hi{a}b") - F.col(f"lo{a}a"), F.col(f"hi{a}a") - F.col(f"lo{a}b"))
            total = total + (gap if kind == "least" else far) ** 2
        return F.sqrt(total)

    out, depth = None, 0
    while True:
        judged = cut(pairs.withColumn("_least", span("least")).filter(F.col("_least") <= tolerance).withColumn("_sure", span("greatest") <= tolerance))
        sure = judged.filter("_sure").select(F.col("_repa").alias("a"), F.col("_repb").alias("b")).distinct()
        out = sure if out is None else out.unionByName(sure)
        open_ = judged.filter("not _sure").join(sure, (F.col("_repa") == F.col("a")) & (F.col("_repb") == F.col("b")), "left_anti")
        if depth > FINEST or open_.isEmpty():  # points leave nothing open
            return cut(out)
        depth += 1
        now = [F.col(a) if depth > FINEST else _cell(F.col(a), side / 4**depth) for a in axes]
        up = [_cell(F.col(a), side / 4 ** (depth - 1)).alias(f"_u{i}") for i, a in enumerate(axes)]
        asking = open_.select(F.col("_repa").alias("_rep")).unionByName(open_.select(F.col("_repb").alias("_rep"))).distinct()
        fine = placed.join(asking, "_rep", "left_semi").select("_rep", *axes, *up, *[x.alias(k) for x, k in zip(now, part)])
        fine = cut(fine.groupBy("_rep", *[f"_u{i}" for i in range(len(axes))], *part).agg(*_bounds(axes)))
        pairs = open_.select("_repa", "_repb", *[F.col(k + s).alias(f"_u{i}{s}") for i, k in enumerate(part) for s in "ab"])
        for s in "ab":
            under = ["_rep" + s, *[f"_u{i}{s}" for i in range(len(axes))]]
            pairs = pairs.join(fine.select(*[F.col(c).alias(c + s) for c in fine.columns]), under)


def _places(points: DataFrame, axes: list[str], ident: str, side: str) -> tuple[DataFrame, DataFrame]:
    """(place, rank, id): points by place, ranked by id from 1; and (place, axes, n): the different places."""
    rows = numbered(points.select(F.col(ident).alias("_id"), *[F.col(a).cast("double").alias(a) for a in axes]), [*axes, "_id"], "_g")
    places = cut(rows.groupBy(*axes).agg(F.min("_g").alias(f"place_{side}"), F.count("*").alias(f"n_{side}")))
    ranked = rows.join(places, axes).select(f"place_{side}", (F.col("_g") - F.col(f"place_{side}") + 1).alias(f"rank_{side}"), F.col("_id").alias(side))
    return cut(ranked), places.select(f"place_{side}", f"n_{side}", *[F.col(a).alias(f"{a}_{side}") for a in axes])


#: Points of the left side that one group of tied places matches in a round.
MOST_TIED = 1 << 17


def _tied_points(edges: DataFrame, rows_l: DataFrame, rows_r: DataFrame, left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(place_l, place_r, d, used_l, used_r, n = 1): what a group of tied places takes, all at one distance: of its first unused left points, by id, each
    takes the first unused right point of the places tied to its own. edges: component, place_l, place_r, d; left and right: place, used."""
    unused = lambda rows, side, s: rows.join(side.select(f"place_{s}", f"used_{s}"), f"place_{s}").filter(F.col(f"rank_{s}") > F.col(f"used_{s}")).drop(f"used_{s}")
    place = edges.select("component", "place_l").distinct()
    first = unused(rows_l, left, "l").join(place, "place_l").withColumn("_k", F.row_number().over(Window.partitionBy("component").orderBy("l"))).filter(F.col("_k") <= most)
    first = cut(first.select("component", "place_l", "rank_l", "l"))
    asking = first.groupBy("place_l").agg(F.count("*").alias("_n"))
    some = cut(edges.join(asking, "place_l"))
    need = some.groupBy("component", "place_r").agg(F.sum("_n").alias("_n")).join(right.select("place_r", F.col("used_r").alias("_u")), "place_r")
    last = rows_r.join(need, "place_r").filter((F.col("rank_r") > F.col("_u")) & (F.col("rank_r") <= F.col("_u") + F.col("_n"))).select("component", "place_r", "rank_r", "r")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    lines = (
        first.select("component", "place_l", none(last, "place_r"), F.col("rank_l").alias("rank"), F.col("l"), none(last, "r"), F.lit(None).cast("double").alias("d"))
        .unionByName(last.select("component", none(first, "place_l"), "place_r", F.col("rank_r").alias("rank"), none(first, "l"), "r", F.lit(None).cast("double").alias("d")))
        .unionByName(some.select("component", "place_l", "place_r", F.lit(None).cast("long").alias("rank"), none(first, "l"), none(last, "r"), "d"))
    )

    def take(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in ("place_l", "place_r", "rank", "l", "r", "d")}
        asks, queues, near, distance = [], {}, {}, None
        for pl, pr, rank, l, r, d in zip(*col.values()):
            if rank is None:
                near.setdefault(pl, []).append(pr)
                distance = d
            elif pr is None:
                asks.append((l, pl, rank))
            else:
                queues.setdefault(pr, []).append((r, rank))
        for q in queues.values():
            q.sort(key=lambda x: x[1], reverse=True)
        out = []
        for _, pl, rank in sorted(asks, key=lambda x: (x[0], x[2])):
            open_ = [p for p in near[pl] if queues.get(p)]
            if open_:
                pr = min(open_, key=lambda p: queues[p][-1])
                out.append((pl, pr, distance, rank - 1, queues[pr].pop()[1] - 1, 1))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [()] * len(TAKEN), TAKEN)], schema=TAKEN)

    return lines.groupBy("component").applyInArrow(take, "place_l long, place_r long, d double, used_l long, used_r long, n long")


TAKEN = pa.schema([("place_l", pa.int64()), ("place_r", pa.int64()), ("d", pa.float64()), ("used_l", pa.int64()), ("used_r", pa.int64()), ("n", pa.int64())])


def nearest_matching(left: DataFrame, right: DataFrame, axes: list[str], tolerance: float, ident: str = "id", most: int | None = None) -> DataFrame:
    """Greedy one-to-one matching of two sets of points: (l, r, d) in the order of (d, l, r) over all pairs within the tolerance, each side used once.

    No list of pairs is made. In each round every place with unused points asks for the nearest places of the other side that have some, and two that
    ask for each other are matched: the least of all pairs is such a pair, so every round brings one. Points of one place leave it by their
    id, so a place is its number of used points. Where neither of two places has another as near, all that both have are matched at once. Places that
    are tied, each as near to two or more, are matched together, in the order of their points' ids, unless one of them is as near to a place
    that first takes what is nearer to it: then they wait. A round takes `most` left points of such a group at most, the next ones the rest.
    """
    most = most or MOST_TIED
    (rows_l, l), (rows_r, r) = _places(left, axes, ident, "l"), _places(right, axes, ident, "r")
    w = wider(tolerance)
    l = l.withColumns({f"_lo{a}": F.col(f"{a}_l") - w for a in axes} | {f"_hi{a}": F.col(f"{a}_l") + w for a in axes})
    l, r = cut(l.withColumn("used_l", F.lit(0).cast("long"))), cut(r.withColumn("used_r", F.lit(0).cast("long")))
    plan = Plan(l, r, [], [(f"_lo{a}", f"_hi{a}") for a in axes], [(f"{a}_r", f"{a}_r") for a in axes], max(tolerance, 1e-3), MOST_PAIRS)
    distance = F.sqrt(sum(((F.col(f"{a}_l") - F.col(f"{a}_r")) ** 2 for a in axes), F.lit(0.0)))
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"place_{s}").alias("place")) for s in "lr"]))
    out = None
    while True:
        met = plan.pairs(l, r).withColumn("d", distance).filter(F.col("d") <= tolerance)
        least = cut(met.select(ends.alias("_e"), "d").groupBy("_e.side", "_e.place").agg(F.min("d").alias("m")))
        # a place without a partner in reach never has one again
        l, r = (cut(side.join(least.filter(F.col("side") == s).select(F.col("place").alias(f"place_{s}"), F.col("m").alias(f"m_{s}")), f"place_{s}")) for side, s in ((l, "l"), (r, "r")))
        near = plan.pairs(l, r).withColumn("d", distance).filter((F.col("d") <= tolerance) & ((F.col("d") == F.col("m_l")) | (F.col("d") == F.col("m_r"))))
        near = cut(near.select("place_l", "place_r", "d", "n_l", "n_r", "used_l", "used_r", "m_l", "m_r"))
        if near.isEmpty():
            break
        asked = near.select("*", ends.alias("_e")).filter(F.col("d") == F.when(F.col("_e.side") == "l", F.col("m_l")).otherwise(F.col("m_r")))
        asked = cut(asked.groupBy("_e.side", "_e.place").agg(F.count("*").alias("k"), F.bool_or(F.col("m_l") != F.col("m_r")).alias("waits")))
        each = lambda s: asked.filter(F.col("side") == s).select(F.col("place").alias(f"place_{s}"), F.col("k").alias(f"k_{s}"), F.col("waits").alias(f"waits_{s}"))  # noqa: E731, B023
        mutual = cut(near.filter(F.col("m_l") == F.col("m_r")).join(each("l"), "place_l").join(each("r"), "place_r"))
        alone = (F.col("k_l") == 1) & (F.col("k_r") == 1)
        taken = mutual.filter(alone).select("place_l", "place_r", "d", "used_l", "used_r", F.least(F.col("n_l") - F.col("used_l"), F.col("n_r") - F.col("used_r")).alias("n"))
        tied = mutual.filter(~alone).select("place_l", "place_r", "d", (F.col("waits_l") | F.col("waits_r")).alias("waits"))
        if not tied.isEmpty():
            found = components(tied.select((F.col("place_l") * 2).alias("a"), (F.col("place_r") * 2 + 1).alias("b")))
            tied = cut(tied.join(found.select(F.shiftright("node", 1).alias("place_l"), "component", (F.col("node") % 2).alias("_s")).filter("_s = 0").drop("_s"), "place_l"))
            ready = tied.groupBy("component").agg(F.bool_or("waits").alias("_w")).filter("not _w")
            taken = taken.unionByName(_tied_points(tied.join(ready.select("component"), "component").drop("waits"), rows_l, rows_r, l, r, most))
        taken = cut(taken)
        out = taken if out is None else out.unionByName(taken)
        sides = []
        for side, s in ((l, "l"), (r, "r")):
            now = side.drop(f"m_{s}").join(taken.groupBy(f"place_{s}").agg(F.sum("n").alias("n")), f"place_{s}", "left")
            sides.append(cut(now.withColumn(f"used_{s}", F.col(f"used_{s}") + F.coalesce("n", F.lit(0))).drop("n").filter(F.col(f"used_{s}") < F.col(f"n_{s}"))))
        l, r = sides
    if out is None:
        return rows_l.select("l").join(rows_r.select("r"), F.lit(False)).select("l", "r", F.lit(0.0).alias("d"))
    each = out.select("place_l", "place_r", "d", "used_l", "used_r", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    each = each.select("place_l", "place_r", "d", (F.col("used_l") + F.col("k")).alias("rank_l"), (F.col("used_r") + F.col("k")).alias("rank_r"))
    return each.join(rows_l, ["place_l", "rank_l"]).join(rows_r, ["place_r", "rank_r"]).select("l", "r", "d")
