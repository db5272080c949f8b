"""Voids of tiles and who could stand in them: sockets beside voids, air between places, gaps between floors, lines of sight, walks.

One tile's volume is one task's array, bounded by MOST_VOXELS; a row of the result is a socket, a pair or a step. None of it says that a game
lets a player pass.
"""

from __future__ import annotations

import itertools
import math
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.boxes import AXES
from ..operators.spatial import cells
from ..operators.voxel import components, feet, once, steps, volume, walk

MOST_EXPLORED = 250_000
SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))
# Why two floors are apart.
GAPS = ("step_exceeds_limit", "low_side_headroom_blocked", "unexplained_graph_disconnect")


def shifted(d: int, n: int) -> tuple[slice, slice]:
    """Of an axis of n cells, those that have a cell d further on, and these."""
    return slice(max(0, -d), max(0, n - max(0, d))), slice(max(0, d), max(0, n - max(0, -d)))


class Cavern:
    """A volume read with so many bits of density; free where written and under the threshold."""

    def __init__(self, blocks: list, dims: tuple[int, int, int], bits: int = 4, threshold: int | None = None, headroom: int = 2, step: int = 1):
        if bits not in (4, 5):
            raise ValueError("density has 4 or 5 bits")
        self.bits, self.threshold = bits, 1 << (bits - 1) if threshold is None else threshold
        if not 1 <= self.threshold <= (1 << bits) - 1:
            raise ValueError("the threshold is outside the densities")
        self.raw, self.written = volume(blocks, dims)
        self.dims, self.headroom, self.step = dims, headroom, step
        self.density = (self.raw & ((1 << bits) - 1)).astype(int)
        self.free = (self.raw != 255) & (self.density < self.threshold)

    def feet(self) -> np.ndarray:
        solid = self.raw != 255
        return feet(self.free, solid, self.headroom)

    def floors(self) -> tuple[np.ndarray, list]:
        stand = self.feet()
        links = steps(stand, self.free, self.headroom, self.step)
        return components(stand, links), links

    def inside(self, p) -> bool:
        return all(0 <= c < d for c, d in zip(p, self.dims))

    def nearest(self, point, allowed: np.ndarray, radius: float, tie: Callable[[np.ndarray], list[np.ndarray]]) -> tuple[float, tuple[int, int, int]] | None:
        """(squared distance, cell) of the cell with the nearest middle; equal distances by tie."""
        box = [slice(max(0, math.floor(c - radius)), min(d - 1, math.ceil(c + radius)) + 1) for c, d in zip(point, self.dims)]
        at = np.argwhere(allowed[tuple(box)]) + [s.start for s in box]
        if not len(at):
            return None
        d2 = ((at + 0.5 - np.array(point)) ** 2).sum(1)
        keep = d2 <= radius * radius
        at, d2 = at[keep], d2[keep]
        if not len(at):
            return None
        best = np.lexsort((*reversed(tie(at)), d2))[0]
        return float(d2[best]), tuple(int(c) for c in at[best])

    def near_component(self, point, label: np.ndarray, radius: float, least: int) -> tuple[int, float, tuple[int, int, int]] | None:
        """(component, distance, cell): the nearest cell of a component of so many cells; then the lower component, then the cell."""
        size = np.bincount(label.ravel())
        size[0] = 0
        got = self.nearest(point, size[label] >= least, radius, lambda at: [label[tuple(at.T)], *at.T])
        return None if got is None else (int(label[got[1]]), math.sqrt(got[0]), got[1])

    def near_foot(self, point, label: np.ndarray, radius: float, least: int) -> tuple[int, float, tuple[int, int, int]] | None:
        """As near_component, but of equal distances the cell decides."""
        size = np.bincount(label.ravel())
        size[0] = 0
        got = self.nearest(point, size[label] >= least, radius, lambda at: [*at.T])
        return None if got is None else (int(label[got[1]]), math.sqrt(got[0]), got[1])

    def near_air(self, point, radius: float = 2.5) -> tuple[float, tuple[int, int, int]] | None:
        got = self.nearest(point, self.free, radius, lambda at: [*at.T])
        return None if got is None else (math.sqrt(got[0]), got[1])

    def air_bridge(self, start, end, most: int = MOST_EXPLORED) -> dict:
        """The shortest way through free cells that share faces, and how much of it one could stand on."""
        if not (self.inside(start) and self.inside(end)):
            return {"status": "outside_tile"}
        for p, name in ((start, "start"), (end, "target")):
            if not self.free[tuple(p)]:
                return {"status": f"{name}_not_candidate_free"}
        before, queue, explored = {tuple(start): None}, deque([tuple(start)]), 0
        while queue:
            if explored >= most:
                return {"status": "search_limit", "explored": explored}
            p = queue.popleft()
            explored += 1
            if p == tuple(end):
                break
            for axis in range(3):
                for d in (-1, 1):
                    q = p[:axis] + (p[axis] + d,) + p[axis + 1 :]
                    if q not in before and self.inside(q) and self.free[q]:
                        before[q] = p
                        queue.append(q)
        if tuple(end) not in before:
            return {"status": "no_candidate_air_connection", "explored": explored}
        way = [tuple(end)]
        while before[way[-1]] is not None:
            way.append(before[way[-1]])
        way.reverse()
        stand, z = self.feet(), [p[2] for p in way]
        return {
            "status": "candidate_air_path_found", "steps": len(way) - 1, "with_foot": sum(bool(stand[p]) for p in way), "rises": sum(b > a for a, b in zip(z, z[1:])),
            "drops": sum(b < a for a, b in zip(z, z[1:])), "min_z": min(z), "max_z": max(z), "explored": explored,
        }

    def gap(self, label: np.ndarray, a: int, b: int) -> dict[str, int]:
        """Why floors a and b are not one: for each pair of neighbouring standing cells, the step or what is overhead."""
        reach, height = max(2, self.step), self.dims[2]
        shut = np.pad(~self.free, ((0, 0), (0, 0), (0, self.headroom + reach)), constant_values=True)
        over = [np.zeros(self.dims, bool)]  # over[m]: whether one of the m cells above the head of who stands here is shut
        for k in range(reach):
            over.append(over[-1] | shut[:, :, self.headroom + k : self.headroom + k + height])
        found = dict.fromkeys(GAPS, 0)
        for (dx, dy), dz in itertools.product(SIDES, range(-reach, reach + 1)):
            own, far = zip(*(shifted(d, n) for d, n in zip((dx, dy, dz), self.dims)))
            met = (label[own] == a) & (label[far] == b)
            n, low = int(met.sum()), own if dz > 0 else far
            if abs(dz) > self.step:
                found[GAPS[0]] += n
            else:
                blocked = int((met & over[abs(dz)][low]).sum())
                found[GAPS[1]] += blocked
                found[GAPS[2]] += n - blocked
        return {reason: n for reason, n in found.items() if n}

    def inward(self, point, count: int = 9) -> dict:
        """What lies straight in from the side of the tile that a point is nearest to."""
        x, y, z = point
        sides = ((x, "x-", (1, 0)), (self.dims[0] - x, "x+", (-1, 0)), (y, "y-", (0, 1)), (self.dims[1] - y, "y+", (0, -1)))
        _, face, (dx, dy) = min(sides, key=lambda s: s[0])
        base, first, again, seen = [math.floor(c) for c in point], None, False, 0
        for k in range(count):
            p = (base[0] + dx * k, base[1] + dy * k, base[2])
            if not self.inside(p):
                break
            seen += 1
            if self.free[p] and first is None:
                first = k
            elif not self.free[p] and first is not None:
                again = True
        return {"face": face, "first_open": first, "reblocked": again, "samples": seen}

    def sight(self, start, end, part: float = 0.25) -> str:
        """Whether the line between two cells' middles stays in free cells, looked at every quarter of a metre."""
        a, b = np.array(start) + 0.5, np.array(end) + 0.5
        n = max(1, math.ceil(float(np.sqrt(((b - a) ** 2).sum())) / part))
        for k in range(n + 1):
            p = tuple(int(c) for c in np.floor(a + (b - a) * (k / n)))
            if not self.inside(p):
                return "outside_tile"
            if not self.free[p]:
                return "candidate_solid_intersection"
        return "clear_centreline"

    def surface(self, p) -> float | None:
        """Where the density falls through the threshold between the cell below a foot and the foot."""
        x, y, z = p
        if not (self.inside(p) and z >= 1) or 255 in (self.raw[x, y, z - 1], self.raw[x, y, z]):
            return None
        d0, d1 = int(self.density[x, y, z - 1]), int(self.density[x, y, z])
        return z - 1 + (d0 - self.threshold) / (d0 - d1) if d0 >= self.threshold > d1 else None

    def profile(self, path: list[tuple[int, int, int]]) -> dict:
        """Heights along a walk between cells, its length and its grades; a step without a surface ends it."""
        h = []
        for k, p in enumerate(path):
            z = self.surface(p)
            if z is None:
                return {"status": "no_supported_vertical_density_crossing", "at": k}
            h.append(z)
        flat = [math.hypot(q[0] - p[0], q[1] - p[1]) for p, q in zip(path, path[1:])]
        if 0 in flat:
            return {"status": "nonhorizontal_path_edge", "at": flat.index(0)}
        rise = [b - a for a, b in zip(h, h[1:])]
        grade = [abs(r) / f for r, f in zip(rise, flat)]
        return {
            "status": "experimental_vertical_iso_interpolation", "heights": h, "length": sum(math.hypot(f, r) for f, r in zip(flat, rise)), "max_grade": max(grade, default=0.0),
            "mean_grade": sum(grade) / len(grade) if grade else 0.0, "steep": sum(g > 1 for g in grade), "over_half": sum(g > 0.5 for g in grade),
        }

    def edge_samples(self, a, b) -> list[dict]:
        """Places to measure along the edge between two neighbouring feet: three lanes of five."""
        dx, dy = b[0] - a[0], b[1] - a[1]
        if dx * dx + dy * dy != 1:
            raise ValueError("the cells are not neighbours")
        za, zb = self.surface(a), self.surface(b)
        if za is None or zb is None:
            raise ValueError("an end has no surface")
        return [{"lane": lane, "fraction": t / 4, "x": a[0] + 0.5 + t / 4 * dx - lane * dy, "y": a[1] + 0.5 + t / 4 * dy + lane * dx, "z": za + t / 4 * (zb - za)} for lane in (-0.5, 0.0, 0.5) for t in range(5)]


def by_tile(blocks: DataFrame, other: DataFrame, dims: tuple[int, int, int], ddl: str, each: Callable[[Cavern, pd.DataFrame], list[dict]], **how) -> DataFrame:
    """each over the cavern of a tile and the other table's rows of it; tiles without rows there are not read, equal ones once."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(key: tuple, b: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if not len(o):
            return pd.DataFrame(columns=names)
        c = Cavern([*zip(b.bx, b.by, b.bz, b.data)], dims, **how)
        rows = [{"tile": key[0]} | r for r in each(c, o)]
        return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    solve = lambda b, o: b.groupBy("tile").cogroup(o.groupBy("tile")).applyInPandas(run, ddl)
    return once(blocks.select("tile", "bx", "by", "bz", "data"), other, solve)


def socket_voids(blocks: DataFrame, sockets: DataFrame, dims: tuple[int, int, int], radius: float = 5.0, least: int = 100, **how) -> DataFrame:
    """(tile, socket, component, distance): of each socket (tile, socket, x, y, z) the void next to it, null where none of so many cells is near."""
    if not 0 < radius <= 32 or least < 1:
        raise ValueError("the radius is over 0 and at most 32, the least size at least 1")

    def each(c: Cavern, rows: pd.DataFrame) -> list[dict]:
        label = components(c.free)
        got = [(r.socket, c.near_component((r.x, r.y, r.z), label, radius, least)) for r in rows.itertuples()]
        return [{"socket": s, "component": g[0] if g else None, "distance": g[1] if g else None} for s, g in got]

    return by_tile(blocks, sockets.select("tile", "socket", "x", "y", "z"), dims, "tile string, socket string, component int, distance double", each, **how)


def socket_groups(found: DataFrame) -> DataFrame:
    """(tile, component, sockets): sockets that one void joins."""
    return found.filter("component is not null").groupBy("tile", "component").agg(F.array_sort(F.collect_list("socket")).alias("sockets"))


WALK = (
    "tile string, a string, b string, floor_a int, floor_b int, status string, cells int, length double, max_grade double, surface_length double, surface_max_grade double, "
    "air string, air_steps int, air_with_foot int, sight string, reasons map<string,int>"
)


def socket_walks(blocks: DataFrame, sockets: DataFrame, dims: tuple[int, int, int], radius: float = 5.0, least: int = 20, minimax: bool = False, most_grade: float | None = None, **how) -> DataFrame:
    """For each two sockets of a tile the walk between the floors next to them; where there is none, why, and whether air or sight joins them."""

    def each(c: Cavern, rows: pd.DataFrame) -> list[dict]:
        label, links = c.floors()
        at = sorted((r.socket, c.near_foot((r.x, r.y, r.z), label, radius, least)) for r in rows.itertuples())
        out, flat = [], lambda p: int(np.ravel_multi_index(p, c.dims))
        for k, (a, fa) in enumerate(at):
            for b, fb in at[k + 1 :]:
                r = {"a": a, "b": b, "floor_a": fa[0] if fa else None, "floor_b": fb[0] if fb else None, "status": "no_floor"}
                if fa and fb:
                    way = walk(links, c.dims[2], flat(fa[2]), flat(fb[2]), minimax, most_grade) if fa[0] == fb[0] else None
                    air = c.air_bridge(fa[2], fb[2])
                    r |= {"status": "walk" if way else "no_walk", "air": air["status"], "air_steps": air.get("steps"), "air_with_foot": air.get("with_foot"), "sight": c.sight(fa[2], fb[2])}
                    if way:
                        path = [tuple(int(x) for x in np.unravel_index(p, c.dims)) for p in way[2]]
                        prof = c.profile(path)
                        r |= {"cells": len(path), "max_grade": way[0], "length": way[1], "surface_length": prof.get("length"), "surface_max_grade": prof.get("max_grade")}
                    elif fa[0] != fb[0]:
                        r["reasons"] = c.gap(label, fa[0], fb[0])
                out.append(r)
        return out

    return by_tile(blocks, sockets.select("tile", "socket", "x", "y", "z"), dims, WALK, each, **how)


def socket_openings(blocks: DataFrame, sockets: DataFrame, dims: tuple[int, int, int], **how) -> DataFrame:
    """(tile, socket, face, first_open, reblocked, air, air_distance): what lies inward of each socket, and the free cell next to it."""

    def each(c: Cavern, rows: pd.DataFrame) -> list[dict]:
        out = []
        for r in rows.itertuples():
            i, near = c.inward((r.x, r.y, r.z)), c.near_air((r.x, r.y, r.z))
            out.append({"socket": r.socket, "face": i["face"], "first_open": i["first_open"], "reblocked": i["reblocked"], "air": list(near[1]) if near else None, "air_distance": near[0] if near else None})
        return out

    return by_tile(blocks, sockets.select("tile", "socket", "x", "y", "z"), dims, "tile string, socket string, face string, first_open int, reblocked boolean, air array<int>, air_distance double", each, **how)


def near_path(placements: DataFrame, path: DataFrame, radius: float = 5.0) -> DataFrame:
    """Placements (tile, placement, x, y, z) with a foot (tile, fx, fy, fz) of the path within the radius: (tile, placement, distance, foot), equal
    distances to the least foot."""
    if radius <= 0:
        raise ValueError("the radius must be positive")
    p, q = placements.select("tile", *AXES).distinct(), path.select("tile", *[F.col(f"f{c}") for c in AXES]).distinct()
    for c in "xy":
        p = p.withColumn(f"_{c}", cells(F.col(c) - radius, F.col(c) + radius, radius))
        q = q.withColumn(f"_{c}", F.floor((F.col(f"f{c}") + 0.5) / radius).cast("long"))
    d2 = sum(((F.col(f"f{c}") + 0.5 - F.col(c)) ** 2 for c in AXES), F.lit(0.0))
    met = p.join(q, ["tile", "_x", "_y"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    near = met.groupBy("tile", *AXES).agg(F.min(F.struct("d2", "fx", "fy", "fz")).alias("n"))
    best = placements.select("tile", "placement", *AXES).join(near, ["tile", *AXES]).groupBy("tile", "placement").agg(F.min("n").alias("n"))
    return best.select("tile", "placement", F.sqrt("n.d2").alias("distance"), F.struct("n.fx", "n.fy", "n.fz").alias("foot"))
