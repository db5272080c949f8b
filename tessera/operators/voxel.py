"""Dense voxel volumes, a tile at a time: a group's blocks become one NumPy array, bounded by MOST_VOXELS, and results are rows again."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Voxels of a tile at most; a larger tile is an error, not a truncated result.
MOST_VOXELS = 4_000_000
BLOCK = 16


def volume(blocks: list[tuple[int, int, int, bytes]], dims: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(raw, written) of blocks (x, y, z in blocks, 16^3 bytes with z fastest, then y, then x); blocks may not overlap."""
    if math.prod(dims) > MOST_VOXELS:
        raise ValueError(f"{dims} is more than {MOST_VOXELS} voxels")
    raw, written = np.full(dims, 255, np.uint8), np.zeros(dims, bool)
    for bx, by, bz, data in blocks:
        at = tuple(slice(max(0, b * BLOCK), min(d, (b + 1) * BLOCK)) for b, d in zip((bx, by, bz), dims))
        inner = tuple(slice(s.start - b * BLOCK, s.stop - b * BLOCK) for s, b in zip(at, (bx, by, bz)))
        if any(s.stop <= s.start for s in at):
            continue
        if written[at].any():
            raise ValueError("blocks overlap")
        raw[at] = np.frombuffer(data, np.uint8).reshape(BLOCK, BLOCK, BLOCK)[inner]
        written[at] = True
    return raw, written


def components(inside: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """A label for each cell: 0 outside, else the component's number in order of its first cell. Without links, the six neighbours."""
    number = np.arange(inside.size).reshape(inside.shape)
    if links is None:
        links = []
        for axis in range(inside.ndim):
            a, b = np.moveaxis(inside, axis, 0)[:-1], np.moveaxis(inside, axis, 0)[1:]
            both, n = a & b, np.moveaxis(number, axis, 0)
            links.append((n[:-1][both], n[1:][both]))
    a, b = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, int) for k in (0, 1))
    label = np.arange(inside.size)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    label = np.where(inside.ravel(), label, -1)
    found, back = np.unique(label, return_inverse=True)
    return (back + (0 if len(found) and found[0] == -1 else 1)).reshape(inside.shape)


def feet(free: np.ndarray, written: np.ndarray, headroom: int) -> np.ndarray:
    """Where one can stand: a written solid below, so many free cells from here up."""
    ok = np.zeros(free.shape, bool)
    ok[:, :, 1:] = written[:, :, :-1] & ~free[:, :, :-1]
    for k in range(headroom):
        above = np.zeros(free.shape, bool)
        above[:, :, : free.shape[2] - k] = free[:, :, k:]
        ok &= above
    return ok


def steps(stand: np.ndarray, free: np.ndarray, headroom: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of standing cells one step apart: next to each other in x or y, at most so far up or down, free above the lower one."""
    number, out, height = np.arange(stand.size).reshape(stand.shape), [], stand.shape[2]
    for axis in (0, 1):
        s, f, n = (np.moveaxis(x, axis, 0) for x in (stand, free, number))
        for dz in range(-most, most + 1):
            lo, hi = max(0, -dz), min(height, height - dz)
            if lo >= hi:
                continue
            both = s[:-1, :, lo:hi] & s[1:, :, lo + dz : hi + dz]
            a, b = n[:-1, :, lo:hi][both], n[1:, :, lo + dz : hi + dz][both]
            if dz and len(a):  # the lower one must see the higher one's head
                low = a if dz > 0 else b
                flat, z = free.ravel(), low % height
                clear = np.ones(len(low), bool)
                for k in range(headroom + abs(dz)):
                    clear &= (z + k < height) & flat[np.minimum(low + k, flat.size - 1)]
                a, b = a[clear], b[clear]
            out.append((a, b))
    return out


def walk(links: list[tuple[np.ndarray, np.ndarray]], height: int, start: int, goal: int, minimax: bool = False, most_grade: float | None = None, level: np.ndarray | None = None) -> tuple[float, float, list[int]] | None:
    """(greatest grade, length, cells) of the shortest walk, or with minimax of the least steep and then shortest; None without one."""
    z = (lambda c: float(level[c])) if level is not None else (lambda c: float(c % height))
    near: dict[int, list[int]] = {}
    for a, b in links:
        for p, q in zip(a.tolist(), b.tolist()):
            near.setdefault(p, []).append(q)
            near.setdefault(q, []).append(p)
    best, before, queue = {start: (0.0, 0.0)}, {}, [((0.0, 0.0), start)]
    while queue:
        cost, cell = heapq.heappop(queue)
        if cost > best[cell]:
            continue
        if cell == goal:
            path = [cell]
            while path[-1] != start:
                path.append(before[path[-1]])
            grade = max((abs(z(p) - z(q)) for p, q in zip(path, path[1:])), default=0.0)
            return grade, cost[1], path[::-1]
        for other in near.get(cell, ()):
            dz = abs(z(other) - z(cell))
            if most_grade is not None and dz > most_grade:
                continue
            new = (max(cost[0], dz) if minimax else 0.0, cost[1] + math.hypot(1, dz))
            if other not in best or new < best[other]:
                best[other], before[other] = new, cell
                heapq.heappush(queue, (new, other))
    return None


def crossings(column: np.ndarray, written: np.ndarray, threshold: float) -> list[float]:
    """Heights at which a column passes from at or above the threshold to below it, interpolated; both ends must be written."""
    d = column.astype(float)
    at = np.flatnonzero(written[:-1] & written[1:] & (d[:-1] >= threshold) & (d[1:] < threshold))
    return [float(k + (d[k] - threshold) / (d[k] - d[k + 1])) for k in at]


def sample(raw: np.ndarray, written: np.ndarray, x: float, y: float, z: float) -> float | None:
    """Trilinear; a missing corner that counts makes the value missing, never zero."""
    total = 0.0
    base = [math.floor(c) for c in (x, y, z)]
    for corner in range(8):
        at, weight = [], 1.0
        for axis, c in enumerate((x, y, z)):
            up, part = corner >> axis & 1, c - base[axis]
            at.append(base[axis] + up)
            weight *= part if up else 1 - part
        if weight:
            if any(not 0 <= p < n for p, n in zip(at, raw.shape)) or not written[tuple(at)]:
                return None
            total += weight * float(raw[tuple(at)])
    return total


def once(blocks: DataFrame, other: DataFrame | None, solve: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """What solve(blocks, other) says of each tile, where tiles with the same blocks (by SHA-256) and the same rows of the other table are solved once, as
    the least of them, and the answer is joined to all. blocks: tile, bx, by, bz, data; the answer has a column tile and may depend on no tile's name."""
    # Digests are taken before rows are gathered: a group's lists fall back on sorting whole rows, which would hold and spill all voxels.
    hashed = blocks.select("tile", F.struct("bx", "by", "bz", F.sha2("data", 256).alias("data")).alias("_block"))
    parts = hashed.groupBy("tile").agg(F.sort_array(F.collect_list("_block")).alias("_blocks"))
    if other is not None:
        rows = other.groupBy(F.col("tile").alias("_tile")).agg(F.sort_array(F.collect_list(F.struct(*[c for c in other.columns if c != "tile"]))).alias("_rows"))
        parts = rows.join(parts, F.col("tile").eqNullSafe(F.col("_tile")), "left").select(F.col("_tile").alias("tile"), "_blocks", "_rows")
    case = cut(parts.select("tile", F.sha2(F.to_json(F.struct(*[c for c in parts.columns if c != "tile"])), 256).alias("_case")))
    first = cut(case.groupBy("_case").agg(F.min(F.struct("tile")).alias("_f")).select("_case", F.col("_f.tile").alias("_tile")))
    own = lambda df: df.join(first.select("_tile"), F.col("tile").eqNullSafe(F.col("_tile")), "left_semi")
    answer = solve(own(blocks), None if other is None else own(other))
    names = answer.columns
    answer = cut(answer.join(first, F.col("tile").eqNullSafe(F.col("_tile"))).drop("tile", "_tile"))
    return case.join(answer, "_case").select(*names)


COMPONENTS = pa.schema([("tile", pa.string()), ("component", pa.int32()), ("cells", pa.int64()), *[(f"{e}_{c}", pa.int32()) for e in ("min", "max") for c in "xyz"]])


def tile_components(blocks: DataFrame, dims: tuple[int, int, int], mask: int = 0xFF, threshold: int = 128, walkable: int | None = None, step: int = 1) -> DataFrame:
    """Connected void of each tile, or with walkable (the headroom) connected standing places. blocks: tile, bx, by, bz, data."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        raw, written = volume([*zip(*(table.column(c).to_pylist() for c in ("bx", "by", "bz", "data")))], dims)
        free = written & ((raw & mask) < threshold)
        if walkable is None:
            label = components(free)
        else:
            stand = feet(free, written, walkable)
            label = components(stand, steps(stand, free, walkable, step))
        at = np.argwhere(label > 0)
        own = label[label > 0]
        rows = []
        for k in range(1, int(label.max(initial=0)) + 1):
            p = at[own == k]
            rows.append((key[0].as_py(), k, len(p), *p.min(0).tolist(), *p.max(0).tolist()))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), COMPONENTS)], schema=COMPONENTS) if rows else COMPONENTS.empty_table()

    solve = lambda b, _: b.groupBy("tile").applyInArrow(run, "tile string, component int, cells long, min_x int, min_y int, min_z int, max_x int, max_y int, max_z int")
    return once(blocks.select("tile", "bx", "by", "bz", "data"), None, solve)
