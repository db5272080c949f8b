"""What can be asked of a save, a tile or a log, by name: `python -m tessera COMMAND ...` prints each result's rows as JSON.

A command returns named DataFrames. It decodes no more than it needs; limits are checked before a plan is built.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .domain import caverns, fields, ground, layout, navigation, probes, regions, routes, terrain, topology, underground
from .operators import voxel
from .operators.boxes import canonical_point
from .operators.graph import cut
from .operators.spatial import face_contacts
from .sinks import svg
from .sources import decode, logs, savedb

COMMANDS: dict[str, Callable[..., dict[str, DataFrame]]] = {}
NO_TILES = "tile_uuid string, path string"


def command(f):
    COMMANDS[f.__name__.replace("_", "-")] = f
    return f


class Save:
    """The tables of one save, decoded when asked for. catalog: a table (tile_uuid, path), as Parquet, of tiles whose names are known."""

    def __init__(self, spark: SparkSession, path: str, marker: str = "", catalog: str | None = None):
        self.spark, self.path, self.marker = spark, path, bytes.fromhex(marker)
        self.tiles = spark.read.parquet(catalog) if catalog else spark.createDataFrame([], NO_TILES)

    def table(self, name: str) -> DataFrame:
        return savedb.read_table(self.spark, self.path, name)

    def worlds(self) -> DataFrame:
        return decode.worlds(self.table("GenericData"), self.marker)

    def voxels(self, world: int, limit: int = 5000) -> DataFrame:
        return cut(decode.voxels(decode.scanned(self.table("VoxelTerrain"), world, limit)))

    def portals(self) -> DataFrame:
        return decode.portals(self.table("Portal"))

    def nodes(self, world: int) -> DataFrame:
        """The values of the world's terrain row alone."""
        script = self.table("ScriptData").filter(F.col("worldId") == world)
        every = cut(decode.lua_nodes(script))
        return cut(every.join(underground.terrain_rows(every, script).select("row_id"), "row_id", "left_semi"))

    def layout(self, world: int) -> dict[str, DataFrame]:
        n = self.nodes(world)
        p, t = cut(underground.pieces(n)), cut(underground.tunnels(n))
        s, k = cut(layout.cave_structures(p, self.tiles)), cut(layout.pocket_structures(p.filter("kind = 'pocket'"), self.tiles))
        facts = layout.known(self.tiles).select("tile_uuid", "tile_w", "tile_d", "tile_h")
        nodes = cut(layout.layout_nodes(s, k).join(facts, "tile_uuid", "left"))
        lengths = cut(underground.tunnel_lengths(t))
        return {"values": n, "pieces": p, "tunnels": t, "structures": s, "pockets": k, "nodes": nodes, "lengths": lengths, "spawners": layout.spawners(n)}

    def topology(self, world: int) -> dict[str, DataFrame]:
        own = self.layout(world)
        return own | {"contacts": cut(face_contacts(own["nodes"].select(*topology.BOX))), "links": cut(routes.tunnel_links(own["tunnels"], own["lengths"], own["nodes"]))}


@command
def saves(spark, root: str, **o):
    return {"saves": savedb.discover(spark, root)}


@command
def inspect(spark, save: str, **o):
    counts, facts = savedb.inspect(spark, save)
    return {"tables": counts, "facts": spark.createDataFrame([(json.dumps(facts),)], "facts string")}


@command
def schema(spark, save: str, table: str, **o):
    return {"columns": spark.createDataFrame([(c[0], c[1], c[2], bool(c[3]), c[4], bool(c[5])) for c in savedb.columns(save, table)], "cid int, name string, type string, notnull boolean, `default` string, pk boolean")}


@command
def sample(spark, save: str, table: str, limit: int = 5, **o):
    return {"rows": savedb.preview(savedb.read_table(spark, save, table), limit, "row_id")}


@command
def worlds(spark, save: str, marker: str = "", **o):
    return {"worlds": terrain.ordered_worlds(Save(spark, save, marker).worlds(), ["overworld", "underground", "warehouse", "dungeon"])}


@command
def graph(spark, save: str, marker: str = "", underground: bool = False, **o):
    s = Save(spark, save, marker)
    p, w = cut(s.portals()), cut(s.worlds())
    return {"portals": terrain.world_graph(p, w, underground).drop("header"), "counts": terrain.reference_counts(p, w), "cells": terrain.portal_cells(p)}


@command
def portal_probe(spark, save: str, world: int | None = None, ident: int | None = None, **o):
    s = Save(spark, save)
    rows = s.table("Portal")
    if world is not None:
        rows = rows.filter((F.col("worldIdA") == world) | (F.col("worldIdB") == world))
    if ident is not None:
        rows = rows.filter(F.col("id") == ident)
    return {"portals": decode.portals(rows), "floats": decode.portal_floats(rows)}


@command
def portal_compare(spark, save: str, side: str = "a", **o):
    if side not in "ab":
        raise ValueError("side must be a or b")
    rows = Save(spark, save).table("Portal")
    return {"affixes": probes.byte_affixes(rows, f"worldId{side.upper()}", "data")}


@command
def terrain_summary(spark, save: str, marker: str = "", **o):
    s = Save(spark, save, marker)
    return {"worlds": terrain.terrain_summary(s.table("VoxelTerrain"), s.worlds())}


@command
def terrain_chunks(spark, save: str, world: int, limit: int = 5000, **o):
    v = Save(spark, save).voxels(world, limit)
    return {"summary": terrain.chunk_summary(v), "duplicates": terrain.duplicate_chunks(v), "details": terrain.chunk_details(v)}


@command
def terrain_payload(spark, save: str, world: int, limit: int = 1000, **o):
    v = Save(spark, save).voxels(world, limit)
    return {"frames": probes.payload_frames(v), "aspects": probes.payload_profile(v), "examples": probes.diverse_examples(v)}


@command
def terrain_probe(spark, save: str, world: int, limit: int = 100, **o):
    rows = decode.scanned(Save(spark, save).table("VoxelTerrain"), world, limit)
    return {"blocks": probes.lz4_starts(rows)}


@command
def terrain_structure(spark, save: str, world: int, limit: int = 500, **o):
    found = probes.structure(decode.scanned(Save(spark, save).table("VoxelTerrain"), world, limit))
    return {"profile": probes.structure_profile(found)}


@command
def terrain_layout(spark, save: str, world: int, limit: int = 1000, **o):
    return {"layouts": probes.layout_scan(decode.scanned(Save(spark, save).table("VoxelTerrain"), world, limit)).limit(25)}


@command
def terrain_codecs(spark, save: str, world: int, limit: int = 5000, **o):
    v = Save(spark, save).voxels(world, limit)
    return {"codecs": probes.codec_scan(v), "masks": probes.mask_scan(v), "widths": probes.width_matches(v), "trees": probes.tree_scan(v), "densities": probes.density_scan(v)}


@command
def terrain_map(spark, save: str, world: int, out: str, limit: int = 5000, **o):
    return written(spark, out, svg.chunk_map(Save(spark, save).voxels(world, limit)))


@command
def terrain_data(spark, save: str, world: int, **o):
    script = Save(spark, save).table("ScriptData").filter(F.col("worldId") == world)
    reasons, magic = terrain.script_tally(cut(decode.scripts(script)))
    nodes = cut(decode.lua_nodes(script))
    return {"reasons": reasons, "magic": magic, "rows": underground.terrain_rows(nodes, script), "keys": probes.key_profile(nodes.filter("reject_reason is null"))}


@command
def underground_tunnels(spark, save: str, world: int, **o):
    own = Save(spark, save).layout(world)
    return {"tunnels": own["lengths"].withColumn("role", regions.tunnel_role(F.col("tunnel_type"))), "bounds": layout.combined_bounds([own["tunnels"].select("worldId", *[F.col(c).alias(f"{c}{k}") for c in "xyz" for k in (0, 1)])])}


@command
def underground_map(spark, save: str, world: int, out: str, catalog: str | None = None, **o):
    own = Save(spark, save, catalog=catalog).layout(world)
    return written(spark, out, svg.combined_map(own["pieces"], own["tunnels"], own["spawners"], title=f"World {world}"))


@command
def underground_graph(spark, save: str, world: int, region: float = 4.0, endpoint: float = 6.0, **o):
    own = Save(spark, save).layout(world)
    nodes, edges = regions.region_graph(own["pieces"], topology.endpoints(own["tunnels"]), own["lengths"], own["spawners"], region, endpoint)
    nodes, edges = cut(nodes), cut(edges)
    return {"nodes": nodes, "edges": edges, "summary": regions.graph_summary(nodes, edges)}


@command
def underground_tiles(spark, save: str, world: int, catalog: str | None = None, top: int = 30, **o):
    s = Save(spark, save, catalog=catalog)
    used, by = layout.tile_usage(s.layout(world)["pieces"], s.tiles, top)
    return {"tiles": used, "by": by}


@command
def underground_layout(spark, save: str, world: int, catalog: str | None = None, **o):
    own = Save(spark, save, catalog=catalog).layout(world)
    return {"structures": own["structures"], "pockets": own["pockets"], "summary": layout.layout_summary(own["structures"], own["pockets"]), "search": layout.search_index(own["structures"], own["pockets"], own["pieces"], own["tunnels"])}


@command
def underground_topology(spark, save: str, world: int, catalog: str | None = None, **o):
    t = Save(spark, save, catalog=catalog).topology(world)
    flat, _ = navigation.transit(t["nodes"], t["contacts"], t["links"])
    full, _ = navigation.transit(t["nodes"], t["contacts"], t["links"], vertical=True)
    return {"nodes": t["nodes"], "contacts": t["contacts"], "links": t["links"], "horizontal": flat, "all_faces": full}


@command
def underground_portals(spark, save: str, world: int, catalog: str | None = None, attach: float = 4.0, **o):
    t = Save(spark, save, catalog=catalog).layout(world)
    seen = cut(navigation.observed(t["tunnels"], t["nodes"], attach))
    return {"portals": seen, "profile": navigation.portal_profile(seen), "rays": navigation.ray_buckets(seen)}


@command
def underground_navigation(spark, save: str, world: int, catalog: str | None = None, least: int = 2, step: float = 4.0, match: float = 4.1, **o):
    t = Save(spark, save, catalog=catalog).topology(world)
    templates = cut(navigation.learned(navigation.observed(t["tunnels"], t["nodes"]), least, step))
    pairs, counts = navigation.candidate_graph(t["contacts"], t["links"], navigation.placed(templates, t["nodes"]), match)
    rows = cut(navigation.diagnosed(t["contacts"], t["nodes"], templates))
    return {"templates": templates, "pairs": pairs, "counts": counts, "contacts": rows, "diagnosis": navigation.diagnosis_totals(rows)}


def planned_route(spark, save: str, world: int, catalog: str | None, vertical: bool, **target):
    s = Save(spark, save, catalog=catalog)
    t = s.topology(world)
    inside = navigation.start_portals(navigation.portals_inside(navigation.portal_ends(cut(s.portals()), world), t["nodes"]))
    g = routes.RouteGraph(t["nodes"], t["contacts"], t["links"], t["tunnels"], inside, vertical)
    start, _ = g.start()
    tree = g.tree(start)
    hit = g.target(tree, t["links"], **target)
    return t, g, cut(g.segments(tree, hit["anchor"]))


@command
def underground_route(spark, save: str, world: int, catalog: str | None = None, vertical: bool = False, node: int | None = None, tag: str | None = None, tunnel_type: str | None = None, **o):
    _, _, way = planned_route(spark, save, world, catalog, vertical, node=node, tag=tag, tunnel_type=tunnel_type)
    return {"segments": way, "report": routes.route_report(way)}


@command
def underground_route_map(spark, save: str, world: int, out: str, catalog: str | None = None, vertical: bool = False, node: int | None = None, tag: str | None = None, tunnel_type: str | None = None, **o):
    t, g, way = planned_route(spark, save, world, catalog, vertical, node=node, tag=tag, tunnel_type=tunnel_type)
    steps = way.select("step", F.col("a").alias("anchor")).unionByName(way.groupBy().agg((F.max("step") + 1).alias("step"), F.max_by("b", "step").alias("anchor")))
    return written(spark, out, svg.combined_map(t["pieces"], t["tunnels"], t["spawners"], steps.join(g.anchors, "anchor").select("step", "x", "y"), f"World {world}"))


def files(spark, tile: str) -> DataFrame:
    return spark.read.format("binaryFile").load(tile).select("path", "content")


@command
def tile_probe(spark, tile: str, **o):
    c = cut(decode.tile_chunks(files(spark, tile)))
    return {"chunks": c.filter("present"), "totals": decode.chunk_totals(c)}


@command
def tile_nodes(spark, tile: str, **o):
    return {"nodes": decode.tile_nodes(files(spark, tile))}


@command
def tile_voxel_probe(spark, tile: str, top: int = 16, **o):
    b = cut(decode.tile_voxels(files(spark, tile)).filter("reject_reason is null"))
    return {"bytes": decode.byte_histogram(b, []).orderBy(F.desc("count"), F.desc("value")).limit(top), "blocks": b.select("path", "cell", "number", "bx", "by", "bz", F.sha2("data", 256).alias("sha256"))}


@command
def tile_chunk_probe(spark, tile: str, kind: str, **o):
    return {"chunks": decode.tile_dump(files(spark, tile), kind)}


@command
def tile_object_probe(spark, tile: str, **o):
    b = cut(decode.tile_objects(files(spark, tile)))
    return {"objects": b, "counts": b.filter("reject_reason is null").rollup("kind", "uuid_hex").agg(F.count("*").alias("objects"))}


def tile_blocks(spark, tile: str) -> tuple[DataFrame, DataFrame, tuple[int, int, int]]:
    """Blocks and sockets of a tile whose name says its size in chunks."""
    facts = topology.tile_facts(spark.createDataFrame([(tile,)], "path string")).first()
    if facts["tile_w"] is None:
        raise ValueError("the tile's name does not say its size")
    b = decode.tile_voxels(files(spark, tile)).filter("reject_reason is null").select(F.col("path").alias("tile"), "bx", "by", "bz", "data")
    s = decode.tile_nodes(files(spark, tile)).filter("reject_reason is null").select(F.col("path").alias("tile"), F.concat(F.lit("cell"), "cell", F.lit(":node"), "number").alias("socket"), "x", "y", "z")
    return cut(b), cut(s), tuple(16 * facts[c] for c in ("tile_w", "tile_d", "tile_h"))


@command
def tile_voxel_space(spark, tile: str, bits: int = 4, radius: float = 5.0, least: int = 100, **o):
    b, s, dims = tile_blocks(spark, tile)
    found = cut(caverns.socket_voids(b, s, dims, radius, least, bits=bits))
    return {"components": voxel.tile_components(b, dims, (1 << bits) - 1, 1 << (bits - 1)).filter(F.col("cells") >= least).orderBy(F.desc("cells")), "sockets": found, "groups": caverns.socket_groups(found)}


@command
def tile_voxel_walk(spark, tile: str, bits: int = 4, radius: float = 5.0, headroom: int = 2, climb: int = 1, minimax: bool = False, **o):
    b, s, dims = tile_blocks(spark, tile)
    how = {"bits": bits, "headroom": headroom, "step": climb}
    return {"walks": caverns.socket_walks(b, s, dims, radius, minimax=minimax, **how), "openings": caverns.socket_openings(b, s, dims, **how)}


@command
def tile_ground_extract(spark, plan: str, logs_dir: str, mark: str, out: str | None = None, **o):
    """The newest run of a plan; mark begins a record's line ("X" for "X,..." and "X_META,...")."""
    world, samples = logs.checked_plan(document(plan))
    run = logs.newest_run(spark, logs_dir, world, len(samples), f"{mark}_META,", f"{mark},")
    if out:
        logs.write_run(run, out, f"{mark},")
    return {"records": run}


def compared(spark, plan: str, log: str, mark: str) -> DataFrame:
    """A plan's samples beside the records of one run."""
    rows = logs.parsed(logs.read_lines(spark, log), f"{mark}_META,", f"{mark},").filter("not is_marker")
    return cut(ground.compare(logs.plan_rows(spark, document(plan)), rows))


@command
def tile_ground_compare(spark, plan: str, log: str, mark: str, **o):
    c = compared(spark, plan, log, mark)
    return {"samples": c, "grades": ground.grades(c), "rise": ground.end_to_end(c), "across": ground.cross_grades(c)}


def measured(spark, plan: str, log: str, mark: str, tile: str) -> tuple[DataFrame, DataFrame, DataFrame, tuple[int, int, int]]:
    """A tile's blocks, and the hits of a run in its coordinates, turned back as the plan's placement says."""
    p, (b, _, dims) = document(plan), tile_blocks(spark, tile)
    lo, turn = p["world_bounds"]["min"], int(p["layout_rotation_quarter_turns"])
    if list(dims) != list(p["tile_dimensions_m"]):
        raise ValueError("the tile is not as large as the plan says")
    c = compared(spark, plan, log, mark)
    x, y = canonical_point(F.col("x") - lo[0], F.col("y") - lo[1], F.lit(float(dims[0])), F.lit(float(dims[1])), F.lit(turn))
    name = b.select("tile").limit(1).first()["tile"]
    s = c.filter("status = 'hit'").select(F.lit(name).alias("tile"), "index", "lane", x.alias("x"), y.alias("y"), (F.col("z") - lo[2]).alias("z"), (F.col("plan_predicted_z") - lo[2]).alias("predicted_z"), "nx", "ny", "nz", F.lit(turn).alias("rotation"), F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("z").alias("wz"))
    return b, cut(s), c, dims


@command
def tile_ground_audit(spark, plan: str, log: str, mark: str, tile: str, six_bits: bool = False, radius: int = 1, margin: int = 3, **o):
    """All audits of one run: hypotheses and their hold-out, densities, normals, slopes, bytes, columns, planes."""
    b, s, c, dims = measured(spark, plan, log, mark, tile)
    read = cut(fields.readings(b, s, dims, six_bits))
    models = fields.held_out_models(read)
    columns = fields.nearby_columns(s, dims, radius)
    pairs = {shift: cut(fields.byte_pairs(b, columns, dims, shift)) for shift in (0.0, 0.5)}
    whole = {k: p.filter("status = 'recorded_pair'") for k, p in pairs.items()}
    hits = s.select("index", "lane", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"), "nx", "ny", "nz")
    planned = c.select("index", F.col("plan_x").alias("x"), F.col("plan_y").alias("y"), "fraction")
    facets = cut(ground.facets(hits))
    return {
        "hypotheses": fields.hypothesis_scores(read), "held_out": ground.held_out(models, c.filter("status <> 'foreign'").select("lane", "index")), "isovalues": fields.isovalue_spread(read), "normals": fields.normal_scores(read), "slopes": ground.slope_scores(models, planned),
        "tangents": ground.tangent_held_out(hits), "facets": ground.facet_evidence(hits, facets), "profile": fields.density_profile(b, s, dims, margin),
        **{f"bits_{k}": fields.bit_transitions(p) for k, p in whole.items()}, **{f"midpoints_{k}": fields.midpoint_checks(p) for k, p in whole.items()}, **{f"pairs_{k}": fields.common_pairs(p) for k, p in whole.items()},
    }


@command
def tile_ground_grid_plan(spark, plan: str, log: str, mark: str, tile: str, out: str, size: int = 5, **o):
    _, s, _, dims = measured(spark, plan, log, mark, tile)
    p = document(plan)
    grid = cut(fields.expanded_plan(s, dims, int(p["layout_rotation_quarter_turns"]), size))
    written(spark, out, json.dumps(p | {"critical_edge": fields.plan_document(p["world_id"], grid)["critical_edge"]}))
    return {"grid": grid}


def document(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def written(spark, out: str, text: str) -> dict[str, DataFrame]:
    """The text in a file of the driver, which must not be there yet."""
    with open(out, "x", encoding="utf-8") as f:
        f.write(text)
    return {"written": spark.createDataFrame([(os.path.abspath(out), len(text))], "path string, characters int")}
