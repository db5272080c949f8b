"""Summaries of saved terrain and the graph of worlds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNRESOLVED = 65535


def terrain_summary(terrain: DataFrame, worlds: DataFrame) -> DataFrame:
    """Records, distinct cells, bounds and bytes of each world, with its label; worlds that are not known are "unknown"."""
    n = F.coalesce(F.octet_length("data"), F.lit(0)).cast("long")
    g = terrain.groupBy("worldId").agg(
        F.count("*").alias("records"), F.countDistinct("x", "y").alias("cells"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.sum(n).alias("bytes"), F.min(n).alias("least_bytes"), F.max(n).alias("most_bytes"),
    )
    known = worlds.filter("reject_reason is null").select("worldId", "label", "kind", "world_depth")
    out = g.join(known, "worldId", "left").withColumn("records_per_cell", F.bround(F.col("records") / F.col("cells"), 3))
    return out.withColumns({"label": F.coalesce("label", F.lit("unknown")), "kind": F.coalesce("kind", F.lit("unknown"))})


def chunk_summary(voxels: DataFrame) -> DataFrame:
    """Of each world: decoded and rejected records, surplus records at one chunk, bounds; null bounds where nothing decoded."""
    ok = F.col("reject_reason").isNull()
    at = voxels.filter(ok).groupBy("worldId", "chunk_x", "chunk_y", "chunk_z").agg(F.count("*").alias("n"))
    dense = at.groupBy("worldId").agg(F.sum(F.col("n") - 1).alias("surplus"), *[f(c).alias(f"{a}_{c}") for c in ("chunk_x", "chunk_y", "chunk_z") for a, f in (("min", F.min), ("max", F.max))])
    return voxels.groupBy("worldId").agg(F.count_if(ok).alias("decoded"), F.count_if(~ok).alias("rejected")).join(dense, "worldId", "left")


def world_graph(portals: DataFrame, worlds: DataFrame, underground: bool = False) -> DataFrame:
    """Portals with the labels and kinds of the worlds at both ends."""
    known = worlds.filter("reject_reason is null")
    end = lambda s: known.select(F.col("worldId").alias(f"worldId{s}"), F.col("label").alias(f"label{s}"), F.col("kind").alias(f"kind{s}"))
    out = portals.join(end("A"), "worldIdA", "left").join(end("B"), "worldIdB", "left")
    for s in "AB":
        missing = F.when(F.col(f"worldId{s}") == UNRESOLVED, "unresolved").otherwise(F.concat(F.lit("World "), f"worldId{s}"))
        out = out.withColumns({f"label{s}": F.coalesce(f"label{s}", missing), f"kind{s}": F.coalesce(f"kind{s}", F.when(F.col(f"worldId{s}") == UNRESOLVED, "unresolved").otherwise("unknown"))})
    return out.filter("kindA = 'underground' or kindB = 'underground'") if underground else out


def chunk_details(voxels: DataFrame, top: int = 30) -> DataFrame:
    """(worldId, aspect, value, records): decoded chunks by height, size and first eight bytes, the most frequent of these, and rejected ones by
    reason; equal counts in the order of first ids. One pass counts them all."""
    ok = F.col("reject_reason").isNull()
    entry = lambda aspect, when, value: F.when(when, F.struct(F.lit(aspect).alias("aspect"), value.cast("string").alias("value")))
    options = [entry("chunk_z", ok, F.col("chunk_z")), entry("size", ok, F.col("size")), entry("prefix", ok, F.lower(F.hex(F.substring("payload", 1, 8)))), entry("reason", ~ok, F.col("reject_reason"))]
    e = voxels.select("worldId", "id", F.explode(F.array_compact(F.array(*options))).alias("e")).select("worldId", "id", "e.*")
    g = e.groupBy("worldId", "aspect", "value").agg(F.count("*").alias("records"), F.min("id").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("worldId", "aspect").orderBy(F.desc("records"), "_first", "value"))
    return g.withColumn("_rank", rank).filter((F.col("aspect") != "prefix") | (F.col("_rank") <= top)).drop("_first", "_rank")


def duplicate_chunks(voxels: DataFrame) -> DataFrame:
    """Of each world: chunks that several records share, and records too many there."""
    at = voxels.filter("reject_reason is null").groupBy("worldId", "chunk_x", "chunk_y", "chunk_z").agg(F.count("*").alias("n"))
    return at.groupBy("worldId").agg(F.count_if(F.col("n") > 1).alias("shared"), F.sum(F.col("n") - 1).alias("surplus"))


def reference_counts(portals: DataFrame, worlds: DataFrame) -> DataFrame:
    """One row: portals with both worlds known, with an unresolved side, and sides that name a world which is not saved."""
    known = worlds.filter("reject_reason is null").select("worldId", F.lit(True).alias("k")).distinct()
    p = portals.join(known.toDF("worldIdA", "ka"), "worldIdA", "left").join(known.toDF("worldIdB", "kb"), "worldIdB", "left")
    open_end = (F.col("worldIdA") == UNRESOLVED) | (F.col("worldIdB") == UNRESOLVED)
    lost = lambda s: (F.col(f"k{s.lower()}").isNull() & (F.col(f"worldId{s}") != UNRESOLVED)).cast("long")
    return p.agg(F.count("*").alias("portals"), F.count_if(F.col("ka") & F.col("kb")).alias("resolved"), F.count_if(open_end).alias("unresolved"), F.coalesce(F.sum(lost("A") + lost("B")), F.lit(0)).alias("missing_references"))


def portal_cells(portals: DataFrame) -> DataFrame:
    """(worldId, id, cell_x, cell_y, sides, other_world): the cells of each world that portals open in; both sides of one portal in one cell are one
    row, A/B, that leads to the world of its first side's other end."""
    side = lambda s, o: portals.filter(F.col(f"worldId{s}") != UNRESOLVED).select(F.col(f"worldId{s}").alias("worldId"), "id", F.col(f"x{s}").alias("cell_x"), F.col(f"y{s}").alias("cell_y"), F.lit(s).alias("side"), F.nullif(F.col(f"worldId{o}"), F.lit(UNRESOLVED)).alias("other"))
    both = side("A", "B").unionByName(side("B", "A"))
    g = both.groupBy("worldId", "id", "cell_x", "cell_y").agg(F.array_join(F.sort_array(F.collect_list("side")), "/").alias("sides"), F.min_by("other", "side").alias("other_world"))
    return g.filter("id is not null and cell_x is not null and cell_y is not null")


def grouped_cells(cells: DataFrame, pieces: DataFrame) -> DataFrame:
    """(worldId, cell_x, cell_y, portals, over_placement): cells with how many portals open there, and whether a saved piece lies in the cell."""
    g = cells.groupBy("worldId", "cell_x", "cell_y").agg(F.count("*").alias("portals"))
    there = pieces.select("worldId", "cell_x", "cell_y", F.lit(True).alias("_p")).distinct()
    return g.join(there, ["worldId", "cell_x", "cell_y"], "left").withColumn("over_placement", F.coalesce("_p", F.lit(False))).drop("_p")


def script_tally(scripts: DataFrame, top: int = 30) -> tuple[DataFrame, DataFrame]:
    """Script records by reject reason, and by the first four bytes of what they hold with the largest size."""
    reasons = scripts.groupBy(F.coalesce("reject_reason", F.lit("decoded")).alias("reason")).agg(F.count("*").alias("records"))
    return reasons, scripts.filter("reject_reason is null").groupBy("magic").agg(F.count("*").alias("records"), F.max("size").alias("largest")).orderBy(F.desc("records"), "magic").limit(top)


def ordered_worlds(worlds: DataFrame, kinds: list[str]) -> DataFrame:
    """Worlds in the order of their kinds as listed, then depth, none last, then id."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit(0)), F.lit(len(kinds) + 1))
    return worlds.orderBy(place, F.asc_nulls_last("world_depth"), "worldId")
