"""Decoders over DataFrames, in Arrow batches. What cannot be decoded is a row with its reason, never an error in an executor."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import codecs


#: Rows of a batch that a decoder sends on: a record may become a million.
BATCH = 4096


#: Rows and bytes of a batch that become Python objects at once.
SLICE, SLICE_BYTES = 256, 1 << 22


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts: Spark bounds a batch's rows, not what each of them holds or becomes."""
    for b in batches:
        n = max(1, min(SLICE, b.num_rows * SLICE_BYTES // max(1, b.nbytes)))
        yield from (b.slice(at, n) for at in range(0, b.num_rows, n))


def attempts(decode: Callable[..., Iterable[dict]], values: tuple, names: list[str]) -> Iterator[dict]:
    """What decode yields for the values, by the names and with reject_reason; where they are rejected a row that has the reason alone."""
    none = dict.fromkeys(names)
    try:
        if any(v is None for v in values):
            raise codecs.Reject("not_blob")
        for x in decode(*values):
            yield {n: x.get(n) for n in names} | {"reject_reason": None}
    except codecs.Reject as e:
        yield none | {"reject_reason": str(e)}
    except (ArithmeticError, LookupError, RecursionError, ValueError, struct.error) as e:
        yield none | {"reject_reason": f"error:{type(e).__name__}"}


def decoded(df: DataFrame, keep: list[str], fields: str, decode: Callable[..., Iterable[dict]], inputs: list[str]) -> DataFrame:
    """keep columns, what decode yields for the inputs of a row (null where it was rejected), reject_reason.

    A record that is rejected after it has yielded rows has these and the rejection. Any other error of a decoder is a rejection too: the bytes
    are not to be trusted, and one record must not end a task.
    """
    schema = StructType([*df.select(*keep).schema, *StructType.fromDDL(fields), *StructType.fromDDL("reject_reason string")])
    arrow, names = to_arrow_schema(schema), [f.name for f in StructType.fromDDL(fields)]

    def rows(b: pa.RecordBatch) -> Iterator[dict]:
        for r in b.to_pylist():
            for x in attempts(decode, tuple(r[c] for c in inputs), names):
                yield {k: r[k] for k in keep} | x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            some = rows(b)
            while out := [*itertools.islice(some, BATCH)]:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)


def one(f: Callable[..., dict]) -> Callable[..., Iterable[dict]]:
    return lambda *x: [f(*x)]


def worlds(generic: DataFrame, marker: bytes) -> DataFrame:
    """Worlds of the rows that carry the marker and flag 3, with kind, depth and label."""
    rows = generic.filter((F.col("uid") == F.lit(marker)) & (F.col("flags") == 3))
    w = decoded(rows, ["worldId"], "decoded_world int, seed long, filename string, classname string, terrain string", one(codecs.world), ["data"])
    kind = F.when(F.col("classname") == "Overworld", "overworld").when(F.col("classname") == "DungeonWorld", "dungeon").when(F.col("classname") == "WarehouseWorld", "warehouse").when(F.col("classname").startswith("UndergroundWorld"), "underground").otherwise("other")
    depth = F.expr("cast(try_cast(get_json_object(terrain, '$.depth') as double) as int)")
    path = F.coalesce(F.nullif(F.get_json_object("terrain", "$.path"), F.lit("")), F.get_json_object("terrain", "$.worldFilePath"))
    stem = F.nullif(F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]+?)(\.[^./]*)?$", 1), F.lit(""))
    name = F.when((kind == "underground") & depth.isNotNull() & stem.isNotNull(), F.concat(F.lit("D"), depth, F.lit(" "), stem)).otherwise(stem)
    index, level, most = (F.expr(f"cast(try_cast(get_json_object(terrain, '$.{k}') as double) as int)") for k in ("warehouseIndex", "level", "maxLevels"))
    house = F.concat(F.when(F.get_json_object("terrain", "$.isQuestWarehouse") == "true", "Quest Warehouse ").otherwise("Warehouse "), index, F.lit(" L"), level, F.coalesce(F.concat(F.lit("/"), most), F.lit("")))
    label = F.coalesce(F.when(kind == "warehouse", house), name, F.nullif("classname", F.lit("")), F.concat(F.lit("World "), F.col("worldId")))
    return w.withColumns({"kind": kind, "world_depth": depth, "label": label}).withColumn("reject_reason", F.when(F.col("decoded_world") != F.col("worldId"), "world mismatch").otherwise(F.col("reject_reason")))


def voxels(terrain: DataFrame) -> DataFrame:
    return decoded(terrain, ["id", "worldId", "x", "y"], "chunk_x int, chunk_y int, chunk_z int, size int, payload binary", one(codecs.voxel), ["id", "x", "y", "data"])


HEADER = ["prefix", "marker", "id", "flag_a", "x_a", "y_a", "world_a", "flag_b", "x_b", "y_b", "world_b"]
COLUMNS = {"id": "id", "world_a": "worldIdA", "x_a": "xA", "y_a": "yA", "world_b": "worldIdB", "x_b": "xB", "y_b": "yB"}


def portals(portal: DataFrame) -> DataFrame:
    """Decoded transforms. header_matches and matches are null where nothing could be read, else whether the header repeats the row's columns,
    and whether both sides lie where these say (a missing side B must be unresolved)."""
    side = "world_{0} int, position_{0} array<double>, rotation_{0} array<double>"
    keep = ["id", "worldIdA", "xA", "yA", "worldIdB", "xB", "yB"]
    head = "header struct<" + ", ".join(f"{n}: long" for n in HEADER) + ">"
    p = decoded(portal, keep, f"{head}, dimensions array<double>, {side.format('a')}, {side.format('b')}, tail_at int, tail_bits string", one(codecs.portal), ["data"])
    at = lambda s, k: F.floor(F.get(f"position_{s}", F.lit(k)) / 64)
    same = lambda s: (F.col(f"world_{s}") == F.col(f"worldId{s.upper()}")) & (at(s, 0) == F.col(f"x{s.upper()}")) & (at(s, 1) == F.col(f"y{s.upper()}"))
    absent = F.col("world_b").isNull() & (F.col("worldIdB") == 65535) & (F.col("xB") == 0) & (F.col("yB") == 0)
    p = p.withColumn("matches", F.when(F.col("reject_reason").isNull(), same("a") & F.when(F.col("world_b").isNull(), absent).otherwise(same("b"))))
    mirror = F.lit(True)
    for own, column in COLUMNS.items():
        mirror = mirror & F.col(f"header.{own}").eqNullSafe(F.col(column))
    return p.withColumn("header_matches", F.when(F.col("header").isNotNull(), mirror))


def opposite(portals: DataFrame, destination: int) -> DataFrame:
    """(id, position) of the side from which a portal leads to the world; only verified portals with two sides."""
    sure = portals.filter("matches and world_b is not null and world_a <> world_b")
    position = F.when(F.col("world_b") == destination, F.col("position_a")).when(F.col("world_a") == destination, F.col("position_b"))
    return sure.select("id", position.alias("position")).filter("position is not null")


def portal_floats(portal: DataFrame) -> DataFrame:
    return decoded(portal, ["id"], "offset int, hex string, value double, text string", codecs.aligned_floats, ["data"])


NODE = "node int, parent int, depth int, key_kind string, key_int long, key_str string, value_kind string, b boolean, i long, d double, s string, vector array<double>"


def lua_nodes(script: DataFrame, same_world: bool = False) -> DataFrame:
    """Every node of the values in ScriptData, in pre-order within a row; with same_world a row whose blob names another world is rejected."""

    def nodes(blob: bytes, world: int) -> Iterable[dict]:
        e = codecs.script_envelope(blob)
        if same_world and e["world_id"] != world:
            raise codecs.Reject("world mismatch")
        return codecs.lua_nodes(e["data"])

    return decoded(script, ["row_id", "worldId"], NODE, nodes, ["data", "worldId"])


def scripts(script: DataFrame) -> DataFrame:
    """The envelopes alone: unpacked size and the first four bytes."""
    return decoded(script, ["row_id", "worldId"], "size long, magic string", lambda blob: [{"size": len(d := codecs.script_envelope(blob)["data"]), "magic": d[:4].hex()}], ["data"])


CHUNK = "cell int, cell_x int, cell_y int, kind string, level int, count int, index int, packed int, full int, present boolean, in_file boolean"
OBJECT = "kind string, cell int, number int, x double, y double, z double, rotation array<double>, scale array<double>, uuid_hex string, tail_hex string"


#: Cells whose directories are read at once; each has 26 chunks.
CELLS = 1024


def tile_chunks(files: DataFrame) -> DataFrame:
    """files: path, content, as format "binaryFile" reads them. As decoded would with codecs.tile_chunks; the directories of many cells are read at once."""
    schema = StructType([*files.select("path").schema, *StructType.fromDDL(f"{CHUNK}, reject_reason string")])
    arrow = to_arrow_schema(schema)

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for path, data in zip(b.column("path"), b.column("content")):
            for r in attempts(codecs.tile_directories, (data.as_py(),), ["cell", "width", "ints", "size"]):
                yield path, *r.values()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = rows(b)
            while part := [*itertools.islice(some, CELLS)]:
                sound, bad = [r for r in part if r[5] is None], [r for r in part if r[5] is not None]
                if sound:
                    path, cell, width, ints, size, _ = zip(*sound)
                    columns = codecs.directory_columns(*map(np.array, (cell, width, ints, size)))
                    at = np.repeat(np.arange(len(path)), len(codecs.CHUNKS))
                    arrays = [pa.array(path, arrow[0].type).take(pa.array(at)), *[x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, [*arrow][1:-1])], pa.nulls(len(at), pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
                if bad:
                    none = [pa.nulls(len(bad), f.type) for f in [*arrow][1:-1]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in bad], arrow[0].type), *none, pa.array([r[5] for r in bad], pa.string())], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def tile_objects(files: DataFrame) -> DataFrame:
    return decoded(files, ["path"], OBJECT, codecs.tile_objects, ["content"])


TILE_NODE = "cell int, number int, x double, y double, z double, rotation array<double>, scale array<double>, parameters string"


def tile_nodes(files: DataFrame) -> DataFrame:
    return decoded(files, ["path"], TILE_NODE, codecs.tile_nodes, ["content"])


def tile_voxels(files: DataFrame) -> DataFrame:
    return decoded(files, ["path"], "cell int, number int, bx int, by int, bz int, data binary", codecs.tile_voxels, ["content"])


def tile_dump(files: DataFrame, kind: str) -> DataFrame:
    fields = "cell int, level int, size int, sha256 string, head string, tail string, texts array<string>, floats array<double>"
    return decoded(files, ["path"], fields, lambda data: codecs.tile_dump(data, kind), ["content"])


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Of each kind: present chunks, those outside the file, bytes packed and full."""
    here = chunks.filter("present")
    return here.groupBy("kind").agg(F.count("*").alias("chunks"), F.count_if(~F.col("in_file")).alias("outside"), F.sum(F.col("packed").cast("long")).alias("packed"), F.sum(F.col("full").cast("long")).alias("full"))


def byte_histogram(blocks: DataFrame, groups: list[str], data: str = "data") -> DataFrame:
    """(groups, value, count) of the bytes of a column; a batch's bytes are counted before they are rows."""
    keep = blocks.select(*groups, data)
    schema = StructType([*blocks.select(*groups).schema, *StructType.fromDDL("value int, n long")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.bincount(np.frombuffer(r[data] or b"", np.uint8), minlength=256)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pylist([{g: r[g] for g in groups} | {"value": int(v), "n": int(n[v])} for v in at], arrow)

    return keep.mapInArrow(run, schema).groupBy(*groups, "value").agg(F.sum("n").alias("count"))


def scanned(records: DataFrame, world: int, limit: int = 5000, order: str = "id") -> DataFrame:
    """The first records of a world, in order, that a command looks at."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be between 1 and 5000")
    return records.filter(F.col("worldId") == world).orderBy(order).limit(limit)


def reject_tally(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("reject_reason", F.lit("decoded")).alias("reason")).agg(F.count("*").alias("records"))
