"""What a batch becomes in Python: bounded parts of it, few steps for each record, rows spread over all cores."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from tessera.domain import probes
from tessera.functions import surface
from tessera.plans import saves
from tessera.sinks import formats as W
from tessera.sources import codecs, decode


def test_table_functions_hand_rows_over_without_a_frame_for_each_record():
    made = surface._table(decode.CHUNK, codecs.tile_chunks)
    assert made.evalType == PythonEvalType.SQL_TABLE_UDF


class Counted(bytes):
    reads = 0

    def __getitem__(self, k):
        Counted.reads += 1
        got = super().__getitem__(k)
        return Counted(got) if isinstance(k, slice) else got


def test_bytes_that_begin_no_block_are_left_at_once():
    block = W.lz4(bytes([195]) * 17**3)
    for data, want in ((bytes(4000), []), (b"\x01" * 4000, []), (b"\xff\xff" + block + b"tail", [(2, len(block))])):
        Counted.reads = 0
        assert [(r["offset"], r["packed"]) for r in probes.block_starts(Counted(data))] == want
        assert Counted.reads < 97 * 40
    with pytest.raises(codecs.Reject, match="lz4:bad offset"):
        codecs.lz4_prefix(b"\x10a\x02\x00\x00", 6)
    packed = pa.compress(b"abcd" * 50, codec="lz4_raw", asbytes=True)
    assert codecs.lz4_prefix(b"??" + packed + b"!", 200, 2) == (b"abcd" * 50, len(packed))


def test_a_batch_becomes_objects_in_bounded_parts():
    batch = pa.RecordBatch.from_pydict({"id": [*range(5000)], "data": [bytes(5000)] * 5000})
    parts = [*decode.slices([batch])]
    assert max(p.num_rows for p in parts) <= decode.SLICE and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    large = pa.RecordBatch.from_pydict({"data": [bytes(1 << 20)] * 20})
    assert max(p.num_rows for p in decode.slices([large])) <= 4 and sum(p.num_rows for p in decode.slices([large, batch, large.slice(0, 0)])) == 5020


def test_densities_of_many_bodies_are_read_at_once(spark):
    rng = random.Random(4)
    bodies = [rng.randbytes(n) for n in (0, 1, 3, 40, 900, 3685, 3686, 5000)]
    places, streams = np.array([0, 1, 2, 7, 50, 1199, 4900, 4912]), probes.Streams(bodies, 4)
    for start, order in itertools.product(range(38), ("msb", "lsb")):
        for body, got in zip(bodies, streams.densities(places, start, order)):
            bits = [byte >> (7 - k if order == "msb" else k) & 1 for byte in body for k in range(8)]
            for p, v in zip(places, got):
                own = bits[start + 6 * p : start + 6 * p + 6]
                assert v == (sum(x << (5 - k if order == "msb" else k) for k, x in enumerate(own)) if len(own) == 6 else -1)
    p = spark.range(1204).select("id", F.lit(1).alias("worldId"), F.lit(None).cast("string").alias("reject_reason"), F.floor(F.col("id") / 4).cast("int").alias("chunk_x"), F.lit(0).alias("chunk_y"), (F.col("id") % 4 * 9).cast("int").alias("chunk_z"))
    frame = lambda b: F.lit(b"\x04" + len(b).to_bytes(2, "big") + b)
    p = p.withColumn("payload", F.when(F.col("chunk_x") % 2 == 0, frame(bodies[4])).otherwise(frame(bodies[5])))
    many, one = (probes.density_scan(x, 0).drop("error").orderBy("bit_offset", "bit_order", "fill").collect() for x in (p, p.filter("chunk_x < 3 and chunk_z = 0")))
    assert len(many) == 24 and [r["face_pairs"] for r in one] == [2] * 24 and [r["face_pairs"] for r in many] == [1200] * 24
    assert all(a["samples"] == 600 * b["samples"] and a["exact"] == 600 * b["exact"] and a["active_error"] == 600 * b["active_error"] for a, b in zip(many, one))


def test_directories_of_many_cells_are_read_at_once(spark):
    cell = {"harvestable": (2, W.objects_body([(1.0, 2.0, 3.0)] * 2)), "voxel_terrain": (1, W.blocks_body([((0, 0, 1), bytes(4096))]))}
    whole = W.tile_of([{}, cell, cell, {}], 2)
    cells = [*codecs.tile_directories(whole)]
    got = codecs.directory_columns(*(np.array([c[k] for c in cells]) for k in ("cell", "width", "ints", "size")))
    assert [*zip(*(x.to_pylist() if isinstance(x, pa.Array) else x.tolist() for x in got))] == [tuple(r.values()) for r in codecs.tile_chunks(whole)]
    head = codecs.TILE_HEAD.size + 2 * codecs.CELL_INTS * 4  # two of four cells are there
    files = spark.createDataFrame([("t", whole), ("cut", whole[:head]), ("end", whole[:-9]), ("short", b"TILE"), ("none", None), (None, b"\0" * 99)], "path string, content binary")
    want = decode.decoded(files, ["path"], decode.CHUNK, codecs.tile_chunks, ["content"])
    found = decode.tile_chunks(files)
    assert found.schema == want.schema and sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == (4 + 2 + 4) * 26 + 4


def test_rows_that_become_records_are_dealt_out(spark):
    few = spark.range(100).coalesce(1)
    made = saves.records(few, lambda k: bytes([k]) * 10, ["id"])
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(r["id"], bytes(r["data"])) for r in made.collect()} == {(k, bytes([k]) * 10) for k in range(100)}


def test_records_of_a_batch_are_not_held_together(spark):
    def build(k):
        with open("/proc/self/statm") as f:
            return f.read().split()[1].encode().ljust(200_000)

    made = saves.records(spark.range(3000).coalesce(1), build, ["id"])
    pages = made.agg(F.max(F.expr("cast(trim(cast(substring(data, 1, 20) as string)) as long)"))).first()[0]
    assert pages * 4096 < 450e6


def test_tunnels_of_many_points_are_records_of_bounded_size(spark):
    """One user's points may be all of a table's: a record holds a part of them, and no step between parts is lost or counted twice."""
    sizes = [1, 2, 1000, 1001, 2500]
    points = [(user, e, float(e * 7 % 31)) for user, n in enumerate(sizes) for e in range(n)]
    events = spark.createDataFrame([(u, 10_000 * u + e, -e, v) for u, e, v in points], "user_id long, event_id long, ts long, value double").repartition(4)
    held = saves.tunnel_nodes(lambda _: events).groupBy("row_id").count().agg(F.max("count")).first()[0]
    assert held <= 1010
    got = {r["tunnel_id"]: r for r in saves.saved_tunnels(lambda _: events, spark).collect()}
    assert {u: r["points"] for u, r in got.items()} == {u: n for u, n in enumerate(sizes) if n > 1}
    for u, r in got.items():
        way = [(v, float(e % 100), float((10_000 * u + e) % 7)) for w, e, v in reversed(points) if w == u]
        assert abs(r["length"] - sum(math.dist(p, q) for p, q in zip(way, way[1:]))) < 0.002
        assert r["min_x"] == min(p[0] for p in way) and r["max_y"] == max(p[1] for p in way)
