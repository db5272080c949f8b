"""Profiles of payloads and values whose format is not known yet, and scans over hypotheses of how to read them."""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources import codecs
from ..sources.decode import slices


def unsigned(data: Column, at: Column, size: int, little: Column | None = None) -> Column:
    """An unsigned integer of so many bytes; null where the data end before it."""
    part = F.substring(data, at + 1, F.lit(size))
    big = F.conv(F.hex(part), 16, 10).cast("long")
    if little is not None:
        reverse = F.concat(*[F.substring(part, k, 1) for k in range(size, 0, -1)])
        big = F.when(little, F.conv(F.hex(reverse), 16, 10).cast("long")).otherwise(big)
    return F.when(F.octet_length(part) == size, big)


def signed(value: Column, size: int) -> Column:
    return F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)


def frames(voxels: DataFrame) -> DataFrame:
    """Decoded payloads with their frame: mode (the first byte), declared length, body; null where a payload is too short for one."""
    p = voxels.filter("reject_reason is null").withColumn("n", F.octet_length("payload"))
    long = F.col("n") >= 3
    return p.withColumns({"mode": F.when(long, F.lower(F.hex(F.substring("payload", 1, 1)))), "declared": F.when(long, unsigned(F.col("payload"), F.lit(1), 2)), "body": F.when(long, F.expr("substring(payload, 4)"))})


def payload_frames(voxels: DataFrame) -> DataFrame:
    """Of each mode: how many frames, least, greatest and mean size of their bodies, how many are as long as they say, how many hold one zero."""
    f = frames(voxels).withColumn("size", F.octet_length("body"))
    return f.filter("mode is not null").groupBy("mode").agg(F.count("*").alias("records"), F.min("size").alias("least"), F.max("size").alias("most"), F.bround(F.avg("size"), 2).alias("mean"), F.count_if(F.col("declared") == F.col("size")).alias("exact_frames"), F.count_if(F.hex("body") == "00").alias("single_zeros"))


def payload_profile(voxels: DataFrame, top: int = 40) -> DataFrame:
    """(aspect, value, records, least, most, mean, rank): payloads by size, by first byte, first two (as a number and as a group), first eight, by
    the whole of four, and by mode and first byte of the body; the most frequent of each, ties by the least id. One pass counts them all."""
    f = frames(voxels)
    h = lambda n: F.lower(F.hex(F.substring("payload", 1, n)))
    entry = lambda aspect, value: F.struct(F.lit(aspect).alias("aspect"), value.cast("string").alias("value"))
    n = F.col("n")
    own = [
        entry("size", n), entry("first_byte", F.when(n >= 1, h(1))), entry("first_u16", F.when(n >= 2, unsigned(F.col("payload"), F.lit(0), 2))), entry("group", F.when(n >= 2, h(2))), entry("prefix", F.when(n >= 1, h(8))),
        entry("four_bytes", F.when(n == 4, h(4))), entry("body_first_byte", F.when(F.octet_length("body") >= 1, F.concat_ws(":", "mode", F.lower(F.hex(F.substring("body", 1, 1)))))),
    ]
    e = f.select("id", "n", F.explode(F.array(*own)).alias("e")).select("id", "n", "e.*").filter("value is not null")
    g = e.groupBy("aspect", "value").agg(F.count("*").alias("records"), F.min("n").alias("least"), F.max("n").alias("most"), F.bround(F.avg("n"), 2).alias("mean"), F.min("id").alias("_first"))
    w = Window.partitionBy("aspect").orderBy(F.desc("records"), "_first", "value")
    return g.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= top) | (F.col("aspect") == "size")).drop("_first")


def diverse_examples(voxels: DataFrame, most: int = 20) -> DataFrame:
    """Ids of payloads to look at: the first of each different value of four bytes, then the smallest and the largest of each group of two first
    bytes, larger groups first."""
    f = frames(voxels).select("id", "n", F.hex("payload").alias("h"), F.hex(F.substring("payload", 1, 2)).alias("g"))
    four = f.filter("n = 4").groupBy("h").agg(F.min("id").alias("id")).select("id", F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.col("id").alias("c")).alias("order"))
    group = f.filter("n >= 2").groupBy("g").agg(F.count("*").alias("k"), F.min(F.struct("n", "id")).alias("lo"), F.max(F.struct("n", "id")).alias("hi"))
    ends = group.select(F.explode(F.array("lo.id", "hi.id")).alias("id"), F.struct(F.lit(1).alias("a"), (-F.col("k")).alias("b"), F.col("lo.id").alias("c")).alias("order"))
    return four.unionByName(ends).groupBy("id").agg(F.min("order").alias("order")).orderBy("order", "id").limit(most).select("id")


def find_bytes(data: Column, wanted: Column, size: int, end: int) -> Column:
    """Where the bytes are first found before the given place, null where they are not."""
    return F.get(F.filter(F.sequence(F.lit(0), F.lit(end - size)), lambda i: F.substring(data, i + 1, F.lit(size)) == wanted), F.lit(0))


def structure(records: DataFrame, marker: bytes = codecs.VOXEL_MAGIC, z: tuple[int, int] = codecs.VOXEL_Z) -> DataFrame:
    """records: id, x, y, data, packed as they are. Where the marker and the record's own id stand, whether minus one follows the id, and whether
    three integers after it are a chunk of the record's cell (exactly, or at most one beside it)."""
    ident = F.unhex(F.lpad(F.hex(F.col("id").cast("long")), 8, "0"))
    d = F.col("data")
    out = records.withColumns({"marker_at": find_bytes(d, F.lit(marker), len(marker), 16), "id_at": find_bytes(d, ident, 4, 32)})
    number = lambda k: signed(unsigned(d, F.col("id_at") + 16 + 4 * k, 4), 4)
    out = out.withColumns({"minus_one": F.coalesce(F.substring(d, F.col("id_at") + 5, F.lit(4)) == F.lit(b"\xff" * 4), F.lit(False)), "cx": number(0), "cy": number(1), "cz": number(2)})
    near = lambda by: F.col("cx").between(F.col("x") * 4 - by, F.col("x") * 4 + 3 + by) & F.col("cy").between(F.col("y") * 4 - by, F.col("y") * 4 + 3 + by) & F.col("cz").between(*z)
    return out.withColumns({"exact": F.coalesce(near(0), F.lit(False)), "boundary": F.coalesce(near(1), F.lit(False))})


def structure_profile(found: DataFrame) -> DataFrame:
    """One row of counts and the range of plausible heights."""
    n = lambda c, name: F.count_if(c).alias(name)
    return found.agg(F.count("*").alias("records"), n(F.col("marker_at").isNotNull(), "markers"), n(F.col("id_at").isNotNull(), "ids"), n(F.col("minus_one"), "minus_ones"), n(F.col("boundary"), "candidates"), n(F.col("exact"), "exact"), F.min(F.when(F.col("boundary"), F.col("cz"))).alias("least_z"), F.max(F.when(F.col("boundary"), F.col("cz"))).alias("most_z"))


def byte_affixes(df: DataFrame, group: str, data: str) -> DataFrame:
    """Bytes that all of a group's strings begin and end with; extremes of the strings and of their reverses are enough."""
    h = df.select(group, F.hex(data).alias("h")).withColumn("r", F.reverse("h"))
    g = h.groupBy(group).agg(*[f(c).alias(f"{c}{n}") for c in "hr" for n, f in (("0", F.min), ("1", F.max))], F.count("*").alias("records"))
    same = lambda a, b: F.floor(F.expr(f"size(filter(sequence(1, greatest(1, least(length({a}), length({b})))), i -> i <= length({a}) and i <= length({b}) and substring({a}, 1, i) = substring({b}, 1, i)))") / 2).cast("long")
    return g.select(group, "records", same("h0", "h1").alias("prefix"), same("r0", "r1").alias("suffix"))


def key_profile(nodes: DataFrame, most_depth: int = 4) -> DataFrame:
    """How often each key holds each kind of value, by depth."""
    key = F.coalesce(F.col("key_str"), F.when(F.col("key_kind").isNotNull(), F.concat(F.lit("#"), "key_kind")))
    return nodes.filter(F.col("reject_reason").isNull() & (F.col("depth") <= most_depth)).groupBy("depth", key.alias("key"), "value_kind").agg(F.count("*").alias("records"), F.countDistinct("row_id").alias("rows"))


def nested_signatures(nodes: DataFrame, most: int = 20) -> DataFrame:
    """(key, rank, signature, tables): of each key at the top of a value, the commonest signatures of the tables that its table holds. A signature is
    the table's string keys in order, or where it has none the kinds of its keys; of equally common ones the one that is met first in scan
    order, which the numbers of rows and nodes carry."""
    sound = nodes.filter("reject_reason is null")
    key = F.coalesce(F.when(F.col("key_kind").isin("string", "json"), F.col("key_str")), F.concat(F.lit("#"), "key_kind")).alias("key")
    tops = sound.filter("depth = 1 and value_kind = 'table'").select("row_id", F.col("node").alias("top"), key)
    tables = sound.filter("depth = 2 and value_kind = 'table'").select("row_id", F.col("parent").alias("top"), F.col("node").alias("table"))
    text = F.when(F.col("key_kind").isin("string", "json"), F.col("key_str"))
    held = sound.filter("depth = 3").groupBy("row_id", F.col("parent").alias("table")).agg(F.sort_array(F.collect_set(text)).alias("names"), F.sort_array(F.collect_set("key_kind")).alias("kinds"))
    kinds = F.concat(F.lit("<no string keys; "), F.coalesce(F.array_join("kinds", "/"), F.lit("")), F.lit(">"))
    found = tables.join(tops, ["row_id", "top"]).join(held, ["row_id", "table"], "left").withColumn("signature", F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise(kinds))
    counted = found.groupBy("key", "signature").agg(F.count("*").alias("tables"), F.min(F.struct("row_id", "table")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("tables"), "first")).cast("long")
    return counted.withColumn("rank", rank).filter(F.col("rank") <= most).select("key", "rank", "signature", "tables")


BLOCK = "offset int, packed int, sha256 string, dense long, materials array<long>"


#: Offsets of a record that are looked at together.
STRETCH = 1 << 16


def sound_starts(data: bytes, first: int, last: int, want: int) -> np.ndarray:
    """Of the offsets from first to before last those whose first sequence may begin a block of so many voxels: its literals are all of them, or a
    match follows that refers to them. All are judged at once, and only bytes that such a sequence can reach are read."""
    raw = np.frombuffer(data, np.uint8, min(len(data), last + want + want // 255 + 8) - first, first)
    end = len(raw)
    at = np.arange(last - first)
    n, after = (raw[: last - first] >> 4).astype(np.int64), at + 1
    long = np.flatnonzero(n == 15)
    if len(long):
        stop = np.append(np.minimum.accumulate(np.where(raw == 255, end, np.arange(end))[::-1])[::-1], end)[after[long]]
        n[long] = np.where(stop < end, 15 + 255 * (stop - after[long]) + raw[np.minimum(stop, end - 1)], want + 1)
        after[long] = stop + 1
    after = after + n
    back = [raw[np.minimum(after + k, end - 1)].astype(np.int64) for k in (0, 1)]
    back = back[0] | back[1] << 8
    return first + np.flatnonzero((n == want) & (after <= end) | (n < want) & (after + 2 <= end) & (0 < back) & (back <= n))


def block_starts(data: bytes, most: int | None = 96, want: int = 17**3) -> Iterator[dict]:
    """BLOCK for each offset, up to the given one where there is one, where a block begins that makes so many voxels, whatever follows it."""
    last = len(data) if most is None else min(most + 1, len(data))
    for first in range(0, last, STRETCH):
        for at in sound_starts(data, first, min(first + STRETCH, last), want).tolist():
            try:
                out, used = codecs.lz4_prefix(data, want, at)
            except codecs.Reject:
                continue
            v = np.frombuffer(out, np.uint8)
            yield {"offset": at, "packed": used, "sha256": hashlib.sha256(out).hexdigest(), "dense": int((v & 63 > 0).sum()), "materials": np.bincount(v >> 6, minlength=4).tolist()}


def lz4_starts(blobs: DataFrame, most: int | None = 96, want: int = 17**3) -> DataFrame:
    """(id, offset, packed, sha256, dense, materials) for each offset of a blob (id, data), none left out where most is None, where a block begins that
    makes so many voxels, whatever follows it: bytes it takes, digest, voxels whose low six bits are not zero, and how many have each value of the
    two high bits. Equal blobs of a part of a batch are searched once."""
    if most is not None and not 0 <= most <= 512:
        raise ValueError("most must be between 0 and 512, or None")
    schema = pa.schema([("id", pa.int64()), ("offset", pa.int32()), ("packed", pa.int32()), ("sha256", pa.string()), ("dense", pa.int64()), ("materials", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            blob = b.column("data").to_pylist()
            found = {data: [*block_starts(data or b"", most, want)] for data in set(blob)}
            yield pa.RecordBatch.from_pylist([{"id": i} | x for i, data in zip(b.column("id").to_pylist(), blob) for x in found[data]], schema)

    return blobs.select(F.col("id").cast("long").alias("id"), "data").mapInArrow(run, f"id long, {BLOCK}")


def summed(df: DataFrame, keys: str, counts: str, each: Callable[[pa.RecordBatch], Iterable[dict]], extremes: str = "") -> DataFrame:
    """Sums of what each says of a batch, by keys; a column named least_... or most_... is an extreme. What leaves a task is of the hypotheses' size."""
    ddl = ", ".join(filter(None, (keys, counts, extremes)))
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    names = lambda d: [x.split()[0] for x in d.split(", ")] if d else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([*each(b)], schema)

    worst = [(F.min if n.startswith("least") else F.max)(n).alias(n) for n in names(extremes)]
    return df.mapInArrow(run, ddl).groupBy(*names(keys)).agg(*[F.sum(n).alias(n) for n in names(counts)], *worst)


def layout_scan(records: DataFrame, offsets: range = range(8, 65), factors: tuple[int, ...] = (1, 2, 4, 8), z: tuple[int, int] = (-128, 128)) -> DataFrame:
    """Ranks every reading of three integers as coordinates: byte order, order of axes, chunks per cell, offset. records: x, y, data.

    A reading is exact for a record if its x and y fall into the record's cell; ranked by plausible z, exact, then the smaller offset. A batch of
    records is counted for all readings at once, so that only counts leave a task.
    """
    if not (0 <= offsets.start < offsets.stop <= 512 and z[0] <= z[1]):
        raise ValueError("the offsets or the heights are out of range")
    width = offsets.stop + 12

    def each(b: pa.RecordBatch) -> Iterator[dict]:
        own = [(x, y, d) for x, y, d in zip(*(b.column(c).to_pylist() for c in ("x", "y", "data"))) if d is not None]
        if not own:
            return
        cell = {"x": np.array([r[0] for r in own]), "y": np.array([r[1] for r in own])}
        size = np.array([len(r[2]) for r in own])
        raw = np.frombuffer(b"".join(r[2][:width].ljust(width, b"\0") for r in own), np.uint8).reshape(len(own), width)
        for little, dtype in ((False, ">i4"), (True, "<i4")):
            at = {p: np.ascontiguousarray(raw[:, p : p + 4]).view(dtype)[:, 0].astype(np.int64) for p in range(offsets.start, offsets.stop + 8)}
            for o in offsets:
                long = size >= o + 12
                for axes in itertools.permutations("xyz"):
                    v = {a: at[o + 4 * k] for k, a in enumerate(axes)}
                    for f in factors:
                        exact = long & (v["x"] // f == cell["x"]) & (v["y"] // f == cell["y"])
                        if exact.any():
                            yield {"little": little, "axes": "".join(axes), "factor": f, "offset": o, "exact": int(exact.sum()), "plausible": int((exact & (v["z"] >= z[0]) & (v["z"] <= z[1])).sum()), "records": len(own)}

    found = summed(records.select("x", "y", "data"), "little boolean, axes string, factor int, offset int", "exact long, plausible long, records long", each)
    return found.drop("records").orderBy(F.desc("plausible"), F.desc("exact"), "offset", "little", "axes", "factor")


def run_lengths(data: bytes, literal_first: bool, bias: int, want: int) -> bool:
    """Whether the data are exactly so many values in runs: a control byte's high bit tells runs from literals."""
    at, made = 0, 0
    while at < len(data):
        c = data[at]
        n = (c & 127) + bias
        at += 1
        if (c >= 128) == literal_first:
            at += n
        else:
            at += 1
        made += n
        if made > want or at > len(data):
            return False
    return made == want


def packbits(data: bytes, want: int) -> bool:
    """Whether the data are exactly so many values in PackBits: 128 does nothing, above it a value is repeated 257 - control times."""
    at, made = 0, 0
    while at < len(data):
        c = data[at]
        at += 1
        if c == 128:
            continue
        n = c + 1 if c < 128 else 257 - c
        at += n if c < 128 else 1
        made += n
        if made > want or at > len(data):
            return False
    return made == want


#: What a stored count stands for; None rejects a count of zero.
COUNTS = {
    "count": lambda n: n if n.all() else None,
    "count+1": lambda n: n + 1,
    "zero=256": lambda n: np.where(n == 0, 256, n),
}


def count_sum(data: bytes, width: int, at: int, dtype: str, counts: str, want: int) -> bool:
    """Whether the data are records of so many bytes, whose counts (of a type, at a place in the record) sum to so many values."""
    if not data or len(data) % width:
        return False
    n = np.ndarray(len(data) // width, dtype, data, at, (width,)).astype(np.int64)
    n = COUNTS[counts](n)
    return n is not None and int(n.sum()) == want


def codecs_of_runs() -> dict[tuple[str, bool | None, int | None], Callable[[bytes, int], bool]]:
    """By (codec, literal_first, bias), which are null but for runs by a high bit."""
    out = {}
    for order, first in (("count-value", True), ("value-count", False)):
        for c in COUNTS:
            out[f"rle8/{order}/{c}", None, None] = partial(count_sum, width=2, at=0 if first else 1, dtype="u1", counts=c)
        for short, dtype in (("be", ">u2"), ("le", "<u2")):
            for c in ("count", "count+1"):
                out[f"rle16{short}/{order}/{c}", None, None] = partial(count_sum, width=3, at=0 if first else 1, dtype=dtype, counts=c)
    for c in COUNTS:
        out[f"run-sum/{c}", None, None] = partial(count_sum, width=1, at=0, dtype="u1", counts=c)
    out["packbits", None, None] = packbits
    for literal_first, bias in itertools.product((False, True), (0, 1, 2, 3)):
        out[f"highbit/{int(not literal_first)}=repeat", literal_first, bias] = partial(run_lengths, literal_first=literal_first, bias=bias)
    return out


def codec_scan(voxels: DataFrame, want: int = 17**3, offsets: range = range(5), modes: tuple[int, ...] = (4, 5)) -> DataFrame:
    """(codec, literal_first, bias, framed, mode, offset, records): how many payloads each run-length codec explains to the last byte.

    Offsets count from the payload's start, or where framed from the body of a frame (mode, length of two bytes, body) that fits exactly. The
    mode is "all", or the first byte of the payloads counted. What explains no payload has no row.
    """
    schema = pa.schema([("codec", pa.string()), ("literal_first", pa.bool_()), ("bias", pa.int32()), ("framed", pa.bool_()), ("mode", pa.string()), ("offset", pa.int32())])
    models = codecs_of_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = []
            for data in filter(None, b.column("payload").to_pylist()):
                own = ["all"] + [f"{m:02x}" for m in modes if data[0] == m]
                starts = [(False, 0)] + [(True, 3)] * (len(data) >= 3 and int.from_bytes(data[1:3], "big") == len(data) - 3)
                for (framed, start), offset in itertools.product(starts, offsets):
                    rest = data[start + offset :]
                    hits += [(*model, framed, mode, offset) for model, fits in models.items() if fits(rest, want=want) for mode in own]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h)) for h in hits], schema)

    hits = voxels.filter("reject_reason is null").select("payload").mapInArrow(run, "codec string, literal_first boolean, bias int, framed boolean, mode string, offset int")
    return hits.groupBy(schema.names).agg(F.count("*").alias("records"))


MODES = [None, "04", "05"]


def bodies(voxels: DataFrame, exact: bool = True) -> DataFrame:
    """(mode, body) of frames, with exact only of those as long as they say."""
    f = frames(voxels).filter("mode is not null")
    return (f.filter(F.col("declared") == F.octet_length("body")) if exact else f).select("mode", "body")


def by_mode(b: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    own = [*zip(b.column("mode").to_pylist(), b.column("body").to_pylist())]
    for m in MODES:
        yield m or "all", [body for mode, body in own if m in (None, mode)]


def mask_scan(voxels: DataFrame, want: int = 17**3, offsets: range = range(9)) -> DataFrame:
    """(mode, offset, ones, bits, candidates, records): bodies of frames that are a mask of want bits followed by so many bits for each one (or
    zero) of the mask; candidates are long enough for the mask."""
    n = -(-want // 8)

    def each(b: pa.RecordBatch) -> Iterator[dict]:
        for mode, own in by_mode(b):
            for o in offsets:
                long = [x for x in own if len(x) >= o + n]
                ones = np.array([int(np.unpackbits(np.frombuffer(x, np.uint8, n, o))[:want].sum()) for x in long], np.int64)
                rest = np.array([len(x) - o - n for x in long], np.int64)
                for is_one, bits in itertools.product((True, False), range(1, 9)):
                    hits = -(-(ones if is_one else want - ones) * bits // 8) == rest
                    yield {"mode": mode, "offset": o, "ones": is_one, "bits": bits, "candidates": len(long), "records": int(hits.sum())}

    found = summed(bodies(voxels), "mode string, offset int, ones boolean, bits int", "candidates long, records long", each)
    return found.orderBy(F.desc("records"), F.desc("candidates"), "mode", "offset", F.desc("ones"), "bits")


def width_matches(voxels: DataFrame, want: int = 17**3, most: int = 8) -> DataFrame:
    """(mode, bits, exact, within): bodies as long as want values of so many bits, and those no longer than so many planes of one bit."""
    plane = -(-want // 8)
    b = bodies(voxels).withColumns({"n": F.octet_length("body"), "bits": F.explode(F.sequence(F.lit(1), F.lit(most)))})
    return b.groupBy("mode", "bits").agg(F.count_if(F.col("n") == F.ceil(F.col("bits") * want / 8)).alias("exact"), F.count_if(F.col("n") <= F.col("bits") * plane).alias("within"))


def parse_octree(body: bytes, depth: int, ones: bool) -> tuple[bool, int, int]:
    """Whether the bytes are exactly a tree of masks, one byte a node, each one (or zero) of which has a child, in pre-order; nodes and leaves."""
    at, leaves, open_at = 0, 0, [0]  # depths of nodes still to come, the next one last
    while open_at:
        d = open_at.pop()
        if at >= len(body):
            return False, at, leaves
        children = 0 if d >= depth else (body[at] if ones else ~body[at] & 255).bit_count()
        at += 1
        leaves += not children
        open_at += [d + 1] * children
    return at == len(body), at, leaves


def tree_scan(voxels: DataFrame, most_depth: int = 6) -> DataFrame:
    """(mode, depth, ones, records, nontrivial, exact, exact_nontrivial, extremes of nodes and leaves): bodies of frames that are octrees of masks;
    those of more than one byte are not trivial. Best first."""
    if not 1 <= most_depth <= 8:
        raise ValueError("the depth must be between 1 and 8")

    def each(b: pa.RecordBatch) -> Iterator[dict]:
        for mode, own in by_mode(b):
            for depth, ones in itertools.product(range(1, most_depth + 1), (True, False)):
                got = [(len(x) > 1, *parse_octree(x, depth, ones)) for x in own]
                hit = [g for g in got if g[1]]
                yield {
                    "mode": mode, "depth": depth, "ones": ones, "records": len(got), "nontrivial": sum(g[0] for g in got), "exact": len(hit), "exact_nontrivial": sum(g[0] for g in hit),
                    "least_nodes": min((g[2] for g in hit), default=None), "most_nodes": max((g[2] for g in hit), default=None), "least_leaves": min((g[3] for g in hit), default=None), "most_leaves": max((g[3] for g in hit), default=None),
                }

    found = summed(bodies(voxels, exact=False), "mode string, depth int, ones boolean", "records long, nontrivial long, exact long, exact_nontrivial long", each, "least_nodes int, most_nodes int, least_leaves int, most_leaves int")
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    return found.orderBy(F.desc(share("exact_nontrivial", "nontrivial")), F.desc(share("exact", "records")), F.desc("exact_nontrivial"), "mode", "depth", F.desc("ones"))


#: Where a face is looked at, along each of its axes, and bits of a density.
FACE, SIDE, DENSITY_BITS = tuple(range(0, 17, 2)), 17, 6


def neighbours(voxels: DataFrame) -> DataFrame:
    """(mode, axis, id, body, other): frames of equal modes whose chunks touch; of several records at one chunk the last counts as a neighbour."""
    f = frames(voxels).filter((F.col("mode").isin("04", "05")) & (F.col("declared") == F.octet_length("body"))).select("worldId", "id", "chunk_x", "chunk_y", "chunk_z", "mode", "body")
    last = f.groupBy("worldId", "chunk_x", "chunk_y", "chunk_z").agg(F.max_by(F.struct("mode", "body"), "id").alias("o"))
    step = lambda a: F.struct(F.lit(a).alias("axis"), *[(F.col(f"chunk_{c}") + int(c == a)).alias(f"chunk_{c}") for c in "xyz"])
    asked = f.select("worldId", "id", "mode", "body", F.explode(F.array(*map(step, "xyz"))).alias("s")).select("worldId", "id", "mode", "body", "s.*")
    met = asked.join(last, ["worldId", "chunk_x", "chunk_y", "chunk_z"]).filter(F.col("o.mode") == F.col("mode"))
    return met.select("mode", "axis", "id", "body", F.col("o.body").alias("other"))


def face_places(face: Iterable[int] = FACE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each axis the voxels on the far face of one chunk and on the near face of the next, at the given places along either of its axes; z is fastest,
    then y, then x."""
    at = lambda x, y, z: z + SIDE * y + SIDE * SIDE * x
    out = {}
    for k, axis in enumerate("xyz"):
        two = [*itertools.product(face, repeat=2)]
        full = lambda edge: np.array([at(*(p[:k] + (edge,) + p[k:])) for p in two])  # noqa: B023, E731
        out[axis] = full(SIDE - 1), full(0)
    return out


#: Pairs of different bodies that are read at once.
PAIRS = 256


class Streams:
    """Bodies as rows of bytes, with room for every place under every reading."""

    def __init__(self, bodies: list[bytes], most_byte: int):
        width = (SIDE**3 * DENSITY_BITS + 7) // 8 + most_byte + 2
        self.bits = np.array([[8 * len(x)] for x in bodies])
        self.raw = np.frombuffer(b"".join(x[:width].ljust(width, b"\0") for x in bodies), np.uint8).reshape(len(bodies), width)

    def densities(self, places: np.ndarray, start: int, order: str) -> np.ndarray:
        """Values of six bits at the places of each stream that begins at a bit; -1 where the stream ends before one does."""
        first = start + places * DENSITY_BITS
        one, two = (self.raw[:, first // 8 + k].astype(np.int64) for k in (0, 1))
        v = (one << 8 | two) >> 16 - DENSITY_BITS - first % 8 if order == "msb" else (one | two << 8) >> first % 8
        return np.where(first + DENSITY_BITS <= self.bits, v & (1 << DENSITY_BITS) - 1, -1)


SCORES = "face_pairs long, samples long, exact long, active long, active_exact long, observed long, observed_exact long, observed_active long, observed_active_exact long, error long, active_error long, observed_error long, observed_active_error long"


def density_scan(voxels: DataFrame, most_byte: int = 4, face: Iterable[int] = FACE) -> DataFrame:
    """Ranks readings of bodies as streams of six bits: by mode, byte and bit where they begin, order of bits, and what a voxel beyond the end
    counts as. Two touching faces of neighbours should be equal; active samples are not zero on both sides, observed ones lie in both streams. Faces are
    sampled at the given places along either axis: every second one, or all of range(SIDE)."""
    if not 0 <= most_byte <= 16:
        raise ValueError("the byte offset must be between 0 and 16")
    face = sorted({*face})
    if not face or not 0 <= face[0] <= face[-1] < SIDE:
        raise ValueError("the places of a face must be between 0 and 16")
    where = face_places(face)

    def each(b: pa.RecordBatch) -> Iterator[dict]:
        different: Counter = Counter()
        for part in slices([b]):
            different.update(zip(*(part.column(c).to_pylist() for c in ("mode", "axis", "body", "other"))))
        sums: dict = {}
        for (mode, axis), own in itertools.groupby(sorted(different.items()), lambda x: x[0][:2]):
            while some := [*itertools.islice(own, PAIRS)]:
                left, right = (Streams([x[0][k] for x in some], most_byte) for k in (2, 3))
                times = np.array([n for _, n in some])
                for byte, bit, order in itertools.product(range(most_byte + 1), range(DENSITY_BITS), ("msb", "lsb")):
                    a, c = left.densities(where[axis][0], byte * 8 + bit, order), right.densities(where[axis][1], byte * 8 + bit, order)
                    seen = (a >= 0) & (c >= 0)
                    for fill in (0, (1 << DENSITY_BITS) - 1):
                        l, r = np.where(a < 0, fill, a), np.where(c < 0, fill, c)
                        e, same, active = np.abs(l - r), l == r, (l != 0) | (r != 0)
                        both, every = seen & active, np.ones_like(seen)
                        got = [times.sum(), *[x.sum(1) @ times for x in (every, same, active, active & same, seen, seen & same, both, both & same, e, e * active, e * seen, e * both)]]
                        key = mode, byte, bit, order, fill
                        sums[key] = np.array(got) + sums.get(key, 0)
        for key, v in sums.items():
            yield dict(zip(("mode", "byte_offset", "bit_offset", "bit_order", "fill"), key)) | dict(zip((x.split()[0] for x in SCORES.split(", ")), v.tolist()))

    found = summed(neighbours(voxels).drop("id"), "mode string, byte_offset int, bit_offset int, bit_order string, fill int", SCORES, each)
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    return found.orderBy(F.desc(F.col("observed_active") >= 100), F.desc(share("observed_active_exact", "observed_active")), F.desc("observed_active"), F.desc(share("observed_exact", "observed")), "mode", "byte_offset", "bit_offset", "bit_order", "fill")
