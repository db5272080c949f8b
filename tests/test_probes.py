import random
import struct
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import fixtures as X
from pyspark.sql import functions as F

from tessera.domain import probes as P
from tessera.plans import measurements
from tessera.sources import codecs


def voxels(spark, payloads):
    return spark.createDataFrame([(k, bytearray(p), None) for k, p in enumerate(payloads)], "id int, payload binary, reject_reason string")


def test_payload_profiles(spark):
    df = voxels(spark, [b"\x04\x00\x02ab", b"\x04\x00\x09a", b"\x00", b"\x01\x02\x03\x04", b"\x01\x02\x03\x04", b"\x09\x02\x03\x04"])
    got = {r["mode"]: r for r in P.payload_frames(df).collect()}
    assert (got["04"]["records"], got["04"]["exact_frames"], got["04"]["mean"], "00" in got) == (2, 1, 1.5, False)
    four = P.payload_profile(df, 2).filter("aspect = 'four_bytes'").orderBy("rank").collect()
    assert [(r["value"], r["records"]) for r in four] == [("01020304", 2), ("04000961", 1)]
    assert [r["id"] for r in P.diverse_examples(df, 4).collect()] == [1, 3, 5, 0]
    df = spark.createDataFrame([(1, bytearray(b"abXcd")), (1, bytearray(b"abYYcd")), (2, bytearray(b"q"))], "g int, d binary")
    assert {r["g"]: (r["prefix"], r["suffix"]) for r in P.byte_affixes(df, "g", "d").collect()} == {1: (2, 2), 2: (1, 1)}


def test_lz4_starts(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff" + X.lz4(b"\x41\x80zzz") + b"more")), (2, None)], "id int, data binary")
    got = {(r["id"], r["offset"]): r for r in P.lz4_starts(df, want=5).collect()}
    assert (got[1, 3]["packed"], got[1, 3]["dense"], got[1, 3]["materials"]) == (6, 4, [0, 4, 1, 0])


def test_lz4_starts_at_every_offset(spark):
    """Blocks after the first 512 bytes, and across stretches, are found; what begins none is left out as by trying each offset."""
    block = X.lz4(b"\x41\x80zzz")
    df = spark.createDataFrame([(1, bytearray(b"\xff" * 700 + block + b"more")), (2, bytearray(bytes(P.STRETCH - 3) + block)), (3, bytearray(b"")), (4, None)], "id int, data binary")
    assert [tuple(r) for r in P.lz4_starts(df, None, 5).select("id", "offset", "packed").orderBy("id", "offset").collect()] == [(1, 700, 6), (2, P.STRETCH - 3, 6)]
    rng, lz = random.Random(7), lambda n: bytes(rng.choice([0, 1, 2, 3, 16, 31, 79, 240, 255, 255]) for _ in range(n))
    for want in (5, 20, 300, 700):
        for n in (0, 1, 2, 60, 900):
            data, plain = lz(n), []
            data += X.lz4(bytes(want)) + lz(n % 7)
            for at in range(len(data)):
                try:
                    plain.append((at, codecs.lz4_prefix(data, want, at)[1]))
                except codecs.Reject:
                    pass
            assert plain and [(r["offset"], r["packed"]) for r in P.block_starts(data, None, want)] == plain


def test_the_planted_blocks_are_searched_whole(spark, monkeypatch):
    seen, own = [], P.lz4_starts
    monkeypatch.setattr(P, "lz4_starts", lambda blobs, *a: seen.append(a) or own(blobs, *a))
    table = lambda name: spark.range(8).select(F.col("id").alias("event_id"))
    got = measurements.block_candidates(table, spark).orderBy("id").collect()
    assert seen == [(None,)] and [tuple(r) for r in got] == [(k, 0, 2, 4913 if k else 0) for k in range(4)]


def test_the_planted_layout_ranks_first(spark):
    rows = [(x, y, bytearray(bytes(10) + struct.pack("<iii", z, y * 4 + 1, x * 4 + 2) + bytes(30))) for x, y, z in ((1, -3, 5), (7, 2, -9), (-4, 6, 60), (3, 9, 1))]
    best = P.layout_scan(spark.createDataFrame(rows, "x int, y int, data binary"), range(8, 16), (2, 4)).first()
    assert (best["little"], best["axes"], best["factor"], best["offset"], best["exact"], best["plausible"]) == (True, "zyx", 4, 10, 4, 4)


def test_codec_and_mask_scans(spark):
    runs = bytes([0x80 | 9, 7, 0x80 | 4, 1]) + bytes([5]) + b"abcdef"  # 10 + 5 values in runs, 6 literals
    got = {(r["literal_first"], r["bias"], r["offset"]): r["records"] for r in P.codec_scan(voxels(spark, [b"\x04" + runs, runs]), want=21).collect()}
    assert got[False, 1, 0] == 1 and got[False, 1, 1] == 1
    body = b"\x00" + bytes([0b10110000, 0b00000001, 0]) + b"xy"  # four ones of four bits after a byte
    got = {(r["mode"], r["offset"], r["ones"], r["bits"]): r["records"] for r in P.mask_scan(voxels(spark, [b"\x04\x00\x06" + body]), want=24).collect()}
    assert got["04", 1, True, 4] == got["all", 1, True, 4] == 1 and got["all", 1, True, 5] == 0
    assert P.mask_scan(voxels(spark, [b"\x04\x00\x06" + body]), want=24).first()["records"] == 1
    got = {r["bits"]: (r["exact"], r["within"]) for r in P.width_matches(voxels(spark, [b"\x04\x00\x06" + body]), want=24, most=3).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (0, 1)}


def plain_tree(body, depth, ones):
    """By recursion, as the format reads."""
    at = 0

    def node(d):
        nonlocal at
        if at >= len(body):
            return False
        mask = body[at] if ones else ~body[at] & 255
        at += 1
        return d >= depth or all([node(d + 1) for _ in range(bin(mask).count("1"))])

    return node(0) and at == len(body)


def test_octrees(spark):
    rng = random.Random(4)
    for _ in range(300):
        body = bytes(rng.choice([0, 1, 3, 255, 254, 128]) for _ in range(rng.randrange(0, 8)))
        for depth in (1, 2, 3):
            for ones in (True, False):
                assert P.parse_octree(body, depth, ones)[0] == plain_tree(body, depth, ones)
    best = P.tree_scan(voxels(spark, [b"\x04\x00\x03\x03\x00\x00", b"\x05\x00\x02\x01\x00"]), 3).first()
    assert (best["ones"], best["exact"], best["exact_nontrivial"]) == (True, best["records"], best["records"])


def test_density_streams(spark):
    """Neighbours written by one field in six bits, the highest first, after one byte: that reading is exact on all faces."""
    value = lambda x, y, z: (x * 5 + y * 3 + z * 7) % 64

    def body(cx):
        bits = "".join(f"{value(x + 16 * cx, y, z):06b}" for x in range(17) for y in range(17) for z in range(17))
        bits += "0" * (-len(bits) % 8)
        return b"\x00" + int(bits, 2).to_bytes(len(bits) // 8, "big")

    rows = [(k, 1, None, k, 0, 0, bytearray(b"\x04" + len(body(k)).to_bytes(2, "big") + body(k))) for k in (0, 1)]
    df = spark.createDataFrame(rows, "id int, worldId int, reject_reason string, chunk_x int, chunk_y int, chunk_z int, payload binary")
    got = {(r["byte_offset"], r["bit_offset"], r["bit_order"], r["fill"]): r for r in P.density_scan(df, 1).collect()}
    own = got[1, 0, "msb", 0]
    assert (own["face_pairs"], own["samples"], own["observed_active_exact"], own["error"]) == (1, 81, own["observed_active"], 0) and own["observed_active"] > 70
    assert len(got) == 2 * 6 * 2 * 2


def test_densities_of_whole_faces(spark):
    """Two bodies that differ in one voxel of their faces, at odd places: only the whole face shows it, and the planted query reads whole faces."""
    body = lambda bits: b"\x04" + (17**3 * 6 // 8 + 1).to_bytes(2, "big") + int(bits + "00", 2).to_bytes(17**3 * 6 // 8 + 1, "big")
    flat = ["000001"] * 17**3
    odd = [*flat]
    odd[3 + 17 * 5] = "000101"  # on the near face of x
    rows = [(k, 1, None, k, 0, 0, bytearray(body("".join(b)))) for k, b in enumerate((flat, odd))]
    df = spark.createDataFrame(rows, "id int, worldId int, reject_reason string, chunk_x int, chunk_y int, chunk_z int, payload binary")
    read = lambda *a: P.density_scan(df, 0, *a).filter("bit_offset = 0 and bit_order = 'msb' and fill = 0").first()
    some, whole = read(), read(range(P.SIDE))
    assert (some["samples"], some["exact"], whole["samples"], whole["exact"], whole["error"]) == (81, 81, 289, 288, 4)
    table = lambda name: spark.range(300).select(F.col("id").alias("event_id"))
    assert all(r["samples"] == 289 * r["face_pairs"] > 0 for r in measurements.density_readings(table, spark).collect())


def test_structure(spark):
    blob = b"zz\x0c\x00\x01" + struct.pack(">I", 7) + b"\xff" * 4 + bytes(8) + struct.pack(">iii", 9, -3, 5)
    df = spark.createDataFrame([(7, 2, -1, bytearray(blob)), (8, 2, -1, bytearray(blob)), (7, 3, -1, bytearray(blob))], "id int, x int, y int, data binary")
    got = [(r["marker_at"], r["id_at"], r["minus_one"], r["exact"], r["boundary"]) for r in P.structure(df).collect()]
    assert got == [(2, 5, True, True, True), (2, None, False, False, False), (2, 5, True, False, False)]


def test_codec_scan_holds_every_codec(spark):
    """A payload for each codec of the survey's M2, of 300 values, in a frame and two bytes after its head."""
    bodies = {}
    for name, counts in (("count", [200, 100]), ("count+1", [199, 99]), ("zero=256", [0, 44])):
        bodies[f"rle8/count-value/{name}"] = bytes([counts[0], 7, counts[1], 9])
        bodies[f"rle8/value-count/{name}"] = bytes([7, counts[0], 9, counts[1]])
        bodies[f"run-sum/{name}"] = bytes(counts)
    for end, short in ((">", "be"), ("<", "le")):
        for name, n in (("count", 300), ("count+1", 299)):
            bodies[f"rle16{short}/count-value/{name}"] = struct.pack(end + "HB", n, 7)
            bodies[f"rle16{short}/value-count/{name}"] = struct.pack(end + "BH", 7, n)
    bodies["packbits"] = bytes([129, 7, 128, 129, 8, 43]) + bytes(range(44))  # 128 + 128 + 44
    bodies["highbit/1=repeat"] = bytes([255, 7, 255, 8, 43]) + bytes(range(44))
    bodies["highbit/0=repeat"] = bytes([127, 7, 127, 8, 128 | 43]) + bytes(range(44))
    assert len(bodies) == 20
    df = voxels(spark, [bytes([4 + k % 2]) + struct.pack(">H", len(x) + 2) + b"zz" + x for k, x in enumerate(bodies.values())] + [b"", b"\x04"])
    got = {(r["codec"], r["bias"], r["framed"], r["mode"], r["offset"]): r["records"] for r in P.codec_scan(df, want=300).collect()}
    for k, name in enumerate(bodies):
        bias = 1 if "highbit" in name else None
        assert got[name, bias, True, "all", 2] >= 1 and got[name, bias, True, f"0{4 + k % 2}", 2] >= 1, name
    modes = lambda m: {(c, b, o): n for (c, b, framed, mode, o), n in got.items() if framed and mode == m}
    every = modes("all")
    assert every == {x: modes("04").get(x, 0) + modes("05").get(x, 0) for x in every}
    assert got["packbits", None, True, "all", 2] == 1 and got["rle16be/count-value/count", None, True, "all", 2] == 1
    assert {r["codec"] for r in P.codec_scan(voxels(spark, [bytes([200, 7, 0, 9, 100, 1])]), want=300, offsets=range(1)).collect()} == set()  # a count of zero
    assert P.codec_scan(voxels(spark, [b"\x04\x00\x09" + bodies["packbits"]]), want=300).filter("framed").count() == 0  # not the length that it declares


def test_key_profile(spark):
    df = spark.createDataFrame([(1, 0, None, None, "table", None), (1, 1, "string", "a", "int", None), (2, 1, "string", "a", "float", None), (2, 1, "int", None, "int", None), (3, None, None, None, None, "bad")], "row_id int, depth int, key_kind string, key_str string, value_kind string, reject_reason string")
    assert {(r["key"], r["value_kind"]): r["records"] for r in P.key_profile(df).filter(F.col("depth") == 1).collect()} == {("a", "int"): 1, ("a", "float"): 1, ("#int", "int"): 1}


def test_nested_signatures_rank_by_count_then_by_first_met(spark):
    from tessera.sinks import formats
    from tessera.sources import decode

    rows = [(5, {"a": {1: {"z": 1, "b": 2}, 2: {}, 3: {"b": 3}, 4: 7}, "n": 3}), (6, {"a": {1: {1: 1, 2.5: 2}, 2: {"b": 1}, 3: {"b": 2, "z": {"q": 1}}, 4: {1: 0}}}), (7, [{"k": {"x": 1}}])]
    script = spark.createDataFrame([(r, 1, formats.script(1, v)) for r, v in rows], "row_id long, worldId int, data binary")
    got = {(x["key"], x["rank"]): (x["signature"], x["tables"]) for x in P.nested_signatures(decode.lua_nodes(script)).collect()}
    assert got == {("a", 1): ("b, z", 2), ("a", 2): ("b", 2), ("a", 3): ("<no string keys; >", 1), ("a", 4): ("<no string keys; float/int>", 1), ("a", 5): ("<no string keys; int>", 1), ("#int", 1): ("x", 1)}
    assert P.nested_signatures(decode.lua_nodes(script), 1).count() == 2
