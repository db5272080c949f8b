"""Pure decoders of the binary formats: no Spark here. A decoder raises Reject with a reason; callers turn it into a row."""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


class Reject(ValueError):
    """Why a record cannot be decoded."""


# Fixed values of the formats.
WORLD_LIMIT, VOXEL_LIMIT, SCRIPT_LIMIT = 1 << 20, 1 << 16, 1 << 25
NIL, NIL_OLD, BOOL, FLOAT, STRING, TABLE, INT32, INT16, INT8, JSON, DOUBLE, USERDATA = 0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08, 0x09, 0x0B, 0x64
UUID, VEC3, QUAT, COLOR = 10001, 10003, 10004, 10005
HANDLES = {10021, 10023, 10024, 10025, 10027, 10028, 10030, 10036, 10037, 10039}
MOST_DEPTH, MOST_ITEMS, MOST_STRING = 256, 1_000_000, 1 << 25
VOXEL_MAGIC, VOXEL_ID_AT, VOXEL_AT, VOXEL_PAYLOAD_AT, VOXEL_Z = b"\x0c\x00\x01", 3, 19, 31, (-125, 63)
CHUNKS_PER_CELL = 4
TILE_MAGIC, TILE_HEAD, CELL_INTS = 0x454C4954, struct.Struct("<II16sQIIIIIII"), 97
STRIDES = {"unknown": 69, "harvestable": 65}


def lz4_block(data: bytes, limit: int) -> bytes:
    """A raw block of unknown size; nothing may follow it."""
    out, at, end = bytearray(), 0, len(data)

    def extended(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                if at >= end:
                    raise Reject("lz4:truncated length")
                more = data[at]
                at += 1
                n += more
                if more != 255:
                    break
        return n

    while at < end:
        token = data[at]
        at += 1
        literals = extended(token >> 4)
        if at + literals > end:
            raise Reject("lz4:truncated literals")
        out += data[at : at + literals]
        at += literals
        if len(out) > limit:
            raise Reject("lz4:too large")
        if at == end:
            return bytes(out)
        if at + 2 > end:
            raise Reject("lz4:truncated offset")
        back = data[at] | data[at + 1] << 8
        at += 2
        if not 0 < back <= len(out):
            raise Reject("lz4:bad offset")
        n = extended(token & 15) + 4
        if len(out) + n > limit:
            raise Reject("lz4:too large")
        start = len(out) - back
        whole, rest = divmod(n, back)  # a match may overlap what it writes
        piece = bytes(out[start:])
        out += piece * whole + piece[:rest]
    raise Reject("lz4:no end")


def lz4_prefix(data: bytes, size: int, start: int = 0) -> tuple[bytes, int]:
    """A raw block of a known size, from start on, that other bytes may follow: what it holds, and how many bytes it takes. Bytes that are no block mostly
    refer to what is before their beginning, which ends the search at once."""
    end = lz4_length(data, size, start, True)
    return lz4_block(data[start:end], size), end - start


def lz4_length(data: bytes, size: int, start: int = 0, backs: bool = False) -> int:
    """Where a raw block ends that makes so many bytes; only lengths are read, and with backs where matches begin. Nothing is copied."""
    at, made, end = start, 0, len(data)
    while at < end:
        token, at = data[at], at + 1
        n = token >> 4
        if n == 15:
            while at < end and data[at] == 255:
                n, at = n + 255, at + 1
            if at >= end:
                raise Reject("lz4:truncated length")
            n, at = n + data[at], at + 1
        at, made = at + n, made + n
        if at > end or made > size:
            raise Reject("lz4:truncated literals" if at > end else "lz4:size")
        if made == size:
            return at
        if at + 2 > end:
            raise Reject("lz4:truncated offset")
        if backs and not 0 < data[at] | data[at + 1] << 8 <= made:
            raise Reject("lz4:bad offset")
        at += 2
        n = token & 15
        if n == 15:
            while at < end and data[at] == 255:
                n, at = n + 255, at + 1
            if at >= end:
                raise Reject("lz4:truncated length")
            n, at = n + data[at], at + 1
        made += n + 4
    raise Reject("lz4:size")


def lz4_exact(data: bytes, size: int) -> bytes:
    """A raw block whose size is known. The library does not say how much it wrote, so the lengths are added up first; it also refuses blocks whose
    last literals are fewer than the format asks of writers, which are read here."""
    if lz4_length(data, size) != len(data):
        raise Reject("lz4:trailing")
    try:
        return pa.decompress(data, decompressed_size=size, codec="lz4_raw", asbytes=True)
    except (OSError, pa.ArrowException):
        return lz4_block(data, size)


class Bits:
    """A cursor over bits, the highest of a byte first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        first, last = self.at // 8, (self.at + n + 7) // 8
        if last > len(self.data):
            raise Reject("truncated")
        self.at += n
        return int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if x >> (n - 1) else x

    def raw(self, n: int) -> bytes:
        return self.take(8 * n).to_bytes(n, "big")

    def aligned(self, n: int) -> bytes:
        self.at = (self.at + 7) // 8 * 8
        s = self.at // 8
        if s + n > len(self.data):
            raise Reject("truncated")
        self.at += 8 * n
        return self.data[s : s + n]

    def floats(self, n: int) -> tuple[float, ...]:
        return struct.unpack(f">{n}f", self.raw(4 * n))


def uuid_text(stored: bytes) -> str:
    h = stored[::-1].hex()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def lua_value(bits: Bits, depth: int = 0) -> tuple[str, object]:
    """(kind, value); a table's value is the list of its (key, value) pairs, a repeated key keeping its place and taking the last value."""
    if depth > MOST_DEPTH:
        raise Reject("lua:depth")
    tag = bits.take(8)
    if tag in (NIL, NIL_OLD):
        return "nil", None
    if tag == BOOL:
        return "bool", bool(bits.take(1))
    if tag in (INT8, INT16, INT32):
        return "int", bits.signed({INT8: 8, INT16: 16, INT32: 32}[tag])
    if tag == FLOAT:
        return "float", bits.floats(1)[0]
    if tag == DOUBLE:
        return "float", struct.unpack(">d", bits.raw(8))[0]
    if tag in (STRING, JSON):
        n = bits.take(32)
        if n > MOST_STRING:
            raise Reject("lua:string size")
        return "string" if tag == STRING else "json", bits.aligned(n).decode("utf-8", "replace")
    if tag == TABLE:
        return "table", _table(bits, depth)
    if tag == USERDATA:
        kind = bits.take(32)
        if kind == UUID:
            return "uuid", uuid_text(bits.raw(16))
        if kind in (VEC3, QUAT, COLOR):
            return {VEC3: "vec3", QUAT: "quat", COLOR: "color"}[kind], bits.floats(3 if kind == VEC3 else 4)
        if kind in HANDLES:
            return "handle", (kind, bits.take(32))
        raise Reject("lua:userdata")
    raise Reject("lua:tag")


def _table(bits: Bits, depth: int) -> list[tuple[tuple, tuple]]:
    n = bits.take(32)
    if n > MOST_ITEMS:
        raise Reject("lua:items")
    if bits.take(1):
        first = bits.signed(32)
        return [(("int", first + k), lua_value(bits, depth + 1)) for k in range(n)]
    out: dict = {}
    for _ in range(n):
        key, value = lua_value(bits, depth + 1), lua_value(bits, depth + 1)
        if key[0] == "table":
            raise Reject("lua:key")
        same = key[1] if key[0] in ("int", "float", "bool") else key  # numbers and booleans that are equal are one key
        out[same] = (out[same][0] if same in out else key, value)
    return [*out.values()]


def lua_nodes(data: bytes) -> Iterator[dict]:
    """The value as a table of nodes in pre-order, which keeps the order of insertion."""
    bits = Bits(data, 24)
    if data[:3] != b"LUA" or bits.take(32) != 1:
        raise Reject("lua:magic")
    stack, number = [(None, None, lua_value(bits), 0)], 0
    while stack:
        parent, key, (kind, value), depth = stack.pop()
        row = {"node": number, "parent": parent, "depth": depth, "value_kind": kind}
        if key is not None:
            row |= {"key_kind": key[0], "key_int": int(key[1]) if key[0] in ("int", "bool") else None, "key_str": str(key[1]) if key[0] not in ("int", "bool") else None}
        if kind == "table":
            stack += [(number, k, v, depth + 1) for k, v in reversed(value)]
        elif kind in ("vec3", "quat", "color"):
            row["vector"] = [*map(float, value)]
        elif kind == "handle":
            row["i"] = value[1]
        elif kind != "nil":
            row[{"bool": "b", "int": "i", "float": "d"}.get(kind, "s")] = value
        yield row
        number += 1


def generic_envelope(blob: bytes) -> dict:
    if len(blob) < 29:
        raise Reject("envelope:short")
    packed = blob[29:]
    size = blob[28]
    return {"uid": blob[:16], "world_id": int.from_bytes(blob[22:24], "big"), "flags": int.from_bytes(blob[24:28], "little"), "data": lz4_block(packed[:size] if 0 < size <= len(packed) else packed, WORLD_LIMIT)}


def world(blob: bytes) -> dict:
    e = generic_envelope(blob)
    data, at, texts = e["data"], 4, []
    if len(data) < 4:
        raise Reject("world:short")
    for _ in range(3):
        n = int.from_bytes(data[at : at + 2], "big")
        if at + 2 + n > len(data):
            raise Reject("world:truncated")
        try:
            texts.append(data[at + 2 : at + 2 + n].decode())
        except UnicodeDecodeError:
            raise Reject("world:utf8") from None
        at += 2 + n
    return {"decoded_world": e["world_id"], "seed": int.from_bytes(data[:4], "big"), "filename": texts[0], "classname": texts[1], "terrain": texts[2]}


def script_envelope(blob: bytes) -> dict:
    """Exactly as long as it says."""
    if len(blob) < 25:
        raise Reject("envelope:short")
    end = 18 + int.from_bytes(blob[16:18], "big")
    if end + 7 > len(blob):
        raise Reject("envelope:truncated")
    size = int.from_bytes(blob[end + 3 : end + 7], "big")
    if end + 7 + size != len(blob):
        raise Reject("envelope:truncated" if end + 7 + size > len(blob) else "envelope:trailing")
    return {"uid": blob[:16], "key": blob[18:end], "world_id": int.from_bytes(blob[end : end + 2], "big"), "data": lz4_block(blob[end + 7 :], SCRIPT_LIMIT)}


def voxel(ident: int, x: int, y: int, blob: bytes) -> dict:
    data = lz4_block(blob, VOXEL_LIMIT)
    if len(data) < VOXEL_PAYLOAD_AT:
        raise Reject("short")
    if not data.startswith(VOXEL_MAGIC):
        raise Reject("magic")
    if int.from_bytes(data[VOXEL_ID_AT : VOXEL_ID_AT + 4], "big") != ident:
        raise Reject("id")
    cz, cy, cx = struct.unpack_from(">iii", data, VOXEL_AT)
    for reason, chunk, cell in (("cell_x", cx, x), ("cell_y", cy, y)):
        if chunk // CHUNKS_PER_CELL != cell:
            raise Reject(reason)
    if not VOXEL_Z[0] <= cz <= VOXEL_Z[1]:
        raise Reject("chunk_z")
    return {"chunk_x": cx, "chunk_y": cy, "chunk_z": cz, "size": len(data), "payload": data[VOXEL_PAYLOAD_AT:]}


def portal_header(blob: bytes) -> dict | None:
    """The columns of a portal's row as its blob repeats them, in 29 bytes; null where it is shorter."""
    if len(blob) < 29:
        return None
    prefix, marker, ident, flag_a, y_a, x_a, world_a, flag_b, y_b, x_b, world_b = struct.unpack_from(">BHIBiiHBiiH", blob)
    return {"prefix": prefix, "marker": marker, "id": ident, "flag_a": flag_a, "x_a": x_a, "y_a": y_a, "world_a": world_a, "flag_b": flag_b, "x_b": x_b, "y_b": y_b, "world_b": world_b}


def portal(blob: bytes) -> dict:
    """The transforms; side B is there from 812 bits on. Also the header, and the bits after what was read."""
    if len(blob) * 8 < 570:
        raise Reject("portal:short")
    bits = Bits(blob, 29 * 8)
    out, numbers = {"header": portal_header(blob), "dimensions": [*bits.floats(3)]}, []
    for side in "ab" if len(blob) * 8 >= 812 else "a":
        bits.take(2)
        out[f"world_{side}"] = bits.take(16)
        out[f"position_{side}"], out[f"rotation_{side}"] = [*bits.floats(3)], [*bits.floats(4)]
        numbers += out[f"position_{side}"] + out[f"rotation_{side}"]
    if not all(map(math.isfinite, numbers + out["dimensions"])):
        raise Reject("portal:not finite")
    left = len(blob) * 8 - bits.at
    return out | {"tail_at": bits.at, "tail_bits": f"{bits.take(left):0{left}b}" if left else ""}


def aligned_floats(blob: bytes, start: int = 29) -> Iterator[dict]:
    """Every four bytes from start on as a big-endian float; one that is not finite has no value but its name."""
    for at in range(start, len(blob) - 3, 4):
        x = struct.unpack_from(">f", blob, at)[0]
        yield {"offset": at, "hex": blob[at : at + 4].hex(), "value": x if math.isfinite(x) else None, "text": str(x)}


#: Where the directory of a cell keeps each kind: count, index, compressed and full size (None: no count), each over so many levels.
DIRECTORY = [("mip", 6, None, 0), ("clutter", 1, None, 18), ("assets", 4, 21, 25), *[(k, 1, 37 + 4 * i, 38 + 4 * i) for i, k in enumerate(("blueprint", "node", "script", "prefab", "decal"))], ("harvestable", 4, 57, 61), ("kinematics", 4, 73, 77), ("unknown", 1, 89, 90), ("voxel_terrain", 1, 93, 94)]


def tile_chunks(data: bytes) -> Iterator[dict]:
    for cell, width, v in tile_cells(data):
        for kind, levels, count, base in DIRECTORY:
            for k in range(levels):
                index, packed, full = (v[base + j * levels + k] for j in range(3))
                present = index > 0 and packed > 0 and full > 0
                yield {"cell": cell, "cell_x": cell % width, "cell_y": cell // width, "kind": kind, "level": k if levels > 1 else None, "count": None if count is None else v[count + k], "index": index, "packed": packed, "full": full, "present": present, "in_file": present and index + packed <= len(data)}


def tile_cells(data: bytes) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """(cell, cells in a row, its directory's integers)."""
    if len(data) < TILE_HEAD.size:
        raise Reject("tile:short")
    magic, version, uuid, _, width, height, cell_at, cell_size, *_ = TILE_HEAD.unpack_from(data)
    if magic != TILE_MAGIC:
        raise Reject("tile:magic")
    if cell_size < CELL_INTS * 4:
        raise Reject("tile:cell size")
    for cell in range(width * height):
        at = cell_at + cell * cell_size
        if at + CELL_INTS * 4 > len(data):
            raise Reject("tile:cell header")
        yield cell, width, struct.unpack_from(f"<{CELL_INTS}i", data, at)


def tile_directories(data: bytes) -> Iterator[dict]:
    """Of each cell its directory as it is, for directory_columns."""
    for cell, width, v in tile_cells(data):
        yield {"cell": cell, "width": width, "ints": v, "size": len(data)}


#: By kind and level what tile_chunks yields of a cell: kind, level, and where the directory keeps count, index, packed and full size.
CHUNKS = [(kind, k if levels > 1 else None, None if count is None else count + k, *(base + j * levels + k for j in range(3))) for kind, levels, count, base in DIRECTORY for k in range(levels)]


def directory_columns(cell: np.ndarray, width: np.ndarray, ints: np.ndarray, size: np.ndarray) -> list:
    """The columns of what tile_chunks yields of many cells; size: of each cell's file."""
    n, each = len(cell), lambda x: np.repeat(x, len(CHUNKS))
    kinds, levels, counts, *at = zip(*CHUNKS)
    index, packed, full = (ints[:, list(a)].ravel() for a in at)
    present = (index > 0) & (packed > 0) & (full > 0)
    kind, level = (pa.array(x).take(pa.array(np.tile(np.arange(len(CHUNKS)), n))) for x in (kinds, pa.array(levels, pa.int32())))
    known = np.tile([c is not None for c in counts], n)
    count = pa.array(ints[:, [c or 0 for c in counts]].ravel(), pa.int32(), mask=~known)
    inside = present & (index.astype(np.int64) + packed <= each(size))
    return [each(cell), each(cell % width), each(cell // width), kind, level, count, index, packed, full, present, inside]


def tile_objects(data: bytes) -> Iterator[dict]:
    """Placements of the kinds with records of a fixed size."""
    for c in [*tile_chunks(data)]:
        if c["kind"] in STRIDES and (c["count"] or 0) > 0:
            stride, body = STRIDES[c["kind"]], lz4_exact(data[c["index"] : c["index"] + c["packed"]], c["full"])
            if len(body) != stride * c["count"]:
                raise Reject("tile:stride")
            for k in range(c["count"]):
                r = body[k * stride : (k + 1) * stride]
                f = struct.unpack_from("<10f", r)
                if not all(map(math.isfinite, f)):
                    raise Reject("tile:not finite")
                yield {"kind": c["kind"], "cell": c["cell"], "number": k, "x": f[0] + 64.0 * c["cell_x"], "y": f[1] + 64.0 * c["cell_y"], "z": f[2], "rotation": [*f[3:7]], "scale": [*f[7:10]], "uuid_hex": r[40:56].hex(), "tail_hex": r[56:].hex()}


#: Fixed value: what stands between a tunnel node's transform and the length of its parameters.
TUNNEL_NODE = bytes.fromhex("0100470000004c554100000001050000000102000000030074756e6e656c0c866c52e429a84bbf3341b2bf7b626186")
BLOCK_BYTES = 16**3


def bodies(data: bytes, kind: str) -> Iterator[tuple[dict, bytes]]:
    """The present chunks of a kind, decompressed."""
    for c in tile_chunks(data):
        if c["kind"] == kind and c["present"]:
            yield c, lz4_exact(data[c["index"] : c["index"] + c["packed"]], c["full"])


def tile_nodes(data: bytes) -> Iterator[dict]:
    """Tunnel nodes: a transform of ten floats, the fixed bytes, the size of a JSON text, the text."""
    for c, body in bodies(data, "node"):
        if len(body) < 8 or not body[0]:
            raise Reject("node:short" if len(body) < 8 else "node:no groups")
        found, at = 0, 1
        while (at := body.find(TUNNEL_NODE, at)) >= 0:
            start, size_at = at - 40, at + len(TUNNEL_NODE)
            if start < 0:
                raise Reject("node:no transform")
            end = size_at + 4 + int.from_bytes(body[size_at : size_at + 4], "big")
            if size_at + 4 > len(body) or end > len(body):
                raise Reject("node:truncated")
            try:
                text = body[size_at + 4 : end].decode()
                parameters = json.loads(text)
            except ValueError:
                raise Reject("node:json") from None
            if not isinstance(parameters, dict) or not isinstance(parameters.get("tunnel"), dict):
                at += 1
                continue
            f = struct.unpack_from("<10f", body, start)
            yield {"cell": c["cell"], "number": found, "x": f[0] + 64.0 * c["cell_x"], "y": f[1] + 64.0 * c["cell_y"], "z": f[2], "rotation": [*f[3:7]], "scale": [*f[7:10]], "parameters": text}
            found, at = found + 1, end
        if body[0] == 1 and c["count"] is not None and found != c["count"]:
            raise Reject("node:count")


def tile_voxels(data: bytes) -> Iterator[dict]:
    """Voxel blocks of a tile: where each lies, in blocks, and its bytes, z fastest, then y, then x."""
    for c, body in bodies(data, "voxel_terrain"):
        if len(body) % (12 + BLOCK_BYTES):
            raise Reject("voxel:alignment")
        if c["count"] and c["count"] * (12 + BLOCK_BYTES) != len(body):
            raise Reject("voxel:count")
        for k in range(len(body) // (12 + BLOCK_BYTES)):
            r = body[k * (12 + BLOCK_BYTES) : (k + 1) * (12 + BLOCK_BYTES)]
            x, y, z = struct.unpack_from("<3i", r)
            yield {"cell": c["cell"], "number": k, "bx": x, "by": y, "bz": z, "data": r[12:]}


def tile_dump(data: bytes, kind: str, least: int = 4, most_floats: int = 64) -> Iterator[dict]:
    """What can be said of a chunk whose format is not known: its digest, its ends, its texts, and floats of a plausible size."""
    for c, body in bodies(data, kind):
        floats = []
        for at in range(0, len(body) - 3, 4):
            x = struct.unpack_from("<f", body, at)[0]
            if abs(x) <= 1e5 and (x == 0 or abs(x) >= 1e-12) and len(floats) < most_floats:
                floats.append(x)
        yield {"cell": c["cell"], "level": c["level"], "size": len(body), "sha256": hashlib.sha256(body).hexdigest(), "head": body[:128].hex(), "tail": body[-64:].hex(), "texts": [m.decode() for m in re.findall(rb"[ -~]{%d,}" % least, body)], "floats": floats}


def json_number(text: str, name: str) -> float | None:
    try:
        x = json.loads(text).get(name)
    except (ValueError, AttributeError):
        return None
    return x if isinstance(x, (int, float)) and not isinstance(x, bool) else None
