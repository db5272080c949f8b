"""The library's decoders and geometry by name in SQL text: table functions for use with LATERAL, and scalar functions.

    register(spark)
    spark.sql("SELECT t.path, c.kind FROM tiles t, LATERAL tile_chunks(t.content) c WHERE c.present")

A table function has the columns of its decoder and reject_reason, as a row where a record cannot be decoded; a null record is one. Scalar
functions are SQL expressions, which Catalyst inlines; with a null argument they are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from ..domain.navigation import CONTACT_BOUNDS, RAY_BOUNDS
from ..domain.probes import BLOCK, block_starts
from ..sources import codecs, decode

AXES = ("x", "y", "z")


def _table(fields: str, decoder: Callable[..., Iterable[dict]]):
    names = [f.name for f in StructType.fromDDL(fields)]

    class Decoded:
        def eval(self, data: bytes) -> Iterator[tuple]:
            for row in decode.attempts(decoder, (data,), names):
                yield tuple(row.values())

    return udtf(Decoded, returnType=f"{fields}, reject_reason string", useArrow=False)


def value_nodes(blob: bytes) -> Iterable[dict]:
    return codecs.lua_nodes(codecs.script_envelope(blob)["data"])


TABLES: dict[str, tuple[str, Callable[..., Iterable[dict]]]] = {
    "tile_chunks": (decode.CHUNK, codecs.tile_chunks), "tile_objects": (decode.OBJECT, codecs.tile_objects), "tile_nodes": (decode.TILE_NODE, codecs.tile_nodes),
    "value_nodes": (decode.NODE, value_nodes), "block_starts": (BLOCK, block_starts),
}


def ladder_sql(bounds: list[float]) -> str:
    steps = " ".join(f"WHEN v <= {b}D THEN '<={b:g}'" for b in bounds)
    return f"CASE WHEN v IS NULL THEN NULL {steps} ELSE '>{bounds[-1]:g}' END"


BOX = ", ".join(f"{a}{k} DOUBLE" for a in AXES for k in (0, 1))
POINT = ", ".join(f"{a} DOUBLE" for a in AXES)
OUTSIDE = " + ".join(f"pow(greatest({a}0 - {a}, {a} - {a}1, 0D), 2)" for a in AXES)


def face_sql() -> str:
    """The nearest face, equal distances by name, and where on it the point lies: the other two axes from the box's least corner."""
    faces = []
    for a in AXES:
        u, v = (o for o in AXES if o != a)
        faces += [f"named_struct('distance', abs({a} - {a}{k}), 'face', '{a}{s}', 'u', {u} - {u}0, 'v', {v} - {v}0)" for k, s in ((0, "-"), (1, "+"))]
    known = " AND ".join(f"{c.split()[0]} IS NOT NULL" for c in f"{POINT}, {BOX}".split(", "))
    return f"CASE WHEN {known} THEN array_min(array({', '.join(faces)})) END"


def _distance() -> str:
    known = " AND ".join(f"{c.split()[0]} IS NOT NULL" for c in f"{POINT}, {BOX}".split(", "))
    return f"CASE WHEN {known} THEN sqrt({OUTSIDE}) END"


def scalars() -> dict[str, str]:
    """By name: parameters, type and expression."""
    return {
        "nearest_face": f"({POINT}, {BOX}) RETURNS STRUCT<distance: DOUBLE, face: STRING, u: DOUBLE, v: DOUBLE> RETURN {face_sql()}",
        "box_distance": f"({POINT}, {BOX}) RETURNS DOUBLE RETURN {_distance()}",
        "ray_bucket": f"(v DOUBLE) RETURNS STRING RETURN {ladder_sql(RAY_BOUNDS)}",
        "contact_bucket": f"(v DOUBLE) RETURNS STRING RETURN {ladder_sql(CONTACT_BOUNDS)}",
    }


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session, again if they are; their names."""
    for name, (fields, decoder) in TABLES.items():
        spark.udtf.register(name, _table(fields, decoder))
    for name, body in scalars().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return [*TABLES, *scalars()]
