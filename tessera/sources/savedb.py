"""SQLite databases as a Spark source: format "savedb", read-only, split by ranges of rowid."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing, contextmanager
from typing import ClassVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

MAGIC, LEAST_BYTES = b"SQLite format 3\x00", 100
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
TYPES = {"INTEGER": "bigint", "INT": "bigint", "BLOB": "binary", "TEXT": "string", "REAL": "double"}
KNOWN = ["GenericData", "ScriptData", "VoxelTerrain", "Portal", "RigidBody", "ChildShape"]


@contextmanager
def connect(path: str) -> Iterator[sqlite3.Connection]:
    """Read-only, closed at the end; raises unless the file begins as a database does and is long enough for its header."""
    with open(path, "rb") as f:
        head = f.read(LEAST_BYTES)
    if not head.startswith(MAGIC) or len(head) < LEAST_BYTES:
        raise ValueError(f"{path} is not a SQLite database")
    c = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    with closing(c):
        c.execute("PRAGMA query_only = ON")
        yield c


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> list[str]:
    with connect(path) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def columns(path: str, table: str) -> list[tuple]:
    """(number, name, type, not null, default, key) of each column."""
    with connect(path) as c:
        found = c.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    if not found:
        raise ValueError(f"no table {table!r}")
    return found


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options["table"]
        self.rows, self.asked, self.values = int(options.get("rows", 10_000)), [], []
        self.types = {"row_id": "bigint"} | {c[1]: kind(c[2]) for c in columns(self.path, self.table)}

    def partitions(self):
        """Ranges of about so many rows each, whatever gaps the rowids have: the database counts along its own index."""
        with connect(self.path) as c:
            at = [r[0] for r in c.execute(f"SELECT r FROM (SELECT rowid AS r, row_number() OVER (ORDER BY rowid) AS n FROM {quoted(self.table)}) WHERE n % ? = 1 OR ? = 1 ORDER BY r", (self.rows, self.rows))]
        return [Range(lo, hi) for lo, hi in zip(at, [*at[1:], (1 << 63) - 1])] or [Range(0, 0)]

    def read(self, part: Range):
        where = "".join(f" AND {x}" for x in self.asked)
        names = ", ".join(quoted(n) for n in self.types if n != "row_id")
        last = "<=" if part.hi == (1 << 63) - 1 else "<"
        with connect(self.path) as c:
            for row in c.execute(f"SELECT rowid, {names} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid {last} ?{where} ORDER BY rowid", (part.lo, part.hi, *self.values)):
                yield tuple(map(typed, row, self.types.values()))


class PushingReader(Reader):
    """Takes comparisons of numbers and tests for null into the database; Spark keeps the others."""

    SIGNS: ClassVar = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            column = "rowid" if name == "row_id" else quoted(name or "")
            # a column may hold any kind of value, so only what is a number is compared as one
            if name in self.types and type(f) in self.SIGNS and self.types[name] == "bigint" and type(f.value) is int:
                self.asked.append(f"typeof({column}) = 'integer' AND {column} {self.SIGNS[type(f)]} ?")
                self.values.append(f.value)
            elif name in self.types and isinstance(f, IsNotNull):
                self.asked.append(f"{column} IS NOT NULL")
                yield f
            else:
                yield f


def kind(declared: str) -> str:
    return TYPES.get(declared.upper().split("(")[0], "string")


def typed(value, to: str):
    """The value where it is of the column's type, else null: SQLite does not hold columns to their types."""
    if to == "binary":
        return value if isinstance(value, bytes) else None
    if to == "string":
        return None if value is None or isinstance(value, bytes) else str(value)
    if to == "double":
        return float(value) if isinstance(value, (int, float)) else None
    return value if isinstance(value, int) else None


class SaveDb(DataSource):
    """Options: path (on a folder that all executors see), table, rows (of a partition), pushdown (whether the session's
    spark.sql.python.filterPushdown.enabled is set, as read_table does)."""

    @classmethod
    def name(cls) -> str:
        return "savedb"

    def schema(self) -> str:
        return ", ".join(["row_id bigint", *[f"`{c[1]}` {kind(c[2])}" for c in columns(self.options["path"], self.options["table"])]])

    def reader(self, schema) -> Reader:
        return (PushingReader if self.options.get("pushdown") == "true" else Reader)(self.options)


def read_table(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    spark.dataSource.register(SaveDb)
    pushdown = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format("savedb").options(path=path, table=table, pushdown=pushdown, **options).load()


def inspect(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(table_name, records) of every table, and the file's size, user version and known tables of all that are known."""
    with connect(path) as c:
        version = c.execute("PRAGMA user_version").fetchone()[0]
        counts = [(t, c.execute(f"SELECT count(*) FROM {quoted(t)}").fetchone()[0]) for t in tables(path)]
    known = sorted({t for t, _ in counts} & set(KNOWN))
    facts = {"path": path, "size_bytes": os.path.getsize(path), "user_version": version, "known_tables": known, "signal": f"{len(known)}/{len(KNOWN)}"}
    return spark.createDataFrame(counts, "table_name string, records long"), facts


def preview(df: DataFrame, limit: int = 5, order: str | None = None) -> DataFrame:
    """The first rows as a person would look at them: of bytes the size and the first 32 in hex, of long texts the size and 200 characters."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    some, shown = (df.orderBy(order) if order else df).limit(limit), []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "binary":
            c = F.when(c.isNotNull(), F.struct(F.octet_length(c).alias("size"), F.lower(F.hex(F.substring(c, 1, 32))).alias("hex_prefix")))
        elif f.dataType.typeName() == "string":
            c = F.when(c.isNotNull(), F.struct(F.length(c).alias("size"), F.substring(c, 1, 200).alias("preview"), (F.length(c) > 200).alias("truncated")))
        shown.append(c.alias(f.name))
    return some.select(*shown)


def discover(spark: SparkSession, root: str, pattern: str = "*/Save/Survival/*.db") -> DataFrame:
    """(path, name, size_bytes, modified) of the save files below a folder, newest first, equal times by name; only metadata is read. Empty files are not
    listed."""
    try:
        files = spark.read.format("binaryFile").load(f"{root}/{pattern}").select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, size_bytes long, modified timestamp")
    base = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(base, "[.][^.]*$", "").alias("name"), "size_bytes", "modified").orderBy(F.desc("modified"), F.desc(F.lower(base)))
