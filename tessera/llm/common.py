"""What the text operators share: the shared work folder, Arrow text batches as NumPy arrays, and global prefix sums."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch: at a few KB a text, a batch is a few MB, which bounds the memory of a Python worker.
BATCH_ROWS = 512

#: The bytes that separate words: space and 0x09 to 0x0D.
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False

_scratch: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators rely on; all of them are runtime settings of Spark SQL."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only where it is unset and Spark is local, as in tests, a
    temporary one; on a cluster without it no executor could read what another wrote."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _scratch:
            _scratch.append(tempfile.mkdtemp(prefix="tessera-"))
        base = f"file://{_scratch[0]}"
        spark.sparkContext.setCheckpointDir(base)
    return base


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder belongs to it
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives the loss of executors. It goes with the driver."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(total_bytes: float, each: float, least: int = 48) -> int:
    return int(max(least, -(-total_bytes // each)))


def arrow_map(df: DataFrame, schema: str, step: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> DataFrame:
    return df.mapInArrow(step, schema)


class Texts:
    """A column of texts as one byte buffer; null counts as empty. Every array is NumPy, nothing is copied from Arrow but the slice."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        column = column.cast(pa.large_binary())
        self.n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + self.n + 1]
        data = column.buffers()[2]
        base = int(offsets[0]) if self.n else 0
        end = int(offsets[-1]) if self.n else 0
        self.bytes = np.frombuffer(data, dtype=np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
        self.at = (offsets - base) if self.n else np.zeros(1, np.int64)

    @functools.cached_property
    def words(self) -> Words:
        return Words(self)

    def text(self, i: int) -> bytes:
        return self.bytes[self.at[i] : self.at[i + 1]].tobytes()


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross the borders in at."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = at[1:] > at[:-1]
    s, e = at[:-1][full], at[1:][full] - 1
    first[s], last[e] = inside[s], inside[e]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """Maximal runs of bytes other than space and 0x09 to 0x0D; ptr[i]:ptr[i + 1] are those of text i."""

    def __init__(self, texts: Texts):
        inside = WORD_BYTE[texts.bytes]
        self.start, self.end = runs(inside, texts.at)
        self.ptr = np.searchsorted(self.start, texts.at)
        self.n = len(self.start)
        self._packed = texts.bytes[inside]

    @functools.cached_property
    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the different words by number."""
        offsets = np.zeros(self.n + 1, np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(self._packed)])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each word, from XXH3-128 of each different word."""
        code, different = self.coded
        both = hash128(different.to_pylist())
        return both[:, 0][code], both[:, 1][code]


def hash128(items: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(x) for x in items]), dtype="<u8").reshape(-1, 2)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of values[ptr[i]:ptr[i + 1]] for each i, added in order, so that it does not depend on what stands around it."""
    out = np.zeros(len(ptr) - 1)
    full = np.flatnonzero(ptr[1:] > ptr[:-1])
    if len(full):
        out[full] = np.add.reduceat(np.asarray(values, np.float64), ptr[:-1][full])
    return out


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its two parts, in order."""
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0xA0761D6478BD642F)))


def window_hashes(word: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of so many words, by doubling: a window is joined of windows whose lengths are powers of two."""
    if len(word) < length:
        return np.zeros(0, np.uint64)
    n, have, done, out, power = len(word) - length + 1, 1, 0, None, word
    while True:
        if length & have:
            part = power[done : done + n]
            out = mixed(part) if out is None else joined(out, part)
            done += have
        have *= 2
        if have > length:
            return out
        power = joined(power[: len(power) - have // 2], power[have // 2 :])


def window_starts(ptr: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which word starts a window that ends in the same text, and the text of each such window."""
    count = np.maximum(np.diff(ptr) - length + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    first = np.concatenate([[0], np.cumsum(count)])
    return np.arange(int(first[-1])) - first[:-1][owner] + ptr[:-1][owner], owner


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in schema], schema=schema)


def running_totals(df: DataFrame, order: list[str], values: list[str], name: str) -> DataFrame:
    """For each row the sums of the values over all rows before it in the given order, as columns before_<value>.

    The rows are dealt out by ranges of the order and stored with the number of their range; the sums of the ranges (a row for each) go to
    the driver, and a window within each range adds the rest. No task sees more than one range, also where one value of the first key fills many.
    The order must be total.
    """
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = stored(df.repartitionByRange(int(n), *order).withColumn("_range", F.spark_partition_id()), name)
    totals = ranged.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values]).orderBy("_range").collect()
    base, rows = [0] * len(values), []
    for t in totals:
        rows.append((t["_range"], *base))
        base = [b + (t[v] or 0) for b, v in zip(base, values)]
    before = df.sparkSession.createDataFrame(rows or [(0, *base)], "_range int, " + ", ".join(f"_base_{v} long" for v in values))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(before), "_range")
    return out.select(*df.columns, *[(F.coalesce(F.sum(v).over(w), F.lit(0)) + F.col(f"_base_{v}")).cast("long").alias(f"before_{v}") for v in values])
