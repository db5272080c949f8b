"""The corpus pipeline: learned quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of documents.

Defined results, of every stage: rows without a doc_id cannot be named, so no stage but the first, which judges rows where they lie, and the
last, which leaves them out, acts on them. Rows that repeat an id are documents of their own: each is judged, dropped or cut by its own text,
and among them the order of their texts (then of their other columns) stands for that of ids. A null text counts as empty and stays null
where the row stays. Other columns pass through unchanged, whatever their names; n_chars, where there is one, follows the text. An empty table
gives an empty one.

SQL cannot express a learned classifier, so there is no ORACLE_SQL; the tests hold each stage against a plain version of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import prepare, stored, table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.ngram_join import ngram_join
from tessera.llm.packing import pack
from tessera.llm.quality_classifier import fit, keep_good
from tessera.llm.substring_dedup import substring_dedup

FOLDS, HELD = 4, 2


def fresh(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of docs has; names differ by more than case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and the column that tells their rows apart: doc_id or, where ids repeat, the rows' number in the order of id and text."""
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs, "doc_id"
    ordered = docs.orderBy("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    row = fresh(docs, "_row")
    return stored(ordered.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows"), row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = table(spark, sf_dir, "labels")
    return keep_good(docs, fit(docs, labels, FOLDS, HELD))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; of rows that repeat both id and text one."""
    prepare(spark)
    rows, key = told_apart(docs)
    return rows.join(exact_dedup(rows, key).filter("not kept").select(key), key, "left_anti").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest id stays; of rows that repeat an id only those go that a link connects to an
    earlier one."""
    prepare(spark)
    rows, key = told_apart(docs)
    return rows.join(ngram_join(rows, id_col=key).filter(F.col("class_id") != F.col(key)).select(key), key, "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; a document of which nothing is left goes too, one that loses nothing stays as it is. Rows
    that repeat an id lose their own passages only, also those that an earlier row of the id holds."""
    prepare(spark)
    rows, key = told_apart(docs)
    left = fresh(rows, "_left")
    cut = stored(substring_dedup(rows, id_col=key, with_text=True).filter("n_removed > 0").select(key, F.col("kept_text").alias(left)), "cut")
    out = rows.join(cut, key, "left").filter(F.col(left).isNull() | (F.col(left) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(left).isNull(), F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.coalesce(left, "text")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    prepare(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
