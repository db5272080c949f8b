"""A bounded sample of labelled documents for training, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds).cast("int")


def sample(labels: DataFrame, label: str, folds: int, held: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label, place): at most so many labelled rows outside the held-out fold, those first by a hash of the id.

    The sample is the only bounded part of training; it is broadcast to the texts, its rows being two numbers each.
    """
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    own = own.filter(fold("doc_id", folds) != held).dropDuplicates(["doc_id"])
    return own.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(most)


def with_texts(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
