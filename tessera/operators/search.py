"""Text search: every term is a substring, facets restrict, groups take turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import round_robin

#: Characters of a query that count.
QUERY_CHARS = 100


def terms(query: str) -> list[str]:
    return query[:QUERY_CHARS].lower().split()


def search(df: DataFrame, query: str, text: Column, facets: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows whose lower-cased text holds every term and whose facets are among those asked for; nothing asked for finds nothing."""
    asked = terms(query)
    if not asked and not facets:
        return df.filter(F.lit(False))
    for name, values in (facets or {}).items():
        df = df.filter(F.col(name).isin(values))
    lower = F.lower(text)
    for t in asked:
        df = df.filter(lower.contains(t))
    return df


def interleaved(found: DataFrame, group: str, order: list[str], most: int = 100) -> DataFrame:
    """The first results of each group in turn, so that no group crowds the others out."""
    return round_robin(found, group, order, most).filter(F.col("place") <= most)
