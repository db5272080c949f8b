"""Parameter sweeps and validation that holds whole groups out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .relational import numbered


#: Rows of parameters that are broadcast at once.
SLICE = 10_000


def sweep(records: DataFrame, parameters: DataFrame, hit: Column, keys: list[str]) -> DataFrame:
    """How many records each row of parameters explains. Parameters are broadcast in slices of a bounded number of rows, counts are summed by them."""
    if parameters.limit(SLICE + 1).count() <= SLICE:
        slices = [parameters]
    else:
        listed = cut(numbered(parameters, keys, "_n"))
        last = listed.agg(F.max("_n")).first()[0]
        slices = [listed.filter(F.col("_n").between(n, n + SLICE - 1)).drop("_n") for n in range(1, last + 1, SLICE)]
    out = None
    for part in slices:
        scored = records.join(F.broadcast(part)).groupBy(*keys).agg(F.count_if(hit).alias("hits"), F.count("*").alias("records")).filter("hits > 0")
        out = scored if out is None else out.unionByName(scored)
    return out


def leave_one_group_out(df: DataFrame, fold: str, value: str) -> DataFrame:
    """For each fold the errors, on its rows, of the mean and of the midrange of all other folds; both are scored on the same rows.

    Of the others the sums are the totals less the fold's own, and the extremes the best that are not its own: of all folds the two least and the
    two greatest are enough. One aggregate of the rows, one of the folds, one row of totals.
    """
    f = df.groupBy(fold).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    low, high = F.struct("lo", F.col(fold).alias("f")), F.struct("hi", F.col(fold).alias("f"))
    best = f.agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.min(low).alias("l1"), F.max(high).alias("h1"), F.count("*").alias("_folds"))
    second = f.withColumn("_one", F.lit(1)).join(best.select("l1", "h1", F.lit(1).alias("_one")), "_one")
    second = second.agg(F.min(F.when(F.col(fold) != F.col("l1.f"), F.col("lo"))).alias("l2"), F.max(F.when(F.col(fold) != F.col("h1.f"), F.col("hi"))).alias("h2"))
    totals = best.withColumn("_one", F.lit(1)).join(second.withColumn("_one", F.lit(1)), "_one")
    t = f.withColumn("_one", F.lit(1)).join(totals, "_one").filter("_folds > 1")
    tlo = F.when(F.col(fold) == F.col("l1.f"), F.col("l2")).otherwise(F.col("l1.lo"))
    thi = F.when(F.col(fold) == F.col("h1.f"), F.col("h2")).otherwise(F.col("h1.hi"))
    error = lambda m: F.sqrt((F.col("ss") - 2 * m * F.col("s") + m * m * F.col("n")) / F.col("n"))
    return t.select(fold, "n", error((F.col("_s") - F.col("s")) / (F.col("_n") - F.col("n"))).alias("rmse_mean"), error((tlo + thi) / 2).alias("rmse_midrange"))
