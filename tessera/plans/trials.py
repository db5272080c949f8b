"""Sweeps and validation on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import evaluate as E


@query("""SELECT factor, "offset", count(*) FILTER ((user_id * factor + "offset") % 16 = event_id % 16) AS hits, count(*) AS records
    FROM events, (SELECT unnest(range(1, 5)) AS factor), (SELECT unnest(range(0, 4)) AS "offset") GROUP BY ALL HAVING count(*) FILTER ((user_id * factor + "offset") % 16 = event_id % 16) > 0""")
def parameter_sweep(table, spark):
    grid = spark.range(1, 5).select(F.col("id").alias("factor"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("offset"))
    return E.sweep(table("events").select("user_id", "event_id"), grid, (F.col("user_id") * F.col("factor") + F.col("offset")) % 16 == F.col("event_id") % 16, ["factor", "offset"])


@query("""WITH f AS (SELECT event_type, count(value) AS n, avg(value) AS m FROM events GROUP BY 1),
    t AS (SELECT a.event_type, (SELECT avg(value) FROM events e WHERE e.event_type <> a.event_type) AS mean, (SELECT (min(value) + max(value)) / 2 FROM events e WHERE e.event_type <> a.event_type) AS mid FROM f a)
    SELECT event_type, count(*) AS n, round(sqrt(avg((value - mean) * (value - mean))), 5) AS rmse_mean, round(sqrt(avg((value - mid) * (value - mid))), 5) AS rmse_midrange FROM events JOIN t USING (event_type) GROUP BY event_type""")
def leave_one_group_out(table, spark):
    return E.leave_one_group_out(table("events"), "event_type", "value").withColumns({"rmse_mean": F.round("rmse_mean", 5), "rmse_midrange": F.round("rmse_midrange", 5)})
