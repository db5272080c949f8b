"""Series on the driver's tables: adjacency, sessions, runs, interleaving, interpolation, windows of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import series as S

ORDER = ["ts", "event_id"]


def events(table):
    return table("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT user_id, event_id, change, micros FROM (
    SELECT user_id, event_id, event_type <> 'error' AS ok, lag(event_type <> 'error') OVER w AS before, value - lag(value) OVER w AS change, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS micros
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE ok AND before""")
def gap_safe_adjacency(table, spark):
    out = S.gap_safe_adjacency(events(table), "user_id", ORDER, F.col("event_type") != "error", {"change": F.col("value"), "micros": F.unix_micros("ts")})
    return out.select("user_id", "event_id", "change", "micros")


SESSIONS = "SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM events"


@query(f"""SELECT user_id, session::BIGINT AS session, count(*) AS records FROM (SELECT *, max(session) OVER (PARTITION BY user_id) AS last FROM ({SESSIONS})) WHERE session = last AND session > 0 GROUP BY ALL""")
def marker_sessions_last(table, spark):
    return S.last_session(events(table), "user_id", ORDER, F.col("event_type") == "signup").groupBy("user_id", "session").agg(F.count("*").alias("records"))


@query("""WITH r AS (SELECT user_id, event_id, sum(CAST(value AS DECIMAL(18, 4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run, sum(CAST(value AS DECIMAL(18, 4))) OVER (PARTITION BY user_id) AS total, ts FROM events)
    SELECT user_id, event_id, CAST(run AS DOUBLE) AS reached, CAST(total AS DOUBLE) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM r WHERE run * 2 >= total) WHERE n = 1""")
def arc_midpoint(table, spark):
    out = S.arc_midpoint(events(table), "user_id", ORDER, F.col("value").cast("decimal(18,4)"))
    return out.select("user_id", "event_id", F.col("reached").cast("double").alias("reached"), F.col("total").cast("double").alias("total"))


@query("""SELECT doc_id, lang, turn, row_number() OVER (ORDER BY turn, lang) AS place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS turn FROM documents) WHERE turn <= 20""")
def round_robin_topk(table, spark):
    d = table("documents").select("doc_id", "lang", (-F.col("n_chars")).alias("shortness"))
    return S.round_robin(d, "lang", ["shortness", "doc_id"], 20).select("doc_id", "lang", "turn", "place")


@query("""WITH f AS (SELECT *, value BETWEEN 20 AND 200 AS inside, lag(value BETWEEN 20 AND 200) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    g AS (SELECT *, sum(CASE WHEN inside AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT user_id, island::BIGINT AS island, count(*) AS records, min(event_id) AS first_id FROM g WHERE inside GROUP BY ALL""")
def islands(table, spark):
    return S.islands(events(table), "user_id", ORDER, F.col("value").between(20, 200)).groupBy("user_id", "island").agg(F.count("*").alias("records"), F.min("event_id").alias("first_id"))


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value, dense_rank() OVER (ORDER BY user_id) AS r FROM events)
    SELECT a.user_id AS lane_a, b.user_id AS lane_b, a.seq, b.value - a.value AS difference FROM s a JOIN s b ON b.r = a.r + 1 AND a.seq = b.seq""")
def cross_lane(table, spark):
    from pyspark.sql import Window

    e = events(table).withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)).cast("long"))
    return S.cross_lane(e, "user_id", "seq", "value")


@query("""SELECT user_id, event_id, before + (100 - before_value) / (value - before_value) AS crossing FROM (
    SELECT user_id, event_id, value, lag(value) OVER w AS before_value, (row_number() OVER w - 2)::DOUBLE AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE (value - 100) * (before_value - 100) < 0""")
def iso_interpolation(table, spark):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(*ORDER)
    e = events(table).select("user_id", "event_id", "value", F.lag("value").over(w).alias("b"), (F.row_number().over(w) - 2).cast("double").alias("before"))
    return e.filter("(value - 100) * (b - 100) < 0").select("user_id", "event_id", (F.col("before") + (100 - F.col("b")) / (F.col("value") - F.col("b"))).alias("crossing"))


@query("""SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS records FROM (
    SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s""")
def session_windows(table, spark):
    from ..streaming.windows import sessions

    return sessions(events(table), "user_id", "1 day").select("user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "records")


@query("""SELECT event_type, epoch_us(date_trunc('day', ts)) AS day_us, count(*) AS records FROM events GROUP BY ALL""")
def tumbling_windows(table, spark):
    from ..streaming.windows import tumbling

    return tumbling(events(table), "event_type", "1 day").select("event_type", F.unix_micros("start").alias("day_us"), "records")


@query("""WITH p AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), x AS (SELECT event_id, b, unnest(range(0, 16)) AS bit FROM p WHERE b IS NOT NULL)
    SELECT bit, count(*) FILTER ((b >> bit) & 1 = 1) AS set_before, count(*) FILTER ((event_id >> bit) & 1 = 1) AS set_after, count(*) FILTER ((b >> bit) & 1 = 1 AND (event_id >> bit) & 1 = 0) AS lost,
           count(*) FILTER ((b >> bit) & 1 = 0 AND (event_id >> bit) & 1 = 1) AS gained FROM x GROUP BY bit""")
def bit_transitions(table, spark):
    from pyspark.sql import Window

    p = events(table).select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy(*ORDER)).alias("b")).filter("b is not null")
    x = p.withColumn("bit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    now, was = F.expr("shiftright(event_id, cast(bit as int)) & 1"), F.expr("shiftright(b, cast(bit as int)) & 1")
    return x.groupBy("bit").agg(F.count_if(was == 1).alias("set_before"), F.count_if(now == 1).alias("set_after"), F.count_if((was == 1) & (now == 0)).alias("lost"), F.count_if((was == 0) & (now == 1)).alias("gained"))
