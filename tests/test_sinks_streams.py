import json

import pytest
from pyspark.sql import functions as F

from tessera.sinks import svg
from tessera.streaming.windows import sessions, tumbling


def test_tunnel_map(spark):
    df = spark.createDataFrame([(1, "Vein", k, 10.0 * k, 5.0, float(k)) for k in (1, 0, 2)], "tunnel_id int, tunnel_type string, ord int, x double, y double, z double")
    out = svg.tunnel_map(df, "a < b", 100.0)
    assert 'points="20.00,20.00 50.00,20.00 80.00,20.00"' in out and "a &lt; b" in out
    with pytest.raises(ValueError):
        svg.tunnel_map(df, most=0)


def test_chunk_map_refuses_gaps(spark):
    rows = [(0, 0, 1, None), (1, 0, 2, None), (1, 0, 2, None)]
    df = spark.createDataFrame(rows, "chunk_x int, chunk_y int, chunk_z int, reject_reason string")
    assert svg.chunk_map(df).count("<rect") == 2
    with pytest.raises(ValueError):
        svg.chunk_map(df.withColumn("reject_reason", F.lit("magic")))


def test_report(spark):
    assert [json.loads(x) for x in svg.report(spark.createDataFrame([(1, None)], "a int, b string"))] == [{"a": 1, "b": None}]


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 5, 30)] + [(2, "2024-01-01 03:00:00"), (3, "2024-01-02 00:00:00")]
    events = spark.createDataFrame(rows, "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    for k, (make, columns) in enumerate(((lambda e: tumbling(e, "user_id", "1 hour", "0 seconds"), ("user_id", "start", "records")), (lambda e: sessions(e, "user_id", "10 minutes", "0 seconds"), ("user_id", "first_ts", "records")))):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(f"w{k}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        closed = {tuple(r[c] for c in columns) for r in spark.table(f"w{k}").collect()}
        batch = {tuple(r[c] for c in columns) for r in make(events).collect()}
        assert closed and closed <= batch and batch - closed == {x for x in batch if x[0] == 3}
