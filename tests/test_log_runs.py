"""Logs in ranges, runs over stretches of lines, and the stream against the batch."""

import random

import pytest

from tessera.sources import logs
from tessera.streaming import runs

MARKER, RECORD = "X_META,", "X,"
SCHEMA = "file string, line long, value string"


def some_lines(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    kinds = ["x X_META,world=3,count=2", "X_META,world=4,count=2", "noise", "X,broken", *["t X,{},1,1.0,2.0,3.0,3,4.0,0,0,1,terrain"] * 6]
    return [r.choice(kinds).format(r.randrange(3)) for _ in range(n)]


def plain_state(lines: list[str]) -> tuple:
    """(status, run, marker line, records, bad, lines) by reading from top to bottom."""
    run, found, active, held = 0, None, False, []
    for k, text in enumerate(lines, 1):
        if MARKER in text:
            run += 1
            active = "world=3" in text
            if active:
                found, held = (run, k), []
        elif RECORD in text and active:
            held.append((k, text.split(",")[1] if "broken" not in text else None))
    if found is None:
        return "none", None, None, None, None, []
    bad = sum(i is None for _, i in held)
    whole = len(held) == 2 and not bad and held[0][1] != held[1][1]
    return "whole" if whole else "broken", *found, len(held), bad, [k for k, _ in held] if whole else []


def shown(df):
    return {r["file"]: (r["status"], r["run"], r["marker_line"], r["records"], r["bad"], list(r["lines"])) for r in df.collect()}


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_log_is_read_in_ranges(spark, tmp_path, small_ranges, end):
    texts = {f"{n}.log": some_lines(n, 400 * n) for n in (1, 2)} | {"empty.log": []}
    for name, lines in texts.items():
        (tmp_path / name).write_bytes("".join(x + end for x in lines).encode())
    got = logs.read_lines(spark, f"file://{tmp_path}")
    assert {(r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in got.collect()} == {(f, k, v) for f, lines in texts.items() for k, v in enumerate(lines, 1)}
    assert max(spark.read.text(f"file://{tmp_path}").rdd.glom().map(len).collect()) < 100  # lines of a task, of 1,200
    states = shown(logs.run_states(logs.parsed(got, MARKER, RECORD, 16), 3, 2))
    assert {f.rsplit("/", 1)[1]: s for f, s in states.items()} == {f: plain_state(lines) for f, lines in texts.items() if lines}


def test_runs_do_not_depend_on_stretches(spark):
    rows = [("f", k, v) for k, v in enumerate(some_lines(5, 300), 1)]
    by = [{(r["line"], r["run"]) for r in logs.parsed(spark.createDataFrame(rows, SCHEMA), MARKER, RECORD, most).collect()} for most in (1, 7, 1 << 18)]
    assert by[0] == by[1] == by[2]


def test_states_of_files(spark):
    ok = ["X_META,world=3,count=2", "X,0,1,1.0,2.0,3.0,3,4.0,0,0,1,terrain", "X,1,1,1.0,2.0,3.0,3,4.0,0,0,1,terrain"]
    files = {"whole": ok, "short": [*ok, *ok[:2]], "long": [*ok, ok[1]], "twice": [*ok[:2], ok[1]], "bad": [*ok[:2], "X,1"], "unnamed": ["X_META,world=x", *ok], "other": ["X_META,world=9,count=2", *ok[1:]], "bare": ok[1:]}
    rows = [(f, k, v) for f, lines in files.items() for k, v in enumerate(lines, 1)]
    got = shown(logs.run_states(logs.parsed(spark.createDataFrame(rows, SCHEMA), MARKER, RECORD), 3, 2))
    assert {f: s[0] for f, s in got.items()} == {"whole": "whole", "short": "broken", "long": "broken", "twice": "broken", "bad": "broken", "unnamed": "marker", "other": "none", "bare": "none"}
    assert got["whole"][5] == [2, 3] and got["short"][1:5] == (2, 4, 1, 0)
    assert shown(logs.run_states(logs.parsed(spark.createDataFrame([], SCHEMA), MARKER, RECORD), 3, 2)) == {}


def streamed(spark, folder, pieces):
    """The newest answer for each file after the pieces came one after another, each to a query started anew from the checkpoint."""
    seen = {}

    def keep(df, n):
        for r in df.collect():
            seen[r["file"]] = (r["status"], r["run"], r["marker_line"], r["records"], r["bad"], list(r["lines"]))

    for piece in pieces:
        spark.createDataFrame(piece, SCHEMA).write.mode("append").parquet(f"{folder}/lines")
        states = runs.run_states(spark.readStream.schema(SCHEMA).parquet(f"{folder}/lines"), MARKER, RECORD, 3, 2)
        states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return seen


def test_the_stream_gives_what_the_batch_gives(spark, tmp_path):
    logs_of = {f"f{n}": some_lines(n, 60) for n in range(6)}
    rows = [(f, k, v) for f, lines in logs_of.items() for k, v in enumerate(lines, 1)]
    random.Random(1).shuffle(rows)
    cuts = {f: sorted(random.Random(f).sample(range(61), 2)) for f in logs_of}
    pieces = [[r for r in rows if sum(r[1] > c for c in cuts[r[0]]) == k] for k in range(3)]
    want = {f: plain_state(lines) for f, lines in logs_of.items()}
    assert streamed(spark, f"file://{tmp_path}", pieces) == want
    assert shown(logs.run_states(logs.parsed(spark.createDataFrame(rows, SCHEMA), MARKER, RECORD, 8), 3, 2)) == want


def test_lines_that_come_too_late_are_reported(spark, tmp_path):
    a, b = ("f", 1, "X_META,world=3,count=2"), ("f", 2, "X,0,1,1.0,2.0,3.0,3,4.0,0,0,1,terrain")
    assert streamed(spark, f"file://{tmp_path}", [[b], [a]])["f"][0] == "disorder"
