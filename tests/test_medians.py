"""Exact medians of groups, gathered and by histograms."""

import random
from statistics import median

import pytest

from tessera.operators.relational import medians

R = random.Random(3)
GROUPS = {
    "even": [R.uniform(-5, 5) for _ in range(300)], "odd": [R.gauss(0, 1e6) for _ in range(301)], "ties": [R.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(400)], "one": [7.5], "same": [0.1] * 300,
    "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1e-300, 3.0], "halves": [1.0] * 100 + [2.0] * 100, "powers": [2.0**k for k in range(-1000, 1000)], None: [4.0, 1.0],
}


@pytest.mark.parametrize("at_once,bins", [(1 << 16, 1024), (2, 64), (0, 8)])
def test_medians(spark, at_once, bins):
    rows = [(g, v) for g, x in GROUPS.items() for v in x] + [("ties", float("nan")), ("ties", float("inf")), ("none", None)]
    R.shuffle(rows)
    got = {r["g"]: r["median"] for r in medians(spark.createDataFrame(rows, "g string, v double"), "g", "v", at_once, bins).collect()}
    assert got == {g: pytest.approx(median(x), rel=1e-15, abs=1e-323) for g, x in GROUPS.items()}


def test_medians_of_several_keys(spark):
    df = spark.range(1000).selectExpr("id % 2 as a", "id % 3 as b", "cast(id * 7919 % 1000 as double) as v", "1 as _x")
    got = {(r["a"], r["b"]): r["median"] for r in medians(df, ["a", "b"], "v", 10, 8).collect()}
    want: dict = {}
    for i in range(1000):
        want.setdefault((i % 2, i % 3), []).append(i * 7919 % 1000)
    assert got == {k: median(v) for k, v in want.items()}


def test_medians_of_nothing(spark):
    assert medians(spark.createDataFrame([], "g string, v double"), "g", "v").collect() == []
