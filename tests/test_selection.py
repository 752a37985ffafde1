"""Selections and ranks against sorting everything."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tarnfold.plans import planners, schedulers, selection


def frame(spark, residuals):
    return spark.createDataFrame(list(enumerate(map(float, residuals))), "state long, residual double").repartition(3)


def brute(residuals, k):
    r = np.array([round(x, 9) if abs(x) < 1e15 else x for x in map(float, residuals)])
    r = np.where(np.isnan(r), -np.inf, r)
    return sorted(range(len(r)), key=lambda i: (-r[i], i))[:k]


RNG = np.random.default_rng(5)
CASES = {
    "spread": RNG.random(500) * 10.0 ** RNG.integers(-8, 9, 500),
    "ties": RNG.integers(0, 4, 500),
    "equal": np.ones(300),
    "one_large": np.r_[np.full(200, 1e-9), 1e18],
    "odd": np.r_[np.nan, np.inf, 0.0, 1e300, np.nan, np.inf, 5.0, 5.0 + 1e-10],
    "close": 1.0 + np.arange(40) * 1e-9,
    "none": [],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_the_largest_by_brute_force(spark, name):
    rows = frame(spark, CASES[name])
    n = len(CASES[name])
    for k in sorted({0, 1, 3, n // 3, n}):
        assert sorted(r["state"] for r in selection.largest(rows, "residual", k).collect()) == sorted(brute(CASES[name], k)), k


def test_a_hot_set_is_ranked_without_a_window(spark):
    x = CASES["ties"]
    hot = schedulers.topk(frame(spark, x), len(x), 1, 200)
    assert [r["state"] for r in hot.orderBy("pos").collect()] == brute(x, 200) and sorted(r["pos"] for r in hot.collect()) == list(range(200))
    plan = hot._jdf.queryExecution().toString()
    assert "Window" not in plan and "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_a_bucket_of_all_states_spans_many_tasks(spark):
    n = 5000
    rows = spark.range(n).select(F.col("id").alias("state"), F.when(F.col("id") % 1000 == 0, 99.0).otherwise(3.0).alias("residual"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are put together
    try:
        found = schedulers.residual_buckets(rows, 1.0, 8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["state"] for r in found.orderBy("pos").collect()] == [*range(0, n, 1000), *[i for i in range(n) if i % 1000]]
    shares = [r["count"] for r in found.groupBy(F.input_file_name().alias("file")).count().collect()]
    assert len(shares) >= 4 and max(shares) < n / 2  # a file for each range


def test_weights_before_each_row(spark):
    rng = np.random.default_rng(1)
    score, size = rng.integers(0, 5, 300), rng.integers(1, 9, 300)
    rows = spark.createDataFrame([(i, float(s), 0, int(w)) for i, (s, w) in enumerate(zip(score, size))], "b long, score double, begin long, end long")
    order = sorted(range(300), key=lambda i: (-score[i], i))
    before = dict(zip(order, np.cumsum([0, *size[order]])[:-1].tolist()))
    hot = planners.hot_blocks(rows, 400)
    assert {r["b"]: r["covered"] for r in hot.collect()} == {b: c for b, c in before.items() if c < 400}


def test_places_inside_groups(spark):
    rows = spark.createDataFrame([(i, i % 3 if i < 100 else 2) for i in range(400)], "state long, g int")
    found = selection.ranked_within(rows, "g", [F.col("state").desc()])
    want = {}
    for g in range(3):
        mine = sorted((i for i in range(400) if (i % 3 if i < 100 else 2) == g), reverse=True)
        want |= {i: k for k, i in enumerate(mine)}
    assert {r["state"]: r["own"] for r in found.collect()} == want
