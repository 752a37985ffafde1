"""Dispatch orders, plans, costs and tuning on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from tarnfold.functions import residual_bucket
from tarnfold.plans import autotune, cost, planners, schedulers
from tarnfold.plans.planners import PlannerConfig
from tarnfold.sources import generators as gen


def residuals(spark, xs):
    return spark.createDataFrame(list(enumerate(map(float, xs))), "state long, residual double")


def order(df):
    return [r["state"] for r in df.orderBy("pos").collect()]


def test_buckets_dispatch_the_highest_first(spark):
    rs = residuals(spark, [0.5] * 4 + [2] * 4 + [5] * 4 + [100] * 4)
    assert order(schedulers.residual_buckets(rs, 1.0, 4)) == [*range(12, 16), *range(8, 12), *range(4, 8), *range(4)]
    assert order(schedulers.residual_buckets(residuals(spark, [0.0] * 5), 1.0, 4)) == list(range(5))
    rows = residuals(spark, [float("nan"), 0.5, 1, 2, 3.9, 4, 1e30]).select(residual_bucket(F.col("residual"), 1.0, 5).alias("b"), "state").orderBy("state").collect()
    assert [r["b"] for r in rows] == [0, 0, 0, 1, 1, 2, 4]


def test_hot_sets(spark):
    rs = residuals(spark, [0.1] * 90 + [10] * 10)
    assert order(schedulers.topk(rs, 100, k=10)) == list(range(90, 100))
    assert order(schedulers.conflict_aware_topk(rs, 100, k=10, groups=4, block_size=25)) == list(range(90, 100))
    rising = residuals(spark, range(1, 1001))
    found = order(schedulers.conflict_aware_topk(rising, 1000, k=100, groups=8, block_size=128))
    assert sorted(found) == list(range(900, 1000))
    assert schedulers.hot_size(1000, 1) == 256 and schedulers.hot_size(100, 1) == 100 and schedulers.hot_size(10**6, 4) == 10_000


@pytest.mark.parametrize("n, t", [(10, 3), (16, 4), (7, 5), (3, 4), (100, 4)])
def test_blocks_cover_each_state_once(spark, n, t):
    states = spark.range(n).select(F.col("id").alias("state"))
    rows = schedulers.static_blocks(states, n, t).collect()
    assert sorted(r["state"] for r in rows) == list(range(n))
    sizes = [sum(r["tid"] == i for r in rows) for i in range(t)]
    assert sizes == [n // t + (i < n % t) for i in range(t)]
    for e in (0, 1):
        shuffled = schedulers.shuffled_blocks(states, n, t, e).collect()
        assert {(r["tid"], r["state"]) for r in shuffled} == {(r["tid"], r["state"]) for r in rows}
    cover = schedulers.topk_then_coverage(states.withColumn("residual", F.col("state").cast("double")), n, t, 2)
    assert cover.where("pass = 1").count() == n and cover.where("pass = 0").count() == min(2, n)


def test_plan_shapes(spark):
    p = planners.static_plan(spark, 60, PlannerConfig(threads=2, blk=10))
    m = planners.phase_metrics(p).head()
    assert (m["total_updates"], m["max_thread_updates"]) == (60, 30)
    assert planners.summary(planners.static_plan(spark, 16, PlannerConfig(threads=1, blk=4))).head()["total_updates"] == 16
    assert planners.colored_plan(spark, 16, PlannerConfig(threads=2, blk=4, colors=2)).phases.count() == 2
    empty = planners.colored_plan(spark, 4, PlannerConfig(threads=2, blk=4, colors=3))
    assert [r["total_updates"] for r in planners.phase_metrics(empty).orderBy("phase").collect()] == [4, 0, 0]


def test_priority_plan(spark):
    rs = residuals(spark, [0.1] * 90 + [10] * 10)
    p = planners.priority_plan(spark, 100, PlannerConfig(threads=2, blk=10, colors=2, K=15), rs)
    tasks = p.tasks.orderBy("phase", "tid", "seq").collect()
    hot = [t for t in tasks if t["weight"] != t["end"] - t["begin"]]
    assert {t["conflict_key"] for t in hot} == {0, 9}  # the best block, then the first of equals
    assert sorted(t["conflict_key"] for t in tasks if t not in hot) == list(range(10))
    none = planners.priority_plan(spark, 100, PlannerConfig(threads=2, blk=10, colors=2, hot_phase_enabled=False), rs)
    assert none.tasks.count() == 10
    without = planners.priority_plan(spark, 100, PlannerConfig(threads=2, blk=10, colors=2, K=15), None)
    assert without.tasks.where("weight = 0").count() == 2


def test_costs(spark):
    m = gen.grid(spark, 32, 32, 0.9)
    found = {}
    for name, p in {"static": planners.static_plan(spark, 1024, PlannerConfig(threads=4, blk=64)), "colored": planners.colored_plan(spark, 1024, PlannerConfig(threads=4, blk=64, colors=4, barrier_between_colors=True))}.items():
        p = cost.weighted(p, m.degrees())
        found[name] = cost.estimate(p.tasks, p.phases).head()
    assert found["static"]["phase_cost"] == 100 and found["colored"]["phase_cost"] == 400
    assert found["static"]["barrier_cost"] == 0 and found["colored"]["barrier_cost"] == 2000
    assert found["static"]["work"] == found["colored"]["work"] == m.transitions.count()
    timed = cost.estimate(planners.static_plan(spark, 1024, PlannerConfig(threads=4, blk=64)).tasks, spark.createDataFrame([(0, False)], "phase int, barrier_after boolean"), cost.CostModel(measured_update_ns=2.0)).head()
    assert timed["work"] == 2048


def test_candidates():
    assert len(autotune.candidate_list(10_000, autotune.AutotuneConfig())) == 80
    assert {c[2] for c in autotune.candidate_list(100, autotune.AutotuneConfig())} == {64}
    with pytest.raises(ValueError):
        autotune.candidate_list(10, autotune.AutotuneConfig())


def test_entries_of_any_range(spark):
    from tarnfold.plans import cost

    nnz = [3, 0, 5, 1, 0, 0, 7, 2, 4, 1]
    degrees = spark.createDataFrame(list(enumerate(nnz)), "state long, nnz long").repartition(3)
    ranges = [(0, 10), (0, 0), (3, 3), (1, 2), (2, 7), (9, 10), (-5, 4), (8, 99), (7, 2), (4, 6), (2, 7)]
    tasks = spark.createDataFrame([(0, i, a, b, -1.0) for i, (a, b) in enumerate(ranges)], "phase int, seq int, begin long, end long, weight double")
    found = {r["seq"]: r["weight"] for r in cost.weighted_ranges(tasks, degrees, 10).collect()}
    assert found == {i: float(sum(nnz[max(a, 0) : max(b, 0)])) for i, (a, b) in enumerate(ranges)}
