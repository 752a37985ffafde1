"""Generators, validation and the operator."""

import pytest
from pyspark.sql import functions as F

from tarnfold.model import Mdp, check, violations
from tarnfold.operators import bellman
from tarnfold.sources import generators as gen


@pytest.mark.parametrize(
    "make",
    [
        lambda s: gen.ring(s, 16, 0.9),
        lambda s: gen.ring(s, 1, 0.9),
        lambda s: gen.grid(s, 1, 2, 0.9),
        lambda s: gen.grid(s, 16, 16, 0.9, gradient=0.5),
        lambda s: gen.metastable(s, 32, 0.9),
        lambda s: gen.metastable(s, 1, 0.9),
        lambda s: gen.star(s, 100, 0.9),
        lambda s: gen.star(s, 2, 0.9),
        lambda s: gen.chain(s, 100, 0.9, 0.1, 0.3, 0.6, "quadratic"),
        lambda s: gen.chain(s, 1, 0.9),
        lambda s: gen.chain(s, 50, 0.9, reflecting=False),
        lambda s: gen.random_sparse(s, 200, 5, 0.9),
        lambda s: gen.random_sparse(s, 3, 50, 0.9),
        lambda s: gen.multi_cluster(s, 100, 4, 0.9, rewards=[1, 2, 3, 4]),
    ],
)
def test_generated_models_are_valid(spark, make):
    m = make(spark)
    assert violations(m).count() == 0
    check(m)


def test_one_cluster_is_not_stochastic(spark):
    m = gen.multi_cluster(spark, 10, 1, 0.9)
    assert {(r["check"], round(r["value"], 9)) for r in violations(m).collect()} == {("row sum", 0.9)}
    assert violations(m, strict=False).count() == 0


def test_random_rows_are_distinct_sorted_and_seeded(spark):
    m = gen.random_sparse(spark, 300, 7, 0.9, seed=1)
    rows = m.transitions.orderBy("src", "ord").collect()
    by_src = {}
    for r in rows:
        by_src.setdefault(r["src"], []).append(r["dst"])
    assert len(by_src) == 300
    assert all(d == sorted(set(d)) and len(d) == 7 for d in by_src.values())
    again = gen.random_sparse(spark, 300, 7, 0.9, seed=1).transitions.orderBy("src", "ord").collect()
    other = gen.random_sparse(spark, 300, 7, 0.9, seed=2).transitions.orderBy("src", "ord").collect()
    assert rows == again and rows != other


def test_a_grid_of_one_state_is_refused(spark):
    with pytest.raises(ValueError):
        gen.grid(spark, 1, 1, 0.9)


@pytest.mark.parametrize("entries, beta, what", [([(0, 0, 1.0)], 0.0, "beta"), ([(0, 0, 1.0)], 1.0, "beta"), ([(0, 3, 1.0)], 0.9, "dst"), ([(0, 0, 0.5)], 0.9, "row sum"), ([], 0.9, "row sum"), ([(0, 0, float("nan"))], 0.9, "p outside"), ([(0, 0, -0.5), (0, 0, 1.5)], 0.9, "p outside")])
def test_violations(spark, entries, beta, what):
    t = spark.createDataFrame([(*e, i) for i, e in enumerate(entries)], "src long, dst long, p double, ord int")
    m = Mdp(t, spark.createDataFrame([(0, 1.0)], "state long, r double"), beta)
    assert any(r["check"].startswith(what) for r in violations(m).collect())
    with pytest.raises(ValueError):
        check(m)


def test_hand_computed_residuals(spark):
    m = gen.ring(spark, 4, 0.5)
    x = m.rewards.select("state", (F.col("state") + 1).cast("double").alias("v"))
    found = {r["state"]: r["residual"] for r in bellman.residuals(m, x).collect()}
    assert [round(found[i], 12) for i in range(4)] == [0.75, 0.25, 0.25, 1.75]
    assert bellman.residual_inf(m, x).head()[0] == pytest.approx(1.75, abs=1e-12)
    assert bellman.residual_inf(m, x, 2).head()[0] == pytest.approx(0.75, abs=1e-12)


def test_empty_rows_give_their_reward_and_nan_is_ignored(spark):
    t = spark.createDataFrame([(0, 1, 1.0, 0)], "src long, dst long, p double, ord int")
    m = Mdp(t, spark.createDataFrame([(0, 1.0), (1, 5.0)], "state long, r double"), 0.5)
    x = spark.createDataFrame([(0, float("nan")), (1, 2.0)], "state long, v double")
    found = {r["state"]: r["fv"] for r in bellman.backup(m, x).collect()}
    assert found == {0: 2.0, 1: 5.0}
    assert bellman.residual_inf(m, x).head()[0] == 3.0
    assert bellman.largest(bellman.residuals(m, x).where("false")).head()[0] == 0.0


@pytest.mark.parametrize("n,k", [(5, 2), (40, 6), (3, 9), (1, 1)])
def test_free_draws_are_distinct_and_repeated_by_sql(spark, n, k):
    import duckdb

    from tarnfold.functions import draw_sql

    m = gen.random_sparse(spark, n, k, 0.9, free=True)
    k = min(k, n)
    found = {}
    for r in m.transitions.collect():
        found.setdefault(r["src"], []).append((r["ord"], r["dst"]))
    found = {i: [c for _, c in sorted(x)] for i, x in found.items()}
    t = f"({draw_sql('i', 'k', 42)}) % ({n - k} + k + 1)"
    sql = f"SELECT i, list_sort(list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(range({k}), lambda k: [{n - k} + k, {t}])), lambda s, x: list_append(s, CASE WHEN list_contains(s, x[2]) THEN x[1] ELSE x[2] END))) FROM (SELECT range AS i FROM range({n}))"
    assert found == {i: c for i, c in duckdb.sql(sql).fetchall()}
    assert all(len(set(c)) == k and c == sorted(c) for c in found.values()) and violations(m).count() == 0


def test_free_draws_reach_every_set(spark):
    sets = set()
    for seed in range(12):
        rows = gen.random_sparse(spark, 5, 2, 0.9, seed=seed, free=True).transitions.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("c")).collect()
        sets |= {tuple(r["c"]) for r in rows}
    assert len(sets) == 10
