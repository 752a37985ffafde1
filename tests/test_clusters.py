"""Clusters without a matrix, against the matrix."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tarnfold.operators import clusters
from tarnfold.operators.bellman import backup
from tarnfold.operators.rounds import backed
from tarnfold.operators.solvers import SolverConfig, iterate, solve
from tarnfold.sources import generators as gen


def column(df, c):
    return np.array([r[c] for r in df.orderBy("state").collect()])


MODELS = {
    "metastable": (lambda s: clusters.metastable(s, 33, 0.9, 0.97, 0.03, 1.0, 3.0), lambda s: gen.metastable(s, 33, 0.9, 0.97, 0.03, 1.0, 3.0)),
    "four": (lambda s: clusters.multi_cluster(s, 50, 4, 0.9), lambda s: gen.multi_cluster(s, 50, 4, 0.9)),
    "one": (lambda s: clusters.multi_cluster(s, 7, 1, 0.9), lambda s: gen.multi_cluster(s, 7, 1, 0.9)),
    "single_states": (lambda s: clusters.multi_cluster(s, 6, 6, 0.5), lambda s: gen.multi_cluster(s, 6, 6, 0.5)),
}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_a_backup_equals_the_matrix(spark, name):
    op, m = (f(spark) for f in MODELS[name])
    x = op.states.select("state", (F.col("state") * 7 % 5).cast("double").alias("v"))
    want = column(backup(m, x), "fv")
    assert np.allclose(column(op.apply(x), "fv"), want, atol=1e-12)
    assert np.allclose(column(backup(op.explicit(), x), "fv"), want, atol=1e-12)


def test_the_fixed_point_equals_the_matrix(spark):
    op, m = (f(spark) for f in MODELS["metastable"])
    found = iterate(op, op.zeros(), SolverConfig(eps=1e-2))
    exact = column(solve(m, SolverConfig(eps=1e-10), tier="kernel").values, "v")
    assert found.converged and np.abs(column(found.values, "v") - exact).max() <= 1e-2 / 0.1


def test_a_million_states(spark):
    """The matrix would have 10^12 entries; the halves' values solve two equations."""
    n = 1_000_000
    op = clusters.metastable(spark, n, 0.5)
    found = iterate(op, op.zeros(), SolverConfig(eps=1e-3))
    a, b = np.linalg.solve(np.eye(2) - 0.5 * np.array([[0.95, 0.05], [0.05, 0.95]]), [1, 2])
    rows = found.values.groupBy((F.col("state") >= n // 2).alias("b")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect()
    assert found.converged and sum(r["n"] for r in rows) == n
    for r in rows:
        assert max(abs(r[c] - (b if r["b"] else a)) for c in ("lo", "hi")) <= 2e-3


def test_sweeps_join_no_states(spark, tmp_path):
    """Whatever the sizes of files, rows of all states are never broadcast: a
    sweep joins them with a row a cluster alone."""
    spark.range(3000).select("id", (F.col("id") % 3).alias("c"), F.lit(1.0).alias("w")).write.parquet(f"{tmp_path}/t")
    op = clusters.from_table(spark.read.parquet(f"{tmp_path}/t"), F.col("id"), F.col("c"), F.col("w"), F.avg("w") * 0.9, 0.5)
    x = op.zeros()
    for rows in (backed(op, x), backed(op, x.select("state", "v"))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
        assert len(joins) == 1 and "[cluster" in joins[0] and "BuildRight" in joins[0]
        assert rows.agg(F.min("fv"), F.max("fv"), F.count("*")).head() == (1.0, 1.0, 3000)
