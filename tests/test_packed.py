"""Packed rounds give the frontier's values, over any number of blocks."""

import numpy as np
import pytest

from tarnfold.operators import packed
from tarnfold.operators.bellman import Affine
from tarnfold.operators.frontier import Frontier
from tarnfold.operators.packed import Packed
from tarnfold.operators.solvers import SolverConfig, iterate

IDS = [-(2**63), -7, 0, 1, 2, 16, 2**40, 2**63 - 1]


def model(spark, mirrored):
    rng = np.random.default_rng(3)
    at = [(i, j, float(rng.integers(1, 9))) for i in range(8) for j in range(8) if rng.random() < 0.5]
    at += at[:5] + [(0, 0, 2.0)]  # repeated entries add up
    m = np.zeros((8, 8))
    for i, j, c in at:
        m[i, j] += c
        if mirrored:
            m[j, i] += c
    scale = 0.5 / np.maximum(m.sum(0), 1)
    a = spark.createDataFrame([(IDS[i], IDS[j], c) for i, j, c in at] + [(5, 1, 9.0), (1, 5, 9.0)], "row long, col long, a double")  # 5 is no state
    b = spark.createDataFrame([(IDS[i], 1.0 + i, float(scale[i])) for i in range(8)], "state long, b double, scale double")
    x = spark.createDataFrame([(i, 0.0) for i in IDS], "state long, v double")
    return Affine(a, b, 0.5 if mirrored else 0.0, mirrored), x, np.linalg.solve(np.eye(8) - m * scale, np.arange(1.0, 9.0))


def by_state(df):
    return {r["state"]: r["v"] for r in df.collect()}


@pytest.mark.parametrize("mirrored,least,gathered", [(True, 250_000, 1_000_000), (True, 4, 3), (False, 4, 3)])
def test_values(spark, monkeypatch, mirrored, least, gathered):
    monkeypatch.setattr(packed, "LEAST", least)
    monkeypatch.setattr(packed, "GATHERED", gathered)
    op, x, exact = model(spark, mirrored)
    found = iterate(op, x, SolverConfig(mode="frontier", eps=1e-8), packed=True)
    assert found.converged and len(found.trace) == found.sweeps + 1
    values = by_state(found.values)  # after the run's own tables are gone
    assert np.allclose([values[i] for i in IDS], exact, atol=1e-7, rtol=0) and len(values) == 8
    again = by_state(op.apply(found.values.select("state", "v")).withColumnRenamed("fv", "v"))
    assert all(abs(again[i] - values[i]) < 1e-7 for i in IDS)


def test_rounds_agree_and_move_rows_of_blocks(spark, monkeypatch):
    """The same rounds as over tables, whose rows are blocks and not states."""
    monkeypatch.setattr(packed, "LEAST", 4)
    op, x, _ = model(spark, True)
    a, b = Packed(op, x, 1e-3, 1.0), Frontier(op, x, 1e-3, 1.0)
    assert len(a.names) > 1
    for k in range(3):
        one, two = a.look(), b.look()
        assert abs(one.residual - two.residual) < 1e-12 and one.states == two.states == 8
        assert a.advance(k) == b.advance(k)
    assert 1 < a.rows.count() <= len(a.names) and a.tiles.count() <= len(a.names) ** 2
    one, two = by_state(a.values()), by_state(b.values())
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-12 for i in one)
    a.end(), b.end()


def test_each_block_has_a_bucket(spark):
    from pyspark.sql import functions as F

    for n in (1, 7, 67):
        names = packed.labels(spark, n)
        found = spark.createDataFrame([(int(i),) for i in names], "id long").select(F.pmod(F.hash("id"), F.lit(n)).alias("k"))
        assert sorted(r["k"] for r in found.collect()) == list(range(n))


def test_large_amounts_stay_exact(spark):
    """2^24 + 1 and 0.1 need eight bytes."""
    a = spark.createDataFrame([(0, 1, 0.1), (1, 0, 2.0**24 + 1)], "row long, col long, a double")
    b = spark.createDataFrame([(0, 1.0, 1.0 / 2**26), (1, 2.0, 1.0)], "state long, b double, scale double")
    found = by_state(iterate(Affine(a, b), b.selectExpr("state", "0D as v"), SolverConfig(mode="frontier", eps=1e-13, max_sweeps=60), packed=True).values)
    m = np.array([[0, 0.1], [(2.0**24 + 1) / 2**26, 0]])
    assert np.allclose([found[0], found[1]], np.linalg.solve(np.eye(2) - m, [1, 2]), atol=1e-11, rtol=0)  # short ones would be off by 1e-9


def test_no_states_no_entries_and_what_is_refused(spark):
    none, b = spark.createDataFrame([], "row long, col long, a double"), spark.createDataFrame([(3, 2.0), (4, 1.0)], "state long, b double")
    c = SolverConfig(mode="frontier", eps=1e-9)
    assert by_state(iterate(Affine(none, b), b.selectExpr("state", "0D as v"), c, packed=True).values) == {3: 2.0, 4: 1.0}
    empty = iterate(Affine(none, b.limit(0)), b.limit(0).selectExpr("state", "0D as v"), c, packed=True)
    assert empty.values.collect() == [] and empty.converged
    with pytest.raises(ValueError, match="affine"):
        iterate(Affine(none, b), b.selectExpr("state", "0D as v"), SolverConfig(), packed=True)
    with pytest.raises(Exception, match="twice"):
        iterate(Affine(none, b.union(b)), b.selectExpr("state", "0D as v"), c, packed=True)
