"""Kernels and tables give the same values after the same rounds."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tarnfold.operators import coloring, solvers
from tarnfold.operators.bellman import Affine, PolicyEvaluation
from tarnfold.operators.frontier import Frontier
from tarnfold.operators.halo import Halo
from tarnfold.operators.rounds import Colors
from tarnfold.operators.solvers import SolverConfig, iterate, solve, solve_plan
from tarnfold.plans import planners
from tarnfold.plans.planners import PlannerConfig
from tarnfold.plans.schedulers import Scheduler
from tarnfold.sources import generators as gen


def values(df):
    return np.array([r["v"] for r in df.orderBy("state").collect()])


MODES = {
    "jacobi": ({}, None),
    "damped": ({"alpha": 0.7}, None),
    "gauss_seidel": ({"mode": "gauss_seidel"}, None),
    "colored": ({"mode": "colored"}, None),
    "colored_damped": ({"mode": "colored", "alpha": 0.8}, None),
    "frontier": ({"mode": "frontier"}, None),
    "async_1": ({"mode": "async", "threads": 1}, None),
    "async_4": ({"mode": "async", "threads": 4, "local_sweeps": 2, "alpha": 0.9}, None),
    "static": ({"mode": "async", "threads": 4, "stale": 4}, Scheduler("static")),
    "shuffled": ({"mode": "async", "threads": 4, "stale": 5, "rebuild_every": 2}, Scheduler("shuffled")),
    "topk": ({"mode": "async", "threads": 2, "stale": 16}, Scheduler("topk", K=5)),
    "ca_topk": ({"mode": "async", "threads": 2, "stale": 16}, Scheduler("ca_topk", K=9, groups=3, block_size=4)),
    "buckets": ({"mode": "async", "threads": 3, "stale": 6, "rebuild_every": 0}, Scheduler("buckets")),
}


CASES = [(name, 2) for name in sorted(MODES)] + [(name, k) for name in ("jacobi", "colored", "frontier", "async_4", "topk") for k in (1, 5)]


@pytest.mark.parametrize("name,rounds", CASES)
def test_rounds_agree(spark, name, rounds):
    m = gen.grid(spark, 6, 6, 0.9, gradient=0.5)
    more, scheduler = MODES[name]
    c = SolverConfig(eps=0.0, max_sweeps=rounds, check_every=2, **more)
    a, b = (solve(m, c, tier=t, scheduler=scheduler, block=10) for t in ("kernel", "frame"))
    assert np.allclose(values(a.values), values(b.values), atol=1e-12, rtol=0)
    assert (a.sweeps, a.total_updates) == (b.sweeps, b.total_updates) and abs(a.final_residual_inf - b.final_residual_inf) < 1e-12
    assert [t[0] for t in a.trace] == [t[0] for t in b.trace] and np.allclose([t[2] for t in a.trace], [t[2] for t in b.trace], atol=1e-12)


@pytest.mark.parametrize("planner,rounds", [("static", 1), ("colored", 2), ("priority", 5)])
def test_plans_agree(spark, planner, rounds):
    m = gen.grid(spark, 6, 6, 0.9, gradient=0.5)
    plan = planners.build(planner, spark, 36, PlannerConfig(threads=4, blk=4, colors=2, K=8))
    c = SolverConfig(eps=0.0, max_sweeps=rounds)
    a, b = (solve_plan(m, plan, c, tier=t) for t in ("kernel", "frame"))
    assert np.allclose(values(a.values), values(b.values), atol=1e-12, rtol=0) and a.total_updates == b.total_updates


def test_what_tables_cannot_follow_raises(spark):
    m = gen.grid(spark, 6, 6, 0.9)
    plan = planners.build("static", spark, 36, PlannerConfig(threads=1, blk=4))
    assert solve_plan(m, plan, SolverConfig(), tier="kernel").converged
    with pytest.raises(ValueError, match="state by state"):
        solve_plan(m, plan, SolverConfig(), tier="frame")
    with pytest.raises(ValueError, match="stale"):
        solve(gen.ring(spark, 100, 0.9), SolverConfig(mode="async", stale=1, max_sweeps=1, eps=0.0), tier="frame", scheduler=Scheduler("shuffled"))


@pytest.mark.parametrize("mode", ["jacobi", "gauss_seidel", "colored", "async", "frontier"])
def test_a_start_at_eps(spark, mode):
    """Zeros of a ring with rewards 1 have a residual of exactly 1."""
    m = gen.ring(spark, 8, 0.9)
    a, b = (solve(m, SolverConfig(mode=mode, eps=1.0, threads=2), tier=t) for t in ("kernel", "frame"))
    assert a.sweeps == b.sweeps and (a.sweeps > 0) == (mode in ("jacobi", "gauss_seidel", "colored"))
    x = m.zeros().withColumn("v", F.lit(10.0))
    for t in ("kernel", "frame"):
        found = solve(m, SolverConfig(mode=mode, eps=1e-9, threads=2), x, tier=t)
        assert found.sweeps == 0 and found.converged


@pytest.mark.parametrize("family", ["grid", "star", "chain", "random", "ring", "lonely"])
def test_colors_are_greedy_and_proper(spark, family):
    models = {"grid": lambda: gen.grid(spark, 7, 9, 0.9), "star": lambda: gen.star(spark, 60, 0.9), "chain": lambda: gen.chain(spark, 80, 0.9), "random": lambda: gen.random_sparse(spark, 90, 4, 0.9), "ring": lambda: gen.ring(spark, 33, 0.9), "lonely": lambda: gen.ring(spark, 1, 0.9)}
    m = models[family]()
    found = {r["state"]: r["color"] for r in coloring.colors(m).collect()}
    near = {}
    for r in m.transitions.where("src != dst and p != 0").collect():
        near.setdefault(r["src"], set()).add(r["dst"])
        near.setdefault(r["dst"], set()).add(r["src"])
    n = m.size()
    from tarnfold.functions import draw_numbers

    priority, want = draw_numbers(np.arange(n), 0, 42), {}
    for i in sorted(range(n), key=lambda i: (-priority[i], -i)):
        used = {want[j] for j in near.get(i, ()) if j in want}
        want[i] = next(c for c in range(n) if c not in used)
    assert found == want
    assert all(found[i] != found[j] for i in near for j in near[i])


def test_dense_models_have_too_many_colors(spark):
    with pytest.raises(ValueError, match="colours"):
        coloring.colors(gen.metastable(spark, 20, 0.9), most=8)


def test_a_colored_sweep_has_a_job_for_each_color(spark):
    m = gen.grid(spark, 8, 8, 0.9)
    s = Colors(m, PolicyEvaluation(m), m.zeros(), coloring.colors(m), 1.0)
    made = s.trail.made
    s.advance(0)
    assert s.trail.made - made == len(s.models) <= 6
    s.end()


def test_a_round_sends_only_the_halo(spark):
    """Blocks of whole lines of a grid read one line of each neighbour."""
    m = gen.grid(spark, 16, 10, 0.9)
    s = Halo(m, PolicyEvaluation(m), m.zeros(), 4, 3, 1.0)
    s.look()
    assert s.sent == 2 * 3 * 10 and s.n == 160
    s.advance(0)
    plan = s.round_plan()._jdf.queryExecution().toString()
    s.end()
    assert "Bucketed: true" in plan
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 1 or all("Broadcast" in line for line in shuffled), shuffled


def test_a_block_too_large_raises(spark, monkeypatch):
    from tarnfold.operators import halo

    m = gen.grid(spark, 6, 6, 0.9)
    e = halo.layout(m, 2, 36)
    assert e.count() == 2
    monkeypatch.setattr(halo, "MOST_ENTRIES", 5)
    with pytest.raises(Exception, match="raise `threads`"):
        solve(m, SolverConfig(mode="async", threads=2), tier="frame")


def test_a_frontier_touches_what_changes(spark):
    """After one reward has changed, the values near it are all that is updated."""
    n = 400
    m = gen.chain(spark, n, 0.5)
    old = solve(m, SolverConfig(eps=1e-12), tier="kernel").values
    changed = type(m)(m.transitions, m.rewards.withColumn("r", F.when(F.col("state") == 200, 2.0).otherwise(F.col("r"))), m.beta)
    c = SolverConfig(mode="frontier", eps=1e-6)
    s = Frontier(PolicyEvaluation(changed), old, c.eps, 1.0)
    found = solvers.follow(s, c)
    assert found.converged and s.pushed[0] == 1 and max(s.pushed) < 40 and found.total_updates < n * found.sweeps / 10
    want = values(solve(changed, SolverConfig(eps=1e-12), tier="kernel").values)
    assert np.abs(values(found.values) - want).max() <= 1e-6 / 0.5


def test_any_linear_contraction_is_pushed(spark):
    a = spark.createDataFrame([("p", "q", 0.4), ("q", "p", 0.25), ("q", "q", 0.25)], "row string, col string, a double")
    b = spark.createDataFrame([("p", 1.0), ("q", 2.0), ("alone", 5.0)], "state string, b double")
    x = b.select("state", F.lit(0.0).alias("v"))
    for mode in ("jacobi", "frontier"):
        found = iterate(Affine(a, b), x, SolverConfig(mode=mode, eps=1e-10))
        got = {r["state"]: r["v"] for r in found.values.collect()}
        q = (2 + 0.25) / (1 - 0.25 - 0.1)
        assert found.converged and abs(got["q"] - q) < 1e-8 and abs(got["p"] - (1 + 0.4 * q)) < 1e-8 and got["alone"] == 5.0
    with pytest.raises(ValueError):
        iterate(Affine(a, b), x, SolverConfig(mode="colored"))
