"""All solvers give one answer; budgets, damping, plans."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tarnfold.model import Mdp
from tarnfold.operators import kernels, solvers
from tarnfold.operators.bellman import Affine
from tarnfold.operators.solvers import Run, SolverConfig, solve, solve_many
from tarnfold.plans import planners
from tarnfold.plans.planners import PlannerConfig
from tarnfold.plans.schedulers import Scheduler
from tarnfold.profiling import profile
from tarnfold.sources import generators as gen


def values(df):
    return np.array([r["v"] for r in df.orderBy("state").collect()])


def test_ring_has_its_analytic_value(spark):
    for mode in solvers.MODES:
        s = solve(gen.ring(spark, 16, 0.9), SolverConfig(mode=mode, eps=1e-9, threads=4))
        assert s.converged and np.allclose(values(s.values), 10, atol=1e-7)
        assert s.trace[0][0] == 0 and s.trace[-1][2] == s.final_residual_inf
        assert s.total_updates == 16 * s.sweeps * (4 if mode == "async" else 1)
        assert sum(u for _, u, _ in s.counters) == s.total_updates and s.scans[0] >= s.sweeps


def test_families_modes_and_plans_agree(spark):
    models = {"grid": gen.grid(spark, 8, 8, 0.9, gradient=0.5), "meta": gen.metastable(spark, 32, 0.9), "star": gen.star(spark, 40, 0.9), "chain": gen.chain(spark, 50, 0.9, reward="quadratic"), "random": gen.random_sparse(spark, 60, 5, 0.9), "clusters": gen.multi_cluster(spark, 40, 4, 0.9)}
    configs = {"jacobi": SolverConfig(eps=1e-9), "damped": SolverConfig(eps=1e-9, alpha=0.6), "gs": SolverConfig(mode="gauss_seidel", eps=1e-9), "async": SolverConfig(mode="async", eps=1e-9, threads=3), "one": SolverConfig(mode="async", eps=1e-9, threads=1, local_sweeps=1)}
    rows = solve_many({f"{m}/{c}": (models[m], configs[c]) for m in models for c in configs}).toPandas()
    for m in models:
        found = {c: rows[rows.run_id == f"{m}/{c}"].sort_values("state").v.to_numpy() for c in configs}
        for c in configs:
            assert np.abs(found[c] - found["jacobi"]).max() <= 2e-9 / (1 - 0.9), (m, c)
    plan = planners.colored_plan(spark, 64, PlannerConfig(threads=4, blk=4, colors=4))
    grid = values(solvers.run_plan(models["grid"], plan.tasks, 4, 200))
    assert np.allclose(grid, rows[rows.run_id == "grid/jacobi"].sort_values("state").v.to_numpy(), atol=1e-7)


def test_table_tier_equals_kernel(spark):
    m = gen.chain(spark, 12, 0.5, reward="linear")
    exact = values(solve(m, SolverConfig(eps=1e-10)).values)
    for config in (SolverConfig(eps=1e-3), SolverConfig(mode="async", eps=1e-3, threads=2)):
        s = solve(m, config, tier="frame")
        assert s.converged and np.abs(values(s.values) - exact).max() <= 1e-3 / 0.5
    ordered = SolverConfig(mode="gauss_seidel", eps=0.0, max_sweeps=2)
    assert np.allclose(values(solve(m, ordered, tier="frame", block=5).values), values(solve(m, ordered).values), atol=1e-12)
    for s in (Scheduler("topk", K=3), Scheduler("buckets")):
        found, kernel = (solve(m, SolverConfig(mode="async", eps=1e-2, threads=2), tier=t, scheduler=s) for t in ("frame", "kernel"))
        assert found.converged and np.abs(values(found.values) - exact).max() <= 1e-2 / 0.5 and found.total_updates == kernel.total_updates >= 12 * found.sweeps
    plan = planners.colored_plan(spark, 12, PlannerConfig(threads=2, blk=3, colors=2))
    epochs = SolverConfig(eps=0.0, max_sweeps=2)
    tables = solvers.solve_plan(m, plan, epochs, tier="frame")
    assert np.allclose(values(tables.values), values(solvers.solve_plan(m, plan, epochs).values), atol=1e-12)


KINDS = [Scheduler("static"), Scheduler("shuffled"), Scheduler("topk", K=5), Scheduler("ca_topk", K=9, groups=3, block_size=4), Scheduler("buckets")]


@pytest.mark.parametrize("s", KINDS, ids=lambda s: s.kind)
def test_schedulers_drive_the_solver(spark, s):
    """Every family, from a model's residuals to its fixed point, with rebuilds."""
    models = {"grid": gen.grid(spark, 6, 7, 0.9, gradient=0.5), "meta": gen.metastable(spark, 32, 0.9), "star": gen.star(spark, 40, 0.9), "chain": gen.chain(spark, 50, 0.9, reward="quadratic"), "random": gen.random_sparse(spark, 60, 5, 0.9), "clusters": gen.multi_cluster(spark, 40, 4, 0.9)}
    runs = {f"{m}/{t}/{e}": Run(models[m], SolverConfig(mode="async", eps=1e-8, threads=t, stale=3, rebuild_every=e, alpha=a), s) for m in models for t, e, a in ((1, 1, 1.0), (4, 3, 0.7))}
    rows = solve_many(runs | {m: (models[m], SolverConfig(eps=1e-10)) for m in models}).toPandas()
    for name in runs:
        found, want = (rows[rows.run_id == x].sort_values("state").v.to_numpy() for x in (name, name.split("/")[0]))
        assert np.abs(found - want).max() <= 3e-8 / 0.1, name


@pytest.mark.parametrize("s", KINDS, ids=lambda s: s.kind)
def test_tables_and_arrays_dispatch_alike(spark, s):
    residuals = np.round(np.random.default_rng(1).random(23) * 4, 1)
    rows = s.dispatch(spark.createDataFrame(list(enumerate(residuals.tolist())), "state long, residual double"), 23, 3, 2).collect()
    passes = s.order(residuals, 3, 2)
    assert len(passes) == len({r["pass"] for r in rows})
    for p, queues in zip(sorted({r["pass"] for r in rows}), passes, strict=True):
        mine = sorted((r["tid"] or 0, r["pos"], r["state"]) for r in rows if r["pass"] == p)
        if any(r["tid"] is None for r in rows if r["pass"] == p):
            dealt = [[x[2] for x in mine][t::3] for t in range(3)]
        else:
            dealt = [[x[2] for x in mine if x[0] == t] for t in range(3)]
        assert [q.tolist() for q in queues] == dealt


def test_plan_runs_tell_what_they_did(spark):
    m = gen.grid(spark, 8, 8, 0.9)
    for threads, planner in ((1, "static"), (4, "colored"), (4, "priority")):
        plan = planners.build(planner, spark, 64, PlannerConfig(threads=threads, blk=8, colors=4, K=16))
        s = solvers.solve_plan(m, plan, SolverConfig(eps=1e-6))
        assert s.converged and s.trace[0][0] == 0 and s.trace[-1][2] == s.final_residual_inf <= 1e-6
        assert len(s.counters) == threads and sum(u for _, u, _ in s.counters) == s.total_updates
        p = profile(s.counters_frame("r"), s.scans_frame("r")).head()
        assert p["updates"] == s.total_updates and p["avg_update_cost_ns"] > 0 and p["avg_residual_scan_ns"] > 0


def test_own_planner_and_checks(spark):
    class Backwards:
        def build(self, spark, n, config, residuals):
            p = planners.static_plan(spark, n, config)
            return planners.Plan(p.tasks.withColumn("seq", -F.col("seq")), p.phases, n, config, "backwards")

    m = gen.chain(spark, 20, 0.9)
    s = solvers.solve_plan(m, planners.build(Backwards(), spark, 20, PlannerConfig(threads=1, blk=4)), SolverConfig(eps=1e-9))
    assert np.allclose(values(s.values), values(solve(m, SolverConfig(eps=1e-11)).values), atol=1e-7)
    with pytest.raises(ValueError):
        solve(Mdp(m.transitions, m.rewards, 1.0), SolverConfig(verify=True))


def test_a_start_at_eps(spark):
    m = gen.ring(spark, 4, 0.5)  # residual 1 at the start
    assert solve(m, SolverConfig(eps=1.0)).sweeps == 1
    assert solve(m, SolverConfig(mode="async", eps=1.0)).sweeps == 0


def test_large_models_are_refused(spark, monkeypatch):
    monkeypatch.setattr(solvers, "KERNEL_ENTRIES", 10)
    m = gen.ring(spark, 64, 0.5)
    with pytest.raises(Exception, match="use the frame tier"):  # in the task: counting first would make every model twice
        solve_many({"run": (m, SolverConfig())}).collect()
    assert solve(m, SolverConfig(eps=0.4)).converged  # over tables


def test_any_contraction(spark):
    a = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.25)], "row long, col long, a double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "state long, b double")
    s = solvers.iterate(Affine(a, b), b.selectExpr("state", "0D as v"), SolverConfig(eps=1e-4))
    assert np.allclose(values(s.values), np.linalg.solve([[1, -0.5], [-0.25, 1]], [1, 2]), atol=1e-3)


def test_budgets(spark):
    m = gen.ring(spark, 16, 0.99)
    s = solve(m, SolverConfig(eps=1e-12, max_sweeps=SolverConfig.sweeps_for(100, 16)))
    assert not s.converged and s.sweeps == 7 and s.total_updates == 112
    s = solve(m, SolverConfig(eps=0.0, max_sweeps=10, check_every=4))
    assert [t[0] for t in s.trace] == [0, 4, 8, 10]
    assert not solve(m, SolverConfig(eps=-1.0, max_seconds=0.05)).converged
    for alpha in (0.0, 1.5):
        with pytest.raises(ValueError):
            SolverConfig(alpha=alpha)
    with pytest.raises(ValueError):
        SolverConfig(mode="other")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10_000))
def test_levels_equal_one_by_one(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.random((n, n)) * (rng.random((n, n)) < 0.4)
    src, dst = np.nonzero(a)
    m = kernels.Csr(src, dst, a[src, dst] / n, rng.random(n), 0.9)
    order = rng.permutation(n)
    order = order[: rng.integers(1, n + 1)]
    x = rng.random(n)
    y = x.copy()
    kernels.Levels(m, order).sweep(x, 0.8)
    for i in order:
        y[i] = 0.2 * y[i] + 0.8 * m.apply_one(int(i), y)
    assert np.allclose(x, y)
