"""Solvers: one answer by several schedules.

Two tiers. ``kernel`` solves whole models inside tasks, many models and
configurations in one job; it is for models whose packed rows fit a task.
``frame`` does each sweep as joins and aggregates over tables of any size and
cuts the lineage as it goes. ``auto`` counts the entries and takes ``kernel``
up to ``KERNEL_ENTRIES``. Both give the same values after the same rounds;
where the tables can't follow an order, ``frame`` raises.

Modes: ``jacobi``; ``gauss_seidel``, ascending; ``colored``, Gauss-Seidel in
the order of a colouring, which tables follow in a few jobs a sweep; ``async``,
blocks or a scheduler's order; ``frontier``, changes pushed from the states
that have them.
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draw_numbers
from ..lineage import cut
from ..model import Mdp
from ..plans.planners import Plan
from ..plans.schedulers import Scheduler
from ..profiling import COUNTERS, SCANS
from . import kernels
from .bellman import Affine, FixedPointOperator, PolicyEvaluation, backup, damped, residuals
from .coloring import colors
from .frontier import Frontier
from .halo import Halo
from .packed import Packed
from .rounds import Colors, Phased, Rounds, Scheduled, Synchronous

MODES = ("jacobi", "gauss_seidel", "colored", "async", "frontier")
#: Entries (16 bytes each, packed) that one task may hold.
KERNEL_ENTRIES = 20_000_000
REPORT = (
    "converged boolean, final_residual_inf double, wall_time_sec double, sweeps int, total_updates long, updates_per_sec double, "
    "trace array<struct<sweep:int,time_sec:double,residual:double>>, counters array<struct<tid:int,updates:long,ns:long>>, scans long, scan_ns long"
)
REPORT_TYPE = "struct<" + ",".join(x if "<" in x else x.replace(" ", ":") for x in REPORT.replace(" array", ":array").split(", ")) + ">"
VALUES = f"run_id string, state long, v double, report {REPORT_TYPE}"


@dataclass(frozen=True)
class SolverConfig:
    """``max_sweeps`` and ``max_seconds`` of 0 mean no limit. ``threads`` is
    the number of blocks of the async mode. With a scheduler, ``stale`` states
    a thread are updated between exchanges, and the order is made anew every
    ``rebuild_every`` rounds (0: never). ``verify``: ``solve`` checks the model
    first."""

    mode: str = "jacobi"
    alpha: float = 1.0
    eps: float = 1e-6
    max_sweeps: int = 0
    max_seconds: float = 0.0
    check_every: int = 1
    residual_scan_stride: int = 1
    threads: int = 1
    local_sweeps: int = 4
    stale: int = 64
    rebuild_every: int = 1
    verify: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        damped(self.alpha)

    @staticmethod
    def sweeps_for(updates: int, n: int) -> int:
        """An update budget in whole sweeps."""
        return -(-updates // n) if updates and n else 0


@dataclass
class Solution:
    values: DataFrame  # state, v
    converged: bool
    final_residual_inf: float
    sweeps: int
    total_updates: int
    wall_time_sec: float
    trace: list[tuple[int, float, float]]
    counters: list[tuple[int, int, int]] = field(default_factory=list)
    scans: tuple[int, int] = (0, 0)

    @property
    def updates_per_sec(self) -> float:
        return self.total_updates / self.wall_time_sec if self.wall_time_sec else 0.0

    def trace_frame(self, run_id: str) -> DataFrame:
        rows = [(run_id, i, s, t, r) for i, (s, t, r) in enumerate(self.trace)]
        return self.values.sparkSession.createDataFrame(rows, "run_id string, seq int, sweep int, time_sec double, residual double")

    def counters_frame(self, run_id: str) -> DataFrame:
        return self.values.sparkSession.createDataFrame([(run_id, *c) for c in self.counters], COUNTERS)

    def scans_frame(self, run_id: str) -> DataFrame:
        return self.values.sparkSession.createDataFrame([(run_id, *self.scans)], SCANS)


def block_of(n: int, blocks: int) -> np.ndarray:
    """Owner of each state: contiguous blocks, the first ``n % blocks`` one larger."""
    sizes = [n // blocks + (i < n % blocks) for i in range(blocks)]
    return np.repeat(np.arange(blocks), sizes)


def _step(m: kernels.Csr, c: SolverConfig, scheduler: Scheduler | None, tasks: list[dict[int, np.ndarray]] | None) -> kernels.Step:
    threads = max(1, min(c.threads, m.n))
    if tasks is not None:
        return kernels.Phases(m, tasks, c.threads, c.alpha)
    if c.mode == "jacobi":
        return kernels.Jacobi(m, c.alpha)
    if c.mode == "gauss_seidel":
        return kernels.GaussSeidel(m, c.alpha)
    if c.mode == "colored":
        color = kernels.colors(m, draw_numbers(np.arange(m.n), 0, 42))
        return kernels.GaussSeidel(m, c.alpha, np.argsort(color, kind="stable"))
    if c.mode == "frontier":
        return kernels.Frontier(m, c.eps, c.alpha)
    if scheduler is not None:
        return kernels.Scheduled(m, scheduler, threads, c.stale, c.rebuild_every if scheduler.kind != "static" else 0, c.alpha)
    return kernels.AsyncBlocks(m, block_of(m.n, threads), c.local_sweeps, c.alpha)


@dataclass(frozen=True)
class Run:
    """One model under one configuration: by its mode, by a scheduler's
    order, or by the epochs of a plan."""

    mdp: Mdp
    config: SolverConfig = SolverConfig()
    scheduler: Scheduler | None = None
    plan: DataFrame | None = None  # a plan's tasks
    start: DataFrame | None = None  # (state, v); zeros by default


def _packed(run_id: str, run: Run) -> DataFrame:
    """One row for each reward (kind 0), entry (1), task of the plan (2) and start (3)."""
    none = [F.lit(0).alias("tid"), F.lit(0).alias("seq")]
    e = run.mdp.transitions.select(F.lit(run_id).alias("run_id"), F.lit(1).alias("kind"), F.col("src").alias("i"), F.col("dst").alias("j"), F.col("p").alias("x"), *none)
    rows = e.union(run.mdp.rewards.select(F.lit(run_id), F.lit(0), "state", F.lit(0).cast("long"), "r", *none))
    if run.start is not None:
        rows = rows.union(run.start.select(F.lit(run_id), F.lit(3), "state", F.lit(0).cast("long"), "v", *none))
    if run.plan is None:
        return rows
    return rows.union(run.plan.select(F.lit(run_id), F.lit(2), F.col("phase").cast("long"), "begin", F.col("end").cast("double"), "tid", "seq"))


def _tasks(rows: pd.DataFrame) -> list[dict[int, np.ndarray]]:
    """Each phase's states by thread, in the order of the tasks."""
    out = []
    for _, phase in rows.sort_values(["i", "tid", "seq"]).groupby("i"):
        out.append({int(t): np.concatenate([np.arange(a, int(b)) for a, b in zip(g["j"], g["x"], strict=True)]) for t, g in phase.groupby("tid")})
    return out


def _below(c: SolverConfig, planned: bool) -> bool:
    """Whether a start that lies exactly at ``eps`` must be improved."""
    return not planned and c.mode in ("jacobi", "gauss_seidel", "colored")


def _solved(runs: dict[str, Run]) -> DataFrame:
    """(run_id, state, v, report): the report is in one row of each run."""
    rows = reduce(DataFrame.union, [_packed(run_id, run) for run_id, run in runs.items()])
    limit = KERNEL_ENTRIES
    configs = {k: (asdict(run.config), run.mdp.beta, run.scheduler, run.plan is not None) for k, run in runs.items()}

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        config, beta, scheduler, planned = configs[key[0]]
        c = SolverConfig(**config)
        e, r, x = pdf[pdf["kind"] == 1], pdf[pdf["kind"] == 0].sort_values("i"), pdf[pdf["kind"] == 3].sort_values("i")
        if len(e) > limit:
            raise ValueError(f"{key[0]}: {len(e)} entries are too many for one task; use the frame tier")
        m = kernels.Csr(e["i"].to_numpy(), e["j"].to_numpy(), e["x"].to_numpy(), r["x"].to_numpy(), beta)
        step = _step(m, c, scheduler, _tasks(pdf[pdf["kind"] == 2]) if planned else None)
        out = kernels.solve(m, step, c.eps, c.max_sweeps, c.max_seconds, c.check_every, c.residual_scan_stride, x["x"].to_numpy() if len(x) else None, below=_below(c, planned))
        report = {"converged": out.converged, "final_residual_inf": out.residual, "wall_time_sec": out.seconds, "sweeps": out.sweeps, "total_updates": out.updates, "updates_per_sec": out.updates / out.seconds if out.seconds else 0.0}
        report["trace"] = [{"sweep": s, "time_sec": t, "residual": x} for s, t, x in out.trace]
        report["counters"] = [{"tid": t, "updates": u, "ns": ns} for t, u, ns in out.counters]
        report |= {"scans": out.scans, "scan_ns": out.scan_ns}
        return pd.DataFrame({"run_id": key[0], "state": np.arange(m.n), "v": out.x, "report": [report] + [None] * (m.n - 1)})

    return rows.groupBy("run_id").applyInPandas(kernel, VALUES)


def solve_many(runs: dict[str, Run | tuple[Mdp, SolverConfig]], with_values: bool = True) -> DataFrame:
    """Solves each model under its configuration, in tasks of its own. One row
    a state (run_id, state, v), or one a run (``REPORT``)."""
    rows = _solved({k: r if isinstance(r, Run) else Run(*r) for k, r in runs.items()})
    return rows.select("run_id", "state", "v") if with_values else rows.where("report is not null").select("run_id", "report.*")


def _solution(rows: DataFrame) -> Solution:
    rows = cut(rows)
    found = rows.where("report is not null").select("report.*").head()
    trace = [(t["sweep"], t["time_sec"], t["residual"]) for t in found["trace"]]
    counters = [(c["tid"], c["updates"], c["ns"]) for c in found["counters"]]
    return Solution(rows.select("state", "v"), found["converged"], found["final_residual_inf"], found["sweeps"], found["total_updates"], found["wall_time_sec"], trace, counters, (found["scans"], found["scan_ns"]))


def sweep(m: Mdp, x: DataFrame, alpha: float = 1.0) -> DataFrame:
    """One synchronous sweep: (state, v)."""
    step = damped(alpha)
    return x.join(backup(m, x), "state").select("state", step(F.col("v"), F.col("fv")).alias("v"))


def sweeps(m: Mdp, x: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
    """``k`` synchronous sweeps as one plan; for a small fixed ``k``."""
    for _ in range(k):
        x = sweep(m, x, alpha)
    return x


def follow(s: Rounds, c: SolverConfig, below: bool = False) -> Solution:
    """The frame tier's loop: rounds until the residual is small enough or a
    budget ends. Residuals are looked at, as in the kernels, at the start, after
    each ``check_every`` rounds and at the end."""
    began, updates, trace, scan_ns, k = time.perf_counter(), 0, [], 0, 0
    spent = lambda: time.perf_counter() - began
    while True:
        at = time.perf_counter_ns()
        over = bool(c.max_sweeps and k >= c.max_sweeps or c.max_seconds and spent() >= c.max_seconds)
        looking = over or k % max(1, c.check_every) == 0
        found = s.look() if looking or s.always else None
        over = over or s.stalled
        scan_ns += time.perf_counter_ns() - at
        if looking or over:
            trace.append((k, spent(), found.strided))
            if over or found.strided <= c.eps and not (below and k == 0 and found.strided == c.eps):
                values = s.values()
                s.end()
                if trace[-1][2] != found.residual:
                    trace[-1] = (k, trace[-1][1], found.residual)
                seconds = spent()
                return Solution(values, found.residual <= c.eps, found.residual, k, updates, seconds, trace, [(0, updates, int(1e9 * seconds) - scan_ns)], (k + 1, scan_ns))
        updates += s.advance(k)
        k += 1


def iterate(op: FixedPointOperator, x: DataFrame, c: SolverConfig = SolverConfig(), packed: bool = False) -> Solution:
    """Any contraction over tables: all states at once, one job a sweep, or, in
    the ``frontier`` mode and for linear ones, only those that change.
    ``packed``: the frontier's rounds over arrays, which are worth their
    packing where an ``Affine`` operator needs many rounds."""
    if packed:
        if c.mode != "frontier" or not isinstance(op, Affine) or c.residual_scan_stride > 1:
            raise ValueError("rounds are packed for affine operators in the frontier mode, with residuals of all states")
        return follow(Packed(op, x, c.eps, c.alpha), c)
    if c.mode == "frontier":
        return follow(Frontier(op, x, c.eps, c.alpha, c.residual_scan_stride), c)
    if c.mode != "jacobi":
        raise ValueError("any contraction can be solved in the modes jacobi and frontier")
    return follow(Synchronous(op, x, c.alpha, c.residual_scan_stride), c, True)


def async_round(m: Mdp, x: DataFrame, blocks: int, local_sweeps: int, alpha: float = 1.0) -> DataFrame:
    """(state, v) after one round of block iterations over tables."""
    s = Halo(m, PolicyEvaluation(m), x, blocks, local_sweeps, alpha)
    for k in range(2):
        s.look()
        if k == 0:
            s.advance(k)
    values = s.values()
    s.end()
    return values


def gauss_seidel_sweep(m: Mdp, x: DataFrame, n: int, block: int, alpha: float = 1.0) -> DataFrame:
    """One exact ascending sweep over tables: block after block of consecutive
    states, each in one task against the values so far. As the order asks for,
    the blocks follow each other; only a block's rows are in memory."""
    beta = m.beta

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        own, e = pdf[pdf["kind"] == 0].sort_values("state"), pdf[pdf["kind"] == 1]
        states, y, p, dst = own["state"].to_numpy(), own["y"].to_numpy().copy(), e["p"].to_numpy(), e["dst"].to_numpy()
        row, col = np.searchsorted(states, e["state"].to_numpy()), np.minimum(np.searchsorted(states, dst), len(states) - 1)
        inside = states[col] == dst
        base = own["p"].to_numpy() + beta * np.bincount(row[~inside], (p * e["y"].to_numpy())[~inside], len(states))
        kernels.Levels(kernels.Csr(row[inside], col[inside], p[inside], base, beta)).sweep(y, alpha)
        return pd.DataFrame({"state": states, "v": y})

    for first in range(0, n, block):
        here = F.col("state").between(first, first + block - 1)
        entries = m.transitions.where(F.col("src").between(first, first + block - 1)).join(x.select(F.col("state").alias("dst"), F.col("v").alias("y")), "dst").select(F.col("src").alias("state"), "dst", "p", "y", F.lit(1).alias("kind"))
        own = m.rewards.where(here).join(x, "state").select("state", F.col("state").alias("dst"), F.col("r").alias("p"), F.col("v").alias("y"), F.lit(0).alias("kind"))
        new = entries.union(own).groupBy(F.lit(0).alias("block")).applyInPandas(kernel, "state long, v double")
        x = cut(x.where(~here).union(new))
    return x


class _Ascending(Rounds):
    """Exact ascending sweeps over tables, block after block."""

    def __init__(self, m: Mdp, op: FixedPointOperator, x: DataFrame, block: int, alpha: float, stride: int):
        super().__init__(op, x, alpha, stride)
        self.m, self.n, self.block = m, m.size(), block

    def advance(self, k: int) -> int:
        self.x = gauss_seidel_sweep(self.m, self.x, self.n, self.block, self.alpha)
        return self.n


def _frame(run: Run, x: DataFrame, phases: list[DataFrame] | None, block: int) -> Solution:
    """The frame tier of each way to run a model."""
    m, c, op = run.mdp, run.config, PolicyEvaluation(run.mdp)
    rest = (c.alpha, c.residual_scan_stride)
    if phases is not None:
        s = Phased(m, op, x, *rest)
        s.phases = phases
    elif c.mode == "jacobi" or c.mode == "frontier":
        return iterate(op, x, c)
    elif c.mode == "colored":
        s = Colors(m, op, x, colors(m), *rest)
    elif c.mode == "gauss_seidel":
        s = _Ascending(m, op, x, block, *rest)
    elif run.scheduler is not None:
        s = Scheduled(m, op, x, run.scheduler, max(1, min(c.threads, m.size())), c.stale, c.rebuild_every, *rest)
    else:
        s = Halo(m, op, x, c.threads, c.local_sweeps, *rest)
    return follow(s, c, _below(c, phases is not None))


def _tier(m: Mdp, tier: str) -> str:
    return tier if tier != "auto" else "kernel" if m.transitions.count() <= KERNEL_ENTRIES else "frame"


def solve(m: Mdp, c: SolverConfig = SolverConfig(), x: DataFrame | None = None, tier: str = "auto", scheduler: Scheduler | None = None, block: int = 1_000_000) -> Solution:
    """Solves one model from ``x`` (zeros by default). In the async mode a
    scheduler gives the order. ``block``: states that a task of an ascending
    sweep over tables may hold; such sweeps are as many jobs as blocks, where
    the ``colored`` mode needs as many as colours."""
    if c.verify:
        PolicyEvaluation(m).check()
    run = Run(m, c, scheduler if c.mode == "async" else None, start=x)
    if _tier(m, tier) == "frame":
        return _frame(run, m.zeros() if x is None else x, None, block)
    return _solution(_solved({"run": run}))


def solve_plan(m: Mdp, plan: Plan, c: SolverConfig = SolverConfig(), x: DataFrame | None = None, tier: str = "auto") -> Solution:
    """Repeats a plan's epochs until the residual is small enough or a budget
    ends: with trace, residuals and the counters of each thread. One thread
    updates in place, state by state, which tables can't follow: the frame tier
    raises ValueError. Several update a phase's states together. A plan without
    phases gives the start."""
    c = replace(c, threads=plan.config.threads)
    if _tier(m, tier) == "frame":
        if c.threads <= 1:
            raise ValueError("a plan of one thread updates state by state; over tables, use more threads or the colored mode")
        phases = sorted(r["phase"] for r in plan.phases.collect())  # at most two a color
        return _frame(Run(m, c), m.zeros() if x is None else x, [plan.phase_states(p) for p in phases], 0)
    return _solution(_solved({"run": Run(m, c, plan=plan.tasks, start=x)}))


def run_phases(m: Mdp, x: DataFrame, phases: list[DataFrame], alpha: float = 1.0) -> DataFrame:
    """One epoch of a plan over tables: phase by phase, the states of a phase
    (state) update together from the values before it."""
    step = damped(alpha)
    for states in phases:
        new = backup(m, x, states)
        x = x.join(new, "state", "left").select("state", F.when(F.col("fv").isNull(), F.col("v")).otherwise(step(F.col("v"), F.col("fv"))).alias("v"))
    return x


def run_plan(m: Mdp, tasks: DataFrame, threads: int, epochs: int, alpha: float = 1.0) -> DataFrame:
    """(state, v) after ``epochs`` of a plan from zeros, for a model that fits a task."""
    if epochs < 1:
        return m.zeros()
    config = SolverConfig(alpha=alpha, eps=-1.0, max_sweeps=epochs, check_every=epochs, threads=threads)
    return _solved({"run": Run(m, config, plan=tasks)}).select("state", "v")


__all__ = ["MODES", "Run", "Solution", "SolverConfig", "async_round", "block_of", "gauss_seidel_sweep", "iterate", "residuals", "run_phases", "run_plan", "solve", "solve_many", "solve_plan", "sweep", "sweeps"]
