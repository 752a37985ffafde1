"""Cost of a plan: per phase its busiest thread, plus fixed costs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .planners import Plan
from .selection import ranked


@dataclass(frozen=True)
class CostModel:
    lam: float = 100.0
    barrier_penalty: float = 500.0
    measured_update_ns: float = 0.0


def block_entries(degrees: DataFrame, blk: int) -> DataFrame:
    """(b, nnz): entries of each block's rows. Blocks are aligned, so the range
    of a task is a block number and no range join is needed."""
    return degrees.groupBy(F.floor(F.col("state") / blk).alias("b")).agg(F.sum("nnz").alias("nnz"))


def weighted(p: Plan, degrees: DataFrame) -> Plan:
    """The plan with every task's weight set to its rows' entries."""
    entries = block_entries(degrees, p.config.blk)
    t = p.tasks.join(entries, F.floor(p.tasks["begin"] / p.config.blk) == entries["b"], "left")
    return replace(p, tasks=t.select(*[c for c in p.tasks.columns if c != "weight"], F.coalesce("nnz", F.lit(0)).cast("double").alias("weight")).select(*p.tasks.columns))


def entries_before(degrees: DataFrame) -> DataFrame:
    """(state, before): entries of all rows before a state, and of all rows at
    the number of states. ``degrees`` has each state from 0 on."""
    rows = ranked(degrees.select("state", "nnz"), [F.col("state")], F.col("nnz")).select("state", F.col("before").cast("long").alias("before"))
    return rows.union(degrees.agg(F.count("*"), F.coalesce(F.sum("nnz"), F.lit(0)).cast("long")))


def weighted_ranges(tasks: DataFrame, degrees: DataFrame, n: int) -> DataFrame:
    """``tasks`` of any begin and end with their rows' entries as weight: the
    difference of two prefix sums, read at the range's bounds, so that a range
    of all states costs no more than one of a single state. Bounds outside 0
    to ``n`` are cut to it; a range that ends before it begins is empty."""
    sums = cut(entries_before(degrees))
    bound = lambda c: F.greatest(F.least(F.col(c), F.lit(n)), F.lit(0)).cast("long")
    rows = tasks.drop("weight").withColumn("_lo", bound("begin")).withColumn("_hi", F.greatest(bound("end"), bound("begin")))
    for side in ("_lo", "_hi"):
        rows = rows.join(sums.select(F.col("state").alias(side), F.col("before").alias(f"{side}_sum")), side)
    return rows.withColumn("weight", (F.col("_hi_sum") - F.col("_lo_sum")).cast("double")).select(*tasks.columns)


def task_cost(model: CostModel) -> F.Column:
    """Measured time if known, else the weight, else the size."""
    size = (F.col("end") - F.col("begin")).cast("double")
    if model.measured_update_ns > 0:
        return model.measured_update_ns * size
    return F.when(F.col("weight") > 0, F.col("weight")).otherwise(size)


def estimate(tasks: DataFrame, phases: DataFrame, model: CostModel = CostModel(), by: list[str] | None = None) -> DataFrame:
    """compute_cost, phase_cost, barrier_cost, total_cost and work, one row for
    each ``by`` (one in all without): many plans are costed in one query."""
    by = by or []
    threads = tasks.withColumn("cost", task_cost(model)).groupBy(*by, "phase", "tid").agg(F.sum("cost").alias("cost"))
    busiest = threads.groupBy(*by, "phase").agg(F.max("cost").alias("cost"), F.sum("cost").alias("work"))
    work = busiest.groupBy(*by).agg(F.sum("cost").alias("compute_cost"), F.sum("work").alias("work"))
    fixed = phases.groupBy(*by).agg((F.count("*") * model.lam).alias("phase_cost"), (F.sum(F.col("barrier_after").cast("int")) * model.barrier_penalty).alias("barrier_cost"))
    both = work.join(fixed, by) if by else work.crossJoin(fixed)  # one row each
    return both.select(*by, "compute_cost", "phase_cost", "barrier_cost", (F.col("compute_cost") + F.col("phase_cost") + F.col("barrier_cost")).alias("total_cost"), "work")
