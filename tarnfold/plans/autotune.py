"""Choosing a plan: a grid of candidates, their modelled cost, then pilots."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Mdp
from ..operators.solvers import Run, SolverConfig, solve_many
from .cost import CostModel
from .planners import PLANNERS, Plan, PlannerConfig

CANDIDATE = "candidate_id int, planner string, blk int, colors int, K int, threads int"


@dataclass(frozen=True)
class AutotuneConfig:
    threads: int = 4
    blks: tuple[int, ...] = (64, 128, 256, 512, 1024)
    color_multipliers: tuple[int, ...] = (1, 2, 4)
    hot_fractions: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1)
    pilot_sweeps: int = 10
    top_m: int = 3


def candidate_list(n: int, c: AutotuneConfig) -> list[tuple]:
    """Per block size that fits: one static plan, one colored for each number
    of colors, one priority for each fraction and number of colors."""
    out: list[tuple] = []
    for blk in c.blks:
        if blk > n:
            continue
        out.append((len(out), "static", blk, 0, 0, c.threads))
        out += [(len(out) + i, "colored", blk, m * c.threads, 0, c.threads) for i, m in enumerate(c.color_multipliers)]
        for f in c.hot_fractions:
            k = min(max(int(n * f), c.threads * blk), n)
            out += [(len(out) + i, "priority", blk, m * c.threads, k, c.threads) for i, m in enumerate(c.color_multipliers)]
    if not out:
        raise ValueError("every block size is larger than the model")
    return out


def candidates(spark: SparkSession, n: int, c: AutotuneConfig) -> DataFrame:
    return spark.createDataFrame(candidate_list(n, c), CANDIDATE)


def _plan(spark: SparkSession, n: int, row: tuple, residuals: DataFrame | None) -> Plan:
    _, planner, blk, colors, k, threads = row
    return PLANNERS[planner](spark, n, PlannerConfig(threads=threads, blk=blk, colors=colors, K=k), residuals)


def _blocks_of(m: Mdp, n: int, residuals: DataFrame, blks: list[int]) -> DataFrame:
    """(blk, b, size, score, nnz) of every block of every block size. States
    are summed once, to blocks that divide all others; those are rolled up."""
    unit = math.gcd(*blks)
    sizes, place = F.array(*[F.lit(x) for x in blks]), F.floor(F.col("state") / unit).alias("u")
    units = residuals.groupBy(place).agg(F.sum("residual").alias("score")).join(m.degrees().groupBy(place).agg(F.sum("nnz").alias("nnz")), "u", "full")
    sums = units.select("u", "score", "nnz", F.explode(sizes).alias("blk")).groupBy("blk", F.floor(F.col("u") * unit / F.col("blk")).alias("b")).agg(F.sum("score").alias("score"), F.sum("nnz").alias("nnz"))
    blocks = m.spark.range(1).select(F.explode(sizes).alias("blk")).select("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / F.col("blk")))).alias("b"))
    blocks = blocks.select("blk", "b", F.least("blk", n - F.col("b") * F.col("blk")).alias("size"))
    return blocks.join(sums, ["blk", "b"], "left").na.fill({"score": 0.0, "nnz": 0})


def ranking(m: Mdp, n: int, residuals: DataFrame, c: AutotuneConfig, model: CostModel = CostModel()) -> DataFrame:
    """The candidates with est_cost, cheapest first: the tasks of all their
    plans are one table, costed in one aggregation."""
    spark, rows = m.spark, candidate_list(n, c)
    grid = spark.createDataFrame(rows, CANDIDATE)
    tasks = F.broadcast(grid).join(_blocks_of(m, n, residuals, sorted({r[2] for r in rows})), "blk")  # a few hundred candidates
    cost = model.measured_update_ns * F.col("size") if model.measured_update_ns > 0 else F.when(F.col("nnz") > 0, F.col("nnz")).otherwise(F.col("size"))
    tasks = tasks.withColumn("cost", cost.cast("double")).withColumn("color", F.when(F.col("planner") == "static", 0).otherwise(F.col("b") % F.greatest("colors", F.lit(1))))
    deal = F.when(F.col("planner") == "static", F.col("b")).otherwise(F.floor(F.col("b") / F.greatest("colors", F.lit(1))))
    cover = tasks.select("candidate_id", F.lit(1).alias("part"), "color", (deal % F.col("threads")).alias("tid"), "cost")
    by_score = Window.partitionBy("candidate_id").orderBy(F.round("score", 9).desc(), "b")
    hot = tasks.where("planner = 'priority'").withColumn("covered", F.coalesce(F.sum("size").over(by_score.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("covered") < F.col("K"))
    rank = F.row_number().over(Window.partitionBy("candidate_id", "color").orderBy(F.round("score", 9).desc(), "b")) - 1
    hot = hot.select("candidate_id", F.lit(0).alias("part"), "color", (rank % F.col("threads")).alias("tid"), "cost")
    threads = cover.union(hot).groupBy("candidate_id", "part", "color", "tid").agg(F.sum("cost").alias("cost"))
    busiest = threads.groupBy("candidate_id", "part", "color").agg(F.max("cost").alias("cost"))
    total = busiest.groupBy("candidate_id").agg(F.sum("cost").alias("cost"), F.count("*").alias("phases"))
    phases = F.when(F.col("planner") == "colored", F.col("colors")).otherwise(F.col("phases"))  # colored plans keep empty phases
    costed = grid.join(total, "candidate_id").select(*grid.columns, (F.col("cost") + model.lam * phases).alias("est_cost"))
    return costed.orderBy(F.round("est_cost", 6), "candidate_id")


def pilots(m: Mdp, n: int, residuals: DataFrame, c: AutotuneConfig, model: CostModel = CostModel()) -> DataFrame:
    """The cheapest ``top_m`` candidates with initial_residual, final_residual,
    rdrop and pilot_ups (updates a second) after a fixed number of epochs from
    zeros. Pilots run side by side, one task each, for models that fit one."""
    spark = m.spark
    top = ranking(m, n, residuals, c, model).limit(c.top_m).collect()
    config = SolverConfig(eps=-1.0, max_sweeps=c.pilot_sweeps, check_every=c.pilot_sweeps, threads=c.threads)
    runs = {str(r["candidate_id"]): Run(m, config, plan=_plan(spark, n, tuple(r[x] for x in ("candidate_id", "planner", "blk", "colors", "K", "threads")), residuals).tasks) for r in top}
    done = solve_many(runs, with_values=False)
    first, last = F.get("trace", F.lit(0))["residual"], F.col("final_residual_inf")
    drop = F.when(last > 0, first / last).otherwise(1e12)
    drops = done.select(F.col("run_id").cast("int").alias("candidate_id"), first.alias("initial_residual"), last.alias("final_residual"), drop.alias("rdrop"), F.col("updates_per_sec").alias("pilot_ups"))
    costs = spark.createDataFrame([(r["candidate_id"], r["planner"], r["blk"], r["colors"], r["K"], r["est_cost"]) for r in top], "candidate_id int, planner string, blk int, colors int, K int, est_cost double")
    return costs.join(drops, "candidate_id")


def best(pilot_rows: DataFrame) -> DataFrame:
    """The pilot with the largest drop; ties go to the first candidate."""
    return pilot_rows.orderBy(F.round("rdrop", 6).desc(), "candidate_id").limit(1)


@dataclass(frozen=True)
class Tuned:
    """The winner, and its plan built anew."""

    winner: Row
    plan: Plan


def tune(m: Mdp, n: int, residuals: DataFrame, c: AutotuneConfig = AutotuneConfig(), model: CostModel = CostModel()) -> Tuned:
    winner = best(pilots(m, n, residuals, c, model)).head()
    row = tuple(winner[x] for x in ("candidate_id", "planner", "blk", "colors", "K"))
    return Tuned(winner, _plan(m.spark, n, (*row, c.threads), residuals))
