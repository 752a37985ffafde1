"""Block plans: tasks (phase, tid, seq, kind, begin, end, weight, conflict_key)
and phases (phase, barrier_after). A block is ``blk`` consecutive states.

Phases are a table of their own, as a phase may have no tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .selection import descending, ranked, ranked_within

TASK_COLUMNS = ["phase", "tid", "seq", "kind", "begin", "end", "weight", "conflict_key"]


@dataclass(frozen=True)
class PlannerConfig:
    """``colors`` 0: as many as threads. ``K`` 0: chosen from n."""

    threads: int = 1
    blk: int = 256
    colors: int = 0
    K: int = 0
    hot_phase_enabled: bool = True
    barrier_between_colors: bool = False
    seed: int = 42

    @property
    def color_count(self) -> int:
        return max(1, self.colors or self.threads)


@dataclass(frozen=True)
class Plan:
    tasks: DataFrame
    phases: DataFrame
    n: int
    config: PlannerConfig
    built_from: str

    def phase_states(self, phase: int) -> DataFrame:
        """(state) updated in a phase."""
        t = self.tasks.where(F.col("phase") == phase)
        return t.select(F.explode(F.sequence("begin", F.col("end") - 1)).alias("state"))


class Planner(Protocol):
    """A planner of one's own: any object with this method."""

    def build(self, spark: SparkSession, n: int, config: PlannerConfig, residuals: DataFrame | None) -> Plan: ...


def _blocks(spark: SparkSession, n: int, blk: int) -> DataFrame:
    b = F.col("id")
    return spark.range(-(-n // blk)).select(b.alias("b"), (b * blk).alias("begin"), F.least((b + 1) * blk, F.lit(n)).alias("end"))


def _task(phase: Column, tid: Column, seq: Column, weight: Column) -> list[Column]:
    return [phase.cast("int").alias("phase"), tid.cast("int").alias("tid"), seq.cast("int").alias("seq"), F.lit("BLOCK").alias("kind"), F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), weight.cast("double").alias("weight"), F.col("b").cast("long").alias("conflict_key")]


def _size() -> Column:
    return F.col("end") - F.col("begin")


def static_plan(spark: SparkSession, n: int, c: PlannerConfig, residuals: DataFrame | None = None) -> Plan:
    """Blocks dealt to threads in turn; one phase, no barrier."""
    b, t = F.col("b"), c.threads
    tasks = _blocks(spark, n, c.blk).select(*_task(F.lit(0), b % t, F.floor(b / t), _size()))
    return Plan(tasks, spark.createDataFrame([(0, False)], "phase int, barrier_after boolean"), n, c, "static")


def colored_plan(spark: SparkSession, n: int, c: PlannerConfig, residuals: DataFrame | None = None) -> Plan:
    """One phase for each color (block number modulo colors), empty ones
    included; inside, blocks dealt to threads in turn."""
    b, k, t = F.col("b"), c.color_count, c.threads
    inside = F.floor(b / k)
    tasks = _blocks(spark, n, c.blk).select(*_task(b % k, inside % t, F.floor(inside / t), _size()))
    return Plan(tasks, spark.range(k).select(F.col("id").cast("int").alias("phase"), F.lit(c.barrier_between_colors).alias("barrier_after")), n, c, "colored")


def hot_target(n: int, c: PlannerConfig) -> int:
    """States that the hot phases should cover."""
    return c.K or min(max(n // 50, c.threads * c.blk), n)


def block_scores(spark: SparkSession, n: int, blk: int, residuals: DataFrame | None) -> DataFrame:
    """(b, begin, end, score): the residuals of a block added up, 0 without any."""
    blocks = _blocks(spark, n, blk)
    if residuals is None:
        return blocks.withColumn("score", F.lit(0.0))
    sums = residuals.groupBy(F.floor(F.col("state") / blk).alias("b")).agg(F.sum("residual").alias("s"))
    return blocks.join(sums, "b", "left").select("b", "begin", "end", F.coalesce("s", F.lit(0.0)).alias("score"))


def _by_score() -> list[Column]:
    return [descending("score").desc(), F.col("b")]


def hot_blocks(scores: DataFrame, target: int) -> DataFrame:
    """Blocks in order of their score until they cover ``target`` states, with
    the states ``covered`` before each."""
    return ranked(scores, _by_score(), _size()).where(F.col("before") < target).withColumnRenamed("before", "covered").drop("pos")


def priority_plan(spark: SparkSession, n: int, c: PlannerConfig, residuals: DataFrame | None = None) -> Plan:
    """Hot blocks first, one phase for each color that has any, weighted by
    score and dealt by rank; then all blocks by color. Empty phases are dropped."""
    k, t, b = c.color_count, c.threads, F.col("b")
    scores = block_scores(spark, n, c.blk, residuals)
    hot = hot_blocks(scores, hot_target(n, c) if c.hot_phase_enabled else 0).withColumn("color", b % k)
    ranks = ranked_within(hot, "color", _by_score()).withColumnRenamed("own", "rank")
    parts = ranks.select("*", F.lit(0).alias("part"), F.col("score").alias("w"))
    cover = scores.withColumn("color", b % k).select("*", F.floor(b / k).alias("rank"), F.lit(1).alias("part"), _size().cast("double").alias("w"))
    rows = parts.select("part", "color", "rank", "b", "begin", "end", "w").unionByName(cover.select("part", "color", "rank", "b", "begin", "end", "w"))
    numbers = rows.select("part", "color").distinct().select("part", "color", (F.row_number().over(Window.orderBy("part", "color")) - 1).alias("phase"))
    rows = rows.join(F.broadcast(numbers), ["part", "color"])  # at most two rows a color
    tasks = rows.select(*_task(F.col("phase"), F.col("rank") % t, F.floor(F.col("rank") / t), F.col("w")))
    return Plan(tasks, numbers.select(F.col("phase").cast("int").alias("phase"), F.lit(c.barrier_between_colors).alias("barrier_after")), n, c, "priority")


PLANNERS = {"static": static_plan, "colored": colored_plan, "priority": priority_plan}


def build(planner: str | Planner, spark: SparkSession, n: int, c: PlannerConfig, residuals: DataFrame | None = None) -> Plan:
    """The plan of a planner, given by name or as an object."""
    return PLANNERS[planner](spark, n, c, residuals) if isinstance(planner, str) else planner.build(spark, n, c, residuals)


def phase_metrics(p: Plan) -> DataFrame:
    """phase, total_updates, max_thread_updates, max_thread_weight."""
    threads = p.tasks.groupBy("phase", "tid").agg(F.sum(_size()).alias("u"), F.sum("weight").alias("w"))
    rows = threads.groupBy("phase").agg(F.sum("u").alias("total_updates"), F.max("u").alias("max_thread_updates"), F.max("w").alias("max_thread_weight"))
    zero = {"total_updates": 0, "max_thread_updates": 0, "max_thread_weight": 0.0}
    return p.phases.select("phase").join(rows, "phase", "left").na.fill(zero)


def summary(p: Plan) -> DataFrame:
    """One row: the plan in a line of text, and its updates."""
    c = p.config
    rows = phase_metrics(p).agg(F.count("*").alias("phases"), F.sum("total_updates").alias("total_updates"))
    text = F.format_string(f"{p.built_from} n={p.n} T={c.threads} blk={c.blk} colors={c.color_count} K={c.K} phases=%d updates=%d", "phases", "total_updates")
    return rows.select(text.alias("summary"), "phases", "total_updates")
