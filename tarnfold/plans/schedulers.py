"""Dispatch orders of one epoch: (tid, pos, state) or (pos, state) tables.

Each is a ranking. Hot sets are selected by a threshold, and ranks are prefix
sums over sorted ranges (``selection``), so that no task sees all states, a
whole hot set, or a whole bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import residual_bucket
from .permutation import permuted, permuted_numbers
from .selection import descending, largest, ranked, ranked_within

KINDS = ("static", "shuffled", "topk", "ca_topk", "buckets")


def owner(state: Column, n: int, threads: int) -> Column:
    """Thread of a state: contiguous blocks, the first ``n % threads`` one
    larger, as ``ntile`` deals them, without a sort."""
    size, extra = divmod(n, threads)
    big = extra * (size + 1)
    return F.when(state < big, F.floor(state / (size + 1))).otherwise(extra + F.floor((state - big) / max(size, 1))).cast("int")


def static_blocks(states: DataFrame, n: int, threads: int) -> DataFrame:
    """Each thread's own block in ascending order."""
    size, extra = divmod(n, threads)
    tid = owner(F.col("state"), n, threads)
    begin = tid * size + F.least(tid, F.lit(extra))
    return states.select(tid.alias("tid"), (F.col("state") - begin).cast("int").alias("pos"), "state")


def shuffle_key(tid: Column | int, epoch: int) -> Column | int:
    """The key of a thread's permutation in an epoch."""
    return tid * 1009 + epoch


def shuffled_blocks(states: DataFrame, n: int, threads: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """Each thread's own block in an order that changes with the epoch: a
    permutation gives each state its place, without a sort."""
    size, extra = divmod(n, threads)
    rows = static_blocks(states, n, threads)
    y, key = F.col("pos").cast("long"), shuffle_key(F.col("tid").cast("long"), epoch)
    pos = F.when(F.col("tid") < extra, permuted(y, size + 1, key, seed)).otherwise(permuted(y, size, key, seed))
    return rows.select("tid", pos.cast("int").alias("pos"), "state")


def hot_size(n: int, threads: int, k: int = 0) -> int:
    """K if given, else a hundredth of the states or 256 a thread, at most n."""
    return min(k, n) if k else min(max(n // 100, 256 * threads, 1), n)


def _order() -> list[Column]:
    """Largest first, ties by state."""
    return [descending("residual").desc(), F.col("state")]


def topk(residuals: DataFrame, n: int, threads: int = 1, k: int = 0) -> DataFrame:
    """(pos, state) of the K largest residuals in descending order; NaN counts least."""
    hot = largest(residuals.select("state", "residual"), "residual", hot_size(n, threads, k))
    return ranked(hot, _order()).select("pos", "state")


def conflict_aware_topk(residuals: DataFrame, n: int, threads: int = 1, k: int = 0, groups: int = 0, block_size: int = 256) -> DataFrame:
    """The hot set split into groups of blocks and drawn from the groups in
    turn, each group's largest first."""
    g = groups or 4 * threads
    hot = largest(residuals.select("state", "residual"), "residual", hot_size(n, threads, k)).withColumn("grp", F.pmod(F.floor(F.col("state") / block_size), F.lit(g)).cast("int"))
    turns = ranked_within(hot, "grp", _order()).drop("pos").withColumnRenamed("own", "turn")
    return ranked(turns, [F.col("turn"), F.col("grp")]).select("pos", "grp", "state")


def residual_buckets(residuals: DataFrame, base: float = 1e-12, buckets: int = 32) -> DataFrame:
    """(pos, bucket, state): highest bucket first, ascending inside. Without
    any residual above ``base`` that is the order of the states. A bucket of
    most states spans as many ranges as its share."""
    rows = residuals.select("state", residual_bucket(F.col("residual"), base, buckets).alias("bucket"))
    return ranked(rows, [F.col("bucket").desc(), F.col("state")]).select("pos", "bucket", "state")


def bucket_histogram(residuals: DataFrame, base: float = 1e-12, buckets: int = 32) -> DataFrame:
    rows = residuals.select(residual_bucket(F.col("residual"), base, buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("states"))
    return rows.select("bucket", "states", F.sum("states").over(Window.orderBy(F.desc("bucket"))).cast("long").alias("running"))


def topk_then_coverage(residuals: DataFrame, n: int, threads: int, k: int = 0) -> DataFrame:
    """(pass, tid, pos, state): the hot states first, dealt from one queue (tid
    null); then every state of each thread's block, the hot ones again."""
    hot = topk(residuals, n, threads, k).select(F.lit(0).alias("pass"), F.lit(None).cast("int").alias("tid"), F.col("pos").cast("int").alias("pos"), "state")
    rest = static_blocks(residuals.select("state"), n, threads).select(F.lit(1).alias("pass"), "tid", "pos", "state")
    return hot.unionByName(rest)


@dataclass(frozen=True)
class Scheduler:
    """The order of an asynchronous solver, as a table (``dispatch``) for
    models of any size or as arrays (``order``) inside a task; both give the
    same order. ``K``, ``groups`` of 0: chosen from the sizes."""

    kind: str = "static"
    K: int = 0
    groups: int = 0
    block_size: int = 256
    base: float = 1e-12
    buckets: int = 32
    seed: int = 42

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")

    @property
    def needs_residuals(self) -> bool:
        return self.kind in ("topk", "ca_topk", "buckets")

    def hot(self, residuals: DataFrame, n: int, threads: int) -> DataFrame | None:
        """(pos, state) that go before the coverage of all, None without."""
        if self.kind == "topk":
            return topk(residuals, n, threads, self.K)
        if self.kind == "ca_topk":
            return conflict_aware_topk(residuals, n, threads, self.K, self.groups, self.block_size).select("pos", "state")
        return None

    def dispatch(self, residuals: DataFrame, n: int, threads: int, epoch: int = 0) -> DataFrame:
        """(pass, tid, pos, state) of one epoch; a null tid marks a queue that
        all threads take from in turn."""
        names = ["pass", "tid", "pos", "state"]
        shared = [F.lit(0).alias("pass"), F.lit(None).cast("int").alias("tid"), F.col("pos").cast("int").alias("pos"), "state"]
        if self.kind == "buckets":
            return residual_buckets(residuals, self.base, self.buckets).select(*shared)
        states = residuals.select("state")
        rest = static_blocks(states, n, threads) if self.kind == "static" else shuffled_blocks(states, n, threads, epoch, self.seed)
        rest = rest.select(F.lit(1).alias("pass"), "tid", "pos", "state").select(*names)
        hot = self.hot(residuals, n, threads)
        return rest if hot is None else hot.select(*shared).unionByName(rest)

    def order(self, residuals: np.ndarray, threads: int, epoch: int = 0) -> list[list[np.ndarray]]:
        """Each pass's queue of each thread; a shared queue is dealt in turn."""
        n = len(residuals)
        deal = lambda q: [q[t::threads] for t in range(threads)]
        r = np.round(residuals, 9)
        if self.kind == "buckets":
            with np.errstate(divide="ignore", invalid="ignore"):
                b = np.floor(np.log2(np.round(residuals / self.base, 9)))
            b = np.where((residuals > self.base) & np.isfinite(b), np.clip(b, 0, max(1, self.buckets) - 1), 0)
            return [deal(np.argsort(-b, kind="stable"))]
        size, extra = divmod(n, threads)
        ends = np.cumsum([size + (t < extra) for t in range(threads)])
        blocks = [np.arange(e - size - (t < extra), e) for t, e in enumerate(ends.tolist())]
        if self.kind != "static":
            blocks = [b[np.argsort(permuted_numbers(len(b), shuffle_key(t, epoch), self.seed))] for t, b in enumerate(blocks)]
        if self.kind not in ("topk", "ca_topk"):
            return [blocks]
        hot = np.argsort(-r, kind="stable")[: hot_size(n, threads, self.K)]
        if self.kind == "ca_topk":
            group = hot // self.block_size % (self.groups or 4 * threads)
            by = np.argsort(group, kind="stable")
            starts = np.concatenate([[0], np.flatnonzero(np.diff(group[by])) + 1])
            turn = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
            hot = hot[by][np.lexsort((group[by], turn))]
        return [deal(hot), blocks]
