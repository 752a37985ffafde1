"""Policy evaluation ``F(x) = r + beta P x`` as joins and aggregates.

The values joined to the transitions are one narrow row a state; Spark itself
broadcasts them while they are small, measured at run time, and else shuffles
both sides by state. A state's row of the matrix is summed on the map side
first, so a hub with very many entries does not meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Mdp, check


class FixedPointOperator(Protocol):
    """What a solver needs: any contraction on tables (state, v)."""

    def apply(self, x: DataFrame) -> DataFrame:
        """(state, fv)"""
        ...


class PolicyEvaluation:
    """The Bellman operator of one model. States without transitions get their
    reward alone."""

    name = "policy evaluation"

    def __init__(self, mdp: Mdp):
        self.mdp = mdp

    def check(self) -> None:
        """Raises ValueError if the model is invalid."""
        check(self.mdp)

    def apply(self, x: DataFrame) -> DataFrame:
        return backup(self.mdp, x)


class Affine:
    """Any other linear contraction: rows of ``a`` (row, col, a), where the same
    entry's amounts add up, and ``b`` (state, b). Where ``b`` has a column
    ``scale``, it multiplies the entries that read the state. ``mirrored``: each
    row of ``a`` stands for an entry with row and column exchanged as well.
    ``spectrum``: the eigenvalues of ``a`` are known to be real, as those of a
    walk on an undirected graph, and none larger than this; 0: nothing is known."""

    name = "affine"

    def __init__(self, a: DataFrame, b: DataFrame, spectrum: float = 0.0, mirrored: bool = False):
        if not 0 <= spectrum < 1:
            raise ValueError("spectrum must be in [0, 1)")
        self.a, self.b, self.spectrum, self.mirrored = a, b, spectrum, mirrored

    def entries(self) -> DataFrame:
        """(row, col, a) of all entries, with their scale."""
        a = self.a.select("row", "col", "a")
        if self.mirrored:
            a = a.union(a.select("col", "row", "a"))
        if "scale" not in self.b.columns:
            return a
        return a.join(self.b.select(F.col("state").alias("col"), "scale"), "col").select("row", "col", (F.col("a") * F.col("scale")).alias("a"))

    def apply(self, x: DataFrame) -> DataFrame:
        a = self.entries()
        sums = a.join(x, a["col"] == x["state"]).groupBy(F.col("row").alias("state")).agg(F.sum(F.col("a") * F.col("v")).alias("s"))
        return self.b.join(sums, "state", "left").select("state", (F.col("b") + F.coalesce("s", F.lit(0.0))).alias("fv"))


def backup(m: Mdp, x: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(state, fv): one application of the operator to ``x`` (state, v); with
    ``only`` (state) for those states alone."""
    t, r = m.transitions, m.rewards
    if only is not None:
        keep = only.select("state")
        t, r = t.join(keep, t["src"] == keep["state"], "left_semi"), r.join(keep, "state", "left_semi")
    sums = t.join(x, t["dst"] == x["state"]).groupBy(F.col("src").alias("state")).agg(F.sum(F.col("p") * F.col("v")).alias("s"))
    return r.join(sums, "state", "left").select("state", (F.col("r") + m.beta * F.coalesce("s", F.lit(0.0))).alias("fv"))


def residuals(m: Mdp, x: DataFrame) -> DataFrame:
    """(state, v, fv, residual) with residual = |F(x) - x|."""
    return x.join(backup(m, x), "state").select("state", "v", "fv", F.abs(F.col("fv") - F.col("v")).alias("residual"))


def largest(rows: DataFrame, stride: int = 1) -> DataFrame:
    """One row: the largest residual, 0 without states. A stride looks at each
    stride-th state only and gives a lower bound. NaN residuals are ignored."""
    if stride > 1:
        rows = rows.where(F.col("state") % stride == 0)
    return rows.agg(F.coalesce(F.max(F.when(~F.isnan("residual"), F.col("residual"))), F.lit(0.0)).alias("residual_inf"))


def residual_inf(m: Mdp, x: DataFrame, stride: int = 1) -> DataFrame:
    return largest(residuals(m, x), stride)


def damped(alpha: float) -> Callable[[Column, Column], Column]:
    """The step from v towards F(v)."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    return lambda v, fv: fv if alpha == 1 else (1 - alpha) * v + alpha * fv
