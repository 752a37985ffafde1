"""Solving by pushing changes: only states whose residual is worth it are updated.

Every state keeps its value and its residual ``d = F(x) - x``. In a round the
states with more than ``eps`` of it, the frontier, take it up, and each passes
it on to the states that read it, along the transitions backwards; no other row
is backed up. With few changes, as after new data, few states are ever touched.

Each push lowers a weighted sum of residuals by at least ``eps``, so the rounds
end. Transitions lie in buckets by the state that is read, values in buckets by
state: a round shuffles the pushed changes alone, and sorts nothing, as a
bucket's changes are hashed and its transitions pass by them.

Where an operator's eigenvalues are known to be real and at most ``spectrum``
in size, a state also keeps on moving as it did in the round before, by the
weights of Chebyshev's iteration: at 0.6 a round leaves a third of the error
instead of 0.6 of it. Residuals follow whatever moves are made, so that what is
left out of a frontier is never lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .bellman import Affine, FixedPointOperator, PolicyEvaluation
from .rounds import Look, Rounds, told

#: Of a value: residuals below this are the rounding of a sum of many terms,
#: which another order of the same terms changes, and no further round removes.
ROUNDING = 1e-12


def entries(op: FixedPointOperator) -> DataFrame:
    """(state, row, a): how much of a change of a state each row takes over."""
    if isinstance(op, PolicyEvaluation):
        return op.mdp.transitions.select(F.col("dst").alias("state"), F.col("src").alias("row"), (F.lit(op.mdp.beta) * F.col("p")).alias("a"))
    if isinstance(op, Affine):
        return op.entries().select(F.col("col").alias("state"), "row", "a")
    raise ValueError("changes can be pushed through linear operators only")


class Frontier(Rounds):
    """``pushed``: the number of states of each round's frontier."""

    always = True

    def __init__(self, op: FixedPointOperator, x: DataFrame, eps: float, alpha: float, stride: int = 1):
        super().__init__(op, x, alpha, stride)
        self.eps, self.buckets, self.pushed = max(eps, 0.0), int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), []
        self.spectrum = getattr(op, "spectrum", 0.0) if alpha == 1 else 0.0
        self.into = self.trail.bucketed(entries(op).repartition(self.buckets, "state"), "state", self.buckets, True)
        self.settled = None
        self._exact(x)

    def _write(self, rows: DataFrame, least: Column | None = None) -> None:
        """``rows`` (state, v, d, p) as the run's values, where ``p`` is the
        last move: their residual and frontier are observed. Residuals up to
        ``least`` count for nothing."""
        seen, r = Observation(), F.abs("d")
        if least is not None:
            r = F.when(r > least, r).otherwise(0.0)
        some = r if self.stride <= 1 else F.when(F.col("state") % self.stride == 0, r)
        rows = rows.observe(seen, F.max(r).alias("all"), F.max(some).alias("some"), F.count(F.lit(1)).alias("n"), F.count(F.when(self._moves(), 1)).alias("front"))
        self.rows = self.trail.bucketed(rows, "state", self.buckets)
        self.found, self.front = told(seen), seen.get["front"]

    def _moves(self) -> Column:
        """Whether a state is of the next frontier."""
        moves = F.abs("d") > self.eps
        return moves | (F.abs("p") > self.eps) if self.spectrum else moves

    def _exact(self, x: DataFrame, least: Column | None = None) -> None:
        """Residuals by a backup of all states: at the start, and to be sure at the end."""
        rows = x.join(self.op.apply(x), "state").select("state", "v", (F.col("fv") - F.col("v")).alias("d"), F.lit(0.0).alias("p"))
        self.weight = 1.0
        self._write(rows.repartition(self.buckets, "state"), least)
        self.known = True

    def sure(self) -> None:
        """Residuals of the values as they are, but for rounding."""
        self._exact(self.rows.select("state", "v"), ROUNDING * F.abs("v"))

    def look(self) -> Look:
        if self.found.residual <= self.eps and not self.known:
            self.sure()
            self.stalled = self.settled is not None and self.found.residual > self.settled / 2
            self.settled = self.found.residual
        return self.found

    def round_plan(self) -> DataFrame:
        """(state, v, d, p) after the frontier's push. Its only shuffle is that of the changes."""
        move = self.alpha * F.col("d")
        if self.spectrum:
            move = self.weight * F.col("d") + (self.weight - 1) * F.col("p")
        now = self.rows.select("state", "v", "d", F.when(self._moves(), move).otherwise(0.0).alias("p"))
        front = now.where("p != 0").select("state", F.col("p").alias("delta"))
        push = self.into.join(front.hint("shuffle_hash"), "state").groupBy(F.col("row").alias("state")).agg(F.sum(F.col("a") * F.col("delta")).alias("add"))
        return now.join(push.hint("shuffle_hash"), "state", "left").select("state", (F.col("v") + F.col("p")).alias("v"), (F.col("d") - F.col("p") + F.coalesce("add", F.lit(0.0))).alias("d"), "p")

    def advance(self, k: int) -> int:
        updates = self.front
        self.pushed.append(updates)
        self._write(self.round_plan())
        self.weight = 1 / (1 - self.spectrum**2 * (self.weight / 4 if self.weight > 1 else 0.5))
        self.known = False
        return updates

    def values(self) -> DataFrame:
        return self.trail.plain(self.rows).select("state", "v")
