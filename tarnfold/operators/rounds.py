"""Ways to run a model over tables of any size, a round at a time.

Each keeps the values of a run as tables in the shared folder. ``look`` gives
the residual of the values as they are; ``advance`` goes on to the next ones.
Where a round's own job can tell the residual, ``look`` is that job.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..lineage import Trail
from ..model import Mdp
from ..plans.schedulers import Scheduler
from .bellman import FixedPointOperator, backup, damped, residuals

#: Phases of a round: each is a job of its own.
MOST_PHASES = 64


@dataclass(frozen=True)
class Look:
    """The largest residual, that of each stride-th state, and the states."""

    residual: float
    strided: float
    states: int


def observed(rows: DataFrame, stride: int) -> tuple[DataFrame, Observation]:
    """``rows`` (state, residual) that tell a ``Look`` when they are written. NaN is ignored."""
    seen = Observation()
    r = F.when(~F.isnan("residual"), F.col("residual"))
    some = r if stride <= 1 else F.when(F.col("state") % stride == 0, r)
    return rows.observe(seen, F.max(r).alias("all"), F.max(some).alias("some"), F.count(F.lit(1)).alias("n")), seen


def told(seen: Observation) -> Look:
    x = seen.get
    return Look(x["all"] or 0.0, x["some"] or 0.0, x["n"])


def backed(op: FixedPointOperator, x: DataFrame) -> DataFrame:
    """``x`` with fv. Operators that can add it to the rows by themselves, as
    these have all that a state needs, spare a join of all states."""
    if hasattr(op, "backed"):
        return op.backed(x)
    return x.join(op.apply(x), "state").select("state", "v", "fv")


class Rounds:
    """``always``: a look costs nothing, as the round's own job has it.
    ``stalled``: more rounds don't help, as what is left is rounding."""

    always = stalled = False

    def __init__(self, op: FixedPointOperator, x: DataFrame, alpha: float, stride: int = 1, keep: int = 3):
        self.op, self.x, self.alpha, self.stride = op, x, alpha, stride
        self.trail, self.rows = Trail(x.sparkSession, keep), None

    def look(self) -> Look:
        rows = backed(self.op, self.x).withColumn("residual", F.abs(F.col("fv") - F.col("v")))
        rows, seen = observed(rows, self.stride)
        self.rows = self.trail.cut(rows)
        return told(seen)

    def advance(self, k: int) -> int:
        """To the values after round ``k``; how many updates that took."""
        raise NotImplementedError

    def values(self) -> DataFrame:
        """(state, v) after a look, readable after ``end``."""
        return self.rows.select("state", "v")

    def end(self) -> None:
        self.trail.end()


class Synchronous(Rounds):
    """All states at once: the job of a sweep also has the residual that it starts from."""

    always = True

    def look(self) -> Look:
        found = super().look()
        self.n = found.states
        return found

    def advance(self, k: int) -> int:
        step = damped(self.alpha)
        self.x = self.rows.withColumn("v", step(F.col("v"), F.col("fv"))).drop("fv", "residual")
        return self.n


class Colors(Rounds):
    """Gauss-Seidel by colours: states of one colour don't read each other, so
    they update together, against what the colours before have just made. A
    colour is one job that reads its own transitions and writes its own values;
    a sweep is as many jobs as there are colours."""

    def __init__(self, m: Mdp, op: FixedPointOperator, x: DataFrame, colors: DataFrame, alpha: float, stride: int = 1):
        found = [r["color"] for r in colors.select("color").distinct().orderBy("color").collect()]  # bounded by ``coloring.MOST``
        super().__init__(op, x, alpha, stride, 2 * len(found) + 3)
        t = m.transitions.join(colors, m.transitions["src"] == colors["state"]).select("src", "dst", "p", "color")
        r = m.rewards.join(colors, "state")
        by = lambda df: self.trail.cut(df.repartition("color", df.columns[0]), True)
        t, r = by(t), by(r)
        self.models = {c: Mdp(t.where(F.col("color") == c).select("src", "dst", "p"), r.where(F.col("color") == c).select("state", "r"), m.beta) for c in found}
        first = by(x.join(colors, "state"))
        self.parts = {c: first.where(F.col("color") == c).select("state", "v") for c in found}
        self.n = first.count()

    def advance(self, k: int) -> int:
        step = damped(self.alpha)
        for c, m in self.models.items():
            all_values = reduce(DataFrame.union, self.parts.values())
            new = backup(m, all_values).join(self.parts[c], "state").select("state", step(F.col("v"), F.col("fv")).alias("v"))
            self.parts[c] = self.trail.cut(new)
        self.x = reduce(DataFrame.union, self.parts.values())
        return self.n


class Phased(Rounds):
    """The phases of a plan, or of a scheduler's order, one after the other:
    the states of a phase update together from the values before it."""

    def __init__(self, m: Mdp, op: FixedPointOperator, x: DataFrame, alpha: float, stride: int = 1):
        super().__init__(op, x, alpha, stride, 6)
        self.m, self.phases = m, []

    def advance(self, k: int) -> int:
        updates = 0
        for phase in self.phases:
            seen = Observation()
            new = backup(self.m, self.x, phase).observe(seen, F.count(F.lit(1)).alias("n"))
            step = damped(self.alpha)
            x = self.x.join(new, "state", "left").select("state", F.when(F.col("fv").isNull(), F.col("v")).otherwise(step(F.col("v"), F.col("fv"))).alias("v"))
            self.x = self.trail.cut(x)
            updates += seen.get["n"]
        return updates


class Scheduled(Phased):
    """An asynchronous round in a scheduler's order: the threads take ``stale``
    states each, update them from what all see, and then exchange. The order is
    made anew from the residuals every ``rebuild_every`` rounds (0: never)."""

    def __init__(self, m: Mdp, op: FixedPointOperator, x: DataFrame, scheduler: Scheduler, threads: int, stale: int, rebuild_every: int, alpha: float, stride: int = 1):
        super().__init__(m, op, x, alpha, stride)
        self.scheduler, self.threads, self.stale = scheduler, threads, max(1, stale)
        self.rebuild_every = 0 if scheduler.kind == "static" else rebuild_every
        self.n = m.size()

    def advance(self, k: int) -> int:
        if not self.phases or self.rebuild_every and k % self.rebuild_every == 0:
            found = residuals(self.m, self.x) if self.scheduler.needs_residuals else self.x
            order = self.scheduler.dispatch(found, self.n, self.threads, k)
            turn = F.when(F.col("tid").isNull(), F.floor(F.col("pos") / self.threads)).otherwise(F.col("pos"))
            order = self.trail.cut(order.select("pass", F.floor(turn / self.stale).cast("int").alias("batch"), "state"), True)
            batches = order.groupBy("pass").agg(F.max("batch").alias("last")).orderBy("pass").collect()  # two rows at most
            if sum(b["last"] + 1 for b in batches) > MOST_PHASES:
                raise ValueError(f"an order of {sum(b['last'] + 1 for b in batches)} exchanges a round needs as many jobs over tables, {MOST_PHASES} at most: raise `stale` or `threads`")
            self.phases = [order.where((F.col("pass") == b["pass"]) & (F.col("batch") == i)).select("state") for b in batches for i in range(b["last"] + 1)]
        return super().advance(k)
