"""Markov decision processes under a fixed policy, as tables.

``transitions`` (src, dst, p, ord) holds one row for each entry of the sparse
transition matrix; ``ord`` numbers a row's entries, which may repeat a ``dst``.
``rewards`` (state, r) has one row for each state 0 to n - 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSITIONS = "src long, dst long, p double, ord int"
REWARDS = "state long, r double"
VALUES = "state long, v double"


@dataclass(frozen=True)
class Mdp:
    transitions: DataFrame
    rewards: DataFrame
    beta: float

    @property
    def spark(self) -> SparkSession:
        return self.rewards.sparkSession

    def zeros(self) -> DataFrame:
        return self.rewards.select("state", F.lit(0.0).alias("v"))

    def size(self) -> int:
        return self.rewards.count()

    def profile(self) -> DataFrame:
        """n, nnz, most and fewest entries of a row, beta."""
        degrees = self.degrees()
        return degrees.agg(F.count("*").alias("n"), F.sum("nnz").alias("nnz"), F.max("nnz").alias("max_row"), F.min("nnz").alias("min_row")).withColumn("beta", F.lit(self.beta))

    def degrees(self) -> DataFrame:
        """state, nnz (0 for empty rows)."""
        counts = self.transitions.groupBy(F.col("src").alias("state")).agg(F.count("*").alias("nnz"))
        return self.rewards.select("state").join(counts, "state", "left").select("state", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def violations(m: Mdp, strict: bool = True, tol: float = 1e-9) -> DataFrame:
    """check, state, value of everything that makes the model invalid; empty
    for a valid one. Not strict: rows may sum to anything from 0 to 1."""
    spark, beta = m.spark, m.beta
    one = spark.range(1)

    def rows(df: DataFrame, check: str, state: F.Column, value: F.Column) -> DataFrame:
        return df.select(F.lit(check).alias("check"), state.cast("long").alias("state"), value.cast("double").alias("value"))

    none = F.lit(None)
    found = rows(one.where(F.lit(not 0 < beta < 1)), "beta outside (0, 1)", none, F.lit(beta))
    found = found.union(rows(m.rewards.agg(F.count("*").alias("n")).where("n = 0"), "no states", none, F.col("n")))
    extent = m.rewards.agg(F.count("*").alias("n"), F.countDistinct("state").alias("d"), F.min("state").alias("lo"), F.max("state").alias("hi"))
    found = found.union(rows(extent.where("n > 0 and (n != d or lo != 0 or hi != n - 1)"), "states not 0 to n - 1", none, F.col("d")))
    states = m.rewards.select("state")
    for side in ("src", "dst"):
        lost = m.transitions.join(states, m.transitions[side] == states["state"], "left_anti")
        found = found.union(rows(lost, f"{side} is no state", F.col(side), F.col("p")))
    bad = m.transitions.where(F.isnan("p") | F.col("p").isNull() | (F.col("p") < 0) | (F.col("p") > 1))
    found = found.union(rows(bad, "p outside 0 to 1", F.col("src"), F.col("p")))
    sums = states.join(m.transitions.groupBy(F.col("src").alias("state")).agg(F.sum("p").alias("s")), "state", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    off = F.abs(F.col("s") - 1) > tol if strict else (F.col("s") < -1e-6) | (F.col("s") > 1 + 1e-6)
    return found.union(rows(sums.where(off | F.isnan("s")), "row sum", F.col("state"), F.col("s")))


def check(m: Mdp, strict: bool = True, tol: float = 1e-9) -> None:
    """Raises ValueError on the first violation."""
    first = violations(m, strict, tol).orderBy("check", "state").head()
    if first:
        raise ValueError(f"{first['check']} (state {first['state']}): {first['value']}")
