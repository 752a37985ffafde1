"""Colouring of a model's dependency graph, distributed.

Two states are joined if either reads the other. Every state has a random
priority; in each round the uncoloured states above all their uncoloured
neighbours take the smallest colour that no neighbour has. No two of them are
joined, so a round is one job, and a graph of bounded degree needs about as
many rounds as the logarithm of its states. The result is what a greedy pass in
descending order of priority would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import draw
from ..lineage import Trail
from ..model import Mdp

#: Colours beyond which a sweep by colours is no use: it would be as many jobs.
MOST = 64


def neighbours(m: Mdp) -> DataFrame:
    """(state, other): both directions of each pair of states of which one
    reads the other, once each."""
    t = m.transitions.where("src != dst and p != 0").select(F.explode(F.array(F.struct(F.col("src").alias("state"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("state"), F.col("src").alias("other")))).alias("e"))
    return t.select("e.*").distinct()


def colors(m: Mdp, seed: int = 42, most: int = MOST) -> DataFrame:
    """(state, color) of every state, colours from 0. Raises ValueError where
    more than ``most`` colours are needed."""
    trail = Trail(m.spark)
    edges = trail.cut(neighbours(m), True)
    states = trail.cut(m.rewards.select("state", draw(F.col("state"), 0, seed).alias("pri"), F.lit(None).cast("int").alias("color")))
    left = None
    while left != 0:
        there = states.select(F.col("state").alias("other"), F.struct("pri", "state").alias("rank"), F.col("color").alias("theirs"))
        seen = edges.join(there, "other").groupBy("state").agg(F.max(F.when(F.col("theirs").isNull(), F.col("rank"))).alias("top"), F.collect_set("theirs").alias("used"))
        free = F.element_at(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")), 1)
        new = F.when(F.col("color").isNotNull(), F.col("color")).when(F.col("used").isNull(), F.lit(0)).when(F.col("top").isNull() | (F.struct("pri", "state") > F.col("top")), free)
        now = Observation()
        rows = states.join(seen, "state", "left").select("state", "pri", new.alias("color"))
        states = trail.cut(rows.observe(now, F.count(F.when(F.col("color").isNull(), 1)).alias("left"), F.max("color").alias("last")))
        left = now.get["left"]
        if (now.get["last"] or 0) >= most:
            raise ValueError(f"the model needs more than {most} colours: its states read too many others")
    trail.end()
    return states.select("state", "color")
