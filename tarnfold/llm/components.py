"""Connected components of a graph given by its edges, as tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the smallest node of each edge's component, for all nodes
    of ``edges`` (a, b: long).

    Alternates large-star and small-star steps: every node's larger neighbours
    are hung under its smallest one, then its smaller ones, until all hang
    under their component's smallest node. Each round's edges are a table in
    the shared folder; only their number and a checksum reach the driver.
    """
    now = scratch.write(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    seen = None
    for turn in count(1):  # until nothing changes
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        tops = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(tops, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(tops.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.write(small, f"{name}{turn}")
        if turn > 1:
            scratch.drop(f"{name}{turn - 1}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
