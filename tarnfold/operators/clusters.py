"""Dense models of clusters, without their matrix.

In such a model a state goes to each state of its own cluster alike, and to
each state of all other clusters alike. A row of the matrix has n entries, but
its product with the values is made of two means: that of the own cluster and
that of all others. A backup sums the values by cluster, on the map side first,
and hands each state its cluster's result: it costs a row a state, and n * n
entries are never written. A run's rows carry cluster and reward along with the
values, so that sweeps join nothing but the clusters' results: a join of all
states with their values would be broadcast, whole and through the driver, as
long as their files are small, and files of repeated values are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import Mdp


class Clusters:
    """``states`` (state, cluster, r), every state once; ``shares`` (cluster,
    intra, inter): the chance to stay in the own cluster and to leave it. A
    cluster of all states has nowhere to go: its ``inter`` counts for nothing."""

    name = "policy evaluation of clusters"

    def __init__(self, states: DataFrame, shares: DataFrame, beta: float):
        self.states, self.shares, self.beta = states, shares, beta

    @property
    def spark(self) -> SparkSession:
        return self.states.sparkSession

    def zeros(self) -> DataFrame:
        """(state, cluster, r, v): rows that ``backed`` needs no join for."""
        return self.states.select("state", "cluster", "r", F.lit(0.0).alias("v"))

    def backed(self, x: DataFrame) -> DataFrame:
        """``x`` (state, v) or rows as those of ``zeros`` with fv, as (state, cluster, r, v, fv)."""
        if not {"cluster", "r"} <= set(x.columns):
            x = self.states.hint("merge").join(x, "state")  # neither side is broadcast
        x = x.select("state", "cluster", "r", "v")
        own = x.groupBy("cluster").agg(F.sum("v").alias("s"), F.count("*").alias("m"))
        whole = own.agg(F.sum("s").alias("total"), F.sum("m").alias("n"))
        means = own.crossJoin(F.broadcast(whole)).join(self.shares, "cluster")  # one row
        far = F.when(F.col("n") > F.col("m"), F.col("inter") * (F.col("total") - F.col("s")) / (F.col("n") - F.col("m"))).otherwise(0.0)
        # written, as Spark then knows that they are the smaller side: it would guess that all states are
        means = cut(means.select("cluster", (self.beta * (F.col("intra") * F.col("s") / F.col("m") + far)).alias("g")))
        return x.join(means, "cluster").select("state", "cluster", "r", "v", (F.col("r") + F.col("g")).alias("fv"))

    def apply(self, x: DataFrame) -> DataFrame:
        return self.backed(x).select("state", "fv")

    def explicit(self) -> Mdp:
        """The same model with all entries written out; for small ones."""
        a = self.states.join(self.shares, "cluster").join(self.states.groupBy("cluster").agg(F.count("*").alias("m")), "cluster")
        n = self.states.count()
        b = self.states.select(F.col("state").alias("dst"), F.col("cluster").alias("to"))
        p = F.when(F.col("cluster") == F.col("to"), F.col("intra") / F.col("m")).otherwise(F.col("inter") / F.greatest(n - F.col("m"), F.lit(1)))
        t = a.join(b, F.lit(True)).select(F.col("state").alias("src"), "dst", p.alias("p"), F.col("dst").cast("int").alias("ord"))
        return Mdp(t, self.states.select("state", "r"), self.beta)


def _shares(spark: SparkSession, k: int, intra: float, inter: float) -> DataFrame:
    return spark.range(k).select(F.col("id").alias("cluster"), F.lit(intra).alias("intra"), F.lit(inter).alias("inter"))


def metastable(spark: SparkSession, n: int, beta: float, p_intra: float = 0.95, p_bridge: float = 0.05, reward_a: float = 1.0, reward_b: float = 2.0) -> Clusters:
    """The generator's metastable model of the same parameters."""
    half = max(1, n // 2)
    cluster = F.when(F.col("id") < half, 0).otherwise(1).cast("long")
    states = spark.range(2 * half).select(F.col("id").alias("state"), cluster.alias("cluster"), F.when(F.col("id") < half, reward_a).otherwise(reward_b).alias("r"))
    return Clusters(states, _shares(spark, 2, p_intra, p_bridge), beta)


def multi_cluster(spark: SparkSession, n: int, k: int, beta: float, p_intra: float = 0.9) -> Clusters:
    """The generator's model of k clusters, of reward 1, 2 and so on."""
    k = min(max(1, k), n)
    size, extra = divmod(n, k)
    big, i = extra * (size + 1), F.col("id")
    cluster = F.when(i < big, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - big) / size)).cast("long")
    return Clusters(spark.range(n).select(i.alias("state"), cluster.alias("cluster"), (cluster + 1).cast("double").alias("r")), _shares(spark, k, p_intra, 1 - p_intra), beta)


def from_table(rows: DataFrame, state: Column, cluster: Column, r: Column, p_intra: Column, beta: float) -> Clusters:
    """A model of a table's rows: ``p_intra`` is an aggregate over a cluster's
    rows. Null rewards are 0; rows without a cluster are left out."""
    states = rows.select(state.alias("state"), cluster.alias("cluster"), F.coalesce(r, F.lit(0.0)).alias("r")).where("cluster is not null")
    shares = rows.where(cluster.isNotNull()).groupBy(cluster.alias("cluster")).agg(p_intra.alias("intra")).select("cluster", "intra", (1 - F.col("intra")).alias("inter"))
    return Clusters(states, shares, beta)
