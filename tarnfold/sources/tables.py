"""Models estimated from tables: states that follow each other, by count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import Mdp

#: Discount of the models made from tables.
BETA = 0.9


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(names: DataFrame) -> DataFrame:
    """(name, r, state): states numbered in the order of their names, without
    all passing through one task: ranges of names are sorted by themselves, and
    the sizes of the ranges (one row each) give the offsets."""
    ranges = names.repartitionByRange("name").sortWithinPartitions("name")
    ranges = cut(ranges.select("name", "r", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))
    sizes = ranges.groupBy("part").agg(F.min("id").alias("first"), F.count("*").alias("c"))
    offsets = sizes.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c") - F.col("first")).alias("shift"))
    return ranges.join(F.broadcast(offsets), "part").select("name", "r", (F.col("id") + F.col("shift")).cast("long").alias("state"))  # one row a partition


def from_pairs(names: DataFrame, pairs: DataFrame, beta: float = BETA, many: bool = False) -> Mdp:
    """``names`` (name, r): states, numbered in the order of their names, or as
    their column ``state`` says;
    ``pairs`` (a, b): observed steps between names. A state that is never left
    stays where it is. ``many``: the states grow with the data."""
    states = names if "state" in names.columns else numbered(names) if many else names.select("name", "r", (F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("state"))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    a, b = states.select(F.col("name").alias("a"), F.col("state").alias("src")), states.select(F.col("name").alias("b"), F.col("state").alias("dst"))
    edges = counts.join(a, "a").join(b, "b").select("src", "dst", "c")
    by_src = Window.partitionBy("src")
    t = edges.select("src", "dst", (F.col("c") / F.sum("c").over(by_src)).alias("p"), (F.row_number().over(by_src.orderBy("dst")) - 1).alias("ord"))
    lost = states.select("state").join(edges.select(F.col("src").alias("state")), "state", "left_anti")
    loops = lost.select(F.col("state").alias("src"), F.col("state").alias("dst"), F.lit(1.0).alias("p"), F.lit(0).alias("ord"))
    return Mdp(t.union(loops), states.select("state", "r"), beta)


def events_mdp(spark: SparkSession, sf_dir: str) -> Mdp:
    """Event types; steps: consecutive events of a user."""
    e = read(spark, sf_dir, "events")
    steps = e.select(F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b")).where("b is not null")
    return from_pairs(e.groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("r")), steps)


def user_events_mdp(spark: SparkSession, sf_dir: str) -> Mdp:
    """Pairs of user and event type; steps: consecutive events of a user."""
    e = read(spark, sf_dir, "events").withColumn("name", F.format_string("%012d/%s", "user_id", "event_type"))
    steps = e.select(F.col("name").alias("a"), F.lead("name").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b")).where("b is not null")
    return from_pairs(e.groupBy("name").agg(F.avg("value").alias("r")), steps, many=True)


def nation_mdp(spark: SparkSession, sf_dir: str) -> Mdp:
    """Nations; steps: from a customer's to the supplier's, by order line."""
    customer, orders, line, supplier = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier"))
    nation = read(spark, sf_dir, "nation")
    steps = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customer, orders["o_custkey"] == customer["c_custkey"])
    steps = steps.select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"))
    balance = supplier.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("r"))
    names = nation.join(balance, nation["n_nationkey"] == balance["s_nationkey"], "left").select(F.col("n_nationkey").alias("name"), F.coalesce("r", F.lit(0.0)).alias("r"))
    return from_pairs(names, steps)


def brand_mdp(spark: SparkSession, sf_dir: str) -> Mdp:
    """Brands; steps: consecutive lines of an order."""
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    sold = line.join(part, line["l_partkey"] == part["p_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    steps = sold.select(F.col("p_brand").alias("a"), F.lead("p_brand").over(order).alias("b")).where("b is not null")
    return from_pairs(part.groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_retailprice").alias("r")), steps)
