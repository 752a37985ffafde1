"""What customers are worth: expected discounted revenue by nation.

A customer's state is their market segment with the priority of their latest
order; each nation's customers make a Markov reward process of their own, whose
steps are consecutive orders and whose reward is the mean price of an order in
the state. Its value ``V = r + beta P V`` is what the order and all that follow
are expected to bring, a later order counting ``beta`` times the one before.

    python -m jobs.customer_values --tables PATH --out PATH

Writes ``values`` below ``out``, by nation. A run replaces the partitions of
the nations that it finds, so that running again gives the same.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.lineage import cut
from tarnfold.model import Mdp
from tarnfold.operators.solvers import SolverConfig, solve
from tarnfold.sources.tables import from_pairs, numbered, read

from .common import log, new_folder, replace_partitions, session, settings


@dataclass(frozen=True)
class Settings:
    """``beta`` discounts each next order; values are exact to ``eps / (1 - beta)``."""

    tables: str
    out: str
    beta: float = 0.9
    eps: float = 1e-8


def states(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Every order with its customer's nation and the state it puts them in.
    Orders of unknown customers, and of customers of unknown nations, are left out."""
    known = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    rows = orders.join(known, orders["o_custkey"] == known["c_custkey"])
    return rows.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "n_name", "c_mktsegment", "o_orderpriority", F.to_json(F.struct("n_name", "c_mktsegment", "o_orderpriority")).alias("name"))


def model(rows: DataFrame, beta: float) -> tuple[Mdp, DataFrame]:
    """All nations' processes side by side in one model, and its states."""
    by = F.first("n_name").alias("nation"), F.first("c_mktsegment").alias("segment"), F.first("o_orderpriority").alias("priority")
    names = cut(rows.groupBy("name").agg(F.avg("o_totalprice").alias("r"), F.sum(F.round(100 * F.col("o_totalprice")).cast("long")).alias("cents"), F.count("*").alias("orders"), *by))
    numbers = numbered(names.select("name", "r"))
    following = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = rows.select(F.col("name").alias("a"), F.lead("name").over(following).alias("b")).where("b is not null")
    return from_pairs(numbers, steps, beta), names.join(numbers.select("name", "state"), "name")


def run(spark: SparkSession, s: Settings) -> DataFrame:
    """Reads ``orders``, ``customer`` and ``nation``, solves, writes; the
    values: segment, priority, orders, cents (their revenue), value, place, nation."""
    began = time.time()
    tables = {t: read(spark, s.tables, t) for t in ("orders", "customer", "nation")}
    rows = states(tables["orders"], tables["customer"], tables["nation"])
    m, names = model(rows, s.beta)
    log.info("read %s from %s", ", ".join(f"{t}: {df.count()} rows" for t, df in tables.items()), s.tables)
    found = solve(m, SolverConfig(eps=s.eps))
    log.info("%s after %d sweeps, residual %.3g", "converged" if found.converged else "not converged", found.sweeps, found.final_residual_inf)
    place = F.row_number().over(Window.partitionBy("nation").orderBy(F.desc(F.round("v", 3)), "segment", "priority"))
    values = names.join(found.values, "state")
    values = values.select("segment", "priority", "orders", "cents", F.col("v").alias("value"), place.alias("place"), "nation")
    replace_partitions(values.repartition("nation"), f"{s.out}/values", "nation")
    out = spark.read.parquet(f"{s.out}/values")
    log.info("wrote %d states of %d nations to %s/values in %.1f s", out.count(), out.select("nation").distinct().count(), s.out, time.time() - began)
    return out


def job2_customer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job, twice over the whole tables into a new folder."""
    s = Settings(sf_dir, new_folder(spark, "job2"))
    run(spark, s)
    return run(spark, s).select("nation", "segment", "priority", "orders", "cents", F.round("value", 3).alias("value"), F.col("place").cast("long").alias("place"))


SQL = """WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, n_name, c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT row_number() OVER () AS i, n_name AS nation, c_mktsegment AS segment, o_orderpriority AS priority, avg(o_totalprice) AS price, CAST(sum(CAST(round(100 * o_totalprice) AS BIGINT)) AS BIGINT) AS cents, count(*) AS orders FROM o GROUP BY ALL),
j AS (SELECT o.*, i FROM o JOIN n ON nation = n_name AND segment IS NOT DISTINCT FROM c_mktsegment AND priority IS NOT DISTINCT FROM o_orderpriority),
s AS (SELECT i, lead(i) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS j FROM j), c AS (SELECT i, j, count(*) AS c FROM s WHERE j IS NOT NULL GROUP BY ALL),
e AS (SELECT i, j, c / sum(c) OVER (PARTITION BY i) AS p FROM c UNION ALL SELECT i, i, 1.0 FROM n WHERE i NOT IN (SELECT i FROM c)),
x(k, i, v) AS (SELECT 0, i, CAST(0 AS DOUBLE) FROM n UNION ALL SELECT k + 1, e.i, any_value(price) + 0.9 * sum(p * v) FROM x JOIN e ON x.i = e.j JOIN n ON n.i = e.i WHERE k < 400 GROUP BY k, e.i)
SELECT nation, segment, priority, orders, cents, round(CAST(v AS DOUBLE), 3) AS value, row_number() OVER (PARTITION BY nation ORDER BY round(CAST(v AS DOUBLE), 3) DESC, segment, priority) AS place FROM n JOIN x USING (i) WHERE k = 400"""


def main() -> None:
    s = settings(Settings, "Values of customers' states by nation.")
    spark = session("customer values")
    try:
        run(spark, s)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
