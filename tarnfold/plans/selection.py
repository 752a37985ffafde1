"""Selections and ranks of tables of any size, without a task that sees all rows.

The k-th largest value is found by histograms that are refined: each pass
counts the rows of at most ``BINS`` ranges between two values, and goes on
inside the one range in which the k-th lies. Ties at the value are cut by state
in the same way, so that what is selected is a plain filter.

Ranks are prefix sums in two levels: ranges of the order are sorted by
themselves, and the rows of the ranges before, one number each, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Ranges counted in a pass: the rows of one pass that reach the driver.
BINS = 1024
_HUGE = 1.7e308


def edge(rows: DataFrame, value: Column, k: int) -> tuple[float, int] | None:
    """The k-th largest value (a double), and how many rows of exactly that
    value are among the k largest; None if there are no more than k rows."""
    v = rows.select(value.alias("v"))
    n, lo, hi = v.agg(F.count("*"), F.min("v"), F.max("v")).head()
    if n <= k:
        return None
    while lo < hi:
        # Halves first, as the difference itself may be too large for a double.
        width = max(hi / BINS - lo / BINS, 5e-324)
        bin_of = F.least(F.floor(F.col("v") / width - lo / width), F.lit(BINS - 1)) if abs(lo / width) < 2**52 else (F.col("v") > (lo / 2 + hi / 2)).cast("long")
        bins = v.where(F.col("v").between(lo, hi)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if k <= b["c"]:
                if (b["lo"], b["hi"]) == (lo, hi):  # neighbours that no width parts
                    above = v.where(F.col("v") == hi).count()
                    lo, hi, k = (hi, hi, k) if k <= above else (lo, lo, k - above)
                else:
                    lo, hi = b["lo"], b["hi"]
                break
            k -= b["c"]
    return hi, k


def descending(c: str) -> Column:
    """A value as it is ranked: rounded, so that engines agree on ties; NaN
    last, infinite values first."""
    v = F.col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v), -_HUGE).otherwise(F.greatest(F.least(F.round(v, 9), F.lit(_HUGE)), F.lit(-_HUGE)))


def largest(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest ``column``, ties by the smallest ``state``."""
    if k <= 0:
        return rows.limit(0)
    rows = cut(rows)
    value = descending(column)
    found = edge(rows, value, k)
    if found is None:
        return rows
    at, need = found
    tied = rows.where(value == at)
    last = edge(tied, -F.col("state").cast("double"), need)
    first_ties = F.lit(True) if last is None else F.col("state") <= int(-last[0])
    return rows.where((value > at) | (value == at) & first_ties)


def ranked(rows: DataFrame, order: list[Column], weight: Column | None = None) -> DataFrame:
    """``rows`` with ``pos``, their place in the order from 0, and with
    ``before``, the weights of the rows before, if there is a weight. The
    order must tell rows apart."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    w = F.lit(0) if weight is None else weight
    parts = cut(parts.select("*", w.alias("_w"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("c"), F.sum("_w").alias("w"), F.min("_id").alias("first")).orderBy("_part").collect()  # a row a range
    shifts, c, total = [], 0, 0
    for s in sizes:
        shifts.append((s["_part"], c - s["first"], float(total)))
        c, total = c + s["c"], total + s["w"]
    starts = rows.sparkSession.createDataFrame(shifts, "_part int, _shift long, _total double")
    out = parts.join(F.broadcast(starts), "_part").withColumn("pos", F.col("_id") + F.col("_shift"))
    if weight is not None:
        own = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", (F.coalesce(F.sum("_w").over(own), F.lit(0)) + F.col("_total")).cast(rows.select(weight.alias("w")).schema["w"].dataType))
    return out.drop("_w", "_part", "_id", "_shift", "_total")


def ranked_within(rows: DataFrame, group: str, order: list[Column], descending_groups: bool = False) -> DataFrame:
    """``rows`` with ``pos``, their place among all in the order of groups, and
    ``own``, that inside their group. There must be few groups; a group may
    have any number of rows."""
    first = F.col(group).desc() if descending_groups else F.col(group).asc()
    out = cut(ranked(rows, [first, *order]))
    starts = out.groupBy(group).agg(F.min("pos").alias("_start"))
    return out.join(F.broadcast(starts), group).withColumn("own", F.col("pos") - F.col("_start")).drop("_start")
