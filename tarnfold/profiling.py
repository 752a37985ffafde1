"""Counters of update work: (run_id, tid, updates_completed, time_in_update_ns)
and of residual scans (run_id, scans, scan_ns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = "run_id string, tid int, updates_completed long, time_in_update_ns long"
SCANS = "run_id string, scans long, scan_ns long"


def profile(counters: DataFrame, scans: DataFrame) -> DataFrame:
    """Per run: updates, avg_update_cost_ns, avg_residual_scan_ns (0 where
    nothing was counted) and both in a line of text."""
    u = counters.groupBy("run_id").agg(F.sum("updates_completed").alias("updates"), F.sum("time_in_update_ns").alias("ns"))
    s = scans.groupBy("run_id").agg(F.sum("scans").alias("scans"), F.sum("scan_ns").alias("scan_ns"))
    mean = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = u.join(s, "run_id", "left").select("run_id", "updates", mean("ns", "updates").alias("avg_update_cost_ns"), F.coalesce(mean("scan_ns", "scans"), F.lit(0.0)).alias("avg_residual_scan_ns"))
    return out.withColumn("summary", F.format_string("updates=%d update_ns=%.1f scan_ns=%.1f", "updates", "avg_update_cost_ns", "avg_residual_scan_ns"))
