"""An extension: following a run's residual trace while it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "run_id string, seq int, sweep int, time_sec double, residual double"


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet traces that appear under ``path``."""
    return spark.readStream.schema(TRACE).parquet(path)


def progress(trace: DataFrame, eps: float) -> DataFrame:
    """Per run the latest sweep and residual, and whether it has converged; on
    a stream or a table. The state is one row a run."""
    last = F.max(F.struct("sweep", "residual")).alias("last")
    return trace.groupBy("run_id").agg(last, F.min("residual").alias("least")).select("run_id", F.col("last.sweep").alias("sweep"), F.col("last.residual").alias("residual"), (F.col("least") <= eps).alias("converged"))
