"""Cutting the lineage of iterative plans: tables in the folder that the driver
and all executors share.

A written table also tells Spark its true size. A checkpoint keeps the estimate
of the plan that made it, and an iteration that joins a table with itself
squares that estimate each time, until the planner alone runs out of memory.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder: the session's ``spark.checkpoint.dir``. Only a local
    session without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tarnfold.shared", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tarnfold-")
        spark.conf.set("spark.tarnfold.shared", root)
        atexit.register(shutil.rmtree, root, True)
    return root.rstrip("/")


class Trail:
    """The tables of one iteration. Only the last ``keep`` are held; ``kept``
    ones stay until ``end``, which removes all but the last."""

    def __init__(self, spark: SparkSession, keep: int = 2):
        self.spark, self.keep, self.base = spark, keep, f"{folder(spark)}/trail-{uuid.uuid4().hex[:12]}"
        self.made, self.old, self.fixed, self.names = 0, [], [], []

    def _path(self, fixed: bool) -> str:
        path = f"{self.base}/{self.made}"
        self.made += 1
        if fixed:
            self.fixed.append(path)
            return path
        self.old.append(path)
        while len(self.old) > self.keep:
            self.remove(self.old.pop(0))
        return path

    def cut(self, df: DataFrame, fixed: bool = False) -> DataFrame:
        """``df`` as files, and a reader of them."""
        path, schema = self._path(fixed), df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, buckets: int, fixed: bool = False) -> DataFrame:
        """The same, in buckets by ``key``: a join of such tables on the key
        shuffles neither."""
        path, name = self._path(fixed), f"trail_{uuid.uuid4().hex}"
        df.write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def plain(self, df: DataFrame, at: int = -1) -> DataFrame:
        """A reader of the table written last, that needs no catalog."""
        return self.spark.read.schema(df.schema).parquet(self.old[at])

    def remove(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def end(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # of the catalog: the files stay
        for path in [*self.fixed, *self.old[:-1]]:
            self.remove(path)
        self.names, self.fixed, self.old = [], [], self.old[-1:]


def cut(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared folder."""
    path, schema = f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex[:16]}", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
