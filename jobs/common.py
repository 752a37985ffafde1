"""What the jobs share: settings from a file and the command line, a log, and
tables of a job's folder, which may be remote: only Spark reads and writes it."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import uuid
from pathlib import Path
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tarnfold.lineage import folder

log = logging.getLogger("jobs")
C = TypeVar("C")


def settings(kind: type[C], description: str, argv: list[str] | None = None) -> C:
    """The dataclass ``kind`` from ``--config`` (JSON, by default the file
    beside the job) with what other arguments of the command line override."""
    fields = dataclasses.fields(kind)
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{kind.__module__.rpartition('.')[2]}.json")))
    for f in fields:
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default) if f.default is not dataclasses.MISSING else str)
    given = vars(parser.parse_args(argv))
    found = json.loads(Path(given.pop("config")).read_text())
    unknown = set(found) - {f.name for f in fields}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**found | {k: v for k, v in given.items() if v is not None})


def session(name: str) -> SparkSession:
    """For the command line only: jobs themselves are given a session."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that ``df`` has rows of; others stay as they are.
    Writing the same again changes nothing. The setting holds for this write alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the one that the session shares."""
    root = spark.conf.get("spark.checkpoint.dir", None) or folder(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
