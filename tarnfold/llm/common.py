"""Helpers shared by the training-data operators.

Intermediate tables are written below ``spark.checkpoint.dir``: the one folder
that the driver and all executors share, so a lost executor costs only its own
running tasks.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this subpackage.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words held in a worker's cache of word hashes; beyond it the cache starts anew.
WORD_CACHE = 300_000

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's checkpoint
    folder. Only where that is unset (tests on one machine) a temporary folder
    is chosen, and removed when Python exits."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tarnfold.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tarnfold-")
        spark.conf.set("spark.tarnfold.scratch", root)
        atexit.register(shutil.rmtree, root, True)
    return root


class Scratch:
    """Tables written in the shared folder by one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd", *folders: str) -> DataFrame:
        """Writes ``df``, in a folder for each value of the columns ``folders``,
        and returns a reader of it, whose lineage is the files.
        Spark drops the write's shuffle files at its end, as nothing reads them again."""
        schema, conf = df.schema, self.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").partitionBy(*folders).option("compression", compression).parquet(self.path(name))
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def read(self, df: DataFrame, name: str) -> DataFrame:
        """A reader of a table with the columns of ``df``."""
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """A table's columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``max_bytes`` of ``column`` (one
    row at least)."""
    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        if b.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
            yield b.slice(at, to - at)
            at = to


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORD_CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text, as UTF-8. ``bytes.split`` parts
    at exactly the six ASCII space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; one hash of all words if there are
    fewer than ``n``; none without words."""
    if len(w) == 0:
        return w
    n = min(n, len(w))
    m = len(w) - n + 1
    h = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        h += w[k : m + k] * _C[k % 5] ^ np.uint64(k + 1)
    return mix(h)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats numpy's hashing ``unique`` here."""
    if len(a) < 2:
        return a
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])]


def shingle_set(text: str | None, hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return distinct(ngram_hashes(hashes.of(words_of(text)), n))


def lower_bound(key: Column, cuts: list[Column]) -> Column:
    """How many of the ascending ``cuts`` (literals) are at most ``key``: a
    binary search as a plain expression, so that rows need no Python to find
    their range."""
    if not cuts:
        return F.lit(0)
    arr, m = F.array(*cuts), len(cuts)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(m.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda acc, s: F.when((acc + s <= m) & (F.get(arr, acc + s - 1) <= key), acc + s).otherwise(acc))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def safe_name(name: str) -> str:
    return re.sub(r"\W+", "_", name)
