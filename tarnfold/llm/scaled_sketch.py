"""Threshold-scaled fingerprints of documents.

A fingerprint retains every hash of a document's 5-word shingles that lies
below a fixed fraction of the hash space, the same one for texts of every
length, so fingerprints of very unequal documents stay comparable: what is
retained of a part is retained of the whole, and the fingerprint of a union is
the union of fingerprints (``merge``). A short text retains few hashes, perhaps
none; ``error`` tells how far an estimate may be off.

Beside the hashes a fingerprint names its whole set by one hash, so that equal
sets are known to be equal however few of their hashes are retained.

Written as text: the fraction's denominator, the set's name (zero if unknown,
as after a merge) and the hashes in ascending order, in hex digits of 16 each,
parted by colons. Texts equal but for the case of A-Z and white space between
words have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, lower_bound, map_arrow, shingle_set, shuffle_partitions, slices, table

#: One in so many hashes is retained.
FRACTION = 4
WORDS = 5


class Sketch(NamedTuple):
    fraction: int
    name: int
    hashes: np.ndarray  # sorted


def sketch(shingles: np.ndarray, fraction: int = FRACTION) -> Sketch:
    """Of a sorted set of hashes."""
    name = xxhash.xxh3_64_intdigest(shingles.tobytes()) or 1
    return Sketch(fraction, name, shingles[: int(np.searchsorted(shingles, np.uint64((1 << 64) // fraction)))] if fraction > 1 else shingles)


def _at(s: Sketch, fraction: int) -> np.ndarray:
    return s.hashes if fraction == s.fraction else s.hashes[: int(np.searchsorted(s.hashes, np.uint64((1 << 64) // fraction)))]


def _shared(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    f = max(a.fraction, b.fraction)
    x, y = _at(a, f), _at(b, f)
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity, 0 to 1: 1 for sets known to be equal, 0
    where nothing is retained of either."""
    if a.name and a.name == b.name:
        return 1.0
    n, x, y = _shared(a, b)
    return n / (x + y - n) if x + y else 0.0


def error(a: Sketch, b: Sketch) -> float:
    """Standard error of ``likeness``: that of a share of the hashes retained
    of both, drawn towards one half as they get few. 0 for sets known to be equal."""
    if a.name and a.name == b.name:
        return 0.0
    n, x, y = _shared(a, b)
    both = x + y - n
    p = (n + 1) / (both + 2)
    return math.sqrt(p * (1 - p) / (both + 1))


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of ``a``'s shingles that are in ``b``: 1 for sets known
    to be equal, 0 where nothing of ``a`` is retained."""
    if a.name and a.name == b.name:
        return 1.0
    n, x, _ = _shared(a, b)
    return n / x if x else 0.0


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The fingerprint of both texts' shingles together, at the smaller fraction."""
    f = max(a.fraction, b.fraction)
    return Sketch(f, a.name if a.name == b.name else 0, np.union1d(_at(a, f), _at(b, f)))


def write(s: Sketch) -> str:
    return f"{s.fraction}:{s.name:016x}:" + s.hashes.astype(">u8").tobytes().hex()


def parse(text: str) -> Sketch:
    f, name, hashes = text.split(":")
    return Sketch(int(f), int(name, 16), np.frombuffer(bytes.fromhex(hashes), ">u8").astype(np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fingerprint`` of each text (null: empty), row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, "text"):
            made = [write(sketch(shingle_set(t, hashes))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return map_arrow(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, fingerprint string")


def _key() -> Column:
    """The order of documents: by doc_id (null first), ties by a hash of the
    text, so that a doc_id of very many rows can be split."""
    return F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h"))


def range_cuts(quantiles: list[int]) -> list[tuple[int, int]]:
    """Where ranges start: a doc_id that is several quantiles is cut into as
    many parts by the hash."""
    out = []
    for c in sorted(set(quantiles)):
        m = quantiles.count(c)
        out += [(c, -(1 << 63) + i * (1 << 64) // m) for i in range(m)]
    return out


def with_follower(docs: DataFrame) -> DataFrame:
    """doc_id, text, and ``_part``, ``_copy`` such that a part sorted by
    ``_copy``, doc_id and the text's hash holds consecutive documents, then
    (marked 1) a copy of the first of the following part; the last part gets
    the first.

    Ranges come from quantiles of doc_id, so no row passes through one task;
    the ranges' first keys (as many as parts) are all the driver sees.
    """
    n = max(1, shuffle_partitions(docs.sparkSession))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = docs.select(_key().alias("key"))
    cuts = range_cuts(sorted(keys.agg(F.percentile_approx("key.k", [i / n for i in range(1, n)], 10 * n)).head()[0] or []) if n > 1 else [])
    points = [F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h")) for k, h in cuts]
    heads = sorted((r["p"], tuple(r["key"])) for r in keys.groupBy(lower_bound(F.col("key"), points).alias("p")).agg(F.min("key").alias("key")).collect())
    rows = docs.select("doc_id", "text", _key().alias("key")).withColumn("_part", lower_bound(F.col("key"), points))
    if not heads:
        return rows.select("doc_id", "text", "_part", F.lit(0).alias("_copy"))
    # By part: its first key, and the part before it. Both are looked up by position.
    lead: list[tuple | None] = [None] * (len(cuts) + 1)
    before = [0] * (len(cuts) + 1)
    for i, (p, key) in enumerate(heads):
        lead[p], before[p] = key, heads[i - 1][0]
    own = F.struct(F.col("_part").alias("p"), F.lit(0).alias("c"))
    other = F.struct(F.get(F.array(*map(F.lit, before)), F.col("_part")).alias("p"), F.lit(1).alias("c"))
    first = [F.get(F.array(*[F.lit(x[i] if x else None).cast("long") for x in lead]), F.col("_part")) for i in range(2)]
    is_head = (F.col("key.k") == first[0]) & (F.col("key.h") == first[1])
    places = F.when(is_head, F.array(own, other)).otherwise(F.array(own))
    return rows.select("doc_id", "text", F.explode(places).alias("x")).select("doc_id", "text", F.col("x.p").alias("_part"), F.col("x.c").alias("_copy"))


def edited(text: str, follower: str) -> str:
    """The last half replaced by as much of the following document's start."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against an edited text of each and the next document.

    Null text is empty. Null doc_ids come first; rows with one doc_id follow
    each other by a hash of the text. A single document is followed by itself.
    ``edited_error`` and ``next_error``: standard errors of the two likenesses.
    """
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "edited_error": pa.float64(), "next_error": pa.float64(), "kept_of_edited": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held = None  # part, doc_id, text, sketch: a document whose follower is still to come
        for b in slices(batches, "text"):
            out: list[tuple] = []
            for part, copy, name, text in zip(*(b.column(c).to_pylist() for c in ("_part", "_copy", "doc_id", "text")), strict=True):
                own = sketch(shingle_set(text, hashes)) if not copy or held and held[0] == part else None
                if held and held[0] == part:
                    changed = edited(held[2], text)
                    new = sketch(shingle_set(changed, hashes))
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[1], len(held[2]), sha, write(held[3]), write(new), likeness(held[3], new), likeness(held[3], own), error(held[3], new), error(held[3], own), containment(held[3], new)))
                held = None if copy else (part, name, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds.values(), strict=True)], list(kinds))

    rows = with_follower(table(spark, sf_dir, "documents"))
    rows = rows.repartition(max(1, shuffle_partitions(spark)), "_part").sortWithinPartitions("_part", "_copy", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return map_arrow(rows, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_error double, next_error double, kept_of_edited double")
