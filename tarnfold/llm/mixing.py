"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight and a schedule: its share of the mix as a function of
training time from 0 to 1. The integral of the schedule, scaled to the source's
target, is the number of its words wanted up to a time; inverting it gives each
document the time at which the words before it have been used up, its position.
Documents stand in an order by hash within their source, which is walked again
from the start when a target exceeds the source, up to twice. The mix is
range-sorted by position: all sources run on one clock, and the words taken of
any source before a document's time are its place in the whole mix.

Prefix sums within a source are taken in two steps, over hash buckets and
inside a bucket, so that a source with a third of all rows is spread over as
many tasks as it has buckets; so are those of the whole mix, over ranges of
the sorted positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, columns, map_arrow, shuffle_partitions, slices, table

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix against all words, and the most that a source may repeat.
BUDGET, REPEATS = 1.5, 2
#: By place in ``WEIGHTS``: density at time 0; density is linear with mean 1.
#: Steady, rising, falling.
STARTS = (1.0, 0.5, 1.5)
#: Rows of a source in a hash bucket, about.
BUCKET_ROWS = 4000


def sizes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``size``, the text's words (null: 0), ``name``,
    a hash of the text, and ``h``, the place in the order."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, F.xxhash64(text).alias("name"), order_hash(F.col("doc_id"), text).alias("h"), text.alias("text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n = np.array([len(t.encode("utf-8", "surrogatepass").split()) for t in b.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in (*keep, "name", "h")] + [pa.array(n)], [*keep, "name", "h", "size"])

    return map_arrow(rows, run, f"{ddl}, size long")


def order_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of name and text: the order of documents in their
    source. Documents of one repeated or null name are spread by their texts."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(text.cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(by_source: DataFrame) -> DataFrame:
    """skey, source_size, place, target from one row for each source.

    Shares by weight that exceed the most a source gives are cut to it and the
    excess goes to the others by weight: each target is the lesser of its cap
    and its weight times one level, found from the sorted ratios cap / weight.
    """
    order = Window.orderBy("skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), F.col("place") + 1)
    rows = by_source.withColumn("place", ((F.row_number().over(order) - 1) % len(WEIGHTS)).cast("int")).withColumn("w", w).withColumn("cap", REPEATS * F.col("source_size").cast("double"))
    whole = Window.partitionBy()
    level = Window.orderBy("ratio", "skey")
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w")).withColumn("budget", F.sum("source_size").over(whole) * BUDGET)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("own_level", F.try_divide(F.col("budget") - F.col("capped"), "rest"))
    fits = F.min(F.when(F.col("own_level") <= F.col("ratio"), F.struct("ratio", "skey", "own_level"))).over(whole)
    return rows.select("skey", "source_size", "place", F.least("cap", F.coalesce(fits["own_level"] * F.col("w"), F.col("cap"))).alias("target"))


def position(share: Column, place: Column) -> Column:
    """The time at which a share (0 to 1) of a source's demand is used up: the
    inverse of ``a t + (1 - a) t^2`` for the density that starts at ``a``."""
    a = F.element_at(F.array(*[F.lit(x) for x in STARTS]), place + 1)
    return F.when(a == 1, share).otherwise((F.sqrt(a * a + 4 * (1 - a) * share) - a) / (2 * (1 - a)))


def plan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (doc_id among them) with name, size, source_size,
    target, taken, and first and second: the positions of the document's two
    passes, null where nothing is taken.

    The document at the end of a target is taken in part, by words. Null
    sources are a source of their own, the last; texts without words take
    nothing; repeated rows are documents of their own; an empty table gives no
    rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    keep = list(dict.fromkeys([*keep, "source"]))
    skey = F.when(F.col("source").isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col("source")))
    rows = scratch.write(sizes(docs, keep).withColumn("skey", skey), "sizes")
    n = rows.count()
    buckets = max(1, n // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.shiftright(F.shiftright("h", 20) * buckets, 40))
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    sums = scratch.write(sums, "buckets")
    bases = sums.select("skey", "bucket", (F.sum("words").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("words")).alias("base"))
    aims = targets(sums.groupBy("skey").agg(F.sum("words").alias("source_size")))
    starts = scratch.write(bases.join(aims, "skey"), "starts")
    inner = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", "name")
    out = rows.withColumn("own", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).join(starts, ["skey", "bucket"])
    before, aim = F.col("base") + F.col("own"), F.round("target").cast("long")
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), aim - k * F.col("source_size") - before)) for k in range(REPEATS)]
    taken = sum(passes[1:], passes[0])
    places = [F.when(p > 0, position(F.least(F.lit(1.0), (k * F.col("source_size") + before + p / 2) / F.greatest("target", F.lit(1e-9))), F.col("place"))) for k, p in enumerate(passes)]
    return out.select(*keep, "name", "size", "source_size", "target", taken.cast("long").alias("taken"), places[0].alias("first"), places[1].alias("second"))


def sequence(rows: DataFrame) -> DataFrame:
    """``plan``'s rows with ``start``: the words of the whole mix, of all
    sources, before the document's first pass; null where nothing is taken.

    The passes are range-sorted by position, ties by doc_id, size and text, and
    written with the range that each lies in; a range's words, one row each, are
    added up for those behind it. Repeated rows have positions, and so starts,
    of their own; an empty table gives no rows.
    """
    spark = rows.sparkSession
    scratch, n = Scratch(spark, "sequence"), shuffle_partitions(spark)
    once = F.least("taken", "size")
    passes = F.array(F.struct(F.lit(0).alias("turn"), F.coalesce("first", F.lit(2.0)).alias("at"), once.alias("words")), F.struct(F.lit(1).alias("turn"), F.col("second").alias("at"), (F.col("taken") - once).alias("words")))
    order = ["at", "doc_id", "size", "name", "turn"]
    dealt = rows.select("*", F.inline(passes)).where("turn = 0 or words > 0").repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = scratch.write(dealt.withColumn("range", F.spark_partition_id()), "passes")
    sums = dealt.groupBy("range").agg(F.sum("words").alias("base"))
    bases = sums.select("range", (F.sum("base").over(Window.orderBy("range")) - F.col("base")).alias("base"))  # a row a range
    own = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("own", F.sum("words").over(own) - F.col("words")).join(F.broadcast(bases), "range").where("turn = 0")
    return placed.select(*rows.columns, F.when(F.col("taken") > 0, F.col("base") + F.col("own")).alias("start"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents with all their columns, range-sorted by position.

    A document comes as often as the words taken of it make it up, to the
    nearest whole number; a text is never cut. Equal rows come equally often.
    Null and empty texts, and such without words, never come; null sources are
    a source of their own; an empty table gives no rows.
    """
    key = ["doc_id", "source", "name"]
    rows = plan(docs, ["doc_id"]).where("size > 0").groupBy(*key).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.min("first").alias("first"), F.min("second").alias("second"))
    times = F.array_compact(F.slice(F.array("first", F.coalesce("second", "first")), F.lit(1), F.round(F.try_divide("taken", "size")).cast("int")))
    some = rows.where((F.col("size") > 0) & (2 * F.col("taken") >= F.col("size"))).select(*[F.col(c).alias(f"_{c}_") for c in key], times.alias("_times_"))
    held = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns(docs))])  # the documents' columns may have any names
    name, source, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "source", "text"))
    on = F.col(name).eqNullSafe(F.col("_doc_id_")) & F.col(source).eqNullSafe(F.col("_source_")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_name_"))
    out = held.join(some, on).select(*held.columns, F.explode("_times_").alias("_position_"))
    n = max(1, shuffle_partitions(docs.sparkSession))
    out = out.repartitionByRange(n, "_position_", name).sortWithinPartitions("_position_", name)
    return out.select(*[F.col(h).alias(c) for h, c in zip(held.columns, docs.columns, strict=True)])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``, with each one's place in it."""
    return sequence(plan(table(spark, sf_dir, "documents"), ["doc_id"])).select("doc_id", "size", "source_size", "target", "taken", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"), "start")
