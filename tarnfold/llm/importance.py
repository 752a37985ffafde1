"""Importance resampling towards a target distribution.

A document's features are its runs of one to three words, hashed to buckets.
The gain of a bucket compares how often the target texts and all documents
fall in it; a document's weight is the sum of the gains of its features, and a
draw without replacement takes the highest weights with a Gumbel perturbation
that is fixed by doc_id.

Higher-order functions make the array of buckets inside a document's row, and
sum up ``element_at`` of the gains, one literal array, over it: scoring
explodes nothing and shuffles nothing. Only counts, a row for each bucket and
task, are shuffled, and the narrow scores of documents for the draw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Buckets of features: the size of the table of counts.
BUCKETS = 10_000
#: Percent of the documents that are drawn, fewest words of one, and the draw's seed.
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Words are runs of letters, digits and all beyond ASCII: the others are made spaces.
_BREAKS = "".join(c for c in map(chr, range(128)) if not (c.isalnum()))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the lower-cased words instead of the text. One pass lowers
    the letters and makes all that parts words a space; a split at a plain
    space needs no matcher, which is several times as slow here."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    words = F.filter(F.split(plain, " ", -1), lambda x: x != "")
    return rows.withColumn("words", words).drop(text)


def with_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` (words) with the buckets of all runs of one, two and three words,
    repeats included: longer runs are made from the shorter ones."""
    bucket = lambda x: F.pmod(F.crc32(x), F.lit(BUCKETS)).cast("short")

    def longer(runs: str) -> Column:
        """Each run but the first, behind the word before it."""
        return F.transform(F.slice(F.col(runs), 2, F.greatest(F.size(runs) - 1, F.lit(0))), lambda x, i: F.concat(F.get("words", i), F.lit(" "), x))

    rows = rows.withColumn("pairs", longer("words"))
    rows = rows.withColumn("triples", longer("pairs"))
    return rows.withColumn("buckets", F.concat(*[F.transform(c, bucket) for c in ("words", "pairs", "triples")])).drop("pairs", "triples")


def counts(rows: DataFrame) -> list[int]:
    """How many features fall in each bucket: as many rows as buckets reach the driver."""
    found = rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect()
    out = [0] * BUCKETS
    for r in found:
        out[r["bucket"]] = r["count"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log of how much likelier a bucket is in the target."""
    a, b = float(sum(source) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1.0) * a / ((s + 1.0) * b))) for s, t in zip(source, target, strict=True)]


def literal(numbers: list[int]) -> Column:
    """An array of whole numbers that Spark folds into one literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def gumbel(doc_id: Column, seed: int) -> Column:
    """The perturbation of a document, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every document;
    ``target`` (text) holds the texts to resemble. The rank counts those drawn
    from 1: ``percent`` of the documents with ``least_words`` words, by score,
    then by doc_id (null last), features and order in the table.

    Null and empty texts have no words, no features, weight 0, and are never
    drawn if a word is asked for. A null doc_id is perturbed as the text
    ``null``. Repeated rows are documents of their own. Empty documents give no
    rows; an empty target gives gains against even counts. Only doc_id and text
    are read, whatever other columns are called.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    found = with_buckets(with_words(docs.select("doc_id", "text")))
    rows = scratch.write(found.select("doc_id", F.size("words").alias("n_words"), "buckets"), "buckets")
    wanted = with_buckets(with_words(target.select("text")))
    gain = literal(gains(counts(rows), counts(wanted)))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(gain, b.cast("int") + 1))
    scored = rows.select("doc_id", F.size("buckets").cast("long").alias("n_features"), F.col("n_words").cast("long").alias("n_words"), weight.alias("weight"), F.monotonically_increasing_id().alias("row"))
    scored = scratch.write(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    scratch.drop("buckets")
    names = ["doc_id", "n_features", "weight", "score", "n_words"]
    entitled = scored.where(F.col("n_words") >= least_words)
    drawn = percent * entitled.count() // 100
    # Ranks: ranges of scores are sorted by themselves; a row a range gives the offsets.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    ranges = entitled.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = scratch.write(ranges.select(*names, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")), "ranges")
    sizes = ranges.groupBy("part").agg(F.min("id").alias("first"), F.count("*").alias("c"))
    offsets = sizes.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c") - F.col("first")).alias("shift"))
    place = F.col("id") + F.col("shift") + 1
    ranked = ranges.join(F.broadcast(offsets), "part").select(*names, F.when(place <= drawn, place).alias("rank"))  # a row a partition
    rest = scored.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` resampled towards the texts of ``benchmark``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
