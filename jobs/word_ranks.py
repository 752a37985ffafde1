"""Word ranks of a growing collection of documents, by language.

A walk over words steps from a word to one of its neighbours in the text, by how
often the two stand side by side, and now and then starts anew anywhere. The
fixed point of ``x = (1 - d) + d P'x`` is how often it visits each word, one on
average: the words that hold a language's texts together rank highest.

Counts of neighbours add up over documents. A file stream takes only the files
that are new since its checkpoint and adds a partition of counts for each
batch; a batch that is taken again after a failure replaces its own partition.
Where counts have been added since the ranks were made, the ranks are solved
anew, starting from the former ones: changes are pushed from the words whose
neighbours have changed, and the others are not touched.

    python -m jobs.word_ranks --documents PATH --out PATH

Below ``out``: ``counts`` (by batch and lang), ``ranks`` (by lang), ``runs``
(by last_batch: what each solve read and did) and ``checkpoint``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.lineage import cut
from tarnfold.operators.bellman import Affine
from tarnfold.operators.solvers import SolverConfig, iterate

from .common import existing, log, new_folder, replace_partitions, session, settings

DOCUMENTS = "doc_id long, text string, lang string"
#: Words: runs of anything but space characters and ASCII punctuation.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``documents``: a folder, or a pattern of files and folders, to which
    files are added. ``max_files`` of one batch; ``damping`` is the chance of a step to a
    neighbour; the solve ends when no rank moves by more than ``eps``, or by
    more than the rounding of the sum that makes it (``frontier.ROUNDING``)."""

    documents: str
    out: str
    damping: float = 0.6
    eps: float = 1e-12
    max_sweeps: int = 500
    max_files: int = 1000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BREAKS, -1), lambda x: x != "")


def neighbours(docs: DataFrame) -> DataFrame:
    """(lang, a, b, c): how often b follows a in a line. Null texts and lines
    of one word give none; a null language is ``und``."""
    lines = docs.where("text is not null").select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.select("lang", words(F.col("line")).alias("w")).where(F.size("w") > 1)
    pairs = lines.select("lang", F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p"))
    return pairs.groupBy("lang", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("c"))


def take_new(spark: SparkSession, s: Settings) -> int:
    """Counts of the files that no earlier run has taken: how many batches that made."""
    taken = []

    def add(batch: DataFrame, number: int) -> None:
        replace_partitions(neighbours(batch).withColumn("batch", F.lit(number)), f"{s.out}/counts", "batch", "lang")
        taken.append(number)
        log.info("batch %d of %s added to %s/counts", number, s.documents, s.out)

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", s.max_files).parquet(s.documents)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{s.out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return len(taken)


def number(word: str, seed: int) -> Column:
    """A number that a word of a language has in one solve. Two words with the
    same number are as good as never met, and then another seed is taken."""
    return F.xxhash64(F.lit(seed), "lang", word)


def walk(counts: DataFrame, damping: float) -> tuple[DataFrame, DataFrame]:
    """Entries (row, col, a) and start (state, b, scale, lang, word, steps) of
    the walk over all languages' words. Neighbours count in both directions,
    of which the entries have one, in a row for each batch."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), "c"), F.struct(F.col("b").alias("word"), "c")))
    words = cut(counts.select("lang", ends.alias("e")).groupBy("lang", "e.word").agg(F.sum("e.c").alias("steps")))
    seed, n = 0, words.count()
    while words.select(number("word", seed).alias("state")).distinct().count() < n:
        seed += 1
    start = words.select(number("word", seed).alias("state"), F.lit(1 - damping).alias("b"), (damping / F.col("steps")).alias("scale"), "lang", "word", "steps")
    return counts.select(number("a", seed).alias("row"), number("b", seed).alias("col"), F.col("c").cast("double").alias("a")), start


def first_ranks(start: DataFrame, damping: float) -> DataFrame:
    """(state, lang, word, v): a word's share of its language's steps, from which
    a walk among well-connected words is not far."""
    whole = start.groupBy("lang").agg(F.count("*").alias("n"), F.sum("steps").alias("total"))
    v = F.col("b") + damping * F.col("n") * F.col("steps") / F.col("total")
    return start.join(whole, "lang").select("state", "lang", "word", v.alias("v"))  # a row a language


def solve_ranks(spark: SparkSession, s: Settings, counts: DataFrame, last: int) -> None:
    """Ranks of all words from the counts of all batches up to ``last``."""
    began = time.time()
    entries, start = walk(counts, s.damping)
    x = first_ranks(start, s.damping)
    former = existing(spark, f"{s.out}/ranks")
    if former is not None:
        x = x.join(former.select("lang", "word", F.col("rank").alias("old")), ["lang", "word"], "left").withColumn("v", F.coalesce("old", "v"))
    walked = Affine(entries, start.select("state", "b", "scale"), s.damping, mirrored=True)  # both ways alike: real eigenvalues
    found = iterate(walked, x.select("state", "v"), SolverConfig(mode="frontier", eps=s.eps, max_sweeps=s.max_sweeps), packed=True)
    ranks = found.values.join(start, "state").select("word", F.col("v").alias("rank"), "steps", "lang")
    replace_partitions(ranks.repartition("lang", F.pmod(F.xxhash64("word"), F.lit(32))), f"{s.out}/ranks", "lang")
    run = [(found.sweeps, found.final_residual_inf, found.converged, last)]
    replace_partitions(spark.createDataFrame(run, "sweeps int, residual double, converged boolean, last_batch long"), f"{s.out}/runs", "last_batch")
    log.info("ranks up to batch %d written to %s/ranks: %d sweeps, residual %.3g, %.1f s", last, s.out, found.sweeps, found.final_residual_inf, time.time() - began)


def run(spark: SparkSession, s: Settings) -> DataFrame:
    """Takes what is new and brings the ranks up to date; the ranks: word,
    rank, steps, lang. Without new files the ranks stay as they are. Documents
    without neighbouring words leave an empty table of ranks."""
    log.info("reading new files of %s", s.documents)
    new = take_new(spark, s)
    counts, runs = existing(spark, f"{s.out}/counts"), existing(spark, f"{s.out}/runs")
    last = None if counts is None else counts.agg(F.max("batch")).head()[0]
    solved = None if runs is None else runs.agg(F.max("last_batch")).head()[0]
    log.info("%d new batches; counts up to batch %s, ranks up to batch %s", new, last, solved)
    if last is not None and last != solved:
        solve_ranks(spark, s, counts, last)
    ranks = existing(spark, f"{s.out}/ranks")
    return spark.createDataFrame([], "word string, rank double, steps long, lang string") if ranks is None else ranks


def job1_word_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job, twice over all ``documents`` into a new folder: the second run
    finds nothing new."""
    s = Settings(f"{sf_dir}/documents.parque[t]", new_folder(spark, "job1"))  # a pattern, as the table may be one file
    run(spark, s)
    return run(spark, s).select("lang", "word", "steps", (F.round("rank", 6) + F.lit(0.0)).alias("rank"))


#: The same from the whole table at once, by a fixed number of sweeps.
SQL = r"""WITH RECURSIVE l AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(regexp_split_to_array(lower(line), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x != '') AS w FROM l),
p AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i + 1]})) AS p FROM w WHERE len(w) > 1),
n AS (SELECT lang, p.a AS a, p.b AS b, count(*) AS c FROM p GROUP BY ALL),
s AS (SELECT lang, a, b, sum(c) AS c FROM (SELECT * FROM n UNION ALL SELECT lang, b, a, c FROM n) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS i, lang, b AS word, sum(c) AS steps FROM s GROUP BY lang, b),
e AS (SELECT r.i AS r, q.i AS q, 0.6 * s.c / q.steps AS a FROM s JOIN d r ON r.lang = s.lang AND r.word = s.a JOIN d q ON q.lang = s.lang AND q.word = s.b),
x(k, i, v) AS (SELECT 0, i, CAST(1 AS DOUBLE) FROM d UNION ALL SELECT k + 1, r, 0.4 + sum(a * v) FROM x JOIN e ON x.i = e.q WHERE k < 60 GROUP BY k, r)
SELECT lang, word, CAST(steps AS BIGINT) AS steps, round(CAST(v AS DOUBLE), 6) AS rank FROM d JOIN x USING (i) WHERE k = 60"""


def main() -> None:
    s = settings(Settings, "Ranks the words of new and earlier documents.")
    spark = session("word ranks")
    try:
        run(spark, s)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
