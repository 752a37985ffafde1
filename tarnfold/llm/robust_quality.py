"""Quality rules: fixed limits, then robust multivariate outliers.

Each text becomes a few counts; their transformed ratios form a vector. For
each language and source the minimum covariance determinant (MCD) finds the
centre and the scatter of the tightest share ``H`` of the vectors. From several
starts, concentration steps (keep the ``H`` nearest under the present estimate,
estimate anew from those) are repeated until the determinant falls no more; the
start that ends at the least determinant counts. A text is rejected if its
squared Mahalanobis distance from its group passes a quantile of the
chi-squared distribution.

A group's estimate is drawn towards that of its language, and a language's
towards that of the whole corpus, by the weight of ``PRIOR_ROWS`` rows: a
smooth function of the group's size, so that small groups need no rule of
their own.

Every step is one aggregation over all rows: sums of products in fine bins of
the distance, combined on the map side, so that a group with a third of the
corpus is summed like any other. The nearest share is the bins up to ``H`` of
the rows, the last in part by weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, WordHashes, distinct, map_arrow, ngram_hashes, slices, table

MIN_WORDS = 50
#: Share of rows that each concentration step keeps.
H = 0.75
#: A step counts as progress if it lowers the logarithm of the determinant by so much.
PROGRESS = 1e-3
#: Bins for each doubling of the squared distance.
BINS = 16
#: Rows that a parent's estimate counts for.
PRIOR_ROWS = 50.0
#: The squared distance that a chi-squared variable of as many degrees of
#: freedom as the vector has dimensions exceeds once in about 10^7 cases.
CUTOFF = 42.0
#: Estimates (about 300 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
#: Smallest standard deviation taken of each component: statistics that are
#: constant in a group's core would make its scatter singular.
FEATURES = {
    "x_word": ("log of the mean word length", 0.08),
    "x_symbol": ("square root of symbols a word", 0.06),
    "x_dup": ("square root of the share of repeated lines", 0.15),
    "x_repeat": ("square root of the share of words in repeated 3-word windows", 0.15),
    "x_type": ("log of distinct words against the growth usual for the length", 0.15),
}
DIM = len(FEATURES)
#: Mean of the chi-squared distribution truncated to its lower share H, against
#: the untruncated: scales the core's scatter up to the whole's (5 dimensions, H = 0.75).
CONSISTENCY = 0.708

_X = list(FEATURES)
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def text_stats(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_types."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeated = 0
    w = hashes.of(words)
    if n > 3:
        h = ngram_hashes(w, 3)
        order = np.sort(h)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            often = np.isin(h, twice)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + n - 2] |= often
            repeated = int(covered.sum())
    return n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), len(distinct(w))


def stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The counts of each text (null: none), beside the columns ``keep``."""
    source = docs.select(*[F.col(c) for c in keep], F.coalesce("text", F.lit("")).alias("text"))
    schema = source.drop("text").schema
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_types"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, "text"):
            rows = np.array([text_stats(t, hashes) for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(rows[:, i]) for i in range(len(names))], keep + names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", " + ", ".join(f"{n} long" for n in names)
    out = map_arrow(source, run, ddl)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector(df: DataFrame) -> DataFrame:
    """Adds the vector's components; null for rows without words."""
    n = F.when(F.col("n_words") > 0, F.col("n_words").cast("double"))
    parts = {
        "x_word": F.log(F.col("word_chars") / n),
        "x_symbol": F.sqrt(F.col("n_symbols") / n),
        "x_dup": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "x_repeat": F.sqrt(F.col("n_repeat_words") / n),
        "x_type": F.log(F.col("n_types") / F.pow(n, 0.85)),
    }
    return df.withColumns({k: v.cast("double") for k, v in parts.items()})


def _own() -> F.Column:
    return F.to_json(F.struct(F.lit(0).alias("level"), "lang", "source"))


def _lang() -> F.Column:
    return F.to_json(F.struct(F.lit(1).alias("level"), "lang"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Each row once for its source and language, its language, and all."""
    return rows.select(*_X, F.explode(F.array(_own(), _lang(), F.lit("all"))).alias("key"))


def _sums(xs: list[str], s: str = "s", p: str = "p") -> list[F.Column]:
    """Sums of some columns and of their products."""
    return [F.sum(x).alias(f"{s}{i}") for i, x in enumerate(xs)] + [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"{p}{i}{j}") for i, j in _PAIRS]


def _distance(centre: str = "centre", inverse: str = "inverse") -> F.Column:
    """Squared Mahalanobis distance, as a plain expression."""
    d = [F.col(x) - F.get(F.col(centre), F.lit(i)) for i, x in enumerate(_X)]
    return sum((1 if i == j else 2) * d[i] * d[j] * F.get(F.col(inverse), F.lit(i * DIM + j)) for i, j in _PAIRS)


_ESTIMATE = "key string, start int, size long, centre array<double>, scatter array<double>, inverse array<double>, logdet double"
_FLOOR = np.diag([f[1] ** 2 for f in FEATURES.values()])


def _moments(b: pa.RecordBatch, s: str = "s", p: str = "p") -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of each row's sums."""
    n = b.column("n").to_numpy(zero_copy_only=False)
    mean = np.array([b.column(f"{s}{i}").to_numpy(zero_copy_only=False) for i in range(DIM)]).reshape(DIM, -1).T / n[:, None]
    cov = np.empty((b.num_rows, DIM, DIM))
    for i, j in _PAIRS:
        cov[:, i, j] = cov[:, j, i] = b.column(f"{p}{i}{j}").to_numpy(zero_copy_only=False) / n - mean[:, i] * mean[:, j]
    return mean, cov


def _estimates(key: pa.Array, start: np.ndarray, size: pa.Array, centre: np.ndarray, scatter: np.ndarray, logdet: np.ndarray | None = None) -> pa.RecordBatch:
    lists = lambda x: pa.array(x.reshape(len(x), -1).tolist(), pa.list_(pa.float64()))
    logdet = np.linalg.slogdet(scatter)[1] if logdet is None else logdet
    return pa.RecordBatch.from_arrays([key, pa.array(start, pa.int32()), size, lists(centre), lists(scatter), lists(np.linalg.inv(scatter)), pa.array(logdet, pa.float64())], ["key", "start", "size", "centre", "scatter", "inverse", "logdet"])


def _started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three starts of each group: medians with scales from quartiles; means
    with covariances; medians with the correlations of the hyperbolic tangents
    of the standardised components."""
    for b in batches:
        mean, cov = _moments(b)
        _, tanh = _moments(b, "t", "q")
        q = np.array([b.column(f"m{i}").to_pylist() for i in range(DIM)], float).reshape(DIM, -1, 3).transpose(1, 0, 2)
        scale = _scale(q)
        spread = np.sqrt(np.maximum(np.einsum("nii->ni", tanh), 1e-12))
        corr = tanh / spread[:, :, None] / spread[:, None, :]
        corr[:, range(DIM), range(DIM)] = 1.0
        scatters = [np.einsum("ni,ij->nij", scale**2, np.eye(DIM)), cov + _FLOOR, corr * scale[:, :, None] * scale[:, None, :] + _FLOOR]
        for k, (centre, scatter) in enumerate(zip((q[:, :, 1], mean, q[:, :, 1]), scatters, strict=True)):
            yield _estimates(b.column("key"), np.full(b.num_rows, k), b.column("size"), centre, scatter, np.full(b.num_rows, np.inf))


def _scale(quartiles: np.ndarray) -> np.ndarray:
    return np.sqrt(((quartiles[..., 2] - quartiles[..., 0]) / 1.349) ** 2 + np.diag(_FLOOR))


def _concentrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each group's nearest share to its next estimate."""
    for b in batches:
        mean, cov = _moments(b)
        yield _estimates(b.column("key"), b.column("start").to_numpy(), b.column("size"), mean, cov / CONSISTENCY + _FLOOR)


def _small(estimates: DataFrame, rows: int) -> DataFrame:
    """Broadcast only if the estimates are few, by count; else Spark chooses."""
    return F.broadcast(estimates) if rows <= BROADCAST_ROWS else estimates


def fit(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Estimates (``_ESTIMATE``) over all rows with a vector: one row for each
    group, language, and the whole, each from its best start."""
    keyed = _keyed(rows)
    quartiles = keyed.groupBy("key").agg(F.count("*").alias("size"), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"m{i}") for i, x in enumerate(_X)])
    quartiles = scratch.write(quartiles, "quartiles")
    n = quartiles.count()
    z = [F.tanh((F.col(x) - F.get(f"m{i}", F.lit(1))) / F.sqrt(F.pow((F.get(f"m{i}", F.lit(2)) - F.get(f"m{i}", F.lit(0))) / 1.349, 2) + FEATURES[x][1] ** 2)).alias(f"z{i}") for i, x in enumerate(_X)]
    seen = keyed.join(_small(quartiles, n), "key").select("key", *_X, *z).groupBy("key").agg(F.count("*").alias("n"), *_sums(_X), *_sums([f"z{i}" for i in range(DIM)], "t", "q"))
    found = scratch.write(map_arrow(seen.join(_small(quartiles, n), "key"), _started, _ESTIMATE), "fit0").withColumn("moving", F.lit(True))
    step, moving = 0, 3 * n
    group = Window.partitionBy("key", "start", "size")
    while moving:  # each round lowers a determinant that has a floor, so it ends
        step += 1
        active = found.where("moving").select("key", "start", "size", "centre", "inverse")
        near = F.floor(F.log2(F.greatest(_distance(), F.lit(2.0**-20))) * BINS).cast("int")
        bins = keyed.join(_small(active, moving), "key").groupBy("key", "start", "size", near.alias("bin")).agg(F.count("*").alias("n"), *_sums(_X))
        before = F.sum("n").over(group.orderBy("bin")) - F.col("n")
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.ceil(H * F.col("size")) - before) / F.col("n")))
        names = ["n", *[f"s{i}" for i in range(DIM)], *[f"p{i}{j}" for i, j in _PAIRS]]
        core = bins.withColumn("share", share).groupBy("key", "start", "size").agg(*[F.sum(F.col("share") * F.col(c)).alias(c) for c in names])
        new = map_arrow(core, _concentrated, _ESTIMATE).select("key", "start", F.struct("size", "centre", "scatter", "inverse", "logdet").alias("new"))
        both = found.join(_small(new, moving), ["key", "start"], "left")
        better = F.coalesce(F.col("new.logdet") < F.col("logdet") - PROGRESS, F.lit(False))
        kept = [F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "scatter", "inverse", "logdet")]
        found = scratch.write(both.select("key", "start", "size", *kept, better.alias("moving")), f"fit{step}")
        moving = found.where("moving").count()
        scratch.drop(f"fit{step - 1}")
    best = Window.partitionBy("key").orderBy("logdet", "start")
    return found.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "moving")


def _blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's estimate with its language's and the whole corpus's."""
    for b in batches:
        size = {c: b.column(f"{c}_size").to_numpy().astype(float) for c in ("own", "lang", "all")}
        arrays = {c: (np.array(b.column(f"{c}_centre").to_pylist()).reshape(-1, DIM), np.array(b.column(f"{c}_scatter").to_pylist()).reshape(-1, DIM, DIM)) for c in size}
        centre, scatter = arrays["all"]
        for c in ("lang", "own"):
            w = size[c] / (size[c] + PRIOR_ROWS)
            centre = w[:, None] * arrays[c][0] + (1 - w)[:, None] * centre
            scatter = w[:, None, None] * arrays[c][1] + (1 - w)[:, None, None] * scatter
        lists = lambda x: pa.array(x.reshape(len(x), -1).tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column("key"), lists(centre), lists(np.linalg.inv(scatter))], ["key", "centre", "inverse"])


def blended(found: DataFrame) -> DataFrame:
    """(key, centre, inverse) of each language and source."""

    def named(c: str) -> DataFrame:
        return found.select("key", *[F.col(x).alias(f"{c}_{x}") for x in ("size", "centre", "scatter")])

    own = named("own").where(F.get_json_object("key", "$.level") == "0")
    parent = F.to_json(F.struct(F.lit(1).alias("level"), F.get_json_object("key", "$.lang").alias("lang")))
    rows = own.withColumn("parent", parent).join(named("lang").withColumnRenamed("key", "parent"), "parent").crossJoin(F.broadcast(named("all").where("key = 'all'").drop("key")))  # one row
    return map_arrow(rows, _blend, "key string, centre array<double>, inverse array<double>")


def judge(rows: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``distance`` (null without an estimate or words) and ``kept``."""
    best = scratch.write(blended(found), "best")
    own = best.select(F.col("key").alias("_k"), F.col("centre").alias("_c"), F.col("inverse").alias("_i"))
    out = rows.withColumn("_q", _own()).join(_small(own, best.count()), F.col("_q") == F.col("_k"), "left").withColumn("distance", _distance("_c", "_i"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).drop("_q", "_k", "_c", "_i")


def score(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts, ``base_failed``, ``distance`` and ``kept`` of each row.

    Null or wordless texts fail the base rules. Estimates come from the rows
    that pass those. Null languages and sources are groups of their own; equal
    rows get equal verdicts; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.write(vector(stats(docs, list(dict.fromkeys([*keep, "lang", "source"])))), "vectors")
    return judge(rows, fit(rows.where(~F.col("base_failed")), scratch), scratch)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns. Null and
    empty texts have no words and go; null languages and sources are groups of
    their own; repeated rows stay or go together; an empty table gives no rows.
    """
    name = F.xxhash64(F.coalesce("text", F.lit("")))
    verdicts = score(docs.withColumn("_text_hash", name), ["doc_id", "_text_hash"])
    good = verdicts.where("kept").select(*[F.col(c).alias(f"_{c}_") for c in ("doc_id", "lang", "source", "_text_hash")]).distinct()
    on = docs["doc_id"].eqNullSafe(good["_doc_id_"]) & docs["lang"].eqNullSafe(good["_lang_"]) & docs["source"].eqNullSafe(good["_source_"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == good["__text_hash_"])
    return docs.join(good, on, "left_semi")


def op10_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all ``documents``."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return score(table(spark, sf_dir, "documents"), ["doc_id"]).select(*names)
