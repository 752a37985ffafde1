"""Parametric models. Every generator is a projection of ``range(n)``: a state's
row is an array of (dst, p) made inside one row and exploded, so none shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draw
from ..model import Mdp


def _entry(dst: Column, p: Column | float) -> Column:
    return F.struct(dst.cast("long").alias("dst"), (p if isinstance(p, Column) else F.lit(float(p))).cast("double").alias("p"))


def _exploded(rows: DataFrame, entries: Column) -> DataFrame:
    return rows.select(F.col("id").alias("src"), F.posexplode(entries).alias("ord", "e")).select("src", "e.dst", "e.p", "ord")


def _rewards(rows: DataFrame, r: Column | float) -> DataFrame:
    return rows.select(F.col("id").alias("state"), (r if isinstance(r, Column) else F.lit(float(r))).cast("double").alias("r"))


def ring(spark: SparkSession, n: int, beta: float, p_self: float = 0.5, reward: float = 1.0) -> Mdp:
    """Each state stays with ``p_self``, else moves to the next; the exact
    value is ``reward / (1 - beta)`` everywhere."""
    rows, i = spark.range(n), F.col("id")
    return Mdp(_exploded(rows, F.array(_entry(i, p_self), _entry((i + 1) % n, 1 - p_self))), _rewards(rows, reward), beta)


def grid(spark: SparkSession, rows: int, cols: int, beta: float, p_stay: float = 0.2, base: float = 1.0, gradient: float = 0.0) -> Mdp:
    """A grid walk: stay with ``p_stay``, else to a neighbour, all alike. Order
    of a row: itself, up, down, left, right. The reward grows with the row and
    falls with the column."""
    if rows * cols < 2:
        raise ValueError("a grid needs two states at least")
    ids, i = spark.range(rows * cols), F.col("id")
    r, c = F.floor(i / cols), i % cols
    there = [(r > 0, i - cols), (r < rows - 1, i + cols), (c > 0, i - 1), (c < cols - 1, i + 1)]
    degree = sum((ok.cast("int") for ok, _ in there[1:]), there[0][0].cast("int"))
    moves = F.array(*[F.when(ok, _entry(to, (1 - p_stay) / degree)) for ok, to in there])
    entries = F.concat(F.array(_entry(i, p_stay)), F.array_compact(moves))
    return Mdp(_exploded(ids, entries), _rewards(ids, base + gradient * (cols - 1 - c + r) / (rows + cols - 2)), beta)


def metastable(spark: SparkSession, n: int, beta: float, p_intra: float = 0.95, p_bridge: float = 0.05, reward_a: float = 1.0, reward_b: float = 2.0) -> Mdp:
    """Two halves, each mixing well inside and rarely across: a dense matrix
    with the own half's entries first. ``n`` is rounded down to an even number,
    2 at least."""
    half = max(1, n // 2)
    ids, i = spark.range(2 * half), F.col("id")
    start = F.when(i < half, 0).otherwise(half)
    own = F.transform(F.sequence(start, start + half - 1), lambda s: _entry(s, p_intra / half))
    far = F.transform(F.sequence(half - start, 2 * half - 1 - start), lambda s: _entry(s, p_bridge / half))
    return Mdp(_exploded(ids, F.concat(own, far)), _rewards(ids, F.when(i < half, reward_a).otherwise(reward_b)), beta)


def star(spark: SparkSession, n: int, beta: float, p_to_hub: float = 0.8, hub_reward: float = 1.0, leaf_reward: float = 0.5) -> Mdp:
    """State 0 goes to each leaf alike; a leaf goes to the hub or stays."""
    if n < 2:
        raise ValueError("a star needs two states at least")
    ids, i = spark.range(n), F.col("id")
    leaves = spark.range(1, n)
    # The hub's row is made of rows, not of one array: it has n - 1 entries.
    hub = leaves.select(F.lit(0).cast("long").alias("src"), i.alias("dst"), F.lit(1.0 / (n - 1)).alias("p"), (i - 1).cast("int").alias("ord"))
    out = _exploded(leaves, F.array(_entry(F.lit(0), p_to_hub), _entry(i, 1 - p_to_hub)))
    return Mdp(hub.unionByName(out), _rewards(ids, F.when(i == 0, hub_reward).otherwise(leaf_reward)), beta)


def chain(spark: SparkSession, n: int, beta: float, p_left: float = 0.25, p_stay: float = 0.5, p_right: float = 0.25, reward: str = "uniform", reflecting: bool = True) -> Mdp:
    """A walk on a line. Reflecting ends keep the step that would leave;
    absorbing ends never move. Rewards: uniform 1; linear (i + 1) / n;
    quadratic, highest in the middle."""
    ids, i = spark.range(n), F.col("id")
    first, last = i == 0, i == n - 1
    left = F.when(~first, _entry(i - 1, p_left))
    stay = _entry(i, F.lit(p_stay) + F.when(first, p_left).otherwise(0.0) + F.when(last, p_right).otherwise(0.0))
    right = F.when(~last, _entry(i + 1, p_right))
    entries = F.array_compact(F.array(left, stay, right))
    if not reflecting:
        entries = F.when(first | last, F.array(_entry(i, 1.0))).otherwise(entries)
    r = {"uniform": F.lit(1.0), "linear": (i + 1) / n, "quadratic": 1 - 4 * F.pow(i / max(1, n - 1) - 0.5, 2)}[reward]
    return Mdp(_exploded(ids, entries), _rewards(ids, r), beta)


def random_sparse(spark: SparkSession, n: int, per_row: int, beta: float, max_reward: float = 1.0, seed: int = 42, free: bool = False) -> Mdp:
    """Rows of ``per_row`` distinct columns in ascending order with random
    weights from .1 to 1, normalised. One column is drawn from each of
    ``per_row`` equal ranges: distinct and sorted without a set or a shuffle.
    ``free``: any set of columns may come. Floyd's sampling takes, for each of
    the last ``per_row`` columns, one drawn from those up to it, or the column
    itself where that has been taken, inside the row."""
    m = min(max(1, per_row), n)
    ids, i = spark.range(n), F.col("id")
    places = F.sequence(F.lit(0), F.lit(m - 1))
    weight = lambda k: 0.1 + 0.9 * (draw(i, k + m, seed) % 1_000_000) / 1_000_000
    lo = lambda k: F.floor(k.cast("long") * n / m)
    if free:

        def take(taken: Column, k: Column) -> Column:
            last = (k + (n - m)).cast("long")
            t = draw(i, k, seed) % (last + 1)
            return F.array_append(taken, F.when(F.array_contains(taken, t), last).otherwise(t))

        rows = ids.select("id", F.array_sort(F.aggregate(places, F.array().cast("array<long>"), take)).alias("dsts"))
        drawn = rows.select("id", F.transform("dsts", lambda dst, k: F.struct(dst.alias("dst"), weight(k).alias("w"))).alias("d"))
    else:
        drawn = ids.select("id", F.transform(places, lambda k: F.struct((lo(k) + draw(i, k, seed) % (lo(k + 1) - lo(k))).alias("dst"), weight(k).alias("w"))).alias("d"))
    total = F.aggregate("d", F.lit(0.0), lambda a, d: a + d["w"])
    drawn = drawn.withColumn("t", total)
    entries = F.transform("d", lambda d: _entry(d["dst"], d["w"] / F.col("t")))
    return Mdp(_exploded(drawn, entries), _rewards(ids, max_reward * (draw(i, 2 * m, seed) % 1_000_000) / 1_000_000), beta)


def multi_cluster(spark: SparkSession, n: int, k: int, beta: float, p_intra: float = 0.9, rewards: list[float] | None = None) -> Mdp:
    """``k`` contiguous clusters, the first ``n % k`` one larger: ``p_intra``
    is spread over the own cluster, the rest over all other states. With one
    cluster rows sum to ``p_intra`` only."""
    k = min(max(1, k), n)
    ids, i = spark.range(n), F.col("id")
    size, extra = divmod(n, k)
    big = extra * (size + 1)
    cluster = F.when(i < big, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - big) / size))
    rows = ids.select("id", cluster.alias("c"))
    rows = rows.withColumn("m", F.when(F.col("c") < extra, size + 1).otherwise(size)).withColumn("lo", F.col("c") * size + F.least("c", F.lit(extra)))
    inside = lambda s: (s >= F.col("lo")) & (s < F.col("lo") + F.col("m"))
    all_states = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    if k == 1:
        all_states = F.filter(all_states, inside)
    entries = F.transform(all_states, lambda s: _entry(s, F.when(inside(s), p_intra / F.col("m")).otherwise((1 - p_intra) / F.greatest(n - F.col("m"), F.lit(1)))))
    r = F.element_at(F.array(*[F.lit(float(x)) for x in rewards]), (F.col("c") + 1).cast("int")) if rewards else (F.col("c") + 1).cast("double")
    return Mdp(_exploded(rows, entries), rows.select(F.col("id").alias("state"), r.alias("r")), beta)
