"""Exact n-gram Jaccard join by count vectors in an R-tree.

A document is the set of its word 5-grams. Its grams are hashed into groups,
and the numbers of grams in the groups are a point. For two documents the sum
over the groups of the smaller number bounds their overlap from above; for a
node of an R-tree over points, the same sum against the node's largest numbers
bounds the overlap with every point below it. What these bounds leave is
verified on the whole sets.

No tree over the whole corpus is searched. Documents are first routed to tiles
such that two that link meet in one at least, by exact conditions only:

1. Documents with equal sets are one class and go on once.
2. If A and B link, at most a fifth of A's grams are missing in B. So of the
   grams in a fixed part of the hash space, A shares all but so many with other
   classes. Most documents fail this. The part that A is judged on is one that
   all of its possible partners show.
3. Of the rest, the grams are ordered by rarity. Two that link share one of
   their first ``n // 5 + 1`` grams. Those grams are dealt by hash to tiles of
   some hundred documents, in each of which a document is once, with whatever
   of its grams lie there. A class in which that many grams are its own links
   with nothing.

In a tile only the tree decides who is compared: all members search it at once,
level by level. Beside its numbers a node keeps a signature of the grams for
which its points are in the tile, as two that link have one in common. The first search gives each member its nearest partner, so that
large groups of near copies join by as many links as members. Then all pairs of
a tile that are not yet in one component and pass the bounds, also that of
vectors with more groups, are verified: no link between different components is
missed, and pairs inside a component, which can't change the result, are not
made. A tile of very many members is dealt to parts: those of its commonest
component to one part each, the others to all, as they are to meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, columns, map_arrow, shingle_set, shuffle_partitions, slices, table
from .components import components

WORDS = 5
#: Two sets link from this many hundredths of their union on.
PERCENT = 80
#: Groups of a point, and of the tree's nodes, whose groups are several of a point's.
GROUPS, NODE_GROUPS = 256, 64
#: Part of the hash space looked at first; sets of at most ``SMALL`` grams are judged whole, so
#: their partners, of at most ``SHOWN`` grams, show all of theirs.
PART, SMALL = 0.3, 64
SHOWN = SMALL * 100 // PERCENT
#: Grams of a tile, about (a document may have several of them); a tile of more than ``TILE_ROWS`` members is searched in parts.
TILE_POINTS, TILE_ROWS = 512, 20_000
#: Points in a leaf, and children of a node.
FAN = 16
#: Words of the signature of the grams for which a document is in a tile.
SIGNS = 4
#: Pairs of point and node bounded at once.
AT_ONCE = 1 << 16


def count_vector(grams: np.ndarray) -> np.ndarray:
    """Grams in each group; 255 stands for itself or more."""
    return np.minimum(np.bincount((grams & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8)


def opened(points: bytes) -> np.ndarray:
    """Count vectors as numbers that bound, one row each."""
    out = np.frombuffer(points, np.uint8).reshape(-1, GROUPS).astype(np.uint16)
    out[out == 255] = 60_000
    return out


def fine_vector(grams: np.ndarray) -> np.ndarray:
    """Grams in each of about twice as many groups as there are grams: bounds
    an overlap to within a few. 255 stands for itself or more."""
    groups = 1 << min(max((2 * len(grams) - 1).bit_length(), 7), 16)
    return np.minimum(np.bincount((grams & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def fine_bounds(fine: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bounds on the overlaps of rows i and j from their fine vectors; the
    longer of two vectors is folded to the length of the shorter."""
    lengths = np.fromiter(map(len, fine), np.int64, len(fine))
    short = np.minimum(lengths[i], lengths[j])
    out = np.zeros(len(i), np.int64)
    for g in np.unique(short).tolist():
        at = np.flatnonzero(short == g)
        rows, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        m = np.empty((len(rows), g), np.uint16)
        for k, r in enumerate(rows.tolist()):
            v = np.frombuffer(fine[r], np.uint8).astype(np.uint16)
            v[v == 255] = 4096
            m[k] = v.reshape(-1, g).sum(axis=0) if len(v) > g else v
        a, b = place[: len(at)], place[len(at) :]
        step = max(1, (1 << 22) // g)
        for c in range(0, len(at), step):
            out[at[c : c + step]] = np.minimum(m[a[c : c + step]], m[b[c : c + step]]).sum(axis=1, dtype=np.int64)
    return out


def needed(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """Least overlap at which sets of sizes n and m link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class CountTree:
    """An R-tree over count vectors and sizes, loaded at once: points are split
    at the median of the coordinate that varies most (the sizes' logarithm
    counts like the whole vector) until they fit a leaf. A node knows the
    largest numbers, the least and largest size, and all signs of what it holds."""

    def __init__(self, fine: np.ndarray, sizes: np.ndarray, signs: np.ndarray):
        points = folded(fine)
        order: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        logs = np.log(np.maximum(sizes, 1))
        while todo:
            ids = todo.pop()
            if len(ids) <= FAN:
                order.append(ids)
                continue
            spread = points[ids].std(axis=0) / max(1.0, float(points[ids].mean()))
            axis = int(np.argmax(spread))
            key = logs[ids] if logs[ids].std() * 4 > spread[axis] else points[ids, axis]
            half = np.argpartition(key, len(ids) // 2)
            todo += [ids[half[len(ids) // 2 :]], ids[half[: len(ids) // 2]]]
        self.ids = np.concatenate(order)
        self.points, self.sizes, self.signs = fine[self.ids], sizes[self.ids], signs[self.ids]
        points = points[self.ids]
        ends = np.cumsum([len(x) for x in order])
        self.starts, self.ends = np.concatenate([[0], ends[:-1]]), ends
        self.tops = [np.maximum.reduceat(points, self.starts)]
        self.least, self.most = [np.minimum.reduceat(self.sizes, self.starts)], [np.maximum.reduceat(self.sizes, self.starts)]
        self.all_signs = [np.bitwise_or.reduceat(self.signs, self.starts)]
        while len(self.tops[-1]) > FAN:
            at = np.arange(0, len(self.tops[-1]), FAN)
            self.tops.append(np.maximum.reduceat(self.tops[-1], at))
            self.least.append(np.minimum.reduceat(self.least[-1], at))
            self.most.append(np.maximum.reduceat(self.most[-1], at))
            self.all_signs.append(np.bitwise_or.reduceat(self.all_signs[-1], at))

    def leaves(self, points: np.ndarray, sizes: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, slack) of the leaves that may hold a query's partner;
        slack is the bound on the overlap less what a link needs at least."""
        q = np.repeat(np.arange(len(points)), len(self.tops[-1]))
        node = np.tile(np.arange(len(self.tops[-1])), len(points))
        points = folded(points)
        for level in range(len(self.tops) - 1, -1, -1):
            ok = (100 * self.most[level][node] >= PERCENT * sizes[q]) & (self.all_signs[level][node] & signs[q]).any(axis=1)
            q, node = q[ok], node[ok]
            slack = _overlaps(self.tops[level], node, points, q) - needed(sizes[q], self.least[level][node])
            q, node, slack = q[slack >= 0], node[slack >= 0], slack[slack >= 0]
            if level:
                q, node = np.repeat(q, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, node = q[node < len(self.tops[level - 1])], node[node < len(self.tops[level - 1])]
        return q, node, slack

    def within(self, points: np.ndarray, sizes: np.ndarray, signs: np.ndarray, q: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, slack) of those leaves' points that pass the bound."""
        lengths = self.ends[leaf] - self.starts[leaf]
        at = np.arange(int(lengths.sum())) + np.repeat(self.starts[leaf] - np.cumsum(lengths) + lengths, lengths)
        q = np.repeat(q, lengths)
        ok = (self.signs[at] & signs[q]).any(axis=1)
        q, at = q[ok], at[ok]
        slack = _overlaps(self.points, at, points, q) - needed(sizes[q], self.sizes[at])
        return q[slack >= 0], self.ids[at[slack >= 0]], slack[slack >= 0]


def folded(points: np.ndarray) -> np.ndarray:
    """Points in the groups of the tree's nodes."""
    return points.reshape(len(points), -1, NODE_GROUPS).sum(axis=1, dtype=np.int32)


def _overlaps(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sums of the smaller numbers of rows i of a and j of b."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), AT_ONCE):
        out[k : k + AT_ONCE] = np.minimum(a[i[k : k + AT_ONCE]], b[j[k : k + AT_ONCE]]).sum(axis=1, dtype=np.int64)
    return out


def tile_pairs(sizes: np.ndarray, points: np.ndarray, signs: np.ndarray, labels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile's rows to verify: without labels, a near partner for each
    member; with labels, all that pass the bound and have different labels."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    search = np.arange(len(sizes))
    if labels is not None:  # a pair of different labels has one member outside the commonest
        values, counts = np.unique(labels, return_counts=True)
        if len(values) < 2:
            return none
        search = np.flatnonzero(labels != values[np.argmax(counts)])
    if len(sizes) < 2:
        return none
    tree, firsts, seconds = CountTree(points, sizes, signs), [none[0]], [none[0]]
    step = max(1, 4 * AT_ONCE // max(1, len(tree.starts)))
    for k in range(0, len(search), step):
        mine = search[k : k + step]
        q, leaf, slack = tree.leaves(points[mine], sizes[mine], signs[mine])
        if labels is None:  # the three most promising leaves
            order = np.lexsort((-slack, q))
            q, leaf = q[order], leaf[order]
            q, leaf = (x[_rank(q) < 3] for x in (q, leaf))
        q, j, slack = tree.within(points[mine], sizes[mine], signs[mine], q, leaf)
        i = mine[q]
        ok = i != j if labels is None else labels[i] != labels[j]
        i, j, slack = i[ok], j[ok], slack[ok]
        if labels is None:
            order = np.lexsort((-slack, i))
            i, j = i[order], j[order]
            i, j = (x[_rank(i) < 1] for x in (i, j))
        firsts.append(i)
        seconds.append(j)
    return np.concatenate(firsts), np.concatenate(seconds)


def _rank(sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each element among its equals."""
    if not len(sorted_keys):
        return sorted_keys
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.append(starts, len(sorted_keys))))


def _pairs(batches: Iterator[pa.RecordBatch], labelled: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile to distinct pairs (a < b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def made(tile: np.ndarray, names: np.ndarray, sizes: np.ndarray, points: np.ndarray, signs: np.ndarray, labels: np.ndarray | None = None) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c, d in zip(cut.tolist(), [*cut[1:].tolist(), len(tile)], strict=True):
            x, y = tile_pairs(sizes[c:d], points[c:d], signs[c:d], labels[c:d] if labels is not None else None)
            firsts.append(x + c)
            seconds.append(y + c)
        i, j = np.concatenate(firsts), np.concatenate(seconds)
        pairs = np.unique(np.stack([np.minimum(names[i], names[j]), np.maximum(names[i], names[j])], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        points = opened(b"".join(b.column("point").to_pylist()))
        now = [b.column("tile").to_numpy(), b.column("name").to_numpy(), b.column("n").to_numpy().astype(np.int64), points, np.stack([b.column(f"sign{k}").to_numpy() for k in range(SIGNS)], axis=1)]
        if labelled:
            now.append(b.column("label").to_numpy())
        if held is not None:
            now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
        whole = int(np.searchsorted(now[0], now[0][-1])) if now[0][0] != now[0][-1] else 0
        if whole:
            part = [x[:whole] for x in now]
            yield made(*part)
        held = [x[whole:] for x in now]
    if held is not None:
        yield made(*held)


def gram_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), name (64-bit hash of the set, null if
    empty), part (the hashes that the set shows to others), judged (the number
    of those, from the first on, that it is judged on itself)."""
    limit = np.uint64(int(PART * (1 << 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, "text"):
            n, names, parts, judged = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, hashes, WORDS)
                n.append(len(s))
                names.append(_name(s) if len(s) else None)
                low = int(np.searchsorted(s, limit))
                parts.append((s if len(s) <= SHOWN else s[:low]).view(np.int64))
                judged.append(len(s) if len(s) <= SMALL else low)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32()), pa.array(names, pa.int64()), lists, pa.array(judged, pa.int32())], ["doc_id", "n", "name", "part", "judged"])

    return map_arrow(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, n int, name long, part array<long>, judged int")


def _name(grams: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(grams.tobytes())
    return h - (1 << 64) if h >> 63 else h


def _whole_sets(docs: DataFrame) -> DataFrame:
    """name, n, point, fine, grams of each document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, "text"):
            sets = [s for t in b.column("text").to_pylist() if len(s := shingle_set(t, hashes, WORDS))]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([count_vector(s).tobytes() for s in sets], pa.binary()), pa.array([fine_vector(s).tobytes() for s in sets], pa.binary()), lists], ["name", "n", "point", "fine", "grams"])

    return map_arrow(docs.select(F.coalesce("text", F.lit("")).alias("text")), run, "name long, n int, point binary, fine binary, grams array<long>")


def _finely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that pass the bound of vectors with more groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine = b.column("fa").to_pylist() + b.column("fb").to_pylist()
            i = np.arange(b.num_rows)
            ok = fine_bounds(fine, i, i + b.num_rows) >= needed(b.column("na").to_numpy().astype(np.int64), b.column("nb").to_numpy().astype(np.int64))
            yield b.select(["a", "b"]).filter(pa.array(ok))

    fa, fb = (sets.select(F.col("name").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}")) for x in "ab")
    return map_arrow(pairs.join(fa, "a").join(fb, "b").select("a", "b", "na", "nb", "fa", "fb"), run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("ga"), b.column("gb"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ga, gb = sets.select(F.col("name").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("name").alias("b"), F.col("grams").alias("gb"))
    return map_arrow(pairs.join(ga, "a").join(gb, "b").select("a", "b", "ga", "gb"), run, "a long, b long")


def tiled(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The whole sets (name, n, point, fine, grams) of classes that may link,
    and their tiles (tile, name, n, point, signs, members), from the documents and
    their ``gram_sets``. A gram's frequency is counted on the map side and
    its rows are then found by a join, so one that very many classes share is no
    single task."""
    # 1, 2: classes of equal sets; those whose part of the hash space is shared enough.
    classes = rows.where("name is not null").select("name", "n", "part", "judged").dropDuplicates(["name"])
    grams = classes.select("name", "judged", F.posexplode("part").alias("at", "g")).select("name", "g", (F.col("at") < F.col("judged")).alias("own"))
    # A gram of two classes tells them by its least and largest; a class is known here by 63 bits, and the lowest bit says ``own``.
    known = F.shiftleft("name", 1)
    grams = grams.select("g", known.bitwiseOR(F.col("own").cast("long")).alias("x"))
    told = scratch.write(grams.groupBy("g").agg(F.count("*").alias("df"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("df > 1"), "grams")
    many = grams.join(told.where("df > 2").select("g"), "g", "left_semi").select("x")
    marks = told.where("df = 2").select(F.explode(F.array("lo", "hi")).alias("x")).union(many).where(F.col("x").bitwiseAND(F.lit(1)) == 1)
    shared = marks.groupBy((F.col("x") - 1).alias("known")).agg(F.count("*").alias("shared"))
    spare = F.floor(F.col("n") / 5)
    kept = classes.select("name", "n", F.col("judged").alias("r"), known.alias("known")).join(shared, "known", "left")
    kept = scratch.write(kept.where(F.coalesce("shared", F.lit(0)) >= F.col("r") - spare).select("name"), "kept")
    # Texts are found again by doc_id; those without one all are, and their classes told by name.
    heads = rows.join(kept, "name", "left_semi").groupBy("name").agg(F.min("doc_id").alias("doc_id")).select("doc_id").where("doc_id is not null").distinct()
    texts = docs.select("doc_id", "text")
    texts = texts.join(heads, "doc_id", "left_semi").union(texts.where("doc_id is null"))
    # 3: whole sets of the rest, rarity, tiles.
    sets = scratch.write(_whole_sets(texts).join(kept, "name", "left_semi").dropDuplicates(["name"]), "whole")
    grams = sets.select("name", F.explode("grams").alias("g"))
    ranked = grams.join(grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "g")
    by_class = ranked.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("gs")).join(sets.select("name", "n"), "name")
    take = F.floor(F.col("n") / 5) + 1 - (F.col("n") - F.size("gs"))
    prefix = scratch.write(by_class.where(take > 0).select("name", F.explode(F.slice("gs.g", F.lit(1), take.cast("int"))).alias("gram")), "prefix")
    prefix = prefix.join(prefix.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "gram", "left_semi")
    bundles = max(1, prefix.count() // TILE_POINTS)
    sign = F.expr("shiftleft(1L, cast(gram & 63L AS int))")
    word = F.pmod(F.shiftright("gram", 6), F.lit(SIGNS))
    signs = [F.bit_or(F.when(word == k, sign).otherwise(F.lit(0).cast("long"))).alias(f"sign{k}") for k in range(SIGNS)]
    members = prefix.groupBy(F.pmod(F.xxhash64("gram"), F.lit(bundles)).alias("tile"), "name").agg(*signs)
    sized = members.groupBy("tile").agg(F.count("*").alias("members")).where("members > 1")
    return sets, scratch.write(members.join(sized, "tile").join(sets.select("name", "n", "point"), "name"), "tiles")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row.

    Texts without words (null, empty) have no shingles and link with nothing;
    their component is their own doc_id. Rows with a null doc_id are no source
    of a component_id: they get the smallest doc_id that they link with, else
    null. Rows that repeat, or share a doc_id, each count. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    n = max(1, shuffle_partitions(spark))
    rows = scratch.write(gram_sets(docs), "sets")
    sets, tiles = tiled(docs, rows, scratch)
    large = tiles.where(F.col("members") > TILE_ROWS).head(1)

    def candidates(labels: DataFrame | None, salt: int) -> DataFrame:
        parts = F.ceil(F.col("members") / TILE_ROWS)
        t = tiles.withColumn("part", F.pmod(F.xxhash64("name", F.lit(salt)), parts))
        if labels is not None:
            t = t.join(labels.select(F.col("node").alias("name"), "label"), "name", "left").withColumn("label", F.coalesce("label", "name"))
            mixed = t.groupBy("tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("tile")
            t = t.join(mixed, "tile", "left_semi")
            if large:  # members outside a large tile's commonest component go to all of its parts
                common = t.where(F.col("members") > TILE_ROWS).groupBy("tile", "label").agg(F.count("*").alias("c")).groupBy("tile").agg(F.max_by("label", F.struct("c", "label")).alias("common"))
                t = t.join(common, "tile", "left")
                apart = F.col("common").isNotNull() & (F.col("label") != F.col("common"))
                t = t.withColumn("part", F.explode(F.when(apart, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.col("part").cast("long")))))
        cols = [F.xxhash64("tile", "part").alias("tile"), "name", "n", "point", *[f"sign{k}" for k in range(SIGNS)]] + (["label"] if labels is not None else [])
        t = t.select(*cols).repartition(n, "tile").sortWithinPartitions("tile", "n", "name")
        return map_arrow(t, (lambda it: _pairs(it, True)) if labels is not None else (lambda it: _pairs(it, False)), "a long, b long").distinct()

    edges = scratch.write(_verified(candidates(None, 0), sets), "edges0")
    labels = components(edges, scratch, "near")
    if large:  # parts of large tiles meet others when dealt anew
        edges = scratch.write(edges.union(_verified(candidates(None, 1), sets)), "edges1")
        labels = components(edges, scratch, "again")
    more = scratch.write(_verified(_finely(candidates(labels, 2), sets), sets), "edges2")
    if more.head(1):
        labels = components(edges.union(more), scratch, "all")
    scratch.drop("kept", "grams", "whole", "prefix", "tiles")
    # Names to components, and those to their smallest doc_id.
    found = rows.select("doc_id", "n", "name").join(labels.select(F.col("node").alias("name"), "label"), "name", "left").withColumn("label", F.coalesce("label", "name"))
    least = found.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component"))
    out = found.join(least, "label", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component stays: that with the smallest doc_id
    (rows with a null doc_id stay; of rows with one doc_id all that repeat)."""
    parts = join(docs)
    first = parts.where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is null").union(docs.where("doc_id is not null").join(first, "doc_id", "left_semi").select(*columns(docs)))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents``."""
    return join(table(spark, sf_dir, "documents"))
