"""Exact removal of repeated passages by blockwise suffix sorting.

A byte goes if it lies in a string of ``DEPTH`` bytes that also starts in a
document with a smaller doc_id. To find such strings, suffixes are sorted to
that depth, one bucket at a time, with the help of a difference cover:

* The cover sample holds the positions of each text that are in ``COVER``
  modulo ``PERIOD``. Every difference modulo the period is one of two members
  of the cover, so any two suffixes reach sample positions at one common shift
  below the period.
* Equal strings of ``DEPTH`` bytes therefore share the ``GRAM`` bytes at their
  common sample position. Sample positions whose ``GRAM`` bytes occur in one
  text only go no further.
* The other sample positions, each with the bytes around it, meet by their
  ``GRAM`` bytes, one part of all such strings after the other. Sorting the bytes from each position on gives the ranks of
  the cover sample, with the common length of neighbours, once.
* The suffixes that start t bytes before a sample position are one bucket; one
  is sorted at a time, by the rank of the t bytes up to the sample position,
  ties by the sample's rank. Neighbours equal to the full depth form groups,
  and all but the smallest document's members of a group are marked.

Copies of one whole text are one text with the smallest doc_id. Occurrences
with equal surroundings are settled within a slice of text before the shuffle,
and again before the buckets are sorted. Where more than ``BLOCK`` occurrences
of one string have different surroundings, their strings of ``DEPTH`` bytes are
written out and aggregated by Spark, so that no task holds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns, map_arrow, mix, shuffle_partitions, slices, table

DEPTH = 50
#: A perfect difference set: each difference modulo the period but zero occurs once.
PERIOD = 31
COVER = np.array([0, 1, 3, 8, 12, 18])
#: Bytes that equal strings share from their sample position on, and bytes before it that a string may have.
GRAM = DEPTH - PERIOD + 1
LEFT = PERIOD - 1
CONTEXT = LEFT + DEPTH
#: Occurrences ranked together, and the most of one cover string that a task holds.
BLOCK = 150_000
#: Sample strings and their buckets are taken in so many parts, one after the other, to bound what is on disk.
PARTS = 2
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def cover(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sample positions of texts that stand one after the other in ``data``
    (with 8 bytes more behind them): index of the text, position in ``data``,
    hash of the ``GRAM`` bytes there. Texts below ``DEPTH`` bytes have none."""
    ends = np.cumsum(lengths)
    periods = np.where(lengths >= DEPTH, -(-lengths // PERIOD), 0)
    text = np.repeat(np.arange(len(lengths)), periods)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods)
    p = ((ends - lengths)[text] + PERIOD * turn)[:, None] + COVER
    text = np.repeat(text, len(COVER))
    ok = p.ravel() + GRAM <= ends[text]
    text, p = text[ok], p.ravel()[ok]
    words = np.ndarray((max(0, len(data) - 7),), np.uint64, data, 0, (1,))
    h = mix(words[p] * _C[0] ^ mix(words[p + 8] * _C[1] ^ mix(words[p + GRAM - 8] * _C[2])))
    return text, p, h


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes, with 8 more behind them, and its lengths."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    data = np.zeros(int(offsets[-1] - offsets[0]) + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(texts.buffers()[2], np.uint8, len(data) - 8, int(offsets[0]))
    return data, np.diff(offsets).astype(np.int64)


def occurrences(texts: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sample positions with one of the sorted ``wanted`` hashes: hash, index
    of the text, position in it, the least and the largest distance back to the
    start of a string of ``DEPTH`` bytes in the text, and the ``LEFT`` bytes
    before and ``DEPTH`` from the position (zeros outside the text)."""
    data, lengths = _joined(texts)
    text, p, h = cover(data, lengths)
    data = data[:-8]
    ok = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
    text, p, h = text[ok], p[ok], h[ok]
    at = p - (np.cumsum(lengths) - lengths)[text]
    room = lengths[text] - at
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(DEPTH, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[p]
    offset = np.arange(-LEFT, DEPTH)
    near = (at < LEFT) | (room < DEPTH)
    around[near] *= ((offset >= -at[near, None]) & (offset < room[near, None])).astype(np.uint8)
    return h, text, at, np.maximum(DEPTH - room, 0), np.minimum(at, LEFT), around


def _strings(*parts: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings that sort by them."""
    wide = np.ascontiguousarray(np.concatenate([x.astype(np.uint8, copy=False) for x in parts], axis=1))
    return wide.view(f"S{wide.shape[1]}").ravel()


def _heads(a: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)


def _common(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of sorted rows: the common length of each with the one before (-1 at a
    new anchor)."""
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common[anchor[1:] != anchor[:-1]] = -1
    return np.concatenate([[-1], common])


def _bucket_marks(anchor: np.ndarray, doc: np.ndarray, ctx: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``marked`` of occurrences sorted by anchor and the bytes from their
    position on, which gives the cover sample's ranks."""
    n = len(anchor)
    out = np.zeros((n, LEFT + 1), bool)
    right = _common(anchor, ctx[:, LEFT:])
    back = ctx[:, :LEFT][:, ::-1]
    left = np.argsort(_strings(anchor.astype(">u8").view(np.uint8).reshape(-1, 8), back), kind="stable")
    common_left = _common(anchor[left], back[left])
    name_l, by_doc = np.empty(n, np.int64), np.argsort(doc, kind="stable")
    for t in range(LEFT + 1):
        use = by_doc[((low <= t) & (t <= high))[by_doc]]
        if len(use) < 2:
            continue
        name_l[left] = np.cumsum(common_left < t)
        key = np.cumsum(right < DEPTH - t)[use] * (n + 1) + name_l[use]
        order = np.argsort(key, kind="stable")
        rows, first = use[order], _heads(key[order])
        out[rows, t] = doc[rows] > doc[rows[first]][np.cumsum(first) - 1]
    return out


def marked(anchor: np.ndarray, doc: np.ndarray, ctx: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each occurrence and distance t: whether the string that starts t
    bytes before it also starts in a smaller document of the block. Whole
    anchors only."""
    if not len(anchor):
        return np.zeros((0, LEFT + 1), bool)
    keys = _strings(anchor.astype(">u8").view(np.uint8).reshape(-1, 8), ctx[:, LEFT:], ctx[:, :LEFT], low[:, None], high[:, None])
    order = np.argsort(keys, kind="stable")
    new = _heads(keys[order])
    group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], heads)
    t = np.arange(LEFT + 1)
    out = np.empty((len(anchor), LEFT + 1), bool)
    out[order] = (doc[order] > least[group])[:, None] & (low[order][:, None] <= t) & (t <= high[order][:, None])
    one = order[heads]  # one of each surrounding, as its smallest document's
    a = anchor[one]
    several = np.concatenate([[False], a[1:] == a[:-1]])
    several |= np.concatenate([a[1:] == a[:-1], [False]])
    if several.any():
        use = np.flatnonzero(several)
        rows = one[use]
        marks = np.zeros((len(heads), LEFT + 1), bool)
        marks[use] = _bucket_marks(a[use], least[use], ctx[rows], low[rows], high[rows])
        out[order] |= marks[group]
    return out


def _spans(marks: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of marked strings: their occurrence and byte range."""
    edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    r, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    return r, p[r] - hi + 1, p[r] - lo + DEPTH


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """A row's overlapping ranges as one."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    new = _heads(row)
    base = np.cumsum(new) * (int(end.max(initial=0)) + 1)  # rows apart, so that one running maximum serves all
    reach = np.maximum.accumulate(end + base) - base
    new[1:] |= start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return [row[heads], start[heads], reach[np.append(heads[1:], len(row)) - 1] if len(row) else end]


def _named(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and bytes of text (null: empty) with two hashes of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.cast("binary").alias("text"), F.xxhash64(text).alias("name"), F.xxhash64(F.lit("2"), text).alias("name2"), *more)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key has several names. Only the last
    key's name is held between batches."""
    key, name, known = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for b in batches:
        done = b.filter(pc.is_valid(b.column("anchor")))
        yield pa.RecordBatch.from_arrays([done.column("name"), done.column("anchor")], ["name", "anchor"])
        b = b.filter(pc.is_null(b.column("anchor")))
        if not b.num_rows:
            continue
        key, name = np.concatenate([key, b.column("key").to_numpy()]), np.concatenate([name, b.column("name").to_numpy()])
        new = _heads(key)
        heads = np.flatnonzero(new)
        several = np.minimum.reduceat(name, heads) != np.maximum.reduceat(name, heads)
        several[0] |= known
        told = several[np.cumsum(new) - 1]
        told[0] &= not known  # it went with the batch before
        yield pa.RecordBatch.from_arrays([pa.array(name[told]), pa.array(key[told])], ["name", "anchor"])
        key, name, known = key[-1:], name[-1:], bool(several[-1])


def _wanted(named: DataFrame, part: int) -> DataFrame:
    """(name, anchors): by text, the hashes of its sample strings that other
    texts have too, of one of ``PARTS`` of all hashes. Of one string only two
    rows a slice of text meet the others; what repeats in the slice is known."""
    n = max(1, shuffle_partitions(named.sparkSession))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, "text", 2 << 20):
            fresh = []
            for name in b.column("name").to_pylist():  # copies in a task tell nothing new
                fresh.append(name not in seen)
                if len(seen) < 1_000_000:
                    seen.add(name)
            b = b.filter(pa.array(fresh, pa.bool_()))
            text, _, h = cover(*_joined(b.column("text")))
            ok = h % np.uint64(PARTS) == part
            text, h = text[ok], h[ok]
            order = np.argsort(h)
            new = _heads(h[order])
            run = ~(new & np.append(new[1:], True)[: len(h)])
            order[run] = order[run][np.lexsort((order[run], h[order[run]]))]
            order = order[new | _heads(text[order])]
            new = _heads(h[order])
            inner = order[~new & ~np.append(new[1:], True)[: len(order)]]
            kept = np.sort(order)  # in order of the texts, which packs well
            decided = np.zeros(len(h), bool)
            decided[inner] = True
            name, h, decided = b.column("name").to_numpy()[text[kept]], h[kept], decided[kept]
            key = np.where(decided, mix(h ^ mix(name.view(np.uint64))), h).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(name), pa.array(h.view(np.int64), mask=~decided)], ["key", "name", "anchor"])

    rows = map_arrow(named.select("text", "name"), anchors, "key long, name long, anchor long")
    shared = map_arrow(rows.repartition(n, "key").sortWithinPartitions("key"), _shared, "name long, anchor long")
    return shared.groupBy("name").agg(F.collect_set("anchor").alias("anchors"))


def repeated_spans(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, name, spans) of texts that repeat others in part, with
    spans an array of (start, end) that may overlap; and (name, name2, first):
    the smallest doc_id of each text."""
    n = max(1, shuffle_partitions(docs.sparkSession))
    named = _named(docs.where("doc_id is not null"))
    firsts = scratch.write(named.groupBy("name", "name2").agg(F.min("doc_id").alias("first")), "firsts")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences for their block; of equal ones in a slice only the smallest document's."""
        names = ["anchor", "doc_id", "name", "p", "low", "high", "context"]
        for b in slices(batches, "text", 4 << 20):
            anchors = np.unique(b.column("anchors").flatten().to_numpy().view(np.uint64))
            h, text, p, low, high, ctx = occurrences(b.column("text"), anchors)
            doc, name = b.column("doc_id").to_numpy()[text], b.column("name").to_numpy()[text]
            keys = _strings(h.view(np.uint8).reshape(-1, 8), low[:, None], high[:, None], ctx)
            by_doc = np.argsort(doc, kind="stable")
            order = by_doc[np.argsort(keys[by_doc], kind="stable")]
            new = _heads(keys[order])
            least = doc[order][new][np.cumsum(new) - 1]
            new |= doc[order] == least
            rest, done = order[new], order[~new]
            flat = pa.py_buffer(np.ascontiguousarray(ctx[rest]))
            offsets = pa.py_buffer(np.arange(0, (len(rest) + 1) * CONTEXT, CONTEXT, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(h[rest].view(np.int64)), *(pa.array(x[rest]) for x in (doc, name, p, low, high)), pa.Array.from_buffers(pa.binary(), len(rest), [None, offsets, flat])], names)
            row, start, end = _merged(text[done], p[done] - high[done], p[done] - low[done] + DEPTH)
            d, name = b.column("doc_id").to_numpy()[row], b.column("name").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(d), pa.array(name), pa.array(start), pa.array(end), pa.array(np.zeros(len(d), np.int64)), pa.nulls(len(d), pa.binary())], names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "name", "start", "end", "string"]

        def whole(x: list[np.ndarray]) -> pa.RecordBatch:
            anchor, doc, name, p, low, high, ctx = x
            row, start, end = _spans(marked(anchor.view(np.uint64), doc, ctx, low, high), p)
            return pa.RecordBatch.from_arrays([*map(pa.array, (doc[row], name[row], start, end)), pa.nulls(len(row), pa.binary())], names)

        def written_out(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(x[0]), 10_000):
                _, doc, name, p, low, high, ctx = (y[at : at + 10_000] for y in x)
                t = LEFT - np.arange(LEFT + 1)
                row, k = np.nonzero((low[:, None] <= t) & (t <= high[:, None]))
                strings = np.lib.stride_tricks.sliding_window_view(ctx, DEPTH, axis=1)[row, k]
                start = p[row] - t[k]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (doc[row], name[row], start, start + DEPTH)), pa.array([s.tobytes() for s in strings], pa.binary())], names)

        held, large = None, None
        for b in batches:
            done = b.filter(pc.is_null(b.column("context")))
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([*(done.column(c) for c in ("doc_id", "name", "p", "low")), pa.nulls(done.num_rows, pa.binary())], names)
            b = b.filter(pc.is_valid(b.column("context")))
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy() for c in ("anchor", "doc_id", "name", "p", "low", "high")]
            now.append(_joined(b.column("context"))[0][:-8].reshape(-1, CONTEXT))
            if large is not None and (more := int(np.searchsorted(now[0], large, side="right"))):
                yield from written_out([x[:more] for x in now])
                now = [x[more:] for x in now]
            held = now if held is None else [np.concatenate(xy) for xy in zip(held, now, strict=True)]
            if len(held[0]) < block:
                continue
            if last := int(np.searchsorted(held[0], held[0][-1])):
                yield whole([x[:last] for x in held])
                held = [x[last:] for x in held]
            if len(held[0]) >= block:
                large = held[0][-1]
                yield from written_out(held)
                held = None
        if held is not None:
            yield whole(held)

    parts = []
    for k in range(PARTS):
        wanted = scratch.write(_wanted(named, k), f"shared{k}").join(firsts, "name").select(F.col("first").alias("doc_id"), "name", "name2", "anchors")
        texts = named.join(wanted, ["doc_id", "name", "name2"]).select("doc_id", "name", "text", "anchors")
        rows = map_arrow(texts, spread, "anchor long, doc_id long, name long, p long, low long, high long, context binary")
        rows = rows.repartition(n, "anchor").sortWithinPartitions("anchor")
        parts.append(scratch.write(map_arrow(rows, settle, "doc_id long, name long, start long, end long, string binary"), f"found{k}"))
        scratch.drop(f"shared{k}")
    found = reduce(DataFrame.union, parts)
    large = found.where("string is not null")
    least = large.groupBy("string").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("largest")).where("least < largest")
    spans = found.where("string is null").drop("string").union(large.join(least, "string").where("doc_id > least").select("doc_id", "name", "start", "end"))
    spans = scratch.write(spans.groupBy("doc_id", "name").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    scratch.drop(*(f"found{k}" for k in range(PARTS)))
    return spans, firsts


def remove(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and maximal removed runs."""
    _, lo, hi = _merged(np.zeros(len(start), np.int64), start, end)
    at = np.append(0, hi)
    return b"".join([data[x:y] for x, y in zip(at.tolist(), [*lo.tolist(), len(data)], strict=True)]), int((hi - lo).sum()), len(lo)


def _with_spans(docs: DataFrame, more: list[str], block: int = BLOCK) -> DataFrame:
    """The rows with text, ``copy`` (their whole text has a smaller doc_id) and spans."""
    spans, firsts = repeated_spans(docs, Scratch(docs.sparkSession, "suffixes"), block)
    facts = firsts.join(spans.withColumnRenamed("doc_id", "first"), ["first", "name"], "left")
    rows = _named(docs, *more)
    copies = facts.select("name", "name2", "first", "spans")
    # Copies need no more than their text's first doc_id, which rides on a narrow table keyed by doc_id.
    narrow = rows.where("doc_id is not null").select("doc_id", "name", "name2").distinct().join(copies, ["name", "name2"])
    narrow = narrow.select("doc_id", "name", "name2", (F.col("doc_id") > F.col("first")).alias("copy"), F.when(F.col("doc_id") == F.col("first"), F.col("spans")).alias("spans"))
    return rows.join(narrow, ["doc_id", "name", "name2"], "left")


def _cut(b: pa.RecordBatch) -> Iterator[tuple[bytes, int, int, int]]:
    """Of each row: what is left of its bytes, their number, bytes and runs removed."""
    spans = b.column("spans")
    counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    start, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    last = np.cumsum(counts)
    for data, copy, x, y in zip(b.column("text").to_pylist(), b.column("copy").to_pylist(), (last - counts).tolist(), last.tolist(), strict=True):
        if copy and len(data) >= DEPTH:
            yield b"", len(data), len(data), 1
        elif x < y and not copy:
            left, removed, runs = remove(data, start[x:y], end[x:y])
            yield left, len(data), removed, runs
        else:
            yield data, len(data), 0, 0


def digest(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row.

    Null text is empty. Rows with a null doc_id lose nothing and take nothing
    from others. Rows that share a doc_id take nothing from each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            left, size, removed, runs = zip(*_cut(b), strict=True)
            digests = [hashlib.sha256(x).hexdigest() for x in left]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(_with_spans(docs, [], block).select("doc_id", "text", "copy", "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages removed from their texts, and
    n_chars counted anew if there is such a column. A character cut in two is
    dropped whole. Texts without repeats stay as they are, null included."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = [f"_c{i}_" for i in range(len(others))]  # the documents' other columns may have any names
    source = docs.select("doc_id", "text", *[c.alias(h) for c, h in zip(columns(docs.drop("doc_id", "text")), held, strict=True)], F.col("text").isNull().alias("_null_"))
    rows = _with_spans(source, [*held, "_null_"]).select("doc_id", "text", *held, "_null_", "copy", "spans")
    names = ["doc_id", "text", *held]
    ddl = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            nulls = b.column("_null_").to_pylist()
            texts = [None if null else left.decode("utf-8", "ignore" if removed else "surrogatepass") for null, (left, _, removed, _) in zip(nulls, _cut(b), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names)

    out = map_arrow(rows, run, ddl).select("doc_id", "text", *[F.col(h).alias(c) for c, h in zip(others, held, strict=True)])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns(docs))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all ``documents``."""
    return digest(table(spark, sf_dir, "documents"))
