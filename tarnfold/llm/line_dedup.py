"""Line dedup: lines that many documents hold are dropped.

Each line is hashed by its key: stripped of space characters and lower-cased
(A-Z). The hashes are range-partitioned together with document and position,
and sorted by the same inside a partition, so that a line of a third of all
documents is spread over many partitions. Each partition is streamed once:
first occurrences in a document are counted, at most ``min_documents`` of them
are held back, and what is decided goes out at once. Only a hash at either end
of a partition can go on in the next one; its first rows, a few for each
partition, are settled together afterwards.

The result of the operator is no text but a bitmap for each document of which
lines stay, packed to bits and compressed. Hashes have 96 bits; documents are
told apart by doc_id and 64 bits of their content.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, map_arrow, slices, table

#: Documents in which a line must be found to be dropped, and its key's code points.
MIN_DOCUMENTS, MIN_CHARS = 10, 1
#: Bytes of a text that are split into lines at a time.
CHUNK = 1 << 20

_SPACE = SPACE.encode()
_LINE = ["h", "g", "d", "name", "pos"]
_LINES = "h long, g int, d long, name long, pos int, m int"
_FOUND = "pending boolean, h long, g int, d long, name long, pos int, m int, big long"


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and the document's name (d, name)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long").alias("d"), F.xxhash64("doc_id", text).alias("name"), text.alias("text"))


def line_chunks(data: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first line, lines) of a text, about ``CHUNK`` bytes at a time."""
    at, n = 0, 0
    while True:
        cut = data.find(b"\n", at + CHUNK) if len(data) - at > CHUNK else -1
        lines = data[at : cut if cut >= 0 else len(data)].split(b"\n")
        yield n, lines
        if cut < 0:
            return
        at, n = cut + 1, n + len(lines)


def key_of(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (chars <= 1 or len(key.decode("utf-8", "replace")) >= chars)


def line_hashes(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row (``_LINES``) for each line whose key is long enough; ``m`` is the
    number of equal documents that it stands for: they are met once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            seen: dict[tuple[int, int], int] = {}
            ids = list(zip(b.column("d").to_pylist(), b.column("name").to_pylist(), strict=True))
            first = {}
            for i, k in enumerate(ids):
                seen[k] = seen.get(k, 0) + 1
                first.setdefault(k, i)
            for k, i in first.items():
                for n, lines in line_chunks(b.column("text")[i].as_py().encode("utf-8", "surrogatepass")):
                    found = [(n + j, key) for j, key in enumerate(map(key_of, lines)) if _long_enough(key, min_chars)]
                    if not found:
                        continue
                    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(key) for _, key in found), "<i8").reshape(-1, 2)
                    many = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1].astype(np.int32)), pa.array(np.full(many, k[0])), pa.array(np.full(many, k[1])), pa.array(np.fromiter((p for p, _ in found), np.int32, many)), pa.array(np.full(many, seen[k], np.int32))], [*_LINE, "m"])

    return map_arrow(rows, lambda batches: _joined(run(batches)), _LINES)


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Small batches put together to about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _starts(*arrays: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any of the arrays."""
    new = np.ones(len(arrays[0]), bool)
    new[1:] = False
    for a in arrays:
        new[1:] |= a[1:] != a[:-1]
    return new


class _Stream:
    """What one partition's sorted lines tell: rows (``_FOUND``) of lines to
    drop, and pending ones of hashes that may go on in another partition."""

    def __init__(self, least: int, keep_first: bool):
        self.least, self.keep_first = least, keep_first
        self.first, self.over = True, None  # at the partition's first hash; the hash known to be frequent
        self.held = {c: np.zeros(0, t) for c, t in zip([*_LINE, "m"], (np.int64, np.int32, np.int64, np.int64, np.int32, np.int32), strict=True)}

    def feed(self, x: dict[str, np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        x = {c: np.concatenate([self.held[c], x[c]]) for c in x} if x else self.held
        n = len(x["h"])
        if not n:
            return
        new = _starts(x["h"], x["g"])
        group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        doc = _starts(group, x["d"], x["name"])
        at_first = x["pos"] == x["pos"][np.maximum.accumulate(np.where(doc, np.arange(n), 0))]
        count = np.bincount(group, np.where(at_first, x["m"], 0), len(begin)).astype(np.int64)
        known = self.over is not None and (x["h"][0], x["g"][0]) == self.over
        frequent = count >= self.least
        if known:
            frequent[0] = True
        edge = np.zeros(len(begin), bool)  # groups that may go on elsewhere
        edge[0], edge[-1] = self.first, True
        drop = frequent[group]
        pending = edge[group] & ~drop
        heads = begin[1:] if known else begin  # of groups that begin here
        heads = heads[frequent[group[heads]]]
        big = np.zeros(n, np.int64)
        at_edge = heads[edge[group[heads]]]
        big[at_edge] = count[group[at_edge]]
        pending[at_edge] = True
        if self.keep_first:
            drop[heads] = False
        keep = np.zeros(n, bool)  # rows of the last hash are held back until it is decided
        if not last and not frequent[-1]:
            keep[begin[-1] :] = True
        self.held = {c: a[keep] for c, a in x.items()}
        self.over = (x["h"][-1], x["g"][-1]) if frequent[-1] else None
        if len(begin) > 1:
            self.first = False
        take = (drop | pending) & ~keep
        if take.any():
            cols = [pending[take]] + [x[c][take] for c in (*_LINE, "m")] + [big[take]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["pending", *_LINE, "m", "big"])


def frequent_lines(lines: DataFrame, scratch: Scratch, min_documents: int = MIN_DOCUMENTS, keep_first: bool = False) -> DataFrame:
    """(d, name, pos) of every line to drop, maybe repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Stream(min_documents, keep_first)
        for b in batches:
            if b.num_rows:
                yield from s.feed({c: b.column(c).to_numpy(zero_copy_only=False) for c in (*_LINE, "m")}, False)
        yield from s.feed({}, True)

    rows = lines.repartitionByRange(*_LINE).sortWithinPartitions(*_LINE)
    found = scratch.write(map_arrow(rows, run, _FOUND), "found")
    whole = Window.partitionBy("h", "g")
    pending = found.where("pending").withColumn("least", F.min("pos").over(Window.partitionBy("h", "g", "d", "name")))
    total = F.sum(F.when((F.col("pos") == F.col("least")) & (F.col("big") == 0), F.col("m")).otherwise(0) + F.col("big")).over(whole)
    pending = pending.withColumn("total", total).where(F.col("total") >= min_documents)
    if keep_first:
        pending = pending.withColumn("head", F.min(F.struct("d", "name", "pos")).over(whole)).where(F.struct("d", "name", "pos") != F.col("head"))
    return found.where("not pending").select("d", "name", "pos").union(pending.select("d", "name", "pos"))


def pack(keep: np.ndarray) -> bytes:
    """A bitmap of the lines that stay, first line in the lowest bit, compressed;
    the last byte is filled up with lines that stay."""
    full = np.concatenate([keep, np.ones(-len(keep) % 8, bool)])
    return zlib.compress(np.packbits(full, bitorder="little").tobytes(), 6)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """Lines beyond the bitmap's end stay."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines].astype(bool)
    return np.concatenate([bits, np.ones(n_lines - len(bits), bool)])


def _bitmaps(drops: DataFrame) -> DataFrame:
    """(d, name, n_dropped, keep) of documents that lose lines: a document's
    positions arrive sorted, so that one document is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def done() -> pa.RecordBatch:
            pos = np.unique(np.concatenate(parts))
            keep = np.ones(int(pos[-1]) + 1, bool)
            keep[pos] = False
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([len(pos)], pa.int64()), pa.array([pack(keep)], pa.binary())], ["d", "name", "n_dropped", "keep"])

        for b in batches:
            if not b.num_rows:
                continue
            d, name, pos = (b.column(c).to_numpy() for c in ("d", "name", "pos"))
            cuts = np.flatnonzero(_starts(d, name)).tolist()
            for a, z in zip(cuts, [*cuts[1:], len(d)], strict=True):
                now = (int(d[a]), int(name[a]))
                if now != key and parts:
                    yield done()
                    parts = []
                key = now
                parts.append(pos[a:z])
        if parts:
            yield done()

    rows = drops.repartition("d", "name").sortWithinPartitions("d", "name", "pos")
    return map_arrow(rows, lambda batches: _joined(run(batches), 2000), "d long, name long, n_dropped long, keep binary")


def keep_bitmaps(docs: DataFrame, scratch: Scratch | None = None, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(d, name, n_dropped, keep): for each document that loses lines, how many,
    and the compressed bitmap of those that stay (``unpack``); ``named`` gives
    the documents' names. Documents that lose nothing have no row.

    A line is dropped if its key has ``min_chars`` code points and is found in
    ``min_documents`` documents; with ``keep_first`` its first occurrence, by
    doc_id (null: 0) and position, stays. Null and empty texts are one empty
    line. Repeated rows are documents of their own, and lose the same lines;
    with ``keep_first`` the rows equal to the first one keep the line too. An
    empty table gives no rows; only doc_id and text are read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    return _bitmaps(frequent_lines(line_hashes(named(docs), min_chars), scratch, min_documents, keep_first))


def kept_text(text: str, bitmap: bytes | None) -> tuple[bytes, int]:
    """The lines that stay, joined by a line feed, as UTF-8; and the number of all lines."""
    data = text.encode("utf-8", "surrogatepass")
    n = data.count(b"\n") + 1
    if bitmap is None:
        return data, n
    keep = unpack(bitmap, n)
    return b"\n".join([x for k, lines in line_chunks(data) for x, stays in zip(lines, keep[k : k + len(lines)].tolist(), strict=True) if stays]), n


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (and text) of every document.
    The texts meet their bitmaps in a hash table of the bitmaps of a partition,
    so that texts are not sorted."""
    rows = named(docs).join(bitmaps.hint("shuffle_hash"), ["d", "name"], "left").select("doc_id", "text", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [kept_text(t.as_py(), k.as_py()) for t, k in zip(b.column("text"), b.column("keep"), strict=True)]
            cols = [b.column("doc_id"), pa.array([n for _, n in found], pa.int64()), b.column("n_dropped"), pa.array([hashlib.sha256(x).hexdigest() for x, _ in found], pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array([x.decode("utf-8", "surrogatepass") for x, _ in found], pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string" + (", text string" if with_text else ""))


def drop_frequent_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, text of every document, without
    its frequent lines; odd rows as in ``keep_bitmaps``."""
    scratch = Scratch(docs.sparkSession, "lines")
    return apply_bitmaps(docs, scratch.write(keep_bitmaps(docs, scratch, min_documents, min_chars, keep_first), "bitmaps"), True)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the lines that ten or more of them hold."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "op11")
    bitmaps = scratch.write(keep_bitmaps(docs, scratch), "bitmaps")
    scratch.drop("found")
    return apply_bitmaps(docs, bitmaps)
