"""Token ids in a packed binary file format.

Every id takes ``ceil(log2(vocabulary))`` bits. Documents lie in ascending
order of doc_id; their ids are grouped into blocks of whole documents. A block
is self-describing: a header, the doc ids, the offset of each document's first
id in the block, then the packed ids. Blocks unpack with numpy alone, and one
id is read by its bit offset without unpacking the rest (``read_at``). A
block's place in the whole corpus is in the table ``index`` beside the blocks,
so any range of ids is found by reading a few blocks (``read_range``).

The files are Parquet containers of blocks, because Spark's committer makes a
task's output appear once, whatever executors are lost.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, shuffle_partitions, slices, table

MAGIC = b"TFP1"
HEAD = struct.Struct("<4sBxxxII")
#: Ids in a block, unless one document has more.
BLOCK_IDS = 1 << 19
#: Distinct pieces of text whose ids a worker remembers.
PIECES = 900_000
#: Kinds of bytes: 1 space, 2 ASCII letter, 3 mark that begins no contraction, 4 line break.
_KIND = np.zeros(256, np.uint8)
_KIND[32], _KIND[10] = 1, 4
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[list(b".,;:!?%$&*#()\"-/")] = 3
#: Texts with other space characters, runs of space, or marks of special tokens are encoded whole.
_ODD = re.compile(r" [\s\u180e]|[^\S \n]|<\|")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Packs ids, lowest bit first."""
    if len(ids) and (ids.min() < 0 or int(ids.max()) >> width):
        raise ValueError(f"an id needs more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, width: int, n: int, first: int = 0) -> np.ndarray:
    """``n`` ids from number ``first`` on."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n, first * width // 8).astype(np.uint32)
    at, shift = divmod(first * width, 8)
    raw = np.frombuffer(data, np.uint8, (shift + n * width + 7) // 8, at)
    bits = np.unpackbits(raw, bitorder="little")[shift : shift + n * width].reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def make_block(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return HEAD.pack(MAGIC, width, len(doc_ids), len(flat)) + known.tobytes() + names.tobytes() + offsets.tobytes() + pack(flat, width)


def open_block(data: bytes) -> tuple[list[int | None], np.ndarray, int, memoryview]:
    """Doc ids, offsets (one more than documents), width and the packed ids."""
    magic, width, docs, _ = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of packed ids")
    known = np.frombuffer(data, np.uint8, docs, HEAD.size)
    names = np.frombuffer(data, "<i8", docs, HEAD.size + docs)
    offsets = np.frombuffer(data, "<u8", docs + 1, HEAD.size + 9 * docs).astype(np.int64)
    return [int(n) if k else None for n, k in zip(names, known, strict=True)], offsets, width, memoryview(data)[HEAD.size + 17 * docs + 8 :]


def read_at(data: bytes, number: int) -> int:
    """One id of a block, by random access."""
    _, _, width, packed = open_block(data)
    return int(unpack(packed, width, 1, number)[0])


class PieceEncoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library.

    The tokenizer's own pattern splits a text at least before each single space
    between two characters that aren't space, around such a line break, and
    between an ASCII letter and a mark like a comma; so these pieces are encoded
    on their own, and once for all their occurrences. Texts with other
    white space, or with marks of special tokens, are encoded whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_file)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.lens = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.uint16), 0

    def _learn(self, pieces: list[str]) -> None:
        for e0 in range(0, len(pieces), 20_000):
            part = pieces[e0 : e0 + 20_000]
            ids = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum()))
            n, m = len(self.index), self.used
            while n + len(part) > len(self.starts):
                self.starts, self.lens = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lens, 2 * len(self.lens))
            if len(flat) and flat.max() > np.iinfo(self.pool.dtype).max:
                self.pool = self.pool.astype(np.uint32)
            while m + len(flat) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * len(self.pool))
            self.starts[n : n + len(part)] = m + np.cumsum(lens) - lens
            self.lens[n : n + len(part)] = lens
            self.pool[m : m + len(flat)] = flat
            self.used = m + len(flat)
            self.index.update(zip(part, range(n, n + len(part)), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > PIECES:
            self.clear()
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        raw, which = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if _ODD.search(t) or t[0] == " " or t[-1] == " ":
                out[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                raw.append(t.encode())
                which.append(i)
        if not which:
            return out
        # One Arrow array of all pieces, cut from the joined texts without a Python object for each.
        data = b"".join(raw)
        first = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        kind = _KIND[np.frombuffer(data, np.uint8)]
        before, here = kind[:-1], kind[1:]
        inner = (here == 1) | ((before == 2) & (here == 3)) | ((before != 4) & (before != 1) & (here == 4)) | ((before == 4) & (here != 4) & (here != 1))
        # A line break with more space on either side stays in one piece with it.
        lone = np.flatnonzero(here == 4) + 1
        odd = lone[np.isin(kind[lone - 1], (1, 4)) | np.isin(kind[np.minimum(lone + 1, len(kind) - 1)], (1, 4))]
        inner[odd - 1] = False
        inner[np.minimum(odd, len(inner) - 1)] &= kind[np.minimum(odd + 1, len(kind) - 1)] == 1
        mark = np.zeros(len(data) + 1, bool)
        mark[1:-1] = inner
        mark[first] = True
        cut = np.flatnonzero(mark)
        pieces = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        known = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(new := np.flatnonzero(known < 0)):
            known[new] = len(self.index) + np.arange(len(new))
            self._learn([distinct[i] for i in new.tolist()])
        code = known[pieces.indices.to_numpy()]
        lens = self.lens[code]
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = self.pool[np.repeat(self.starts[code] - ends[:-1], lens) + np.arange(int(ends[-1]))].astype(np.uint32)
        at = ends[np.searchsorted(cut, first)]
        for k, i in enumerate(which):
            out[i] = ids[at[k] : at[k + 1]]
        return out


#: One encoder a worker and file: its memory outlives a task.
_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(tokenizer_file: str) -> PieceEncoder:
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = PieceEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, vocabulary: int, block_ids: int = BLOCK_IDS) -> None:
    """Encodes ``text`` (null: empty) of each row, appends ``end_id``, and
    writes ``path``/blocks and ``path``/index in ascending order of doc_id
    (null first; equal doc_ids by text). Repeated rows are all written."""
    spark, width = docs.sparkSession, bits_for(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_file), TaskContext.get().partitionId()
        names: list[int | None] = []
        held: list[np.ndarray] = []
        seq = n = 0
        end = np.array([end_id], np.uint32)

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_ids": [n], "n_docs": [len(names)], "data": [make_block(names, held, width)]}, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("data", pa.binary())]))

        for b in slices(batches, "text", 4 << 20):
            for name, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                if names and n + len(ids) + 1 > block_ids:
                    yield block()
                    names, held, n, seq = [], [], 0, seq + 1
                names.append(name)
                held.append(np.concatenate([ids, end]))
                n += len(ids) + 1
        if names:
            yield block()

    n = max(1, shuffle_partitions(spark))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    map_arrow(rows, encode, "part int, seq int, n_ids long, n_docs long, data binary").write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    # One row a block: a prefix sum inside each part, and one over the parts' totals (as many rows as tasks).
    sizes = spark.read.parquet(f"{path}/blocks").select("part", "seq", "n_ids", "n_docs")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    sizes.withColumn("own", own).join(bases, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("start"), "n_ids", "n_docs").write.mode("overwrite").parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents in the files: doc_id, start, ids (array of int)."""
    blocks, index = spark.read.parquet(f"{path}/blocks").select("part", "seq", "data"), spark.read.parquet(f"{path}/index").select("part", "seq", "start")

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("data"), strict=True):
                names, offsets, width, packed = open_block(data.as_py())
                ids = unpack(packed, width, int(offsets[-1])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(offsets[:-1] + start, pa.int64()), lists], ["doc_id", "start", "ids"])

    return map_arrow(blocks.join(index, ["part", "seq"]), docs, "doc_id long, start long, ids array<int>")


def read_range(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """The ids from number ``begin`` of the corpus up to ``end`` (not
    included): start, ids (array of int), a row for each block that holds some;
    in order of ``start`` they are the range. Ids beyond the corpus are left
    out; an empty range has no rows.

    Blocks follow each other by part and seq, so that a range is one interval
    of both, found in the index: a filter that Parquet's statistics can use.
    Of the blocks read, only the bits of the range are unpacked.
    """
    index = spark.read.parquet(f"{path}/index").where((F.col("start") < end) & (F.col("start") + F.col("n_ids") > begin)).select("part", "seq", "start", "n_ids")
    place = F.struct("part", "seq")
    ends = index.agg(F.min(place).alias("a"), F.max(place).alias("z")).head()
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "seq", "data")
    if begin >= end or ends["a"] is None:
        blocks = blocks.where("false")
    else:
        part, seq, a, z = F.col("part"), F.col("seq"), ends["a"], ends["z"]
        blocks = blocks.where((part >= a["part"]) & (part <= z["part"]) & ((part > a["part"]) | (seq >= a["seq"])) & ((part < z["part"]) | (seq <= z["seq"])))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, n, data in zip(b.column("start").to_pylist(), b.column("n_ids").to_pylist(), b.column("data"), strict=True):
                first, last = max(0, begin - start), min(n, end - start)
                _, _, width, packed = open_block(data.as_py())
                found = unpack(packed, width, last - first, first).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([start + first], pa.int64()), pa.array([found], pa.list_(pa.int32()))], ["start", "ids"])

    return map_arrow(blocks.join(index, ["part", "seq"]), ids, "start long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""
    blocks, index = spark.read.parquet(f"{path}/blocks").select("part", "seq", "data"), spark.read.parquet(f"{path}/index").select("part", "seq", "start")

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("data"), strict=True):
                names, offsets, width, packed = open_block(data.as_py())
                raw = unpack(packed, width, int(offsets[-1])).astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(offsets[:-1] + start, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(blocks.join(index, ["part", "seq"]), docs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through the packed files and back: start, length and
    checksum of each document's ids. Null text: only the end id. Empty table:
    no rows."""
    import public_tokenizers

    path = Scratch(spark, "packed").path("ids")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2, 50257)
    return digests(spark, path)
