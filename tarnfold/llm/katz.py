"""Katz back-off language model over word n-grams of any order, fitted and
evaluated where the text lies.

Documents are gathered in blocks of up to a few million tokens. A block keeps
its tokens as numbers of its own vocabulary, so only distinct words and distinct
n-grams of a block, each with its count, are exchanged: every frequent n-gram
costs a row for each block, not for each occurrence. Orders are taken from the
lowest to the highest, and for each the exchanges are

* n-grams: each block learns the training count of each of its n-grams in all.
  An n-gram whose first or last words without the other end are found in one
  block only is that block's alone and stays there;
* histories: each n-gram is owned by the first block that holds it; the owners'
  sums over a history's continuations, added up, give its back-off weight.

Counts ``r <= K`` are discounted by Good-Turing at each order, the others kept:

    P(w)   = d1(c(w)) c(w) / N, what is left going to the unknown word
    P(w|h) = dk(c(hw)) c(hw) / c(h)  if c(hw) > 0,  else  alpha(h) P(w|h')
    alpha(h) = (1 - sum of the seen P(w|h)) / (1 - sum of the P(w|h') of seen w)

with h' the history without its first word, evaluated by the same rule: every
token's probability is that of the next lower order until its own order's is
known. For each history the probabilities of all words and the unknown word add
up to 1. A history without discounted counts counts one more for what is
unseen. A document's first words follow marks of its start.

In an exchange a block's keys are sorted and cut into ranges of the hash space;
each range travels as one compressed piece and meets those of the other blocks
in one task, whose answer returns in the same order. The number of ranges grows
with the tokens, so that a range's pieces fit a task.

A block asks about a history's weight only where one of its tokens backs off
from it, and adds to its sums only where it owns a continuation.

The model's tables lie in the shared folder, by order: ``ngrams`` holds the
counts of n-grams that several blocks hold and ``weights`` the back-off weights of histories,
one row for each range of the hash space (``part=-1``); what one block alone
holds is in its row of the last state. The answers to the blocks lie beside
them until they are read. Blocks meet their answers in ``PARTS`` parts, one
after the other, and what a part has read is removed, so that one part's
exchange is on disk at a time. Words and n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, mix, shuffle_partitions, slices, table, words_of

#: The model's order, and the largest discounted count.
ORDER, K = 3, 5
#: Tokens in a block, unless one document has more; tokens to a range of the hash space.
BLOCK_TOKENS, RANGE_TOKENS = 1_000_000, 8_000_000
#: Number and hash of the mark of a document's end, and hash of that of its start.
END, _END, _START = 0, np.uint64(2), np.uint64(1)
FOLDS, HELD_OUT = 5, 1
#: Bits of a number in which history, word and place are sorted together.
_BITS = 63

#: Parts of the blocks that meet their answers one after the other.
PARTS = 4
#: In place of a block's part: a range's row of the model.
MODEL = -1

_STATE = "block long, data binary"
_PIECE = "bucket int, block long, data binary"
_REPLY = _PIECE + ", part int"


def part_of(block: int) -> int:
    """The part of a block, whose number is made of its task's and its place there."""
    return ((block >> 24) + (block & 0xFFFFFF)) % PARTS


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays in one compressed piece, byte plane by byte plane."""
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays.values()]
    return zstandard.ZstdCompressor(1).compress(b"".join([len(head).to_bytes(4, "little"), head, *planes]))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[:4], "little")
    out, at = {}, 4 + n
    for k, kind, size in json.loads(data[4 : 4 + n]):
        width = np.dtype(kind).itemsize
        out[k] = np.ascontiguousarray(np.frombuffer(data, np.uint8, size * width, at).reshape(width, size).T).view(kind).reshape(size)
        at += size * width
    return out


def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 0 to K + 1 (the last for all larger) from the numbers
    of types with counts 1 to K + 1: Good-Turing, scaled so that counts above
    K keep theirs; where a factor isn't between 0 and 1, absolute discounting."""
    d = np.ones(K + 2)
    d[0] = 0
    if not n[0]:
        return d
    absolute = n[0] / (n[0] + 2 * n[1]) if n[1] else 0.5
    a = (K + 1) * n[K] / n[0]
    for r in range(1, K + 1):
        turing = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) if n[r - 1] and a < 1 else 0
        d[r] = turing if 0 < turing < 1 else 1 - absolute / r
    return d


class Unigrams:
    """P(w) by count; ``unknown`` is the unknown word's."""

    def __init__(self, n: list[int], tokens: int, types: int):
        self.d, self.tokens, self.types = discounts(n), tokens, types
        seen = tokens + sum((self.d[r] - 1) * r * n[r - 1] for r in range(1, K + 1))
        self.whole = tokens if tokens - seen > 1e-9 * max(tokens, 1) else tokens + 1
        self.unknown = (self.whole - seen) / self.whole

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.d[np.minimum(count, K + 1)] * count / self.whole, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the contract's smoothed unigram."""
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to blocks: docs, null, held, lens, tokens, vocab (steps of hashes)."""
    part, seq = TaskContext.get().partitionId(), 0
    number: dict[bytes, int] = {}
    docs: list = []
    held: list[bool] = []
    tokens: list[np.ndarray] = []
    size = 0

    def block() -> pa.RecordBatch:
        lens = np.array([len(t) for t in tokens], np.int32)
        flat = np.concatenate(tokens)
        # Frequent words get small numbers, which pack well; so do the
        # differences of the hashes of words that are equally frequent.
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
        order = np.lexsort((hashes, -np.bincount(flat, minlength=len(number) + 1)[1:]))
        rank = np.zeros(len(number) + 1, np.int32)
        rank[order + 1] = np.arange(len(order)) + 1
        data = pack({"docs": np.array([d or 0 for d in docs], np.int64), "null": np.array([d is None for d in docs], bool), "held": np.array(held, bool), "lens": lens, "tokens": rank[flat], "vocab": _steps(np.concatenate([np.array([_END], np.uint64), hashes[order]]))})
        name, trained = (part << 24) | seq, int((~np.array(held, bool)).sum())
        return pa.RecordBatch.from_pydict({"block": pa.array([name], pa.int64()), "data": pa.array([data], pa.binary()), "tokens": pa.array([len(flat)], pa.int64()), "trained": pa.array([trained], pa.int64()), "part": pa.array([part_of(name)], pa.int32())})

    for b in slices(batches, "text"):
        for name, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = words_of(text)
            if docs and size + len(words) >= BLOCK_TOKENS:
                yield block()
                number, docs, held, tokens, size, seq = {}, [], [], [], 0, seq + 1
            new = len(number)
            for w in words:
                if w not in number:
                    number[w] = new
                    new += 1
            t = np.empty(len(words) + 1, np.int32)
            t[:-1] = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
            t[:-1] += 1
            t[-1] = END
            docs.append(name)
            held.append(zlib.crc32(b"" if name is None else str(name).encode()) % FOLDS == HELD_OUT)
            tokens.append(t)
            size += len(t)
    if docs:
        yield block()


class Block:
    """A block's distinct n-grams, order by order, found again from its tokens.

    Of order k: ``place`` is each token's n-gram, ``keys`` the n-grams' hashes,
    ``hist`` each n-gram's history among the n-grams of order k - 1, one more
    than their number, as 0 is the start's; ``example`` is a token of each.
    ``trained`` is the number of training texts, which is the start's count.
    """

    def __init__(self, x: dict[str, np.ndarray], order: int, trained: int):
        self.x, self.trained = x, trained
        self.first = np.cumsum(x["lens"]) - x["lens"]
        self.train = np.repeat(~x["held"], x["lens"])
        vocab = np.cumsum(x["vocab"], dtype=np.uint64)
        self.place, self.keys, self.hist, self.example = [x["tokens"]], [vocab], [None], [None]
        for _ in range(1, order):
            self._next()

    def _next(self) -> None:
        below, tokens = self.place[-1], self.place[0]
        hist = np.empty(len(tokens), np.int64)
        hist[1:] = below[:-1]
        hist += 1
        hist[self.first] = 0
        word, at = (len(self.keys[0]) - 1).bit_length(), (len(tokens) - 1).bit_length()
        code = hist << word | tokens
        if len(self.keys[-1]).bit_length() + word + at <= _BITS:
            # With the place in its last bits a number is sorted by itself, faster than an index of it.
            code = code << at | np.arange(len(code))
            code.sort()
            order = code & ((1 << at) - 1)
            code >>= at
        else:  # a document of many millions of tokens
            order = np.argsort(code, kind="stable")
            code = code[order]
        new = np.concatenate([[True], code[1:] != code[:-1]])
        place = np.empty(len(code), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        code = code[new]
        h, w = code >> word, code & ((1 << word) - 1)
        start = mix(np.array([_START * np.uint64(len(self.place))], np.uint64))
        names = np.concatenate([start, self.keys[-1]])[h]
        self.place.append(place)
        self.keys.append(mix(names * np.uint64(0x9E3779B97F4A7C15) + mix(self.keys[0][w])))
        self.hist.append(h)
        self.example.append(order[new])

    def counts(self) -> np.ndarray:
        """Training counts of the n-grams of the highest order."""
        return np.bincount(self.place[-1][self.train], minlength=len(self.keys[-1]))

    def asked(self) -> np.ndarray:
        """Which n-grams of the highest order (above 1) other blocks may hold."""
        many = self.x[f"many{len(self.place) - 1}"]
        return np.concatenate([[True], many])[self.hist[-1]] & many[self.place[-2][self.example[-1]]]

    def totals(self, k: int) -> np.ndarray:
        """Training counts of the histories of order k, the start's first."""
        return np.concatenate([[self.trained], self.x[f"total{k - 1}"]]).astype(np.int64)

    def shared(self, k: int) -> np.ndarray:
        """Which histories of order k have been seen and other blocks may hold."""
        return np.concatenate([[True], self.x[f"many{k - 1}"]]) & (self.totals(k) > 0)

    def backs_off(self, k: int) -> np.ndarray:
        """Histories of order k from which a token of this block backs off."""
        return np.bincount(self.hist[k - 1], self.x[f"total{k}"] == 0, len(self.keys[k - 2]) + 1) > 0

    def asks(self, k: int, d: np.ndarray) -> np.ndarray:
        """Shared histories whose weight this block needs, or whose counts may
        need one more: those of which no discounted continuation is here."""
        c = self.x[f"total{k}"].astype(np.int64)
        left = np.bincount(self.hist[k - 1], (1 - d[np.minimum(c, K + 1)]) * c, len(self.keys[k - 2]) + 1)
        return self.shared(k) & (self.backs_off(k) | (left <= 2e-9 * self.totals(k)))

    def history_keys(self, k: int) -> np.ndarray:
        return np.concatenate([mix(np.array([_START * np.uint64(k + 1)], np.uint64)), self.keys[k - 2]])

    def sums(self, k: int, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By history of order k, of the seen n-grams that this block owns: the
        discounted counts, and the probabilities of the order below, ``p``."""
        c = self.x[f"total{k}"]
        use = self.x[f"own{k}"] & (c > 0)
        h, c, n = self.hist[k - 1][use], c[use], len(self.keys[k - 2]) + 1
        return np.bincount(h, d[np.minimum(c, K + 1)] * c, n), np.bincount(h, p[self.example[k - 1][use]], n)

    def raised(self, k: int, d: np.ndarray, whole: np.ndarray, alpha: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The tokens' probabilities of order k from those of the order below."""
        c = self.x[f"total{k}"].astype(np.int64)
        h, place = self.hist[k - 1], self.place[k - 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = d[np.minimum(c, K + 1)] * c / whole[h]
        return np.where((c > 0)[place], seen[place], alpha[h][place] * p)

    def probabilities(self, order: int, unigrams: Unigrams, ds: dict[int, np.ndarray]) -> np.ndarray:
        p = unigrams.p(self.x["total1"])[self.place[0]]
        for k in range(2, order + 1):
            p = self.raised(k, ds[k], self.totals(k) + self.x[f"more{k}"], self.x[f"alpha{k}"], p)
        return p


def backoff(total: np.ndarray, seen: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each history's counts are divided by, and its back-off weight."""
    whole = np.where(total - seen > 1e-9 * np.maximum(total, 1), total, total + 1).astype(float)
    alpha = np.where(total > 0, (whole - seen) / whole / np.maximum(1 - below, 1e-300), 1.0)
    return whole, alpha


def _steps(keys: np.ndarray) -> np.ndarray:
    """Keys as differences; those of keys in order are small and pack well."""
    return np.diff(keys, prepend=np.uint64(0))


def _pieces(block: int, keys: np.ndarray, buckets: int, coded: dict[str, np.ndarray] | None = None, **values: np.ndarray) -> pa.RecordBatch:
    """A block's distinct keys with values, one piece a range of the keys.
    ``coded`` values, of which few are distinct, are stored as their numbers in
    a piece's list of them."""
    order = np.argsort(keys)
    keys, values = keys[order], {n: v[order] for n, v in values.items()}
    coded = {n: v[order] for n, v in (coded or {}).items()}
    edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    data, at = [], []
    for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if a < b:
            piece = {"step": _steps(keys[a:b]), **{n: v[a:b] for n, v in values.items()}}
            for n, v in coded.items():
                code = pa.array(v[a:b]).dictionary_encode()
                piece[n], piece[f"{n} at"] = code.dictionary.to_numpy(), code.indices.to_numpy().astype(np.int32)
            data.append(pack(piece))
            at.append(i)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), block)), pa.array(data, pa.binary())], ["bucket", "block", "data"])


def _met(pieces: pa.Table) -> tuple[list[int], np.ndarray, list[dict], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of one range: their blocks and ends, what they hold, an order
    of all keys, where equal keys start, the number of each key in order, and
    the distinct keys."""
    blocks = pieces.column("block").to_pylist()
    held = [unpack(x.as_py()) for x in pieces.column("data")]
    keys = np.concatenate([np.cumsum(x["step"], dtype=np.uint64) for x in held])
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return blocks, np.cumsum([len(x["step"]) for x in held]), held, order, np.flatnonzero(new), np.cumsum(new) - 1, keys[new]


def _replies(pieces: pa.Table, ends: np.ndarray, model: dict[str, np.ndarray], **values: np.ndarray) -> pa.Table:
    """The answer to each block, and the range's row of the model."""
    parts = {n: np.split(v, ends[:-1]) for n, v in values.items()}
    data = [pack({n: p[i] for n, p in parts.items()}) for i in range(len(ends))]
    bucket, block = pieces.column("bucket").to_pylist(), pieces.column("block").to_pylist()
    part = [*map(part_of, block), MODEL]
    return pa.table({"bucket": pa.array([*bucket, bucket[0]], pa.int32()), "block": pa.array([*block, MODEL], pa.int64()), "data": pa.array([*data, pack(model)], pa.binary()), "part": pa.array(part, pa.int32())})


def _count(pieces: pa.Table) -> pa.Table:
    """For each key: 4 * its count in all, + 2 if other blocks hold it, + 1 if
    this block is the first that does."""
    blocks, ends, held, order, starts, number, keys = _met(pieces)
    n = np.concatenate([x["n"] for x in held]).astype(np.int64)[order]
    block = np.repeat(np.array(blocks, np.int64), np.diff(ends, prepend=0))[order]
    total, first = np.add.reduceat(n, starts), np.minimum.reduceat(block, starts)
    many = np.diff(np.append(starts, len(order))) > 1
    told = np.empty(len(order), np.int64)
    told[order] = 4 * total[number] + 2 * many[number] + (first[number] == block)
    kept = many & (total > 0)
    return _replies(pieces, ends, {"step": _steps(keys[kept]), "total": total[kept].astype(np.int32)}, told=told)


def _weigh(pieces: pa.Table) -> pa.Table:
    """For each history that a block asks about: whether its counts are divided
    by one more, and its back-off weight, from the sums over all blocks."""
    _, ends, held, order, starts, number, keys = _met(pieces)
    seen = np.concatenate([h["seen"][h["seen at"]] for h in held])[order]
    total, below = (np.concatenate([h[n] for h in held])[order] for n in ("total", "below"))
    whole, alpha = backoff(total[starts], np.add.reduceat(seen, starts), np.add.reduceat(below, starts))
    more, weight = np.empty(len(order), np.uint8), np.empty(len(order))
    more[order], weight[order] = (whole > total[starts])[number], alpha[number]
    asks = np.concatenate([h["asks"] for h in held])
    ends = np.concatenate([[0], np.cumsum(asks)])[ends]
    return _replies(pieces, ends, {"step": _steps(keys), "alpha": alpha.astype(np.float32)}, more=more[asks], alpha=weight[asks])


def _returned(keys: np.ndarray, replies: pa.Table, **empty: type) -> dict[str, np.ndarray]:
    """Replies to a block, in the order of the keys that it asked about."""
    order = np.argsort(keys)
    parts = [unpack(replies.column("data")[i].as_py()) for i in np.argsort(replies.column("bucket").to_numpy()).tolist()]
    out = {}
    for name, kind in empty.items():
        x = np.concatenate([np.zeros(0, kind), *[p[name] for p in parts]])
        out[name] = np.empty_like(x)
        out[name][order] = x
    return out


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    for b in batches:
        for block, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
            yield block, unpack(data.as_py())


def _counted(n: np.ndarray) -> pa.Array:
    """How many types have each count from 1 to K + 1."""
    return pa.array([np.bincount(np.minimum(n, K + 2), minlength=K + 3)[1 : K + 2].tolist()], pa.list_(pa.int64()))


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    each row. Fitted on the rows whose crc32(doc_id as text) modulo 5 isn't 1.

    A null or empty text is its end mark alone. A null doc_id counts as an
    empty name and trains. Repeated rows count and are scored each. Without
    training rows every token is unknown and has probability 1. An empty table
    gives no rows. The order is two at least.
    """
    if order < 2:
        raise ValueError("the order is two at least")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "katz")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    state = scratch.write(map_arrow(texts, _blocks, _STATE + ", tokens long, trained long, part int"), "state0", "none", "part")
    size = state.agg(F.sum("tokens"), F.sum("trained")).head()
    buckets = max(shuffle_partitions(spark), int(size[0] or 0) // RANGE_TOKENS + 1)
    trained = int(size[1] or 0)

    def exchanged(asked: DataFrame, answer, name: str) -> DataFrame:
        """The answers to the blocks' pieces, by range of the hash space."""
        met = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, _REPLY)
        return scratch.write(met, name, "none", "part")

    def advanced(state: DataFrame, old: str, replies: DataFrame, asked: str, step, schema: str, name: str) -> DataFrame:
        """Each block with its answers, part by part; what is read for the last
        time is removed (``old`` is None where the state stays)."""
        for i in range(PARTS):
            here = F.col("part") == i
            x = state.where(here).select("block", "data").groupBy("block")
            y = replies.where(here).select("block", "bucket", "data").groupBy("block")
            new = scratch.write(x.cogroup(y).applyInArrow(lambda x, y: step(x, y), schema), f"{name}/part={i}", "none")
            scratch.drop(f"{asked}/part={i}", *([f"{old}/part={i}"] if old else []))
        return scratch.read(new.withColumn("part", F.lit(0)), name)

    def row(block: pa.ChunkedArray, x: dict[str, np.ndarray], **more: pa.Array) -> pa.Table:
        return pa.table({"block": block, "data": pa.array([pack(x)], pa.binary()), **more})

    ds: dict[int, np.ndarray] = {}
    unigrams: Unigrams | None = None
    name = "state0"
    for k in range(1, order + 1):

        def ask(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for block, x in _opened(batches):
                b = Block(x, k, trained)
                some = b.asked() if k > 1 else np.ones(len(b.keys[0]), bool)
                yield _pieces(block, b.keys[-1][some], buckets, n=b.counts()[some].astype(np.int32))

        def told(state: pa.Table, replies: pa.Table, k: int = k) -> pa.Table:
            """Adds the n-grams' counts, and which are shared, and owned."""
            x = unpack(state.column("data")[0].as_py())
            b = Block(x, k, trained)
            some = b.asked() if k > 1 else np.ones(len(b.keys[0]), bool)
            reply = _returned(b.keys[-1][some], replies, told=np.int64)["told"]
            total, many, own = b.counts(), np.zeros(len(some), bool), np.ones(len(some), bool)
            total[some], many[some], own[some] = reply >> 2, (reply & 2) > 0, (reply & 1) > 0
            seen = total[own & (total > 0)]
            x = x | {f"total{k}": total.astype(np.int32), f"own{k}": own} | ({f"many{k}": many} if k < order else {})
            return row(state.column("block"), x, n=_counted(seen), tokens=pa.array([int(seen.sum())], pa.int64()), types=pa.array([len(seen)], pa.int64()))

        counts = exchanged(map_arrow(state.select("block", "data"), ask, _PIECE), _count, f"ngrams{k}")
        state = advanced(state, name, counts, f"ngrams{k}", told, _STATE + ", n array<long>, tokens long, types long", f"counted{k}")
        found = state.agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(K + 1)], F.sum("tokens"), F.sum("types")).head()
        name, n = f"counted{k}", [int(v or 0) for v in found]
        if k == 1:
            unigrams = Unigrams(n[: K + 1], n[K + 1], n[K + 2])
            continue
        ds[k] = discounts(n[: K + 1])

        def ask_weights(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for block, x in _opened(batches):
                b = Block(x, k, trained)
                seen, below = b.sums(k, ds[k], b.probabilities(k - 1, unigrams, ds))
                asks = b.asks(k, ds[k])
                some = np.flatnonzero(asks | (b.shared(k) & (seen > 0)))
                yield _pieces(block, b.history_keys(k)[some], buckets, {"seen": seen[some]}, total=b.totals(k)[some], below=below[some], asks=asks[some])

        def weighed(x: dict[str, np.ndarray], replies: pa.Table, k: int = k) -> tuple[Block, np.ndarray]:
            """The block with the histories' weights, and the probabilities of order k."""
            b = Block(x, k, trained)
            p, totals, asks, shared = b.probabilities(k - 1, unigrams, ds), b.totals(k), b.asks(k, ds[k]), b.shared(k)
            whole, alpha = backoff(totals, *b.sums(k, ds[k], p))
            # Of a shared history that isn't asked about no weight is needed here.
            more, alpha = np.where(shared, 0, whole > totals).astype(np.uint8), np.where(shared, 0, alpha)
            reply = _returned(b.history_keys(k)[asks], replies, more=np.uint8, alpha=np.float64)
            more[asks], alpha[asks] = reply["more"], reply["alpha"]
            x[f"more{k}"], x[f"alpha{k}"] = more, alpha
            return b, b.raised(k, ds[k], totals + more, alpha, p)

        def keep(state: pa.Table, replies: pa.Table, k: int = k) -> pa.Table:
            x = unpack(state.column("data")[0].as_py())
            weighed(x, replies)
            del x[f"own{k}"]
            return row(state.column("block"), x)

        def evaluate(state: pa.Table, replies: pa.Table) -> pa.Table:
            x = unpack(state.column("data")[0].as_py())
            b, p = weighed(x, replies)
            lens, total = x["lens"], x["total1"]
            with np.errstate(divide="ignore"):
                scores = np.add.reduceat(np.log10(p), b.first)
            bases = np.add.reduceat(unigrams.base(total)[x["tokens"]], b.first)
            known = np.add.reduceat((total > 0)[x["tokens"]].astype(np.int64), b.first)
            return pa.table({"doc_id": pa.array(x["docs"], pa.int64(), mask=x["null"]), "held_out": pa.array(x["held"]), "n_tokens": pa.array(lens.astype(np.int64)), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(lens), unigrams.tokens, np.int64)), "base_score": pa.array(bases), "score": pa.array(scores)})

        weights = exchanged(map_arrow(state.select("block", "data"), ask_weights, _PIECE), _weigh, f"weights{k}")
        if k < order:
            state = advanced(state, name, weights, f"weights{k}", keep, _STATE, f"state{k}")
            name = f"state{k}"
    scores = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return advanced(state, None, weights, f"weights{order}", evaluate, scores, "scores").drop("part")


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``."""
    return score(table(spark, sf_dir, "documents"))
