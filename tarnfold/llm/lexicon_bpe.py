"""BPE encoding and decoding by a minimal acyclic transducer.

Frequent words are compiled with their ids into a minimal acyclic automaton:
words share their beginnings and their endings, each edge carries the number of
accepted words that sort before it, and so the sum along a word's path numbers
the word and finds its ids. The automaton is a few flat arrays in one file,
which Spark hands to every executor and every Python worker maps into memory.
Words outside the lexicon are merged exactly, all new words of a batch at once.

Reads tokenizer files of the tokenizers library whose model is BPE with an end
of word suffix over byte-level symbols, with this normaliser: NFC, white space
to one space, lower case, and a split that keeps the matches of a pattern.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, slices, table

#: Words in the lexicon at most: the most frequent.
LEXICON_WORDS = 50_000
#: A word counts towards the lexicon from each slice (about 8 MB of text) that
#: holds it so often. The choice of words never changes ids, only speed.
SLICE_COUNT = 4
#: Distinct pieces of text whose ids a worker remembers.
PIECES = 400_000
#: Words of more symbols are merged one at a time, in n log n steps.
LONG = 64
NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable characters that byte-level vocabularies use for bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


class Merger:
    """Exact merges with the vocabulary of a tokenizer file."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError("the tokenizer file is of another kind")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t.encode()
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols, suffix = byte_symbols(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.size = size
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))

    def normal(self, text: str) -> str:
        """NFC and lower case, character by character (no final sigma)."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def words(self, piece: str) -> list[str]:
        return self.pattern.findall(piece)

    def _ranks(self, sym: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Rank of the merge of each symbol with the next; NONE without one."""
        out = np.full(len(sym), NONE, np.int64)
        at = np.flatnonzero(joined)
        key = sym[at] * self.size + sym[at + 1]
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[at] = np.where(self.keys[i] == key, self.ranks[i], NONE)
        return out

    def _long(self, sym: list[int]) -> list[int]:
        n = len(sym)
        prev, nxt, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        rank, size = self.rank_of.get, self.size
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank(sym[i] * size + sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], nxt[i] = int(self.made[r]), False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (r := rank(sym[x] * size + sym[y])) is not None:
                    heapq.heappush(heap, (r, x, sym[x], sym[y]))
        return [s for s, ok in zip(sym, alive, strict=True) if ok]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, joined, and how many each has. All words take
        their lowest-ranked merge together, again and again."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(lens)
        sym[ends - 1] = self.last[raw[ends - 1]]
        out: list[np.ndarray | None] = [None] * len(words)
        for i in np.flatnonzero(lens > LONG).tolist():
            out[i] = np.array(self._long(sym[ends[i] - lens[i] : ends[i]].tolist()), np.int64)
        who = np.repeat(np.arange(len(words)), lens)
        short = (lens <= LONG)[who]
        sym, who = sym[short], who[short]
        done_sym, done_who = [], []
        while len(sym):
            start = np.concatenate([[True], who[1:] != who[:-1]])
            joined = np.concatenate([~start[1:], [False]])
            ranks = self._ranks(sym, joined)
            starts = np.flatnonzero(start)
            best = np.minimum.reduceat(ranks, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(sym))))
            rest = best == NONE
            if rest.any():
                done_sym.append(sym[rest])
                done_who.append(who[rest])
                sym, who, ranks, best = sym[~rest], who[~rest], ranks[~rest], best[~rest]
                if not len(sym):
                    break
            hit = ranks == best
            # Of overlapping places (a a a) every other one from the left merges.
            first = hit & ~np.concatenate([[False], hit[:-1]])
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit &= (run & 1) == 0
            sym[hit] = self.made[best[hit]]
            keep = ~np.concatenate([[False], hit[:-1]])
            sym, who = sym[keep], who[keep]
        if done_sym:
            s, w = np.concatenate(done_sym), np.concatenate(done_who)
            order = np.argsort(w, kind="stable")
            s, w = s[order], w[order]
            names, at = np.unique(w, return_index=True)
            for i, x in zip(names.tolist(), np.split(s, at[1:]), strict=True):
                out[i] = x
        counts = np.fromiter((len(x) for x in out), np.int64, len(out))
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), counts


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """The minimal acyclic automaton of sorted distinct words, built word by
    word: what can no longer change is replaced by an equal state."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]  # states along the last word
    last = b""

    def settle(down: int) -> None:
        while len(path) > down + 1:
            s, parent = path.pop(), path[-1]
            key = (final[s], tuple(edges[s].items()))
            edges[parent][last[len(path) - 1]] = known.setdefault(key, s)

    for w in words:
        k = 0
        while k < len(w) and k < len(last) and w[k] == last[k]:
            k += 1
        settle(k)
        for c in w[k:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][c] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = w
    settle(0)
    return edges, final


class Lexicon:
    """Words with ids in flat arrays: ``keys`` (state * 256 + byte, sorted),
    ``targets``, ``skips`` (words that sort before, through this edge),
    ``final`` by state, and the ids with their offsets by word number."""

    FIELDS = ("keys", "targets", "skips", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: Iterable[bytes], merger: Merger) -> Lexicon:
        words = sorted({w for w in words if w})
        edges, final = minimal_automaton(words)
        order, number, stack = [], {}, [0]
        while stack:  # states in the order of a walk; only those in use
            s = stack.pop()
            if s not in number:
                number[s] = len(order)
                order.append(s)
                stack += edges[s].values()
        count: dict[int, int] = {}

        def words_from(root: int) -> None:
            todo = [root]
            while todo:
                s = todo[-1]
                if wait := [t for t in edges[s].values() if t not in count]:
                    todo += wait
                else:
                    count[s] = final[s] + sum(count[t] for t in edges[s].values())
                    todo.pop()

        words_from(0)
        keys, targets, skips = [], [], []
        for s in order:
            before = int(final[s])
            for c, t in sorted(edges[s].items()):
                keys.append(number[s] * 256 + c)
                targets.append(number[t])
                skips.append(before)
                before += count[t]
        ids, lens = merger.merge(words)
        return cls({"keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "skips": np.array(skips, np.int32), "final": np.array([final[s] for s in order], bool), "offsets": np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), "ids": ids.astype(np.int32)})

    def dump(self) -> bytes:
        """One file: a line of JSON with each array's type and length, then the arrays."""
        head = json.dumps([[n, self.arrays[n].dtype.str, len(self.arrays[n])] for n in self.FIELDS]).encode()
        parts = [head + b" " * (-(len(head) + 1) % 64) + b"\n"]
        for n in self.FIELDS:
            data = self.arrays[n].tobytes()
            parts.append(data + b"\0" * (-len(data) % 64))
        return b"".join(parts)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.dump())

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Maps a saved file into memory."""
        with open(path, "rb") as f:
            head = f.readline()
        arrays, at = {}, len(head)
        for name, kind, n in json.loads(head):
            arrays[name] = np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind)
            at += -(-np.dtype(kind).itemsize * n // 64) * 64
        return cls(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 for those outside: all walk together."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lens) - lens
        raw = np.frombuffer(b"".join(words), np.uint8)
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(lens > 0) if len(self.keys) else np.zeros(0, np.int64)
        out = np.full(len(words), -1, np.int64)
        k = 0
        while len(live):
            key = state[live] * 256 + raw[starts[live] + k]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[i] == key
            live, i = live[ok], i[ok]
            state[live] = self.targets[i]
            total[live] += self.skips[i]
            k += 1
            ended = lens[live] == k
            there = live[ended]
            there = there[self.final[state[there]]]
            out[there] = total[there]
            live = live[~ended]
        return out


class Codec:
    """Encodes texts and decodes ids, with a lexicon."""

    def __init__(self, tokenizer_file: str, lexicon: Lexicon | None = None):
        self.merger = Merger(tokenizer_file)
        self.lexicon = lexicon
        self.decimal = [str(i).encode() for i in range(self.merger.size)]
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pieces: list[tuple[int, bytes, bytes]] = []  # tokens, their ids in decimal, their strings; joined by spaces

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Joined ids of distinct words and how many each has."""
        number = self.lexicon.find(words) if self.lexicon else np.full(len(words), -1, np.int64)
        new = np.flatnonzero(number < 0)
        ids, lens = self.merger.merge([words[i] for i in new.tolist()])
        if not self.lexicon or len(new) == len(words):
            return ids, lens
        pool = np.concatenate([np.asarray(self.lexicon.ids, np.int64), ids])
        all_starts, all_lens = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        known = np.flatnonzero(number >= 0)
        all_starts[known] = self.lexicon.offsets[number[known]]
        all_lens[known] = self.lexicon.offsets[number[known] + 1] - all_starts[known]
        all_starts[new] = len(self.lexicon.ids) + np.cumsum(lens) - lens
        all_lens[new] = lens
        ends = np.cumsum(all_lens)
        return pool[np.repeat(all_starts - (ends - all_lens), all_lens) + np.arange(int(ends[-1]))], all_lens

    def _learn(self, pieces: list[bytes]) -> None:
        of = [[w.encode("utf-8", "surrogatepass") for w in self.merger.words(p.decode("utf-8", "surrogatepass"))] for p in pieces]
        words = list(dict.fromkeys(w for ws in of for w in ws))
        number = dict(zip(words, range(len(words)), strict=True))
        ids, lens = self.word_ids(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        flat, at = ids.tolist(), np.concatenate([[0], np.cumsum(lens)]).tolist()
        decimal, tokens = self.decimal, self.merger.tokens
        for p, ws in zip(pieces, of, strict=True):
            own = [x for w in ws for x in flat[at[number[w]] : at[number[w] + 1]]]
            self.index[p] = len(self.pieces)
            self.pieces.append((len(own), b" ".join([decimal[x] for x in own]), b" ".join([tokens[x] for x in own])))

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in ``pieces`` of the texts' pieces between ASCII white space
        (texts without marks of special tokens), and each text's end."""
        if len(self.index) > PIECES:
            self.clear()
        raw = [self.merger.normal(t).encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(raw)
        if not data:
            return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        space = _IS_SPACE[np.frombuffer(data, np.uint8)]
        text_ends = np.cumsum([len(r) + 1 for r in raw]) - 1
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        # Pieces and the white space between them alternate in one Arrow array; every other value is a piece.
        cut = np.empty(2 * len(starts) + 1, np.int32)
        cut[:-1:2], cut[1::2], cut[-1] = starts, ends, len(data)
        both = pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(data)])
        pieces = both.take(pa.array(np.arange(0, len(cut) - 1, 2))).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        known = np.fromiter((self.index.get(p, -1) for p in distinct), np.int64, len(distinct))
        if len(new := np.flatnonzero(known < 0)):
            known[new] = len(self.pieces) + np.arange(len(new))
            self._learn([distinct[i] for i in new.tolist()])
        return known[pieces.indices.to_numpy()], np.searchsorted(starts, text_ends)

    def encoded(self, texts: list[str | None]) -> list[tuple[int, bytes, bytes]]:
        """Of each text: number of ids, the ids in decimal, the decoded text."""
        out: list[tuple[int, bytes, bytes]] = [(0, b"", b"")] * len(texts)
        plain, marked = [], []
        for i, t in enumerate(texts):
            if t:
                (marked if "<|" in t and self.merger.splitter and self.merger.splitter.search(t) else plain).append(i)
        code, ends = self.codes([texts[i] for i in plain])
        code, at, got = code.tolist(), 0, self.pieces
        for i, end in zip(plain, ends.tolist(), strict=True):
            own = [x for c in code[at:end] if (x := got[c])[0]]
            out[i] = (sum([x[0] for x in own]), b" ".join([x[1] for x in own]), b" ".join([x[2] for x in own]))
            at = end
        for i in marked:
            parts = []
            for k, part in enumerate(self.merger.splitter.split(texts[i])):
                if k % 2:
                    x = self.merger.special[part]
                    parts.append((1, self.decimal[x], self.merger.tokens[x]))
                elif part and (x := self.encoded([part])[0])[0]:
                    parts.append(x)
            out[i] = (sum(x[0] for x in parts), b" ".join(x[1] for x in parts), b" ".join(x[2] for x in parts))
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.array(x[1].split(), np.int64) for x in self.encoded(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings joined by spaces, as without a decoder."""
        return b" ".join([self.merger.tokens[int(i)] for i in ids]).decode("utf-8", "replace")


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def frequent_words(docs: DataFrame, tokenizer_file: str, n: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, at most ``n``. Every slice of text
    tells the words that it holds at least ``SLICE_COUNT`` times. A histogram of
    their counts, in steps of an eighth of a doubling, gives the least count of
    which no more than ``n`` words are: only those come to the driver, from all
    tasks together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _codec(tokenizer_file, None).merger
        for b in slices(batches, "text", 8 << 20):
            raw = [merger.normal(t).encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            pieces = pa.array(b"\n".join(raw).split(), pa.binary()).dictionary_encode()
            counts = np.bincount(pieces.indices.to_numpy(), minlength=len(pieces.dictionary))
            often = np.flatnonzero(counts >= SLICE_COUNT)
            found: dict[str, int] = {}
            for p, c in zip(pieces.dictionary.take(pa.array(often)).to_pylist(), counts[often].tolist(), strict=True):
                for w in merger.words(p.decode("utf-8", "surrogatepass")):
                    found[w] = found.get(w, 0) + c
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    scratch = Scratch(docs.sparkSession, "lexicon")
    rows = map_arrow(docs.select(F.coalesce("text", F.lit("")).alias("text")), run, "word string, n long")
    step = F.floor(F.log2("n") * 8).cast("int")
    counts = scratch.write(rows.groupBy("word").agg(F.sum("n").alias("n")).withColumn("step", step), "counts")
    least, left = None, n
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # a row a step, at most 8 * 63
        if r["count"] > left:
            break
        least, left = r["step"], left - r["count"]
    found = [] if least is None else counts.where(F.col("step") >= least).collect()
    scratch.drop("counts")
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


#: One codec a worker, file and lexicon.
_CODECS: dict[tuple, Codec] = {}


def _codec(tokenizer_file: str, lexicon_file: str | None) -> Codec:
    key = (tokenizer_file, lexicon_file)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tokenizer_file, Lexicon.load(SparkFiles.get(lexicon_file)) if lexicon_file else None)
    return _CODECS[key]


def publish(spark: SparkSession, lexicon: Lexicon) -> str:
    """Hands the lexicon's file, written in the shared folder, to all
    executors, also those that join later. Returns its name there."""
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(Scratch(spark, "lexicon").path(name))
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(lexicon.dump()))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def round_trip(docs: DataFrame, tokenizer_file: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_tokens, ids_sha256 and decoded_sha256 of
    each text. Null text: empty, no tokens. Repeated rows give equal rows; an
    empty table gives no rows."""
    spark = docs.sparkSession
    lexicon = publish(spark, Lexicon.build([w.encode() for w in frequent_words(docs, tokenizer_file)], Merger(tokenizer_file)))
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer_file, lexicon)
        for b in slices(batches, "text"):
            made = codec.encoded(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([m[0] for m in made], pa.int64()), pa.array([hashlib.sha256(m[1]).hexdigest() for m in made]), pa.array([hashlib.sha256(m[2]).hexdigest() for m in made])], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(rows, run, f"{ddl}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded and decoded."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
