"""Joins, passages, mixing, the language model and the pipeline, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tarnfold.llm import jaccard_join, katz, mixing, suffix_dedup
from tarnfold.llm.common import Scratch, words_of
from tarnfold.llm.components import components
from tests.llm.helpers import docs, odd_rows, prose, records


def corpus(seed: int) -> list[tuple]:
    """Originals, exact and near copies, chains of near copies, shared passages."""
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(40):
        texts.append(prose(rng, rng.choice([3, 8, 30, 120, 400]), 3000))
    passage = prose(rng, 70, 3000)
    for i in range(12):
        texts.append(prose(rng, 60, 3000) + "\n" + passage + "\n" + prose(rng, 40, 3000))
    base = prose(rng, 150, 3000).split()
    for i in range(45):  # a large group of near copies, some too far from most
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    chain = prose(rng, 200, 3000).split()
    for i in range(8):  # each near the next only
        chain = chain[9:] + prose(rng, 9, 3000).split()
        texts.append(" ".join(chain))
    texts += [texts[5], texts[5].upper(), texts[41], texts[60], "", " "]
    rng.shuffle(texts)
    return [(7 * i + 3, t, f"s{i % 3}") for i, t in enumerate(texts)]


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    rows = [(r[0], shingles(r[1])) for r in rows]
    label = {i: i for i, _ in rows}
    while True:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if a and b and label[i] != label[j] and 180 * len(a & b) >= 80 * (len(a) + len(b)):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
        if not changed:
            return sorted(((i, len(a), label[i]) for i, a in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_near_copies(spark, monkeypatch, seed):
    rows = corpus(seed)
    want = brute_components(rows)
    assert records(jaccard_join.join(docs(spark, rows)), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 7)  # large tiles are split and their parts paired
    assert records(jaccard_join.join(docs(spark, rows)), "doc_id", "n_shingles", "component_id") == want
    kept = jaccard_join.keep_first(docs(spark, rows))
    assert sorted((r["doc_id"], r["name"]) for r in kept.collect()) == sorted({(c, "x") for _, _, c in want})


def test_components_across_the_switch_of_sizes(spark):
    """Sets of up to SMALL grams whose only partners have more."""
    rng = random.Random(11)
    rows = []
    for n in (*range(52, 65), 65, 72, 80, 81):
        for m in sorted({65, 68, 70, 76, 80, n + 1}):
            words = [f"x{rng.randrange(10**9)}" for _ in range(m + 4)]
            rows += [(2 * len(rows) + 1, " ".join(words[: n + 4])), (2 * len(rows) + 2, " ".join(words))]
    want = brute_components(rows)
    assert sum(i != c for i, _, c in want) > 50
    assert records(jaccard_join.join(docs(spark, rows)), "doc_id", "n_shingles", "component_id") == want


def test_join_of_odd_rows(spark):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs(spark, odd_rows())).collect()}
    by = collections.defaultdict(set)
    for i, n, c in found:
        by[i].add((n, c))
    assert by[1] == by[2] and by[1] != by[5] or by[1] == {(0, 1)}
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[4] == {(1, 4)}
    assert {c for i in (5, 6, 7, 14) for _, c in by[i]} == {5}
    assert by[None] == {(0, None), (4, None)}
    assert jaccard_join.join(docs(spark, odd_rows())).count() == len(odd_rows())
    assert jaccard_join.join(docs(spark, [])).count() == 0


def test_null_ids_link_and_bridge(spark):
    rng = random.Random(12)
    words = [f"x{rng.randrange(10**9)}" for _ in range(230)]
    near, chain = words[:104], words[110:]
    rows = [(5, " ".join(near)), (None, " ".join(near[1:])), (8, " ".join(chain[:100])), (None, " ".join(chain[10:110])), (9, " ".join(chain[20:]))]
    assert brute_components([(i, t) for i, (_, t) in enumerate(rows)]) == [(0, 100, 0), (1, 99, 0), (2, 96, 2), (3, 96, 2), (4, 96, 2)]
    assert not 180 * len(shingles(rows[2][1]) & shingles(rows[4][1])) >= 80 * 192
    found = records(jaccard_join.join(docs(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert found == sorted([(5, 100, 5), (None, 99, 5), (8, 96, 8), (None, 96, 8), (9, 96, 8)], key=repr)


def test_tree_bounds_hold():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(20, 60)).astype(np.uint64)) for _ in range(150)]
    for k in range(0, 150, 3):
        sets[k + 1] = np.union1d(sets[k][: int(len(sets[k]) * 0.95)], sets[k + 1][:2])
    points = jaccard_join.opened(b"".join(jaccard_join.count_vector(s).tobytes() for s in sets))
    sizes = np.array([len(s) for s in sets])
    signs = np.ones((150, jaccard_join.SIGNS), np.int64)
    tree = jaccard_join.CountTree(points, sizes, signs)
    q, leaf, _ = tree.leaves(points, sizes, signs)
    near = set(zip(*(x.tolist() for x in tree.within(points, sizes, signs, q, leaf)[:2]), strict=True))
    for i in range(150):
        for j in range(150):
            overlap = len(np.intersect1d(sets[i], sets[j]))
            fine = jaccard_join.fine_bounds([jaccard_join.fine_vector(sets[i]).tobytes(), jaccard_join.fine_vector(sets[j]).tobytes()], np.array([0]), np.array([1]))[0]
            assert fine >= overlap
            if 180 * overlap >= 80 * (sizes[i] + sizes[j]):
                assert (i, j) in near


def test_the_tree_decides_candidates(spark):
    """Tiles of given documents are large enough for inner searches, and the
    search leaves most leaves and points of them out, but no pair that links."""
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scratch = Scratch(spark, "t")
    sets, tiles = jaccard_join.tiled(frame, scratch.write(jaccard_join.gram_sets(frame), "sets"), scratch)
    grams = {r["name"]: np.array(r["grams"]) for r in sets.collect()}
    by_tile = collections.defaultdict(list)
    for r in tiles.collect():
        by_tile[r["tile"]].append(r)
    assert max(map(len, by_tile.values())) > 3 * jaccard_join.FAN
    leaves = searched = compared = pairs = 0
    links, met = set(), set()
    for rows in by_tile.values():
        points = jaccard_join.opened(b"".join(r["point"] for r in rows))
        sizes = np.array([r["n"] for r in rows])
        signs = np.array([[r[f"sign{k}"] for k in range(jaccard_join.SIGNS)] for r in rows])
        tree = jaccard_join.CountTree(points, sizes, signs)
        q, leaf, _ = tree.leaves(points, sizes, signs)
        leaves, searched = leaves + len(rows) * len(tree.starts), searched + len(q)
        i, j, _ = tree.within(points, sizes, signs, q, leaf)
        found = set(zip(i.tolist(), j.tolist(), strict=True))
        compared, pairs = compared + len(found), pairs + len(rows) ** 2
        for a in range(len(rows)):
            for b in range(a):
                both = len(np.intersect1d(grams[rows[a]["name"]], grams[rows[b]["name"]]))
                if 180 * both >= 80 * (sizes[a] + sizes[b]):
                    links.add((min(rows[a]["name"], rows[b]["name"]), max(rows[a]["name"], rows[b]["name"])))
        met |= {(min(rows[a]["name"], rows[b]["name"]), max(rows[a]["name"], rows[b]["name"])) for a, b in found}
    assert len(links) >= 5 and links <= met  # in one tile at least
    assert searched < 0.7 * leaves and compared < 0.3 * pairs, (leaves, searched, pairs, compared)


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c")
    assert records(found, "node", "label") == sorted(label.items(), key=repr)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").count() == 0


def brute_passages(rows):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def aligned(seed):
    """One passage of 49 to 130 bytes at every shift, zero bytes beside it, and short texts."""
    rng = random.Random(seed)

    def noise(n):
        return "".join(chr(rng.choice([0, 97, 98])) for _ in range(n))

    passage = noise(200)
    rows = [(i, noise(i) + passage[i % 20 :][: 49 + i] + "\0" * (i % 7) + noise(rng.randrange(60))) for i in range(82)]
    rng.shuffle(rows)
    return rows + [(7, passage[20:90]), (7, noise(80)), (90, passage[:60]), (90, "z" * 40 + passage[60:120])]


def test_every_shift_meets_the_cover():
    c, v = suffix_dedup.COVER.tolist(), suffix_dedup.PERIOD
    for i in range(v):
        for j in range(v):
            assert any((i + t) % v in c and (j + t) % v in c for t in range(v))
    assert suffix_dedup.GRAM + v - 1 == suffix_dedup.DEPTH


def test_sample_positions():
    texts = [b"", b"a" * 49, bytes(range(50)), b"", bytes(range(200))]
    text, p, h = suffix_dedup.cover(*suffix_dedup._joined(pa.array(texts, pa.binary())))
    wanted = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 19) if len(t) >= 50 and i % 31 in (0, 1, 3, 8, 12, 18)]
    starts = [sum(map(len, texts[:k])) for k in range(len(texts))]
    assert list(zip(text.tolist(), p.tolist(), strict=True)) == [(k, starts[k] + i) for k, i in wanted]
    same = {}
    for (k, i), x in zip(wanted, h.tolist(), strict=True):
        assert same.setdefault(texts[k][i : i + 20], x) == x
    assert len(set(same.values())) == len(same)


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 10])
def test_repeated_passages(spark, block):
    for rows in (corpus(3), odd_rows(), aligned(5), [(1, "ab" * 400), (2, "ba" * 300), (3, "ab" * 20 + "c" + "ab" * 30), (4, "é" * 60), (5, "xé" + "é" * 40)]):
        found = suffix_dedup.digest(docs(spark, rows), block)
        assert records(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_passages(rows)


def test_stripping(spark):
    rows = corpus(3) + [(1, None), (2, "")]
    lost = {(r[0], r[4]): r[2] for r in brute_passages(corpus(3))}
    found = suffix_dedup.strip_repeats(docs(spark, rows)).collect()
    assert len(found) == len(rows) and {r["name"] for r in found} == {"x"}
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        if r["text"] is not None:
            assert r["n_chars"] == len(r["text"])
            if (r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) in lost and lost[r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()] == 0:
                assert r["text"] == texts[r["doc_id"]]
        else:
            assert texts[r["doc_id"]] is None
    assert suffix_dedup.digest(docs(spark, [])).count() == 0
    dotted = docs(spark, rows).withColumnRenamed("key", "a.b")
    assert records(suffix_dedup.strip_repeats(dotted), "doc_id", "text", "a.b") == sorted([(r["doc_id"], r["text"], "k") for r in found], key=repr)


def water_level(sizes):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    left, free, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            free.discard(s)
            left -= out[s]
    return out


def test_mixing_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)  # prefix sums over many buckets
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 80)), rng.choice(["a", "b", "Z", "é", "big", "big", "big", None])) for i in range(200)] + [(3, "twice the same", "a")] * 2 + [(None, "no name", "b"), (500, None, "null text only")]
    found = mixing.plan(docs(spark, rows), ["doc_id"]).collect()
    assert len(found) == len(rows)
    key = lambda s: "b" if s is None else "a" + s
    sizes = collections.Counter()
    for r in rows:
        sizes[key(r[2])] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    targets, taken = water_level(sizes), collections.Counter()
    for r in found:
        s = key(r["source"])
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["first"] is not None or r["second"] is not None) == (r["taken"] > 0)
        assert all(0 <= t <= 1 for t in (r["first"], r["second"]) if t is not None)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    again = mixing.plan(docs(spark, rows).repartition(3), ["doc_id"])
    assert records(again, "doc_id", "size", "taken", "first") == sorted(((r["doc_id"], r["size"], r["taken"], r["first"]) for r in found), key=repr)
    # All sources on one clock: passes in order of their positions.
    placed = mixing.sequence(again).collect()
    passes = sorted((t, r["doc_id"] if r["doc_id"] is not None else -1, k, r) for r in placed for k, t in enumerate((r["first"], r["second"])) if t is not None)
    before = 0
    for _, _, k, r in passes:
        assert k or r["start"] == before
        before += r["taken"] - r["size"] if k else min(r["taken"], r["size"])
    assert before == sum(taken.values()) and len(placed) == len(rows)
    assert all((r["start"] is None) == (r["taken"] == 0) for r in placed)
    assert mixing.sequence(mixing.plan(docs(spark, []), ["doc_id"])).count() == 0
    assert mixing.plan(docs(spark, []), ["doc_id"]).count() == 0
    assert mixing.plan(docs(spark, [(1, None), (2, " ")]), ["doc_id"]).where("taken > 0").count() == 0


def test_rows_of_one_name_are_spread(spark):
    """Different texts of a repeated or null name don't share a bucket."""
    from pyspark.sql import functions as F

    rows = docs(spark, [(None if i % 2 else 7, f"text {i}") for i in range(100)])
    assert rows.select(mixing.order_hash(F.col("doc_id"), F.col("text")).alias("h")).distinct().count() == 100


def test_positions_follow_the_schedules(spark):
    """A source's demand up to a position is the words before it."""
    from pyspark.sql import functions as F

    for place, a in enumerate(mixing.STARTS):
        for share in (0.0, 0.1, 0.5, 0.9, 1.0):
            t = spark.range(1).select(mixing.position(F.lit(share), F.lit(place))).head()[0]
            assert a * t + (1 - a) * t * t == pytest.approx(share)


def test_columns_of_any_name(spark):
    rows = docs(spark, [(i, f"one two three {i}", "s") for i in range(9)])
    odd = rows.withColumnRenamed("key", "a.b").withColumnRenamed("word", "_position_").withColumnRenamed("copy", "_times_")
    for f in (mixing.mix, jaccard_join.keep_first, suffix_dedup.strip_repeats):
        found = f(odd)
        assert found.columns == odd.columns and found.count() > 0
        assert {(r["a.b"], r["_position_"], r["_times_"]) for r in found.collect()} == {("k", "t", True)}


def test_mixed_documents(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 50), "ab"[i % 2]) for i in range(60)] + [(100, None, "a")]
    found = mixing.mix(docs(spark, rows)).collect()
    counts = collections.Counter(r["doc_id"] for r in found)
    plan = {r["doc_id"]: r for r in mixing.plan(docs(spark, rows), ["doc_id"]).collect()}
    assert counts == {i: n for i, r in plan.items() if r["size"] and (n := math.floor(r["taken"] / r["size"] + 0.5))}
    assert max(counts.values()) <= 2 and set(found[0].asDict()) == set(docs(spark, rows).columns)
    where = [plan[r["doc_id"]]["first"] for r in found if counts[r["doc_id"]] == 1]
    assert where == sorted(where)


@pytest.mark.parametrize(("words", "bits"), [(1, 63), (2, 63), (6, 63), (6, 0)])
def test_ngrams_of_a_block(monkeypatch, words, bits):
    """Equal n-grams, with the marks of starts, get one number; also where
    history, word and place don't fit one number together."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(katz, "_BITS", bits)
    tokens = rng.integers(0, words, 400)
    lens = np.array([1, 150, 99, 150], np.int32)
    x = {"tokens": tokens.astype(np.int32), "lens": lens, "held": np.array([0, 1, 0, 0], bool), "vocab": np.ones(words, np.uint64)}
    b = katz.Block(x, 3, 3)
    for k in (2, 3):
        grams = []
        for first, n in zip(np.cumsum(lens) - lens, lens, strict=True):
            text = [None] * (k - 1) + tokens[first : first + n].tolist()
            grams += [tuple(text[i : i + k]) for i in range(n)]
        number = {}
        assert all(number.setdefault(g, p) == p for g, p in zip(grams, b.place[k - 1].tolist(), strict=True))
        assert len(set(number.values())) == len(number) == len(b.keys[k - 1]) == len(set(b.keys[k - 1].tolist()))
        assert [grams[i] for i in b.example[k - 1]] == sorted(number, key=number.get)
        assert all(h == 0 or b.place[k - 2][i - 1] == h - 1 for h, i in zip(b.hist[k - 1], b.example[k - 1], strict=True))


def good_turing(counts, k=5):
    """Katz's factors by count: adjusted counts, scaled so that those above k stay."""
    n = collections.Counter(counts)
    out = {}
    for r in range(1, k + 1):
        factor = 0.0
        if n[1] and n[r]:
            common = (k + 1) * n[k + 1] / n[1]
            if common < 1:
                factor = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
        if not 0 < factor < 1:  # absolute discounting instead
            factor = 1 - (n[1] / (n[1] + 2 * n[2]) if n[2] else 0.5) / r if n[1] else 1.0
        out[r] = factor
    return out


class BruteKatz:
    def __init__(self, rows, order):
        self.order, self.docs = order, []
        self.c = [collections.Counter() for _ in range(order + 1)]  # n-grams of events by order
        self.h = [collections.Counter() for _ in range(order + 1)]  # histories followed by an event
        for i, t, *_ in rows:
            w = ["<s>"] * (order - 1) + [x.decode() for x in words_of(t)] + ["</s>"]
            held = zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
            self.docs.append((i, w, held))
            if not held:
                for at in range(order - 1, len(w)):
                    for k in range(1, order + 1):
                        self.c[k][tuple(w[at - k + 1 : at + 1])] += 1
                        self.h[k][tuple(w[at - k + 1 : at])] += 1
        self.d = [None] + [good_turing(self.c[k].values()) for k in range(1, order + 1)]
        self.n = sum(self.c[1].values())
        self.after = [collections.defaultdict(list) for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g in self.c[k]:
                self.after[k][g[:-1]].append(g[-1])
        self.cache = {}

    def weight(self, k, g):
        c = self.c[k][g]
        return self.d[k].get(c, 1.0) * c

    def rest(self, h):
        """What divides the counts after a history, what is left for others, and the back-off weight."""
        if h not in self.cache:
            k = len(h) + 1
            total, seen = self.h[k][h], sum(self.weight(k, (*h, w)) for w in self.after[k][h])
            whole = total if total - seen > 1e-9 * max(total, 1) else total + 1
            left = (whole - seen) / whole
            self.cache[h] = whole, left, left / (1 - sum(self.p(h[1:], w) for w in self.after[k][h])) if h else None
        return self.cache[h]

    def p(self, h, w):
        k = len(h) + 1
        if h and not self.h[k][h]:
            return self.p(h[1:], w)
        whole, left, alpha = self.rest(h)
        if self.c[k][(*h, w)] if (*h, w) in self.c[k] else 0:
            return self.weight(k, (*h, w)) / whole
        return alpha * self.p(h[1:], w) if h else left

    def scores(self):
        v = len(self.c[1])
        for i, w, held in self.docs:
            events = w[self.order - 1 :]
            base = sum(math.log10((self.c[1][(x,)] + 0.5) / (self.n + 0.5 * (v + 1))) for x in events)
            score = sum(math.log10(self.p(tuple(w[at - self.order + 1 : at]), w[at])) for at in range(self.order - 1, len(w)))
            yield i, held, len(events), sum((x,) in self.c[1] for x in events), self.n, round(base, 6), round(score, 6)


@pytest.mark.parametrize("tokens, order", [(katz.BLOCK_TOKENS, 3), (300, 3), (700, 2), (400, 4)])
def test_katz_scores(spark, monkeypatch, tokens, order):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", tokens)  # many blocks exchange counts
    rng = random.Random(8)
    rows = corpus(5) + odd_rows() + [(900 + i, prose(rng, 60, 25), "s") for i in range(40)]
    brute = BruteKatz(rows, order)
    found = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.score(docs(spark, rows), order).collect()]
    for a, b in zip(sorted(found, key=repr), sorted(brute.scores(), key=repr), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-4)
    # Every history's probabilities and the unknown word's add up to 1.
    words = [g[0] for g in brute.c[1]]
    for h in [*list(brute.after[order])[:8], *list(brute.after[2])[:8], ("never seen",)]:
        assert sum(brute.p(h, x) for x in words) + brute.p(h, "an unknown word") == pytest.approx(1)


def test_katz_factors():
    counts = [1] * 60 + [2] * 22 + [3] * 11 + [4] * 7 + [5] * 4 + [6] * 3 + [9, 40]
    n = collections.Counter(counts)
    assert katz.discounts([n[r] for r in range(1, katz.K + 2)])[1:6].tolist() == pytest.approx(list(good_turing(counts).values()))


def test_katz_edges(spark):
    assert katz.score(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = katz.score(docs(spark, [(held, "nothing to learn from")])).collect()
    assert [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in only] == [(True, 5, 0, 0, 0.0)]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_bears_odd_rows_and_names(spark, tmp_path, empty):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [] if empty else odd_rows() + [(None, prose(rng, 100, 900), None)] * 2 + [(50 + i, prose(rng, 100, 900)) for i in range(20)]
    docs_ = docs(spark, rows).selectExpr("*", "1 as `a.b`", "'x' as _text_hash")
    first = docs_
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == first.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs_ = spark.read.parquet(f"{tmp_path}/{k}")
    kept = {r["doc_id"] for r in docs_.collect()}
    assert kept == set() if empty else {50 + i for i in range(20)} <= kept and not kept & {1, 2, 3, 4}


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(i, prose(rng, 80 + i % 90, 3000), f"s{i % 3}") for i in range(120)]
    passage = prose(rng, 70, 3000)
    rows += [(200 + i, prose(rng, 70, 3000) + "\n" + passage + "\n" + prose(rng, 70, 3000), "s1") for i in range(4)]
    rows += [(300 + i, rows[i][1] + (" and more" if i % 2 else ""), "s2") for i in range(6)]
    rows += [(400 + i, "### ".join(prose(rng, 90).split()), "s0") for i in range(6)] + [(500, "too short", "s0"), (501, None, None)]
    path = str(tmp_path)
    full = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    full.write.parquet(f"{path}/documents.parquet")
    docs_, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs_.columns
        out.write.parquet(f"{path}/{k}")
        docs_ = spark.read.parquet(f"{path}/{k}")
        seen.append(docs_.collect())
    good, near, strip, mixed, ids = seen
    assert {r["doc_id"] for r in good} == {r[0] for r in rows if r[0] < 400}
    assert {r["doc_id"] for r in near} == {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in good])} == {r[0] for r in rows if r[0] < 300}
    want = {r[0]: r[4] for r in brute_passages([(r["doc_id"], r["text"]) for r in near])}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in strip} == want
    assert sum(passage in r["text"] for r in strip) == 1
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in strip} and len(ids) == len(mixed)
    run = corpus_pipeline.run(spark, path)
    assert records(run, "doc_id", "n_tokens", "ids_sha256") == sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in ids), key=repr)
