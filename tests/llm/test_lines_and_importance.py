"""Line dedup and importance resampling against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.llm import importance, line_dedup
from tarnfold.llm.common import SPACE
from tests.llm.helpers import docs, odd_rows, prose, records


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def brute_lines(rows, least=10, chars=1, keep_first=False):
    """(doc_id, n_lines, n_dropped, kept text) by reading everything again and again."""
    holders = collections.defaultdict(set)
    for i, r in enumerate(rows):
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(i)
    out, first = [], {}
    if keep_first:
        for i, r in sorted(enumerate(rows), key=lambda x: (x[1][0] or 0)):
            for n, line in enumerate((r[1] or "").split("\n")):
                first.setdefault(key(line), (i, n))
    for i, r in enumerate(rows):
        lines = (r[1] or "").split("\n")
        gone = [len(key(x)) >= chars and len(holders[key(x)]) >= least and first.get(key(x)) != (i, n) for n, x in enumerate(lines)]
        out.append((r[0], len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def lined(seed, n=120):
    """Texts of few lines, one line in nearly all of them, often twice."""
    rng = random.Random(seed)
    pool = [prose(rng, 4, 50).replace("\n", " ") for _ in range(60)]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) for _ in range(rng.randrange(0, 12))]
        lines += ["  The COMMON line\t", "the common line", ""] * (rng.random() < 0.9) + ["é" * 3, "日本"] * (rng.random() < 0.1)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.fixture
def many_partitions(spark):
    """A hash of many rows spans partitions that nothing puts together again."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("least,chars,keep_first", [(10, 1, False), (3, 1, True), (2, 0, False), (1, 3, False), (80, 1, True)])
def test_lines_by_brute_force(spark, many_partitions, least, chars, keep_first):
    rows = lined(least)
    found = line_dedup.drop_frequent_lines(docs(spark, rows), least, chars, keep_first)
    assert records(found, "doc_id", "n_lines", "n_dropped", "text") == brute_lines(rows, least, chars, keep_first)
    assert all(r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in found.collect())


def test_odd_texts_and_repeated_rows_lose_lines(spark):
    rows = odd_rows() + [(None, "a line\nheld")] * 9 + [(0, "a line\n other"), (20, "\n" * 5000 + "A LINE")]
    found = line_dedup.drop_frequent_lines(docs(spark, rows))
    assert records(found, "doc_id", "n_lines", "n_dropped", "text") == brute_lines(rows)
    assert brute_lines(rows) != brute_lines(rows, 10**6)


def test_no_documents_lose_no_lines(spark):
    assert line_dedup.drop_frequent_lines(docs(spark, []).limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=70), st.integers(0, 30))
def test_bitmaps_round_trip(keep, more):
    keep = np.array(keep)
    assert (line_dedup.unpack(line_dedup.pack(keep), len(keep) + more)[: len(keep)] == keep).all()
    assert line_dedup.unpack(line_dedup.pack(keep), len(keep) + more)[len(keep) :].all()


@settings(max_examples=60, deadline=None)
@given(st.text("a\n", max_size=60), st.integers(1, 9))
def test_chunks_are_all_lines(text, size):
    old, line_dedup.CHUNK = line_dedup.CHUNK, size
    try:
        chunks = list(line_dedup.line_chunks(text.encode()))
    finally:
        line_dedup.CHUNK = old
    assert [x.decode() for _, lines in chunks for x in lines] == text.split("\n")
    assert [n for n, _ in chunks] == np.cumsum([0, *[len(x) for _, x in chunks]])[:-1].tolist()


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(g.encode()) % 10_000 for g in grams]


def brute_resample(rows, target, percent, least):
    found = [(r[0], *features(r[1])) for r in rows]
    source, wanted = collections.Counter(b for _, _, f in found for b in f), collections.Counter(b for t in target for b in features(t)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000.0) / ((source[b] + 1) * (t + 10_000.0)))) for b in range(10_000)]
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    entitled = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(entitled[: percent * len(entitled) // 100]):
        r[5] = k + 1
    return sorted((tuple(r) for r in out), key=repr)


@pytest.mark.parametrize("percent,least", [(5, 20), (60, 1), (100, 0)])
def test_resampling_by_brute_force(spark, percent, least):
    rng = random.Random(percent)
    rows = odd_rows() + [(100 + i, prose(rng, rng.randrange(0, 90), 200)) for i in range(60)] + [(None, "Same TEXT, twice; and-a few_words more\x00!")] * 40
    target = [prose(rng, 40, 60), None, "", "w1a w2e w3i"]
    found = importance.resample(docs(spark, rows), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), percent, least)
    assert records(found, "doc_id", "n_words", "n_features", "weight", "score", "rank") == brute_resample(rows, target, percent, least)


def test_resampling_of_nothing(spark):
    none = docs(spark, []).limit(0)
    some = docs(spark, [(1, "a b c " * 20), (2, None)])
    assert importance.resample(none, some).collect() == []
    assert records(importance.resample(some, none.select("text"), 100), "doc_id", "rank") == [(1, 1), (2, None)]
