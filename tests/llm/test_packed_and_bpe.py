"""Packed token files and the transducer against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnfold.llm import lexicon_bpe, packed_tokens
from tests.llm.helpers import docs, odd_rows, prose, records

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(st.one_of(st.sampled_from(list("ab .,!'\n\t\"-%5")), st.characters(min_codepoint=32, max_codepoint=0x24F), st.sampled_from(list("Σİ日é́ſ\xa0\u2003"))), max_size=80)


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


BYTES, WORDS = (library(BYTE), packed_tokens.PieceEncoder(BYTE)), (library(WORD), lexicon_bpe.Codec(WORD))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_pieces_encode_as_the_whole(texts):
    tok, enc = BYTES
    assert [x.tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_words_encode_as_the_library(texts):
    tok, codec = WORDS
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        want = tok.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert codec.decode(ids) == tok.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**17 - 1), max_size=50), st.sampled_from([17, 18, 20, 24, 31, 32]), st.integers(0, 49))
def test_packing_and_random_access(ids, width, at):
    a = np.array(ids, np.uint32)
    data = packed_tokens.pack(a, width)
    assert len(data) == -(-len(ids) * width // 8)
    assert packed_tokens.unpack(data, width, len(ids)).tolist() == ids
    if at < len(ids):
        assert packed_tokens.unpack(data, width, 1, at).tolist() == [ids[at]]
        block = packed_tokens.make_block([5, None], [a[:at], a[at:]], width)
        assert packed_tokens.read_at(block, at) == ids[at]
        names, offsets, _, _ = packed_tokens.open_block(block)
        assert names == [5, None] and offsets.tolist() == [0, at, len(ids)]


def test_width():
    assert [packed_tokens.bits_for(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]
    with pytest.raises(ValueError):
        packed_tokens.pack(np.array([70000], np.uint32), 16)


def test_files_round_trip(spark, tmp_path):
    rows = [r for r in odd_rows()]
    packed_tokens.write(docs(spark, rows), str(tmp_path), BYTE, 2, 50257, block_ids=700)
    assert spark.read.parquet(f"{tmp_path}/blocks").count() > 3
    tok, start, want, lists = library(BYTE), 0, [], []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        lists.append((r[0], start, ids.tolist()))
        start += len(ids)
    assert records(packed_tokens.digests(spark, str(tmp_path)), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert records(packed_tokens.read(spark, str(tmp_path)), "doc_id", "start", "ids") == sorted(lists, key=repr)


def test_any_range_of_ids_is_read(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(60)]
    packed_tokens.write(docs(spark, rows), str(tmp_path), BYTE, 2, 50257, block_ids=300)
    tok = library(BYTE)
    flat = [x for _, t in rows for x in [*tok.encode(t, add_special_tokens=False).ids, 2]]
    assert spark.read.parquet(f"{tmp_path}/index").count() > 10
    n = len(flat)
    for a, b in ((0, n), (0, 1), (n - 1, n + 50), (n // 3, n // 2), (299, 1201), (5, 5), (9, 3), (n, n + 9), (-4, 3)):
        found = packed_tokens.read_range(spark, str(tmp_path), a, b).orderBy("start").collect()
        assert [x for r in found for x in r["ids"]] == flat[max(a, 0) : max(b, 0)], (a, b)
        assert not found or found[0]["start"] == max(a, 0)
    plan = packed_tokens.read_range(spark, str(tmp_path), 10, 20)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(part" in plan and "LessThanOrEqual(part" in plan


def test_empty_tables(spark, tmp_path):
    packed_tokens.write(docs(spark, []), str(tmp_path), BYTE, 2, 50257)
    assert packed_tokens.read_range(spark, str(tmp_path), 0, 9).count() == 0
    assert packed_tokens.digests(spark, str(tmp_path)).count() == 0
    assert lexicon_bpe.round_trip(docs(spark, []), WORD, ["doc_id"]).count() == 0


def test_round_trip_of_odd_texts(spark):
    rows, tok = odd_rows(), library(WORD)
    want = []
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    found = lexicon_bpe.round_trip(docs(spark, rows), WORD, ["doc_id"])
    assert records(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_frequent_words_by_a_histogram_of_counts(spark):
    """All words above a count, never more than asked for, ties together."""
    rows = docs(spark, [(1, "aaa " * 64 + "bbb " * 32 + "ccc " * 8 + "ddd " * 8 + "once"), (2, "aaa " * 64 + "ccc " * 2)])
    found = {n: lexicon_bpe.frequent_words(rows, WORD, n) for n in (0, 1, 2, 3, 4, 9)}
    assert found == {0: [], 1: ["aaa"], 2: ["aaa", "bbb"], 3: ["aaa", "bbb"], 4: ["aaa", "bbb", "ccc", "ddd"], 9: ["aaa", "bbb", "ccc", "ddd"]}
    assert lexicon_bpe.frequent_words(docs(spark, [(1, None), (2, "")]), WORD, 5) == []


def test_lexicon_is_minimal_and_finds_its_words(tmp_path):
    merger, rng = lexicon_bpe.Merger(WORD), random.Random(1)
    words = sorted({w.encode() for w in prose(rng, 3000).replace(".", " ").split()} | {b"testing", b"resting", b"test", b"rest", "日本".encode()})
    lexicon_bpe.Lexicon.build(words, merger).save(str(tmp_path / "x"))
    lexicon = lexicon_bpe.Lexicon.load(str(tmp_path / "x"))
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert set(lexicon.find([b"tes", b"testings", b"", b"zzz", b"\xff"]).tolist()) == {-1}
    edges, final = lexicon_bpe.minimal_automaton(sorted([b"testing", b"resting"]))
    reach = {0} | {t for e in edges for t in e.values()}
    assert len([s for s in reach]) <= 9  # start, two first letters meeting in one tail
    plain, with_lexicon = lexicon_bpe.Codec(WORD), lexicon_bpe.Codec(WORD, lexicon)
    text = prose(rng, 500) + " resting 日本 unheardof"
    assert plain.encode([text])[0].tolist() == with_lexicon.encode([text])[0].tolist()
    empty = lexicon_bpe.Lexicon.build([], merger)
    assert empty.find([b"a"]).tolist() == [-1]


def test_long_words_merge_exactly():
    codec, tok, rng = lexicon_bpe.Codec(WORD), library(WORD), random.Random(5)
    for text in ("a" * 3000, "".join(rng.choice("abcdeth") for _ in range(4000)), "!" * 999):
        assert codec.encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids
