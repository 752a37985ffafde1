"""The jobs: growing input, reruns, replays, settings, and their SQL."""

import json
import re
from collections import Counter

import numpy as np
import pytest

import jobs
from jobs import common, customer_values, word_ranks
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", sorted(jobs.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    assert differences(spark, connect(sf_dir), jobs.QUERIES[name], jobs.ORACLE_SQL[name], sf_dir) == ""


def brute_ranks(rows, damping):
    """(lang, word) to rank, by a dense linear solve a language."""
    pairs = {}
    for _, text, lang in rows:
        for line in (text or "").split("\n"):
            w = [x for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line.lower()) if x]
            for a, b in zip(w, w[1:]):
                pairs.setdefault("und" if lang is None else lang, Counter()).update([(a, b), (b, a)])
    out = {}
    for lang, c in pairs.items():
        words = sorted({a for a, _ in c})
        at = {w: i for i, w in enumerate(words)}
        m = np.zeros((len(words), len(words)))
        for (a, b), k in c.items():
            m[at[a], at[b]] += k
        x = np.linalg.solve(np.eye(len(words)) - damping * m / m.sum(0), np.full(len(words), 1 - damping))
        out |= {(lang, w): x[i] for w, i in at.items()}
    return out


def ranks_of(df):
    return {(r["lang"], r["word"]): r["rank"] for r in df.collect()}


def close(a, b, tolerance=1e-7):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) <= tolerance for k in a)


DOCS = [
    (1, "The cat sat on the mat.\nA cat, a mat, a cat!", "en"),
    (2, None, "en"),
    (None, "", None),
    (3, "one\ntwo\n\nthree", "en"),
    (4, "der Hund und die Katze und der Hund", "de"),
    (5, "no language: words words words", None),
]
MORE = [(6, "the dog sat on the log. The dog and the cat", "en"), (7, "die Maus und der Käse", "de"), (7, "die Maus und der Käse", "de"), (8, "le chat et le chien", "fr")]
SCHEMA = "doc_id long, text string, lang string"


def test_ranks_grow_with_the_input(spark, tmp_path):
    source, out = f"{tmp_path}/documents", f"{tmp_path}/out"
    s = word_ranks.Settings(source, out)
    spark.createDataFrame(DOCS, SCHEMA).repartition(1).write.parquet(source)
    assert close(ranks_of(word_ranks.run(spark, s)), brute_ranks(DOCS, s.damping))
    spark.createDataFrame(MORE, SCHEMA).repartition(1).write.mode("append").parquet(source)
    second = ranks_of(word_ranks.run(spark, s))
    assert close(second, brute_ranks(DOCS + MORE, s.damping))
    batches = spark.read.parquet(f"{out}/counts")
    assert [r[0] for r in batches.select("batch").distinct().orderBy("batch").collect()] == [0, 1]
    assert batches.where("batch = 1 and lang = 'en'").agg({"c": "sum"}).head()[0] == 10  # the new file alone

    third = ranks_of(word_ranks.run(spark, s))  # nothing new
    assert third == second and spark.read.parquet(f"{out}/runs").count() == 2
    fresh = word_ranks.Settings(source, f"{tmp_path}/fresh", max_files=1)
    assert close(ranks_of(word_ranks.run(spark, fresh)), second)  # one file a batch, all at once


def test_ranks_need_few_rounds(spark, tmp_path):
    """A walk's eigenvalues are real, so a round leaves a third of the error, not 0.6 of it."""
    docs = [(i, f"the w{i} of a v{i % 7} u{i % 5} the\nw{i} s{i}", "en") for i in range(40)]
    spark.createDataFrame(docs, SCHEMA).repartition(1).write.parquet(f"{tmp_path}/documents")
    s = word_ranks.Settings(f"{tmp_path}/documents", f"{tmp_path}/out")
    assert close(ranks_of(word_ranks.run(spark, s)), brute_ranks(docs, s.damping), 1e-9)
    did = spark.read.parquet(f"{tmp_path}/out/runs").head()
    assert did["converged"] and did["sweeps"] <= 35


def test_words_of_one_number_get_another_seed(spark, tmp_path, monkeypatch):
    """A solve must not take two words for one when their numbers meet."""
    from pyspark.sql import functions as F

    own, seeds = word_ranks.number, []

    def number(word, seed):
        seeds.append(seed)
        return own(word, seed) if seed else F.pmod(own(word, seed), F.lit(5))

    monkeypatch.setattr(word_ranks, "number", number)
    source = f"{tmp_path}/documents"
    spark.createDataFrame(DOCS + MORE, SCHEMA).repartition(2).write.parquet(source)
    s = word_ranks.Settings(source, f"{tmp_path}/out", max_files=1)  # an entry's counts of two batches add up
    assert close(ranks_of(word_ranks.run(spark, s)), brute_ranks(DOCS + MORE, s.damping), 1e-9) and set(seeds) == {0, 1}


def test_a_batch_taken_again_replaces_itself(spark, tmp_path):
    counts = word_ranks.neighbours(spark.createDataFrame(DOCS, SCHEMA))
    from pyspark.sql import functions as F

    for batch in (0, 1, 1, 0):
        common.replace_partitions(counts.withColumn("batch", F.lit(batch)), f"{tmp_path}/counts", "batch", "lang")
    assert spark.read.parquet(f"{tmp_path}/counts").count() == 2 * counts.count()


def test_ranks_lost_before_their_mark_are_made_again(spark, tmp_path):
    source, out = f"{tmp_path}/documents", f"{tmp_path}/out"
    s = word_ranks.Settings(source, out)
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(source)
    first = ranks_of(word_ranks.run(spark, s))
    counts = spark.read.parquet(f"{out}/counts")
    word_ranks.solve_ranks(spark, s, counts, 0)  # a solve that was cut off after the ranks, and runs again
    assert close(ranks_of(spark.read.parquet(f"{out}/ranks")), first, 1e-9)


def test_no_documents_have_no_ranks(spark, tmp_path):
    spark.createDataFrame([(1, None, "en"), (2, "alone", "en")], SCHEMA).write.parquet(f"{tmp_path}/documents")
    assert word_ranks.run(spark, word_ranks.Settings(f"{tmp_path}/documents", f"{tmp_path}/out")).collect() == []


def test_customer_values_solve_their_equations(spark, sf_dir, tmp_path):
    s = customer_values.Settings(sf_dir, f"{tmp_path}/out", beta=0.8)
    rows = [r.asDict() for r in customer_values.run(spark, s).collect()]
    again = [r.asDict() for r in customer_values.run(spark, s).collect()]
    key = lambda r: (r["nation"], r["segment"], r["priority"])
    assert sorted(rows, key=key) == sorted(again, key=key)
    con = connect(sf_dir)
    orders = con.execute("SELECT o_custkey, n_name, c_mktsegment, o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey ORDER BY o_custkey, o_orderdate, o_orderkey").fetchall()
    at = {k: i for i, k in enumerate(sorted({o[1:4] for o in orders}))}
    p, price = np.zeros((len(at), len(at))), [[] for _ in at]
    for a, b in zip(orders, [*orders[1:], (None,)]):
        price[at[a[1:4]]].append(a[4])
        if a[0] == b[0]:
            p[at[a[1:4]], at[b[1:4]]] += 1
    for i in range(len(at)):
        p[i] = p[i] / p[i].sum() if p[i].sum() else np.eye(len(at))[i]
    v = np.linalg.solve(np.eye(len(at)) - 0.8 * p, [np.mean(x) for x in price])
    assert {key(r) for r in rows} == set(at) and all(abs(r["value"] - v[at[key(r)]]) < 1e-3 for r in rows)
    for nation in {r["nation"] for r in rows}:
        mine = sorted((r for r in rows if r["nation"] == nation), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1)) and all(a["value"] >= b["value"] - 0.01 for a, b in zip(mine, mine[1:]))


def test_settings_come_from_the_file_and_the_command_line(tmp_path):
    own = common.settings(word_ranks.Settings, "", [])
    assert own.damping == 0.6 and own.documents == "documents"
    assert common.settings(word_ranks.Settings, "", ["--documents", "d", "--eps", "0.5", "--max-files", "3"]) == word_ranks.Settings("d", "word-ranks", eps=0.5, max_files=3)
    (tmp_path / "c.json").write_text(json.dumps({"tables": "t", "out": "o", "nothing": 1}))
    with pytest.raises(ValueError, match="nothing"):
        common.settings(customer_values.Settings, "", ["--config", f"{tmp_path}/c.json"])
