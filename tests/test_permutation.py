"""Permutations are one to one, and alike as columns, arrays and SQL."""

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from tarnfold.plans import permutation, schedulers


@pytest.mark.parametrize("b", [0, 1, 2, 3, 7, 16, 33, 97, 500])
def test_columns_arrays_and_sql_agree(spark, b):
    want = permutation.permuted_numbers(b, 5, 42).tolist()
    assert sorted(want) == list(range(b))
    found = spark.range(b).select("id", permutation.permuted(F.col("id"), b, F.lit(5).cast("long"), 42).alias("place"))
    assert [r["place"] for r in found.orderBy("id").collect()] == want
    sql = f"WITH z AS (SELECT {b} AS b), sd AS ({permutation.sides_sql('z')}) SELECT {permutation.permuted_sql('y', '5', 42)} FROM (SELECT range AS y FROM range({b})), sd ORDER BY y"
    assert [r[0] for r in duckdb.sql(sql).fetchall()] == want


def test_every_size_is_permuted():
    for b in [*range(1, 400), 4095, 4096, 65_537, 1_000_003]:
        assert (np.sort(permutation.permuted_numbers(b, 1, 7)) == np.arange(b)).all()
        a, c, e = permutation.sides(b)
        assert a * c - b == e and a <= permutation.MOST_ROWS
    assert max(permutation.sides(b)[2] for b in [10**12 + k for k in range(50)]) < 64


def test_keys_give_other_orders():
    a, b, c = (permutation.permuted_numbers(1000, *k) for k in ((1, 42), (2, 42), (1, 43)))
    assert (a != b).mean() > 0.9 and (a != c).mean() > 0.9
    assert abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.15


def test_a_shuffle_needs_no_window_and_no_sort(spark):
    plan = schedulers.shuffled_blocks(spark.range(1000).select(F.col("id").alias("state")), 1000, 3, 2)._jdf.queryExecution().toString()
    assert "Window" not in plan and "Sort" not in plan and "Exchange" not in plan
