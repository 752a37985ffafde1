"""Scalar functions as Spark expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = 2_147_483_647


def draw(i: Column, k: Column | int, seed: int) -> Column:
    """A pseudo-random integer below 2^31 - 1 from two numbers and a seed:
    two multiplicative steps in exact long arithmetic, so that any SQL engine
    can repeat it."""
    k = F.lit(k) if isinstance(k, int) else k
    x = F.pmod(i * 1_000_003 + k * 7_919 + seed * 104_729 + 1, F.lit(_M))
    return F.pmod(F.pmod(x * 48_271, F.lit(_M)) * 16_807 + 12_345, F.lit(_M))


def draw_sql(i: str, k: str, seed: int) -> str:
    """The same in SQL."""
    x = f"((({i}) * 1000003 + ({k}) * 7919 + {seed * 104_729 + 1}) % {_M})"
    return f"((({x} * 48271) % {_M}) * 16807 + 12345) % {_M}"


def draw_numbers(i: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The same on an array of numbers."""
    x = (i.astype(np.int64) * 1_000_003 + k * 7_919 + seed * 104_729 + 1) % _M
    return (x * 48_271 % _M * 16_807 + 12_345) % _M


def residual_bucket(residual: Column, base: float, buckets: int) -> Column:
    """Logarithmic bucket of a residual: 0 up to ``base`` and for NaN, then one
    for each doubling, the last for all above. The ratio is rounded so that
    powers of two fall alike everywhere."""
    b = max(1, buckets)
    ratio = F.round(residual / base, 9)
    return F.when((residual <= base) | F.isnan(residual), 0).otherwise(F.least(F.greatest(F.floor(F.log2(ratio)), F.lit(0)), F.lit(b - 1))).cast("int")


def short_number(n: Column) -> Column:
    """1000 as 1K, 1500000 as 1.5M."""

    def short(x: Column, unit: str) -> Column:
        return F.concat(F.regexp_replace(F.format_string("%.1f", x), r"\.0$", ""), F.lit(unit))

    x = n.cast("double")
    return F.when(x >= 1e6, short(x / 1e6, "M")).when(x >= 1e3, short(x / 1e3, "K")).otherwise(n.cast("long").cast("string"))
