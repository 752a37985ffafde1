"""Pseudo-random permutations of 0 to b - 1 as a column expression: each number
finds its place by itself, without a sort.

A number is a cell of a grid of a by c cells, a little larger than b. Rounds
that shift the row by a hash of the column, and the column by a hash of the
row, permute the cells whatever the hash. Where the place lies beyond b, the
walk goes on from there: as only e = a c - b cells do, e more steps suffice.
The sides are chosen so that e is small.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import draw, draw_numbers, draw_sql

ROUNDS = 4
#: The most rows of the grid.
MOST_ROWS = 4096


def sides(b: int) -> tuple[int, int, int]:
    """(a, c, e) for a size."""
    s = min(math.isqrt(max(b - 1, 0)) + 1, MOST_ROWS)
    a = min(range(-(-s // 2), s + 1), key=lambda a: (-b % a, -a))
    return a, -(-b // a), -b % a


def permuted(y: Column, b: int, key: Column, seed: int) -> Column:
    """The place of ``y`` (0 to b - 1) under the permutation of a key."""
    a, c, e = sides(b)
    if b < 2:
        return y

    def once(y: Column) -> Column:
        row, column = F.floor(y / c), F.pmod(y, F.lit(c))
        for i in range(ROUNDS):
            if i % 2 == 0:
                row = F.pmod(row + draw(column, key * ROUNDS + i, seed), F.lit(a))
            else:
                column = F.pmod(column + draw(row, key * ROUNDS + i, seed), F.lit(c))
        return row * c + column

    if not e:
        return once(y)
    return F.aggregate(F.sequence(F.lit(1), F.lit(e)), once(y), lambda at, _: F.when(at < b, at).otherwise(once(at)))


def permuted_numbers(b: int, key: int, seed: int) -> np.ndarray:
    """The places of 0 to b - 1."""
    a, c, e = sides(b)
    y = np.arange(b, dtype=np.int64)
    if b < 2:
        return y
    out = np.ones(b, bool)
    for _ in range(e + 1):
        row, column = y // c, y % c
        for i in range(ROUNDS):
            if i % 2 == 0:
                row = (row + draw_numbers(column, key * ROUNDS + i, seed)) % a
            else:
                column = (column + draw_numbers(row, key * ROUNDS + i, seed)) % c
        y = np.where(out, row * c + column, y)
        out = y >= b
    return y


def sides_sql(sizes: str) -> str:
    """(b, a, c, e) for each b of a table ``sizes``."""
    s = f"least(CAST(floor(sqrt(greatest(b - 1, 0))) AS BIGINT) + 1, {MOST_ROWS})"
    return f"SELECT b, first(a ORDER BY (a - b % a) % a, a DESC) AS a, first((b + (a - b % a) % a) // a ORDER BY (a - b % a) % a, a DESC) AS c, min((a - b % a) % a) AS e FROM (SELECT b, unnest(range(({s} + 1) // 2, {s} + 1)) AS a FROM {sizes}) GROUP BY b"


def permuted_sql(y: str, key: str, seed: int) -> str:
    """The same in SQL, with the columns b, a, c and e of ``sides_sql``."""

    def once(y: str) -> str:
        row, column = f"({y} // c)", f"({y} % c)"
        for i in range(ROUNDS):
            if i % 2 == 0:
                row = f"(({row} + {draw_sql(column, f'({key}) * {ROUNDS} + {i}', seed)}) % a)"
            else:
                column = f"(({column} + {draw_sql(row, f'({key}) * {ROUNDS} + {i}', seed)}) % c)"
        return f"({row} * c + {column})"

    return f"CASE WHEN b < 2 THEN {y} ELSE list_reduce(list_prepend({once(y)}, range(e)), lambda place, step: CASE WHEN place < b THEN place ELSE {once('place')} END) END"
