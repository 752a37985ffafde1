"""Frontier rounds over packed blocks, for many rounds over very many entries.

States are dealt to blocks by their number. A block's values are one row of
arrays, and its entries one row of arrays for each block that they lead to, so
that a task of a round multiplies arrays and passes on one sum for each state
that its block leads to. Only those sums are shuffled. Entries are dealt and
sorted once; tables lie in as many buckets as there are blocks, one block in
each. A task holds the entries of one block.

Values, frontiers and moves are those of ``frontier``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .bellman import Affine
from .frontier import ROUNDING, Frontier
from .rounds import told

#: Entries of a block, up to 24 bytes each while they are packed: at most, and
#: what a block is worth having for.
MOST, LEAST = 4_000_000, 250_000
#: Rows that a task gathers before it deals them to blocks.
GATHERED = 1_000_000
#: Arrays of a tile.
PARTS = ("rows", "starts", "cols", "a")
INDEX = "block long, states binary, b binary, scale binary, v binary"
STATES = "block long, b binary, scale binary, v binary, d binary, p binary, largest double, n long, front long"


def blocks_for(spark: SparkSession, entries: int) -> int:
    """Two for each core where that leaves enough to do; more where a task could not hold them."""
    cores = spark.sparkContext.defaultParallelism
    n = max(1, -(-entries // MOST), min(2 * cores, entries // LEAST))
    return n if n <= cores else -(-n // cores) * cores


def labels(spark: SparkSession, blocks: int) -> np.ndarray:
    """Numbers to call the blocks by, of which each falls in a bucket of its own."""
    bucket = F.pmod(F.hash("id"), F.lit(blocks))
    return np.array([r["id"] for r in spark.range(40 * blocks).groupBy(bucket).agg(F.min("id").alias("id")).orderBy("id").collect()])


def _array(cell: pa.Scalar, kind: str = "f8") -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _whole(t: pa.Table, name: str, kind: str = "f8") -> np.ndarray:
    """The arrays of a column's rows, one after the other."""
    parts = [_array(x, kind) for x in t.column(name)]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _short(x: np.ndarray) -> np.ndarray:
    """The same numbers in fewer bytes, where those hold them exactly."""
    for kind in ("u2", "i4") if x.dtype.kind == "i" else ("u2", "f4"):
        if kind != "u2" or not len(x) or x.min() >= 0 and x.max() < 65536:
            short = x.astype(kind)
            if (short == x).all():
                return short
    return x


def _dealt(columns: dict[str, np.ndarray], by: np.ndarray, names: np.ndarray) -> dict[str, list]:
    """A row of arrays for each block that has any; ``by``: whose block a row is of."""
    block = np.mod(by, len(names)).astype("u2" if len(names) < 65536 else "i8")
    order = np.argsort(block, kind="stable")
    ends = np.cumsum(np.bincount(block, minlength=len(names)))
    columns = {k: x[order] for k, x in columns.items()}
    some = [(i, a, z) for i, (a, z) in enumerate(zip(np.r_[0, ends], ends)) if z > a]
    return {"block": [int(names[i]) for i, _, _ in some]} | {k: [x[a:z].tobytes() for _, a, z in some] for k, x in columns.items()}


def dealt(rows: DataFrame, by: str, names: np.ndarray, mirrored: bool = False) -> DataFrame:
    """Rows of numbers as rows of arrays of one block each, several a block.
    ``mirrored``: each row also with its first two columns exchanged."""
    columns = [(f.name, "i8" if f.dataType.typeName() == "long" else "f8") for f in rows.schema]
    schema = pa.schema([("block", pa.int64()), *((k, pa.binary()) for k, _ in columns)])
    gathered = GATHERED

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            found = {k: t.column(k).to_numpy().astype(kind, copy=False) for k, kind in columns}
            if mirrored:
                (a, b), rest = list(found)[:2], list(found)[2:]
                found = {a: np.r_[found[a], found[b]], b: np.r_[found[b], found[a]]} | {k: np.r_[found[k], found[k]] for k in rest}
            return pa.RecordBatch.from_pydict(_dealt(found, found[by], names), schema)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= gathered:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return rows.mapInArrow(deal, ", ".join(["block long", *(f"{k} binary" for k, _ in columns)]))


def _indexed(key: tuple, parts: pa.Table) -> pa.Table:
    """A block's states in ascending order."""
    state = _whole(parts, "state", "i8")
    order = np.argsort(state, kind="stable")
    state = state[order]
    if (state[1:] == state[:-1]).any():
        raise ValueError("a state is there twice")
    rest = {k: [_whole(parts, k)[order].tobytes()] for k in ("b", "scale", "v")}
    return pa.Table.from_pydict({"block": [key[0].as_py()], "states": [state.tobytes()]} | rest)


def _places(index: pa.Table, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where states lie in a block, and whether they are there at all."""
    own = _whole(index, "states", "i8")
    if not len(own):
        return np.zeros(len(states), "i8"), np.zeros(len(states), bool)
    at = np.minimum(np.searchsorted(own, states), len(own) - 1)
    return at, own[at] == states


def _tiles(key: tuple, parts: pa.Table, index: pa.Table) -> pa.Table:
    """A block's entries for each block that they lead to: sorted by row, then
    column, where the same entry's amounts are added. ``starts`` has where the
    entries of each of ``rows`` begin; ``kinds`` are the types of the arrays."""
    out = {k: [] for k in ("block", "to", "kinds", *PARTS)}
    to = parts.column("to").to_numpy()
    for t in np.unique(to):
        mine = parts.filter(pa.array(to == t))
        at, there = _places(index, _whole(mine, "col", "i8"))
        if not there.any():
            continue
        place = (_whole(mine, "row", "i4").astype("i8") << 32 | at)[there]
        order = np.argsort(place)
        place = place[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        a, place = np.add.reduceat(_whole(mine, "a")[there][order], first), place[first]
        row = place >> 32
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        tile = [_short(x) for x in (row[starts], starts, place & 0xFFFFFFFF, a)]
        for k, x in zip(out, (key[0].as_py(), int(t), " ".join(x.dtype.str for x in tile), *(x.tobytes() for x in tile)), strict=True):
            out[k].append(x)
    return pa.table(out, schema=pa.schema([("block", pa.int64()), ("to", pa.int64()), ("kinds", pa.string()), *((k, pa.binary()) for k in PARTS)]))


class Packed(Frontier):
    """The same rounds for an ``Affine`` operator of any number of entries."""

    def __init__(self, op: Affine, x: DataFrame, eps: float, alpha: float):
        super(Frontier, self).__init__(op, x, alpha)
        self.eps, self.pushed, self.settled = max(eps, 0.0), [], None
        self.spectrum = op.spectrum if alpha == 1 else 0.0
        spark = x.sparkSession
        self.names = labels(spark, blocks_for(spark, op.a.count() * (1 + op.mirrored)))
        self._pack(x)
        zeros = self.index.select("block", "b", "scale", "v", F.col("v").alias("d"), F.col("v").alias("p"))
        self._exact(zeros)

    def _bucketed(self, df: DataFrame, fixed: bool = False) -> DataFrame:
        return self.trail.bucketed(df, "block", len(self.names), fixed)

    def _pack(self, x: DataFrame) -> None:
        op, names = self.op, self.names
        scale = F.col("scale").cast("double") if "scale" in op.b.columns else F.lit(1.0)
        states = op.b.join(x, "state").select(F.col("state").cast("long").alias("state"), F.col("b").cast("double").alias("b"), scale.alias("scale"), F.col("v").cast("double").alias("v"))
        self.index = self._bucketed(dealt(states, "state", names).groupBy("block").applyInArrow(_indexed, INDEX), True)
        own = self.index.select("block", "states").groupBy("block")

        def with_rows(key: tuple, parts: pa.Table, index: pa.Table) -> pa.Table:
            at, there = _places(index, _whole(parts, "row", "i8"))
            col = _whole(parts, "col", "i8")[there]
            found = _dealt({"row": at[there].astype("i4"), "col": col, "a": _whole(parts, "a")[there]}, col, names)
            found["to"] = [key[0].as_py()] * len(found["block"])
            return pa.table(found, schema=pa.schema([("block", pa.int64()), ("row", pa.binary()), ("col", pa.binary()), ("a", pa.binary()), ("to", pa.int64())]))

        entries = op.a.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("a").cast("double").alias("a"))
        placed = dealt(entries, "row", names, op.mirrored).groupBy("block").cogroup(own).applyInArrow(with_rows, "block long, row binary, col binary, a binary, to long")
        tiles = placed.groupBy("block").cogroup(own).applyInArrow(_tiles, ", ".join(["block long, to long, kinds string", *(f"{k} binary" for k in PARTS)]))
        self.tiles = self._bucketed(tiles, True)

    def _write(self, rows: DataFrame, least: Column | None = None) -> None:
        seen = Observation()
        rows = rows.observe(seen, F.max("largest").alias("all"), F.max("largest").alias("some"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("front"), F.lit(0)).alias("front"))
        self.rows = self._bucketed(rows)
        self.found, self.front = told(seen), seen.get["front"]

    def _exact(self, x: DataFrame, least: Column | None = None) -> None:
        """``x`` has rows of blocks. After rounds, residuals up to rounding count for nothing."""
        self.weight = 1.0
        self._write(self._round(x, True, 0.0 if least is None else ROUNDING))
        self.known = True

    def round_plan(self) -> DataFrame:
        return self._round(self.rows, False, 0.0)

    def _round(self, states: DataFrame, exact: bool, rounding: float) -> DataFrame:
        """``STATES`` after the frontier's push, or, if ``exact``, with the
        residuals of a backup of all states."""
        eps, weight, alpha, spectrum = self.eps, self.weight, self.alpha, self.spectrum

        def frontier(d: np.ndarray, p: np.ndarray) -> np.ndarray:
            moves = np.abs(d) > eps
            return moves | (np.abs(p) > eps) if spectrum else moves

        def move(state: dict) -> np.ndarray:
            d, p = _array(state["d"]), _array(state["p"])
            step = weight * d + (weight - 1) * p if spectrum else alpha * d
            return np.where(frontier(d, p), step, 0.0)

        def row(t: pa.Table) -> dict:
            return {k: t.column(k)[0] for k in t.column_names}

        def send(key: tuple, tiles: pa.Table, own: pa.Table) -> pa.Table:
            to, places, sums = [], [], []
            if own.num_rows:
                state = row(own)
                delta = (_array(state["v"]) if exact else move(state)) * _array(state["scale"])
                for i in range(tiles.num_rows if delta.any() else 0):
                    kinds = tiles.column("kinds")[i].as_py().split()
                    rows, starts, cols, a = (_array(tiles.column(k)[i], kind) for k, kind in zip(PARTS, kinds, strict=True))
                    s = np.add.reduceat(a * delta[cols], starts)
                    some = s != 0
                    if some.any():
                        to.append(tiles.column("to")[i].as_py())
                        places.append(rows[some].tobytes())
                        sums.append(s[some].tobytes())
            return pa.table({"block": pa.array(to, pa.int64()), "at": pa.array(places, pa.binary()), "add": pa.array(sums, pa.binary())})

        def take(key: tuple, own: pa.Table, sent: pa.Table) -> pa.Table:
            state = row(own)
            b, v = _array(state["b"]), _array(state["v"])
            if exact:
                p, now, d = np.zeros(len(v)), v, b - v
            else:
                p = move(state)
                now, d = v + p, _array(state["d"]) - p
            add = np.zeros(len(v))
            for at, x in zip(sent.column("at"), sent.column("add"), strict=True):
                wide = len(at.as_buffer()) > len(x.as_buffer()) // 4
                add[_array(at, "i4" if wide else "u2")] += _array(x)
            d = d + add
            left = np.abs(d)
            counted = np.where(left > rounding * np.abs(now), left, 0.0) if rounding else left
            found = {"b": state["b"].as_py(), "scale": state["scale"].as_py(), "v": now.tobytes(), "d": d.tobytes(), "p": p.tobytes()}
            found |= {"largest": float(counted.max()), "n": len(v), "front": int(frontier(d, p).sum())}
            return pa.Table.from_pydict({"block": [key[0].as_py()]} | {k: [x] for k, x in found.items()})

        states = states.select("block", "b", "scale", "v", "d", "p")
        messages = self.tiles.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(send, "block long, at binary, add binary")
        return states.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(take, STATES)

    def sure(self) -> None:
        self._exact(self.rows, F.lit(ROUNDING))

    def values(self) -> DataFrame:
        def unpack(key: tuple, index: pa.Table, own: pa.Table) -> pa.Table:
            return pa.table({"state": _whole(index, "states", "i8"), "v": _whole(own, "v")})

        found = self.index.select("block", "states").groupBy("block").cogroup(self.rows.select("block", "v").groupBy("block"))
        return self.trail.cut(found.applyInArrow(unpack, "state long, v double"))
