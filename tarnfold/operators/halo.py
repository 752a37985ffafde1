"""Block iterations over tables that exchange only what blocks read of each other.

Transitions are laid out once: a block of consecutive states is one row of
arrays, in a table that is bucketed by the block's owner, and so are its
values. In a round each block sweeps a few times by itself, against values of
the other blocks that are one round old (bounded staleness), and sends each
reader the values that it reads: its halo. Blocks and values lie in the same
buckets and are not shuffled; the messages are all that moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..model import Mdp
from ..plans.schedulers import owner
from .bellman import FixedPointOperator
from .rounds import Look, Rounds, told

#: Entries of one block: about 20 bytes each, held in a task while it sweeps.
MOST_ENTRIES = 4_000_000

_BLOCK = "owner int, states array<long>, r array<double>, row array<int>, col array<int>, p array<double>, halo array<long>"
_ROUND = "owner int, states array<long>, old array<double>, v array<double>, residual double, strided double, n long, messages array<struct<reader:int,v:array<double>,sent:int>>"
_START = "owner int, v array<double>, messages array<struct<reader:int,v:array<double>,sent:int>>"


def layout(m: Mdp, blocks: int, n: int) -> DataFrame:
    """A row for each block: its states, rewards and entries. ``col`` is a place
    in the block, or from the block's size on a place in its ``halo``, the
    sorted states of others that it reads."""
    at = owner(F.col("state"), n, blocks)
    e = m.transitions.select(F.col("src").alias("state"), "dst", "p", F.lit(1).alias("kind"))
    own = m.rewards.select("state", F.col("state").alias("dst"), F.col("r").alias("p"), F.lit(0).alias("kind"))

    limit = MOST_ENTRIES

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mine, e = pdf[pdf["kind"] == 0].sort_values("state"), pdf[pdf["kind"] == 1].sort_values(["state", "dst"])
        if len(e) > limit:
            raise ValueError(f"block {key[0]} has {len(e)} entries, {limit} at most: raise `threads`, the number of blocks")
        states, dst = mine["state"].to_numpy(), e["dst"].to_numpy()
        inside = np.isin(dst, states)
        halo = np.unique(dst[~inside])
        col = np.where(inside, np.searchsorted(states, dst), len(states) + np.searchsorted(halo, dst))
        return pd.DataFrame([{"owner": key[0], "states": states, "r": mine["p"].to_numpy(), "row": np.searchsorted(states, e["state"].to_numpy()).astype(np.int32), "col": col.astype(np.int32), "p": e["p"].to_numpy(), "halo": halo}])

    return own.unionByName(e).groupBy(at.alias("owner")).applyInPandas(pack, _BLOCK)


class Halo(Rounds):
    """The job of a round also has the residual of the values that it starts
    from, as every block then has all that it reads. ``sent`` counts the values
    that the last round's messages carried."""

    always = True

    def __init__(self, m: Mdp, op: FixedPointOperator, x: DataFrame, blocks: int, local_sweeps: int, alpha: float, stride: int = 1):
        super().__init__(op, x, alpha, stride)
        n = m.size()
        self.blocks, self.sweeps, self.beta = max(1, min(blocks, n)), local_sweeps, m.beta
        self.buckets = int(m.spark.conf.get("spark.sql.shuffle.partitions"))
        laid = self.trail.bucketed(layout(m, self.blocks, n), "owner", self.buckets, True)
        # Who reads a block's values: for each reader the places of those values, in the order of its halo.
        reads = laid.select(F.col("owner").alias("reader"), F.explode("halo").alias("state")).withColumn("owner", owner(F.col("state"), n, self.blocks))
        readers = reads.groupBy("owner", "reader").agg(F.array_sort(F.collect_list("state")).alias("wanted")).groupBy("owner").agg(F.collect_list(F.struct("reader", "wanted")).alias("readers"))
        self.laid = self.trail.bucketed(laid.join(readers, "owner", "left"), "owner", self.buckets, True)
        start = x.select(owner(F.col("state"), n, self.blocks).alias("owner"), "state", "v").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("state", "v"))).alias("own"))
        first = self.laid.join(start, "owner").select("owner", "states", F.col("own.v").alias("v"), "readers")
        self.now, self.sent = self.trail.bucketed(first.mapInPandas(_first, _START), "owner", self.buckets), 0

    def round_plan(self) -> DataFrame:
        """(``_ROUND``): one round. Its only shuffle is that of the messages."""
        sent = self.now.select(F.explode("messages").alias("m"), F.col("owner").alias("sender")).select(F.col("m.reader").alias("owner"), F.struct("sender", "m.v").alias("m"))
        # Senders hold ascending ranges of states, so messages in their order are the halo in its order.
        halos = sent.groupBy("owner").agg(F.flatten(F.array_sort(F.collect_list("m"))["v"]).alias("far"))
        rows = self.laid.join(self.now.select("owner", F.col("v").alias("old")), "owner").join(halos, "owner", "left")
        sweeps, alpha, beta, stride = self.sweeps, self.alpha, self.beta, self.stride

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for b in pdf.itertuples():
                    old, row, col, p, r = (np.asarray(a) for a in (b.old, b.row, b.col, b.p, b.r))
                    m = len(old)
                    far = np.asarray(b.far if b.far is not None else [], float)
                    out_of = col >= m
                    base = r + beta * np.bincount(row[out_of], p[out_of] * far[col[out_of] - m], m)
                    row, col, p, v = row[~out_of], col[~out_of], p[~out_of], old
                    residual = None
                    for _ in range(max(1, sweeps)):
                        fv = base + beta * np.bincount(row, p * v[col], m)
                        residual = np.abs(fv - v) if residual is None else residual
                        v = fv if alpha == 1 else (1 - alpha) * v + alpha * fv
                    v = v if sweeps else old
                    states = np.asarray(b.states)
                    some = residual[states % stride == 0]
                    out.append({"owner": b.owner, "states": states, "old": old, "v": v, "residual": _most(residual), "strided": _most(some), "n": m, "messages": _messages(states, v, b.readers)})
                yield pd.DataFrame(out, columns=["owner", "states", "old", "v", "residual", "strided", "n", "messages"])

        return rows.mapInPandas(run, _ROUND)

    def look(self) -> Look:
        seen = Observation()
        sent = F.aggregate("messages", F.lit(0), lambda n, m: n + m["sent"])
        rows = self.round_plan().observe(seen, F.max("residual").alias("all"), F.max("strided").alias("some"), F.sum("n").alias("n"), F.sum(sent).alias("sent"))
        self.rows = self.trail.bucketed(rows, "owner", self.buckets)  # each task writes the bucket that it has read
        found = told(seen)
        self.n, self.sent = found.states, seen.get["sent"]
        return found

    def advance(self, k: int) -> int:
        self.now = self.rows
        return self.n * self.sweeps

    def values(self) -> DataFrame:
        return self.trail.plain(self.rows).select(F.explode(F.arrays_zip("states", "old")).alias("x")).select(F.col("x.states").alias("state"), F.col("x.old").alias("v"))


def _first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(``_START``): the messages before the first round."""
    for pdf in batches:
        yield pd.DataFrame([{"owner": b.owner, "v": b.v, "messages": _messages(b.states, np.asarray(b.v), b.readers)} for b in pdf.itertuples()], columns=["owner", "v", "messages"])


def _most(a: np.ndarray) -> float:
    a = a[~np.isnan(a)]
    return float(a.max()) if len(a) else 0.0


def _messages(states: np.ndarray, v: np.ndarray, readers: object) -> list[dict]:
    """What each reader wants of a block's values."""
    states = np.asarray(states)
    out = []
    for r in readers if readers is not None else []:
        wanted = np.asarray(r["wanted"])
        out.append({"reader": int(r["reader"]), "v": v[np.searchsorted(states, wanted)], "sent": len(wanted)})
    return out
