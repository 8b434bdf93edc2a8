"""Rate windows of keys with very many rows: blocks of sorted hits as functions, composed by a parallel prefix.

Which window a hit belongs to depends on all hits before it, but only through the window that is open when its block begins. So
a block is a function: from the start of that window to the start and hits of the window that is open at its end. It is a step
function, as a later start opens the next window at a later hit, and it has at most as many steps as there are hits
within one window's length of the block's first hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.tables import snapshot

_NEVER, _ALWAYS = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Steps:
    """A start up to limits[i] (and over limits[i - 1]) leads to a window (starts[i], hits[i]); one over all limits stays open and gets n more hits."""

    limits: np.ndarray
    starts: np.ndarray
    hits: np.ndarray
    n: int

    @staticmethod
    def of(times: np.ndarray, length: int, first: bool) -> Steps:
        """The function of one key's sorted hits; ``first`` if nothing can be open before them."""
        n = len(times)
        after = np.searchsorted(times, times + length)
        last = np.where(after < n, after, np.arange(n))
        while not np.array_equal(onward := last[last], last):  # where chains of windows end
            last = onward
        opens = np.flatnonzero(np.append(True, times[1:] != times[:-1]))  # of hits at one time the first opens a window
        most = 1 if first else int(np.searchsorted(times[opens], times[0] + length)) + 1  # an open window started before the first hit
        last = last[opens[:most]]
        return Steps(np.array([_ALWAYS]) if first else times[opens[:most]] - length, times[last], n - last, n).merged()

    def merged(self) -> Steps:
        """Without limits between steps that lead to the same."""
        differ = np.append(self.starts[1:] != self.starts[:-1], True)[: len(self.starts)]
        return Steps(self.limits[differ], self.starts[differ], self.hits[differ], self.n)

    def then(self, other: Steps) -> Steps:
        """This function and then the other."""
        at = np.searchsorted(other.limits, self.starts)
        stays = at == len(other.limits)
        at = np.minimum(at, max(0, len(other.limits) - 1))
        starts = np.where(stays, self.starts, other.starts[at] if len(other.limits) else 0)
        hits = np.where(stays, self.hits + other.n, other.hits[at] if len(other.limits) else 0)
        beyond = other.limits > (self.limits[-1] if len(self.limits) else _NEVER)
        return Steps(np.concatenate([self.limits, other.limits[beyond]]), np.concatenate([starts, other.starts[beyond]]), np.concatenate([hits, other.hits[beyond]]), self.n + other.n).merged()


def _prefixes(steps: DataFrame, key: str) -> DataFrame:
    """Each block's function after those of all blocks of its key before it; the number of rounds is the logarithm of the blocks."""
    kind = f"`{key}` {steps.schema[key].dataType.simpleString()}, place int, limits array<long>, starts array<long>, hits array<long>, n long"

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["own"]]
        if len(own) == len(frame) or not len(own):
            return own.drop(columns="own")
        a, b = (Steps(*(np.asarray(f[c].iloc[0]) for c in ("limits", "starts", "hits")), int(f["n"].iloc[0])) for f in (frame[~frame["own"]], own))
        both = a.then(b)
        return own.drop(columns="own").assign(limits=[both.limits], starts=[both.starts], hits=[both.hits], n=both.n)

    most, far = steps.agg(F.max("place")).first()[0] or 0, 1
    columns = [key, "place", "limits", "starts", "hits", "n"]
    while far <= most:
        moved = steps.select(key, (F.col("place") + far).cast("int").alias("place"), *columns[2:]).withColumn("own", F.lit(False))
        steps = snapshot(steps.select(*columns).withColumn("own", F.lit(True)).unionByName(moved).groupBy(key, "place").applyInPandas(composed, kind))
        far *= 2
    return steps


def entered(rows: DataFrame, key: str, length: int, order: list[str]) -> DataFrame:
    """``rows`` in sorted blocks (_block), each row with the window (_start_in, _hits_in) that is open for its key when the block begins.

    Blocks are ranges of (key, order): a key of any size lies in as many as its rows need. Only the first key of a block can
    have something open, so the table of what is open has at most one row for each block and is broadcast.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * tasks  # so that hashes deal blocks evenly
    by = [key, *order, "_n"]
    ranged = rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(parts, *by)
    placed = snapshot(ranged.withColumn("_block", F.spark_partition_id()))
    in_order = lambda frame: frame.repartition(tasks, "_block").sortWithinPartitions("_block", *by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first and the last key of each block, with their times."""
        block, name, at, first = None, None, [], True

        def ended(more: bool) -> pd.DataFrame | None:
            if name is not None and (first or not more):
                return pd.DataFrame({key: [name], "_block": [block], "times": [np.concatenate(at)]})
            return None

        for frame in frames:
            of, names, times = frame["_block"].to_numpy(), frame[key].to_numpy(), frame["_at"].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (names[1:] != names[:-1])) + 1).tolist(), len(frame)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if (of[a], names[a]) != (block, name):
                    if (found := ended(of[a] == block)) is not None:
                        yield found
                    first = of[a] != block
                    block, name, at = of[a], names[a], []
                at.append(times[a:b])
        if (found := ended(False)) is not None:
            yield found

    kind = rows.schema[key].dataType.simpleString()
    edges = snapshot(in_order(placed).select(key, "_block", "_at").mapInPandas(run, f"`{key}` {kind}, _block int, times array<long>"))
    of_key = Window.partitionBy(key)
    several = edges.withColumn("place", F.row_number().over(of_key.orderBy("_block")) - 1).withColumn("_of", F.count(F.lit(1)).over(of_key)).where("_of > 1")

    def functions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [Steps.of(np.asarray(t, np.int64), length, p == 0) for t, p in zip(frame["times"], frame["place"], strict=True)]
            yield frame[[key, "place", "_block"]].assign(limits=[f.limits for f in found], starts=[f.starts for f in found], hits=[f.hits for f in found], n=[f.n for f in found])

    steps = snapshot(several.select(key, "place", "_block", "times").mapInPandas(functions, f"`{key}` {kind}, place int, _block int, limits array<long>, starts array<long>, hits array<long>, n long"))
    before = _prefixes(steps.drop("_block"), key).select(key, (F.col("place") + 1).alias("place"), F.col("starts")[0].alias("_start_in"), F.col("hits")[0].alias("_hits_in"))
    opened = snapshot(steps.select(key, "place", "_block").join(before, [key, "place"]).drop("place"))
    return in_order(placed.join(F.broadcast(opened), ["_block", key], "left"))  # Spark drops sorts below a join
