"""Rate windows that start at a key's first hit, and expiry of what is too old.

In batches, rows are sorted by key and time inside partitions and read in order, with one window of state; a
key's rows are never held together. A key of very many rows is cut into blocks: each block becomes a function from the
window that is open before it to the one open behind it, functions of neighbours are composed by a parallel prefix, and the
blocks are then numbered side by side (``blocks.py``). As a stream, the same rule runs with state for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import blocks

#: Rows up to which a key is read by one task.
KEY_ROWS = 1_000_000


def _micros(column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def count_windows(keys: np.ndarray, at: np.ndarray, length: int, key=None, start: int = 0, hits: int = 0):
    """Window start and hit number of each row, keys together and times ascending; and the state at the end."""
    starts, numbers = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for i, (k, t) in enumerate(zip(keys, at.tolist(), strict=True)):
        if k != key or start + length <= t:
            key, start, hits = k, t, 0
        hits += 1
        starts[i], numbers[i] = start, hits
    return starts, numbers, (key, start, hits)


def rate_windows(
    events: DataFrame, key: str, time: str, seconds: float, limit: int, ties: tuple[str, ...] = (), key_rows: int = KEY_ROWS
) -> DataFrame:
    """Adds window_start, hit and allowed to rows with a key and a time; rows of one time are counted in the order of ``ties``.

    Where a key has more than ``key_rows`` rows, its rows are counted in blocks by many tasks, to the same numbers.
    """
    length = int(seconds * 1e6)
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_at", _micros(F.col(time)))
    if (rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0) > key_rows:
        rows = blocks.entered(rows, key, length, ["_at", *ties])
    else:
        plain = {"_block": F.lit(0), "_start_in": F.lit(None).cast("long"), "_hits_in": F.lit(None).cast("long")}
        rows = rows.repartition(F.col(key)).sortWithinPartitions(key, "_at", *ties).withColumns(plain)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, state = None, (None, 0, 0)
        for frame in frames:
            starts, hits = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
            keys, at, of = frame[key].to_numpy(), frame["_at"].to_numpy(np.int64), frame["_block"].to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(frame)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b and of[a] != block:
                    block, first = of[a], frame["_start_in"].iloc[a]
                    state = (None, 0, 0) if pd.isna(first) else (keys[a], int(first), int(frame["_hits_in"].iloc[a]))
                starts[a:b], hits[a:b], state = count_windows(keys[a:b], at[a:b], length, *state)
            yield frame[names].assign(_start=starts, hit=hits)

    names = list(events.columns)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    counted = rows.select(*names, "_at", "_block", "_start_in", "_hits_in").mapInPandas(run, f"{kept}, _start long, hit long")
    return counted.select(*events.columns, F.timestamp_micros("_start").alias("window_start"), "hit", (F.col("hit") <= limit).alias("allowed"))


def rate_limit_stream(events: DataFrame, key: str, time: str, seconds: float, limit: int, watermark: str = "1 hour") -> DataFrame:
    """The same over a stream: (key, at, hit, allowed) of each event; a window's state goes once the watermark passes its end."""
    length = int(seconds * 1e6)
    kind = events.schema[key].dataType.simpleString()
    source = events.withWatermark(time, watermark).select(F.col(key).alias("key"), F.col(time).alias("at"))

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, hits = state.get if state.exists else (0, 0)
        known = group[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values("at")
            at = frame["at"].to_numpy("datetime64[us]").astype(np.int64)
            _, numbers, (known, start, hits) = count_windows(np.repeat(np.array([group[0]], object), len(at)), at, length, known, start, hits)
            yield pd.DataFrame({"key": group[0], "at": frame["at"], "hit": numbers, "allowed": numbers <= limit})
        state.update((int(start), int(hits)))
        ends = (start + length) // 1000 + 1
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)

    return source.groupBy("key").applyInPandasWithState(run, f"key {kind}, at timestamp, hit long, allowed boolean", "start long, hits long", "append", GroupStateTimeout.EventTimeTimeout)


def alive(rows: DataFrame, created: str, seconds: float, now: str) -> DataFrame:
    """Rows whose lifetime has not ended; it ends exactly ``seconds`` after they were made."""
    return rows.where(_micros(F.col(created)) + int(seconds * 1e6) > _micros(F.lit(now)))


def single_use(issued: DataFrame, used: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """(key, time, valid) of each use: the first use of an issued key counts, if it comes before the key expires."""
    first = used.groupBy(key).agg(F.min(time).alias("_first"))
    made = issued.groupBy(key).agg(F.min(time).alias("_made"))
    joined = used.join(first, key).join(made, key, "left")
    fresh = (_micros(F.col(time)) < _micros(F.col("_made")) + int(seconds * 1e6)) & (F.col(time) >= F.col("_made"))
    return joined.select(key, time, F.coalesce((F.col(time) == F.col("_first")) & fresh, F.lit(False)).alias("valid"))


def orphans(clients: DataFrame, tokens: DataFrame, key: str, created: str, grace: float, now: str) -> DataFrame:
    """Clients without a token that are older than the grace period."""
    return clients.join(tokens.select(key).distinct(), key, "left_anti").where(_micros(F.col(created)) + int(grace * 1e6) <= _micros(F.lit(now)))


def live_buckets(counted: DataFrame, key: str, seconds: float, now: str, most: int) -> DataFrame:
    """(key, window_start, hits) of a limiter's open windows at a time, from ``rate_windows``: beyond ``most`` keys the latest opened stay.

    A key that is left out starts a new window with its next hit.
    """
    opened = counted.where(_micros(F.col("window_start")) + int(seconds * 1e6) > _micros(F.lit(now)))
    last = opened.groupBy(key).agg(F.max(F.struct("window_start", "hit")).alias("w")).select(key, F.col("w.window_start").alias("window_start"), F.col("w.hit").alias("hits"))
    return last.orderBy(F.desc("window_start"), key).limit(most)


def newest(rows: DataFrame, created: str, most: int, key: str) -> DataFrame:
    """The newest ``most`` rows: a cap that drops the oldest."""
    return rows.orderBy(F.desc(created), key).limit(most)
