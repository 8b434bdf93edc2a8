"""Keyed state machines over events in time order, the same in a batch and as a stream.

A machine sees a group's events in the order of time, kind, item and other. As a stream, events wait in state until the
watermark has passed them, so disorder inside the watermark changes nothing and later rows are left out; deadlines
(expiry, sweeps) are event-time timers. What a machine says carries the time at which it became true, not when a
timer came round to it: a stream's rows up to a watermark are a batch's rows up to that time.

In a batch, rows are sorted inside partitions and read one after another, with one group's state in memory.

Rows without a group or time take no part. Equal rows are events of their own.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Iterator
from copy import deepcopy

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What machines say: at is when it became true, n a count that belongs to it.
SAID = "group string, at timestamp, kind string, item string, outcome string, n long"
_EPOCH = datetime.datetime(1970, 1, 1)
_MICRO = datetime.timedelta(microseconds=1)


class Machine:
    """State of one group: entries of three numbers by name, in the order in which they came, and numbers of the group's own."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.entries: dict[str, tuple[int, int, int]] = {}
        self.own: tuple[int, int, int] = (-1, -1, 0)

    def on(self, at: int, kind: str, item: str, other: str | None) -> Iterable[tuple]:
        """What an event leads to, as (at, kind, item, outcome, n); times are microseconds."""
        raise NotImplementedError

    def deadline(self) -> int | None:
        """When something will happen without an event."""
        return None

    def due(self) -> Iterable[tuple]:
        """What happens at the deadline."""
        return ()

    def advance(self, until: int) -> Iterator[tuple]:
        while (at := self.deadline()) is not None and at <= until:
            yield from self.due()


def _events(rows: DataFrame, group: Column, time: str, kind: Column, item: Column, other: Column) -> DataFrame:
    found = rows.select(group.cast("string").alias("group"), F.col(time).alias("at"), kind.cast("string").alias("kind"), item.cast("string").alias("item"), other.cast("string").alias("other"))
    return found.where("group is not null and at is not null")


def batch(rows: DataFrame, machine: Machine, group: Column, time: str, kind: Column, item: Column, other: Column | None = None, until: str | None = None) -> DataFrame:
    """What the machine says to all ``rows``, and at deadlines up to ``until``; later rows are left out."""
    events = _events(rows, group, time, kind, item, F.lit(None) if other is None else other).withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))
    last = None if until is None else (datetime.datetime.fromisoformat(until) - _EPOCH) // _MICRO
    if last is not None:
        events = events.where(F.col("at") <= last)
    order = ["group", "at", "kind", "item", "other"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, known, said = deepcopy(machine), None, []
        for frame in frames:
            for name, at, kind, item, other in frame.itertuples(index=False):
                if name != known:
                    if known is not None and last is not None:
                        said += [(known, *s) for s in own.advance(last)]
                    own.reset()
                    known = name
                said += [(known, *s) for s in own.advance(at)]
                said += [(known, *s) for s in own.on(at, kind, item, other)]
            yield pd.DataFrame(said, columns=["group", "at", "kind", "item", "outcome", "n"])
            said = []
        if known is not None and last is not None:
            yield pd.DataFrame([(known, *s) for s in own.advance(last)], columns=["group", "at", "kind", "item", "outcome", "n"])

    sorted_ = events.repartition("group").sortWithinPartitions(*order)
    said = sorted_.mapInPandas(run, "group string, at long, kind string, item string, outcome string, n long")
    return said.withColumn("at", F.timestamp_micros("at"))


class _Processor(StatefulProcessor):
    """Rows wait in a list, a machine's entries are a map, and timers stand for the next event that waits and the next deadline."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, kind string, item string, other string")
        self.entries = handle.getMapState("entries", "name string", "a long, b long, c long, place long")
        self.own = handle.getValueState("own", "a long, b long, c long, next long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = [((r["at"].replace(tzinfo=None) - _EPOCH) // _MICRO, r["kind"], r["item"], r["other"]) for r in rows]
        if found:
            self.waiting.appendList(found)
            self._wake(min(f[0] for f in found))
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], *((x is not None, x or "") for x in r[1:])))
        now, later = [r for r in every if r[0] <= until], [r for r in every if r[0] > until]
        own = deepcopy(self.machine)
        own.reset()
        before = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        own.entries = {k: v[:3] for k, v in sorted(before.items(), key=lambda e: e[1][3])}
        place = 0
        if self.own.exists():
            *numbers, place = self.own.get()
            own.own = tuple(numbers)
        said = []
        for event in now:
            said += own.advance(event[0])
            said += own.on(*event)
        said += own.advance(until)
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        else:
            self.waiting.clear()
        for name in before.keys() - own.entries.keys():
            self.entries.removeKey((name,))
        for name, value in own.entries.items():
            if name not in before:
                self.entries.updateValue((name,), (*value, place))
                place += 1
            elif before[name][:3] != value:
                self.entries.updateValue((name,), (*value, before[name][3]))
        if own.entries or own.own != (-1, -1, 0):
            self.own.update((*own.own, place))
        else:
            self.own.clear()
        if (at := own.deadline()) is not None:
            self._wake(at)
        for at, kind, item, outcome, n in said:
            yield Row(group=key[0], at=_EPOCH + at * _MICRO, kind=kind, item=item, outcome=outcome, n=n)

    def close(self) -> None:
        pass


def stream(rows: DataFrame, machine: Machine, group: Column, time: str, kind: Column, item: Column, other: Column | None = None, watermark: str = "1 hour") -> DataFrame:
    """The same of a stream. The session needs the RocksDB state store; ``use_rocksdb`` sets it."""
    events = _events(rows.withWatermark(time, watermark), group, time, kind, item, F.lit(None) if other is None else other)
    return events.groupBy("group").transformWithState(statefulProcessor=_Processor(machine), outputStructType=SAID, outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
