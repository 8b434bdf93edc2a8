"""Operator 13: passages that repeat, found with an FM-index per shard.

A window is WINDOW consecutive words. Its anchor is one of its runs of GRAM words, chosen by hash, so equal windows
have equal anchors at equal places and meet in the anchor's shard: consecutive windows of one anchor travel as one stretch of a
document. Stretches whose anchor is nowhere else are left out, since their windows are nowhere else. Equal stretches are
counted before they travel, and one of them is looked up in its document. A shard indexes its different
stretches, those that occur more than once twice, and streams them through backward search; matches of WINDOW words or more are repeated windows.

Runs of words that are very frequent are chosen last. So a window that only borders on a passage of very many documents
has an anchor outside, and the stretches of frequent anchors are alike; the list of frequent runs has at most HEAVY entries,
as they must each start at one of HEAVY words or more.

Words are compared by 64-bit hashes, stretches by 128 bits.

Nulls and odd rows: a null or empty text has no words; texts under WINDOW words keep all. Rows that share a doc_id are told
apart by their texts; equal rows count as places of their own, so their windows repeat. A null doc_id is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialize
from .fmindex import FMIndex, repeated_windows

WINDOW, GRAM = 35, 8
#: Frequent runs of words at most, and the least count of one. Runs that a task counts at once, and those of them that it names at least.
HEAVY, LEAST = 200_000, 200
COUNTED, NAMED = 1 << 22, 8
#: Stretches of a shard, about. Bytes of a text that are split into words at once.
SHARD, BLOCK = 16_000, 1 << 22
#: Windows whose anchors are found at once; their places must fit into 21 bits.
CHUNK = 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEY = ["_id", "_mark"]


def blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; words part at ASCII white space."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end].split()
        at = end


def word_hashes(text: bytes) -> np.ndarray:
    parts = [np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)) for words in blocks(text)]
    return np.concatenate([*parts, np.empty(0, np.uint64)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    found = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        found = found * np.uint64(_BASE) + words[k : k + len(found)]
    return _mixed(found)


class Heavy:
    """A set of frequent runs' hashes; a bitmap answers for most of the others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.map = np.zeros(1 << 20, bool)
        self.map[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def among(self, grams: np.ndarray) -> np.ndarray:
        found = self.map[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)]
        if found.any():
            some = grams[found]
            at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
            found[found] = self.hashes[at] == some
        return found


def leftmost_least(rank: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of each ``span`` neighbours, the leftmost at a tie; of a rank the first 43 bits count.

    Places stand in the low bits, so plain minima over 1, 2, 4, ... neighbours give them.
    """
    least, width = (rank >> np.uint64(21) << np.uint64(21)) | np.arange(len(rank), dtype=np.uint64), 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: len(rank) - span + 1], least[span - width :])
    return (least & np.uint64((1 << 21) - 1)).astype(np.int64)


def stretches(words: np.ndarray, heavy: Heavy, window: int = WINDOW, size: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, mark, start, windows) of each stretch of consecutive windows with one anchor; mark hashes the stretch's words.

    The anchor is the leftmost of the least runs of words inside the window, frequent ones last.
    """
    grams = gram_hashes(words, size)
    n, span = len(words) - window + 1, window - size + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    rank = (grams >> np.uint64(1)) | (heavy.among(grams).astype(np.uint64) << np.uint64(63))
    at = np.concatenate([leftmost_least(rank[k : k + CHUNK + span - 1], span) + k for k in range(0, n, CHUNK)])
    start = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    windows = np.diff(np.concatenate([start, [n]]))
    powers = np.cumprod(np.full(len(words), _BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers)])
    back = np.cumprod(np.full(len(words), _INVERSE, np.uint64))
    mark = (sums[start + windows + window - 1] - sums[start]) * back[start]
    return grams[at[start]], _mixed(mark + windows.astype(np.uint64)), start, windows


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _id, _mark): text as UTF-8, and what tells rows apart, never null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.xxhash64("text").alias("_mark"))


def heavy_grams(docs: DataFrame, size: int = GRAM, heavy: int = HEAVY, least: int = LEAST) -> np.ndarray:
    """Hashes of the runs of words that start at ``least`` words and at one of ``heavy`` or more; so there are at most ``heavy``.

    Tasks count all runs and name those that are frequent among theirs, as one that is frequent in all texts is in some task's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def named() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(NAMED, n // heavy)
            return pa.RecordBatch.from_arrays([pa.array([*grams[often].view(np.int64).tolist(), None], pa.int64()), pa.array([*counts[often].tolist(), n], pa.int64())], ["gram", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(gram_hashes(word_hashes(text.as_py()), size))
                n += len(held[-1])
                if n >= COUNTED:
                    yield named()
                    held, n = [], 0
        if n:
            yield named()

    counts = materialize(_rows(docs).select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    every = counts.where("gram is null").first()
    if not every:
        return np.empty(0, np.uint64)
    often = counts.where("gram is not null").where(F.col("n") >= max(least, -(-every["n"] // heavy))).select("gram").toPandas()["gram"]
    return often.to_numpy(np.int64).view(np.uint64)


def anchored(docs: DataFrame, heavy: np.ndarray, window: int = WINDOW, size: int = GRAM) -> DataFrame:
    """(anchor, mark, _id, _mark, start, windows) of each stretch of each text."""
    frequent = docs.sparkSession.sparkContext.broadcast(Heavy(heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stretches(word_hashes(t.as_py()), frequent.value, window, size) for t in batch.column(2)]
            of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            anchor, mark, start, windows = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(mark.view(np.int64)), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int8))],
                ["anchor", "mark", *_KEY, "start", "windows"],
            )

    return _rows(docs).select(*_KEY, "text").mapInArrow(run, "anchor long, mark long, _id long, _mark long, start int, windows byte")


def contents(docs: DataFrame, wanted: DataFrame, shards: int, window: int = WINDOW) -> DataFrame:
    """(shard, anchor, mark, windows, twice, words) of the ``wanted`` stretches, read in the document that each names; words are hashes."""
    asked = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("anchor", "mark", "start", "windows", "twice")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lists in zip(batch.column(0), batch.column(1), strict=True):
                asked, words = lists.values, word_hashes(text.as_py()).view(np.int64)
                start, windows = (asked.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "windows"))
                ends = np.concatenate([[0], np.cumsum(windows + window - 1)])
                flat = words[np.arange(ends[-1]) + np.repeat(start - ends[:-1], windows + window - 1)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(asked.field(c) for c in ("anchor", "mark", "windows", "twice")), lists], ["anchor", "mark", "windows", "twice", "words"])

    found = _rows(docs).join(asked, _KEY).select("text", "asked").mapInArrow(run, "anchor long, mark long, windows byte, twice boolean, words array<long>")
    return found.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))


def shard_repeats(table: pa.Table, window: int = WINDOW) -> pa.Table:
    """(anchor, mark, flags) of the stretches of one shard with repeated windows: bit k of flags stands for window k."""
    table = table.combine_chunks()
    names, order = np.unique(np.stack([table[c].to_numpy() for c in ("anchor", "mark")], axis=1), axis=0, return_index=True)[0:2]
    table = table.take(pa.array(order))  # once each: rows of one doc_id and text name a stretch again
    windows, twice = table["windows"].to_numpy().astype(np.int64), table["twice"].to_numpy(zero_copy_only=False).astype(bool)
    kinds, flat = np.unique(table["words"].combine_chunks().flatten().to_numpy(), return_inverse=True)
    lengths = windows + window - 1
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int((lengths + 1).sum()), np.int64)  # 0 ends a stretch
    place = np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)
    text[place] = flat + 1
    again = np.repeat(twice, lengths + 1)
    index = FMIndex(np.concatenate([text, text[again]]), len(kinds) + 1, int(lengths.max(initial=1)))
    flags = np.zeros(len(windows), np.int64)
    for piece, first, last in repeated_windows(index, text, starts, lengths, window):
        np.bitwise_or.at(flags, piece, (np.int64(1) << (last + 1)) - (np.int64(1) << first))
    some = flags != 0
    return pa.table({"anchor": names[some, 0], "mark": names[some, 1], "flags": flags[some]})


def repeated_places(docs: DataFrame, window: int = WINDOW, size: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(_id, _mark, places) of the texts with repeated windows: places are structs (start, flags) of their stretches."""
    spark = docs.sparkSession
    every = materialize(anchored(docs, heavy_grams(docs, size), window, size))
    shared = materialize(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("_all")).where("_all > 1").select("anchor"))  # as a table, so that Spark splits a frequent anchor's rows
    every = materialize(every.join(shared, "anchor", "left_semi"))
    alike = every.groupBy("anchor", "mark").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*_KEY, "start", "windows")).alias("_at"))
    wanted = materialize(alike.select("anchor", "mark", "_at.*", (F.col("_n") > 1).alias("twice")))
    n, tasks = wanted.count(), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // shard), min(tasks, n // 500))
    flagged = contents(docs, wanted, shards, window).groupBy("shard").applyInArrow(lambda t: shard_repeats(t, window), "anchor long, mark long, flags long")
    placed = every.select("anchor", "mark", *_KEY, "start").join(materialize(flagged), ["anchor", "mark"])
    return placed.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "flags")).alias("places"))


def removed_words(n: int, places: list[tuple[int, int]], window: int = WINDOW) -> np.ndarray:
    """Which of n words a repeated window covers."""
    edges = np.zeros(n + 1, np.int64)
    for start, flags in places:
        while flags:  # runs of set bits
            first = (flags & -flags).bit_length() - 1
            run = ((flags >> first) ^ ((flags >> first) + 1)).bit_length() - 1
            edges[start + first] += 1
            edges[start + first + run - 1 + window] -= 1
            flags &= ~(((1 << run) - 1) << first)
    return np.cumsum(edges[:-1]) > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, size: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs`` (doc_id, text): kept has the words that no repeated window covers, with single spaces."""
    places = materialize(repeated_places(docs, window, size, shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = [w for part in blocks(text.as_py()) for w in part]
                gone = removed_words(len(words), [(p["start"], p["flags"]) for p in found.as_py() or []], window)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n_removed[-1] else words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = _rows(docs).join(places, _KEY, "left").select("doc_id", "text", "places")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")

