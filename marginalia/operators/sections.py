"""Outlines of notes that come as rows of parts, such as conversations by turns; no note is ever gathered in one row.

A note's text is its parts in order, joined by newlines. The rows are sorted into blocks, ranges of (note, place), so a note of any
size lies in as many blocks as it needs. What a block needs to know of the blocks before and behind it is small, and only the
first and the last note of a block can go on in another one, so the driver carries at most two short summaries for each block:
first how a block changes the code fence that is open, then its lines and characters, the headings that stay open behind it, and where
the first heading of each level or above is. With that each block tells its own headings: ancestry from the headings before, extents from
the first one behind that is as high.

Nulls: rows without a note or place take no part, a null text is an empty part. Parts of one place are in the order of their texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.text import _FENCE, CHARS_PER_TOKEN, Fences, _CJK, tokens_of, utf16_length
from .tables import snapshot

LEVELS = 6
#: What is summed along a note: UTF-16 units (each line with its newline), characters by cost, lines.
SUMS = ("chars", *CHARS_PER_TOKEN, "lines")
OUTLINE = "note string, heading string, level long, heading_path array<string>, start_line long, chars long, est_tokens long"


def fence_table(markers: list[str]) -> dict:
    """What a sequence of fence markers makes of an open fence: {"": from none, "`": [[longest open marker that ends, then open]], "~": ...}."""
    lengths = sorted({len(m) for m in markers})
    then = [""] * (len(markers) + 1)  # open at the end, if none is open before marker k
    ends: dict[tuple[str, int], int] = {}  # the next marker of this kind and at least this length
    for k in range(len(markers) - 1, -1, -1):
        kind, own = markers[k][0], len(markers[k])
        closed = ends.get((kind, own))
        then[k] = markers[k] if closed is None else then[closed + 1]
        ends |= {(kind, n): k for n in lengths if n <= own}
    return {"": then[0]} | {kind: [[n, then[ends[kind, n] + 1]] for n in lengths if (kind, n) in ends] for kind in "`~"}


def fence_after(table: dict, open_: str) -> str:
    if not open_:
        return table[""]
    return next((then for n, then in table[open_[0]] if len(open_) <= n), open_)


class Lines:
    """Reads a note's lines; knows the sums before each line, the headings, and those still open."""

    def __init__(self, fence: str = "", before: list[int] | None = None, above: list[tuple[int, str]] | None = None):
        self.fences, self.sums, self.above = Fences(), list(before or [0] * len(SUMS)), list(above or [])
        self.fences.open = fence
        self.found: list[tuple[int, str, list[str], list[int]]] = []

    def read(self, text: str) -> None:
        for line in text.split("\n"):
            marked = self.fences.marker(line)
            if line.startswith("#") and marked is None and not self.fences.open and (heads := md.headings([line])):
                head = heads[0]
                while self.above and self.above[-1][0] >= head.level:
                    self.above.pop()
                self.found.append((head.level, head.title, [*(t for _, t in self.above), head.title], self.sums.copy()))
                self.above.append((head.level, head.title))
            self.sums[0] += utf16_length(line) + 1
            self.sums[-1] += 1
            if not marked:
                low = len(line.encode("ascii", "ignore"))
                wide = len(_CJK.findall(line)) if low < len(line) else 0
                self.sums[2 if self.fences.open else 1] += low + 1
                self.sums[3] += wide
                self.sums[4] += len(line) - low - wide

    def firsts(self) -> list[list[int] | None]:
        """For each level the sums before the first heading of that level or above."""
        return [next((at for level, _, _, at in self.found if level <= k), None) for k in range(1, LEVELS + 1)]


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, str, bool, bool, list[str]]]:
    """(block, note, whether it is the block's first, whether it is its last, texts) of each note in each block."""
    held: tuple | None = None
    for frame in frames:
        for block, note, text in frame[["_block", "note", "text"]].itertuples(index=False):
            if held is None or (held[0], held[1]) != (block, note):
                if held:
                    yield held[0], held[1], held[2], held[0] != block, held[3]
                held = (block, note, held is None or held[0] != block, [])
            held[3].append(text or "")
    if held:
        yield held[0], held[1], held[2], True, held[3]


def outline_of_parts(parts: DataFrame, note: str, place: str, text: str) -> DataFrame:
    """(note, heading, level, heading_path, start_line, chars, est_tokens) of each heading of notes that are rows of parts."""
    spark = parts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.select(F.col(note).cast("string").alias("note"), F.col(place).alias("place"), F.col(text).alias("text")).where("note is not null and place is not null")
    blocks = snapshot(rows.repartitionByRange(4 * tasks, "note", "place", F.xxhash64("text")).withColumn("_block", F.spark_partition_id()))
    in_order = blocks.repartition(tasks, "_block").sortWithinPartitions("_block", "note", "place", "text")

    def edges(summary) -> list:
        """Summaries of the first and the last note of each block, in the order of blocks and notes."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for block, name, first, last, texts in _runs(frames):
                if first or last:
                    yield pd.DataFrame({"block": [block], "note": [name], "first": [first], "said": [json.dumps(summary(block, name, texts))]})

        found = in_order.mapInPandas(run, "block int, note string, first boolean, said string").collect()  # two for each block at most
        return sorted(((r.block, not r["first"], r.note, json.loads(r.said)) for r in found), key=lambda r: r[:2])

    def markers(block: int, name: str, texts: list[str]) -> dict:
        return fence_table([m.group(1) for t in texts for line in t.split("\n") if (m := _FENCE.match(line))])

    fences, known, open_ = {}, None, ""
    for block, _, name, table in edges(markers):
        if name != known:
            known, open_ = name, ""
        fences[block, name] = open_
        open_ = fence_after(table, open_)

    def summed(block: int, name: str, texts: list[str]) -> dict:
        lines = Lines(fences.get((block, name), ""))
        for t in texts:
            lines.read(t)
        return {"sums": lines.sums, "above": lines.above, "least": min((f[0] for f in lines.found), default=LEVELS + 1), "firsts": lines.firsts()}

    said, enter = edges(summed), {}
    known, sums, above = None, [0] * len(SUMS), []
    for block, _, name, s in said:
        if name != known:
            known, sums, above = name, [0] * len(SUMS), []
        enter[block, name] = {"sums": sums, "above": above}
        sums = [a + b for a, b in zip(sums, s["sums"], strict=True)]
        above = [x for x in above if x[0] < s["least"]] + s["above"]
    known, behind = None, []
    for block, _, name, s in reversed(said):
        own = enter[block, name]
        ends = [a + b for a, b in zip(own["sums"], s["sums"], strict=True)]
        if name != known:
            known, behind = name, [ends] * LEVELS  # the end of the note
        own["behind"] = behind
        behind = [b if f is None else [x + y for x, y in zip(own["sums"], f, strict=True)] for b, f in zip(behind, s["firsts"], strict=True)]

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in OUTLINE.split(", ")]
        for block, name, _, _, texts in _runs(frames):
            known = enter.get((block, name), {"sums": None, "above": None, "behind": None})
            lines = Lines(fences.get((block, name), ""), known["sums"], [tuple(a) for a in known["above"] or []])
            for t in texts:
                lines.read(t)
            ends, out = list(known["behind"] or [lines.sums] * LEVELS), []
            for level, title, path, at in reversed(lines.found):
                took = dict(zip(SUMS, np.subtract(ends[level - 1], at).tolist(), strict=True))
                out.append((name, title, level, path, at[-1] + 1, took["chars"] - 1, tokens_of(took)))
                ends[level - 1 :] = [at] * (LEVELS - level + 1)
            yield pd.DataFrame(out[::-1], columns=columns)

    return in_order.mapInPandas(told, OUTLINE)
