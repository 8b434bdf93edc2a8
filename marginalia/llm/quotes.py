"""Operator 3: reply-ordered conversations from quoting messages.

A line's quote level is its number of leading ``>`` marks. Runs of lines of one level are passages; passages
and their lines are normalised (NFKC, lower case, one blank for white space) and hashed. Own text (level 0)
is hashed whole, by paragraph and by line. A quoted passage belongs to the first message of its conversation
that has it as own text, if that came before; else, if it has at least ``least`` words, to the first such message of
another conversation. A message replies to the message that most of its level-1 words come from (ties: the later
one), else to the message before it. Quotes, and lines announcing them, are taken out of the text.

Conversations are ordered by reply: a message comes after the one of its conversation that it replies to, with
all answers to an answer before the next thread. A run of messages without a quote of an earlier one stays
together; a run that goes back to an earlier message comes after the run it goes back to, later branching ones
first, however deep branches of branches go. Replies to other
conversations are named in ``reply_conv`` and don't move a message. Numbers come from a sort by range and counts, so
no conversation is gathered in one task.

Nulls and odd rows: a null text has no lines and stays null; null conv_id is a conversation of its own; null
turn comes first and is never replied to. Repeated rows stay and share a turn, ordered by role and text.
Other columns are dropped. Very long lines are hashed whole; parsing is linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .common import materialize, salts_for

MARKS = re.compile(r"^[ \t]*((?:>[ \t]*)+)")
#: How mail programs announce a quotation.
ANNOUNCED = re.compile(r"(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.I)
#: Turns of a range, and least words of a passage from another conversation.
RANGE, LEAST = 256, 3


def normal(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def digest(text: str) -> int:
    value = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def parse(text: str | None) -> tuple[str | None, list[int], list[tuple[int, int, int, int]], int]:
    """Own text, hashes of own text, quotes (number, level, hash, words) and the deepest level.

    The first quote of a number is the whole passage, others are its lines.
    """
    if text is None:
        return None, [], [], 0
    lines = []
    for line in text.split("\n"):
        found = MARKS.match(line)
        lines.append((found.group(1).count(">"), line[found.end() :]) if found else (0, line))
    own, quotes, number = [], [], 0
    upcoming = [0] * (len(lines) + 1)  # level of the next line that is quoted or not blank
    for k in range(len(lines) - 1, -1, -1):
        level, rest = lines[k]
        upcoming[k] = level if level or rest.strip() else upcoming[k + 1]
    for k, (level, line) in enumerate(lines):
        if not level:
            if not (upcoming[k + 1] and ANNOUNCED.search(line[-200:])):
                own.append(line)
            continue
        if k and lines[k - 1][0] == level:
            continue
        end = k
        while end < len(lines) and lines[end][0] == level:
            end += 1
        block = [n for _, rest in lines[k:end] if (n := normal(rest))]
        if block:
            quotes += [(number, level, digest(x), len(x.split())) for x in ([" ".join(block)] + (block if len(block) > 1 else []))]
            number += 1
    kept = "\n".join(own).strip("\n") if number else text
    paragraphs: list[list[str]] = [[]]
    for line in map(normal, kept.split("\n")):
        if line:
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    whole = " ".join(" ".join(part) for part in paragraphs if part)
    hashes = {digest(x) for x in [whole, *(x for part in paragraphs for x in [" ".join(part), *part])] if x}
    return kept, sorted(hashes), quotes, max((level for level, _ in lines), default=0)


SCHEMA = "conv_id long, turn long, role string, text string, own array<long>, quotes array<struct<number:int,level:int,hash:long,words:int>>, levels int"


def parsed(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("number", pa.int32()), ("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))
        for batch in batches:
            texts, own, quotes, levels = zip(*(parse(t) for t in batch.column(3).to_pylist()), strict=True) if batch.num_rows else ((),) * 4
            columns = [pa.array(texts, pa.string()), pa.array(own, pa.list_(pa.int64())), pa.array([[dict(zip(("number", "level", "hash", "words"), q, strict=True)) for q in qs] for qs in quotes], kind), pa.array(levels, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["conv_id", "turn", "role", "text", "own", "quotes", "levels"])

    plain = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, SCHEMA).withColumn("row", F.monotonically_increasing_id())


def links(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(conv_id, turn, number, level, words, to_conv, to_turn) of each quoted passage that was found, from parsed rows."""
    quoted = materialize(rows.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct())
    wanted = quoted.select("hash").distinct()
    own = rows.where("turn is not null").select("conv_id", "turn", F.explode("own").alias("hash")).join(wanted, "hash", "left_semi")
    here = materialize(own.groupBy("conv_id", "hash").agg(F.min("turn").alias("here_turn")))
    # the first holders of a passage in two conversations: one of them is another than the quoting one
    first = materialize(here.groupBy("hash").agg(F.min(F.struct("conv_id", "here_turn")).alias("first")))
    rest = here.join(first, "hash").where(~F.col("conv_id").eqNullSafe(F.col("first.conv_id")))
    second = rest.groupBy("hash").agg(F.min(F.struct("conv_id", "here_turn")).alias("second"))
    there = materialize(first.join(second, "hash", "left"))
    same = quoted.join(here.withColumnRenamed("conv_id", "_conv").withColumnRenamed("hash", "_hash"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("hash") == F.col("_hash")) & (F.col("here_turn") < F.col("turn")), "left")
    found = materialize(same.drop("_conv", "_hash")).join(there, "hash", "left")
    other = F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first"))
    far = F.col("here_turn").isNull() & (F.col("words") >= least)
    return found.withColumn("there", other).select(
        "conv_id", "turn", "number", "level", "words",
        F.when(F.col("here_turn").isNotNull(), F.col("conv_id")).when(far, F.col("there.conv_id")).alias("to_conv"),
        F.when(F.col("here_turn").isNotNull(), F.col("here_turn")).when(far, F.col("there.here_turn")).alias("to_turn"),
    ).where("to_turn is not null")


def carried(turns: DataFrame, value: str, out: str, ahead: int) -> DataFrame:
    """Adds the greatest ``value`` of the conversation up to ``ahead`` turns from a turn, from one row for each turn."""
    ranged = turns.withColumn("_range", F.floor(F.col("turn") / RANGE).cast("long"))
    most = ranged.groupBy("conv_id", "_range").agg(F.max(value).alias("_most"))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = most.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_at"), F.max("_most").over(earlier).alias("_last"))
    inside = Window.partitionBy("conv_id", "_range").orderBy("turn").rangeBetween(Window.unboundedPreceding, ahead)
    joined = ranged.withColumn(out, F.max(value).over(inside)).join(materialize(before), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn(out, F.coalesce(out, "_last")).drop("_range", "_conv", "_at", "_last")


def branches(turns: DataFrame) -> DataFrame:
    """(conv_id, head, path) of the runs that go back to an earlier message, from (conv_id, turn, start, to, head).

    A path is what orders a run: for each branch from the conversation's first run on, the turn it goes back to, latest
    first, and its first turn. Each round doubles the part of a path that is known, so rounds are logarithmic in the depth.
    """
    own = F.array(F.struct((-F.col("to")).alias("back"), F.col("head").alias("at")))
    parents = turns.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("head").alias("up"))
    runs = turns.where("start").join(parents, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("to") == F.col("_turn")))
    known = materialize(runs.select("conv_id", "head", "up", own.alias("path")))
    while not known.where("up is not null").isEmpty():
        above = known.select(F.col("conv_id").alias("_conv"), F.col("head").alias("_head"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        joined = known.join(above, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("up") == F.col("_head")), "left")
        whole = F.concat(F.coalesce("_path", F.array().cast(known.schema["path"].dataType)), "path")
        known = materialize(joined.select("conv_id", "head", F.col("_up").alias("up"), whole.alias("path")))
    return known.select("conv_id", "head", "path")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds position: rows (conv_id, ...) numbered in each conversation by ``order``, by a sort over ranges and counts of its parts."""
    keys = [F.col("conv_id"), *map(F.col, order), F.col("_salt")]
    salted = rows.withColumn("_salt", F.pmod(F.col("row"), F.lit(4093)))  # parts rows that are equal otherwise
    placed = salted.repartitionByRange(salts_for(rows.sparkSession), *keys).sortWithinPartitions(*keys).drop("_salt")
    placed = materialize(placed.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_id", F.col("_id").bitwiseAND((1 << 33) - 1)))
    parts = placed.groupBy("_part", "conv_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("_part").alias("_p"), F.col("conv_id").alias("_conv"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_add"))
    joined = placed.join(materialize(starts), (F.col("_part") == F.col("_p")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.withColumn("position", F.col("_id") + F.col("_add")).drop("_id", "_part", "_p", "_conv", "_add")


def conversations(messages: DataFrame, least: int = LEAST) -> DataFrame:
    """(conv_id, position, turn, role, text, levels, quotes, linked, reply_conv, reply_turn) of messages (conv_id, turn, role, text)."""
    rows = materialize(parsed(messages))
    found = materialize(links(rows, least))
    linked = found.groupBy("conv_id", "turn").agg(F.countDistinct("number").alias("linked"))
    votes = found.where("level = 1").groupBy("conv_id", "turn", "to_conv", "to_turn").agg(F.sum("words").alias("words"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("words", "to_turn", "to_conv")).alias("b"))
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
    named = lambda frame: frame.withColumnsRenamed({"conv_id": "_conv", "turn": "_turn"})
    replies = materialize(linked.join(named(best), here, "left").select("conv_id", "turn", "linked", "b"))
    turns = materialize(carried(rows.where("turn is not null").select("conv_id", "turn").distinct(), "turn", "before", -1))
    turns = turns.join(named(replies), here, "left").drop("_conv", "_turn")
    turns = turns.withColumn("to", F.when(F.col("b.to_conv").eqNullSafe(F.col("conv_id")), F.col("b.to_turn")))
    turns = turns.withColumn("start", F.coalesce((F.col("to") != F.col("before")), F.lit(False))).withColumn("_start", F.when(F.col("start"), F.col("turn")))
    turns = materialize(carried(materialize(turns), "_start", "head", 0).drop("_start"))
    runs = materialize(branches(turns)).withColumnsRenamed({"conv_id": "_conv", "head": "_head"})
    placed = turns.join(runs, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("head") == F.col("_head")), "left").select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "before", "linked", "b", "path")
    lone = named(replies.where("turn is null")).select("_conv", "_turn", F.lit(None).cast("long").alias("before"), "linked", "b", F.lit(None).cast(placed.schema["path"].dataType).alias("path"))
    slim = rows.select("row", "conv_id", "turn", "role", F.xxhash64("text").alias("_text"))
    keyed = slim.join(placed.unionByName(lone), here, "left").drop("_conv", "_turn").withColumn("path", F.coalesce("path", F.array().cast(placed.schema["path"].dataType)))
    ordered = numbered(materialize(keyed), ["path", "turn", "role", "_text"]).select("row", "position", "before", "linked", "b")
    quotes = F.size(F.array_distinct(F.transform("quotes", lambda q: q["number"]))).alias("quotes")
    joined = rows.select("row", "conv_id", "turn", "role", "text", "levels", quotes).join(ordered, "row")
    return joined.select(
        "conv_id", "position", "turn", "role", "text", "levels", "quotes", F.coalesce("linked", F.lit(0)).alias("linked"),
        F.when(F.col("b").isNotNull(), F.col("b.to_conv")).when(F.col("before").isNotNull(), F.col("conv_id")).alias("reply_conv"),
        F.when(F.col("b").isNotNull(), F.col("b.to_turn")).otherwise(F.col("before")).alias("reply_turn"),
    )
