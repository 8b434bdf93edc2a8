"""Operator 8: shards by balanced label propagation.

Documents with equal keys are linked. Every document starts in the shard its doc_id hashes to. The
documents of a group in one shard are alike, so the state is a table (group, start, shard, rows) of linked
documents only; a group larger than half a shard has some such parts for each start. In each round every group aims at the shard that holds most of it, one with room for the rest first if it
was refused before; a group larger than half a shard aims at as many shards as it needs, those first where no other group has
more. How much of all that wants to go from shard to shard may go follows from the quotas: each target's
share of what it is asked to take is as large as its free room and what leaves it allow, all shares together. A hash of the group
grants moves by that share, so groups move whole, and no shard gathers much more than its quota.

Then the law ``rows`` is made to hold, counts at most one apart: only the rows that a shard has over its count leave it,
documents without links first, then those of groups that are cut already, then whole groups one after another, and they fill the shards that
have too few in this order. Ranks come from salted counts, never from one task per shard.

Nulls and odd rows: a null text counts as empty; null doc_ids hash like a value of their own; repeated
rows are rows of their own and linked. Other columns are ignored. An empty table has empty shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, rank_within, salts_for

SHARDS = 24
ROUNDS = 6
#: What a shard may hold while groups move, over the mean, and units into which a start's rows of a group over half a shard are parted.
SLACK, PIECES = 1.05, 64


def _start(shards: int, *columns: str):
    return F.pmod(F.xxhash64(*columns, F.lit(8)), F.lit(shards)).cast("int")


def granted_shares(flows: np.ndarray, load: np.ndarray, quota: float) -> np.ndarray:
    """Of what wants to go to each shard, the share that may: flows[s, t] rows from s to t, at loads and one quota.

    A shard can take its free room and what leaves it, which depends on the others' shares; these fall until all quotas hold.
    """
    shares = np.ones(len(load))
    for _ in range(100):
        can = quota - load + flows @ shares
        shares = np.minimum(shares, np.clip(can / np.maximum(flows.sum(axis=0), 1), 0, 1))
    return shares


def _aims(state: DataFrame, quota: float, turn: int) -> DataFrame:
    """(group, plan): the shards that a group aims at, best first, with the moving rows up to which each takes them."""
    held = state.groupBy("group", "shard").agg(F.sum("rows").alias("held"))
    of_shard = held.groupBy("shard").agg(F.sum("held").alias("load"), F.max(F.struct("held", "group")).alias("top"))
    every = Window.partitionBy("group")
    sized = held.join(F.broadcast(of_shard), "shard").withColumn("n", F.sum("held").over(every))  # one row for each shard is broadcast
    large = F.col("n") > quota / 2
    fits = F.when(large, F.col("top.group") == F.col("group")).otherwise((F.lit(quota) - F.col("load") >= F.col("n") - F.col("held")) & F.lit(turn > 0))
    first = every.orderBy(F.desc(fits), F.desc("held"), F.xxhash64("group", "shard", F.lit(turn)))
    mean = F.lit(quota / SLACK)
    ranked = sized.withColumn("_k", F.row_number().over(first)).withColumn("_to", F.sum(F.greatest(mean - F.col("held"), F.lit(0.0))).over(first.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.where((F.col("_k") == 1) | large & ((F.col("_k") - 1) * mean < F.col("n") - 0.5))  # half a row: quotas are fractions
    plan = F.sort_array(F.collect_list(F.struct("_k", "shard", "_to")))  # one for each shard at most
    return kept.groupBy("group").agg(plan.alias("plan"))


def propagate(units: DataFrame, total: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """(group, start, rows, shard) after label propagation of units (group, start, rows) of linked rows, of ``total`` rows in all.

    A unit starts in the shard that its start is by modulo.
    """
    state, quota = materialize(units.withColumn("shard", F.pmod("start", F.lit(shards)).cast("int"))), SLACK * total / shards
    spark = state.sparkSession
    for turn in range(rounds):
        placed = state.join(materialize(_aims(state, quota, turn)), "group").withColumn("stays", F.exists("plan", lambda x: x["shard"] == F.col("shard")))
        in_line = Window.partitionBy("group").orderBy("stays", F.xxhash64("group", "start", F.lit(turn))).rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.withColumn("_at", F.sum("rows").over(in_line) - F.col("rows") / 2)  # a group has a few units for each shard at most
        open_ = F.filter("plan", lambda x: x["_to"] > F.col("_at"))
        target = F.when(F.col("stays"), F.col("shard")).when(F.size(open_) > 0, open_[0]["shard"]).otherwise(F.col("plan")[0]["shard"])
        wants = materialize(placed.select("group", "start", "rows", "shard", target.alias("target"), (F.size("plan") > 1).alias("large")))
        flows, load = np.zeros((shards, shards)), np.zeros(shards)
        for r in wants.groupBy("shard", "target").agg(F.sum("rows").alias("n")).collect():  # shards squared at most
            load[r["shard"]] += r.n
            flows[r["shard"], r.target] += r.n if r["shard"] != r.target else 0
        if not flows.any():
            break
        shares = granted_shares(flows, load, quota)
        granted = spark.createDataFrame([(s, float(x)) for s, x in enumerate(shares)], "target int, share double")
        draw = F.pmod(F.xxhash64("group", "target", F.when(F.col("large"), F.col("start")), F.lit(turn + 100)), F.lit(1 << 20)) / (1 << 20)
        moved = F.when(draw < F.col("share"), F.col("target")).otherwise(F.col("shard")).cast("int")
        state = materialize(wants.join(F.broadcast(granted), "target").select("group", "start", "rows", moved.alias("shard")))
    return state


def balanced_shards(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Adds shard and slot to materialized rows (doc_id, group, ...): linked by equal group, counts at most one apart."""
    rows = materialize(rows.withColumn("_start", _start(shards, "doc_id", "group")))
    total = rows.count()
    linked = materialize(rows.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    large = linked.where(F.col("_n") > SLACK * total / shards / 2).select("group", F.lit(PIECES).alias("_parts"))  # 2 for each shard at most
    piece = F.pmod(F.xxhash64("doc_id", "group", F.lit(4)), F.coalesce("_parts", F.lit(1)))
    rows = rows.join(F.broadcast(large), "group", "left").withColumn("_start", F.col("_start") + F.lit(shards) * piece).drop("_parts")
    units = rows.groupBy("group", F.col("_start").alias("start")).agg(F.count(F.lit(1)).alias("rows"))
    state = propagate(materialize(units.join(linked.select("group"), "group", "left_semi")), total, shards, rounds)
    whole = Window.partitionBy("group")
    zones = state.withColumn("_cut", F.min("shard").over(whole) != F.max("shard").over(whole))
    moved = materialize(zones.select("group", F.col("start").alias("_start"), F.col("shard").alias("_moved"), F.when(F.col("_cut"), 1).otherwise(2).alias("_linked")))
    placed = rows.join(moved, ["group", "_start"], "left").select(
        *[c for c in rows.columns if c != "_start"],
        F.coalesce("_moved", F.pmod("_start", F.lit(shards))).cast("int").alias("_shard"), F.coalesce("_linked", F.lit(0)).cast("int").alias("_zone"),
    )
    return _level(materialize(placed), shards, total)


def _rank_by_group(linked: DataFrame) -> DataFrame:
    """Adds _rank to linked rows: the rows of a group follow each other. No group is gathered in one task."""
    keys = ["_shard", "_zone"]
    salted = F.pmod(F.xxhash64("group", F.lit(17)), F.lit(salts_for(linked.sparkSession))).cast("int")
    groups = materialize(linked.groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("_n")).withColumn("_salt", salted))
    salts = groups.groupBy(*keys, "_salt").agg(F.sum("_n").alias("_n"))
    above = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_start"))
    before = Window.partitionBy(*keys, "_salt").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(starts, [*keys, "_salt"])
    first = first.select(*keys, "group", (F.col("_start") + F.col("_before")).alias("_from"))
    inside = materialize(rank_within(linked, [*keys, "group"], F.struct("group", "doc_id"), [F.col("doc_id")], "_in"))
    return inside.join(first, [*keys, "group"]).withColumn("_rank", F.col("_from") + F.col("_in")).drop("_from", "_in")


def _level(placed: DataFrame, shards: int, total: int) -> DataFrame:
    """Adds shard and slot: rows (_shard, _zone, group) stay, but for those over a shard's count of total // shards, one more for the first shards.

    A shard's rows are numbered by zone (0: no links, 1: of cut groups, 2: of whole ones), groups one after another; the first ones leave.
    """
    lone = rank_within(placed.where("_zone = 0"), ["_shard", "_zone"], F.struct("group", "doc_id"), [F.col("group"), F.col("doc_id")], "_rank")
    ranked = lone.unionByName(_rank_by_group(placed.where("_zone > 0")))
    sizes = placed.groupBy("_shard", "_zone").agg(F.count(F.lit(1)).alias("n")).collect()  # three for each shard at most
    count = np.zeros((shards, 3), np.int64)
    for r in sizes:
        count[r["_shard"], r["_zone"]] = r.n
    quota = total // shards + (np.arange(shards) < total % shards)
    over = np.maximum(count.sum(axis=1) - quota, 0)
    under = np.maximum(quota - count.sum(axis=1), 0)
    before = np.cumsum(count, axis=1) - count
    leave, enter = np.cumsum(over) - over, np.cumsum(under) - under
    spark = placed.sparkSession
    places = [(s, z, int(before[s, z]), int(over[s]), int(leave[s])) for s in range(shards) for z in range(3)]
    places = spark.createDataFrame(places, "_shard int, _zone int, _before long, _over long, _leave long")
    numbered = ranked.join(F.broadcast(places), ["_shard", "_zone"]).withColumn("_number", F.col("_before") + F.col("_rank"))
    goes = F.col("_number") < F.col("_over")
    gaps = F.array(*[F.struct(F.lit(int(s)).alias("shard"), F.lit(int(enter[s])).alias("from"), F.lit(int(enter[s] + under[s])).alias("to"), F.lit(int(count[s].sum())).alias("slot")) for s in range(shards) if under[s]])
    line = F.col("_leave") + F.col("_number")
    gap = F.filter(gaps, lambda g: (g["from"] <= line) & (line < g["to"]))[0] if under.any() else None
    to = F.when(goes, gap["shard"]).otherwise(F.col("_shard")) if gap is not None else F.col("_shard")
    slot = F.when(goes, gap["slot"] + line - gap["from"]).otherwise(F.col("_number") - F.col("_over")) if gap is not None else F.col("_number")
    found = numbered.withColumns({"shard": to.cast("int"), "slot": slot.cast("long")})
    return found.drop("_shard", "_zone", "_before", "_over", "_leave", "_number", "_rank")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot) for documents (doc_id, text); equal texts are linked."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(raw).alias("group"),
    )
    return balanced_shards(rows, shards, rounds)
