"""Operator 4: mix sources to target weights by entropy balancing.

Of all rates whose words add up to each source's target, entropy balancing takes those nearest to
1 in (word-weighted) relative entropy. They are exponentially tilted, rate = exp(dual of the
source), and the duals minimise the convex function sum(words * exp(dual)) - sum(dual * target).
Newton steps find them on a table of one row per source; the words of a source are summed on the
map side before. Rates become whole copies by carrying the words owed along the documents of a
chunk of a source, largest first, so that a chunk ends about half of its smallest document away.

Targets share all words by weight; a target stops at ``cap`` times its source's words and the
excess is shared out again by weight.

Nulls and odd rows: a null text has size 0, a null source is a source of its own that comes last;
documents without words take none; a null doc_id is ordered first. Repeated rows are rows of their own. Where
more than CHUNK rows are equal in all columns, they are counted instead, dealt in pieces of CHUNK rows, and each
piece is rounded as a whole, so no task gathers them and the result doesn't depend on how the table is stored.
Other columns pass through ``mix`` unchanged; they must be hashable (no maps) and not be named ``_mix_*``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that are rounded together, about, and equal rows of a piece at most.
CHUNK = 1024
#: Newton steps between two tables, and tables at most.
STEPS, ROUNDS = 5, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_rows, source_size, target) from rows of (source, _mix_size).

    One row per source goes through one task here, never documents. Water filling: in order of
    cap per weight, a source is full while the level of all from it on would reach its cap.
    """
    by = sizes.groupBy("source").agg(F.sum("_mix_size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by = by.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    by = by.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_k")
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("_full", F.col("_cap") <= F.col("_w") * level)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0.0))
    share = rest * F.col("_w") / F.sum(F.when(~F.col("_full"), F.col("_w"))).over(every)
    return by.select("source", "source_rows", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(share).alias("target"))


def solve_duals(targets: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Adds dual, by Newton steps from 0: gradient words * exp(dual) - target, curvature words * exp(dual)."""
    solvable = (F.col("source_size") > 0) & (F.col("target") > 0)
    state = materialize(targets.withColumn("dual", F.when(solvable, F.lit(0.0))))
    for _ in range(ROUNDS):
        step = state
        for _ in range(STEPS):
            moved = F.col("target") / (F.col("source_size") * F.exp("dual")) - 1
            step = step.withColumn("dual", F.col("dual") + F.least(moved, F.lit(2.0)))
        state = materialize(step)
        miss = state.agg(F.max(F.abs(F.col("source_size") * F.exp("dual") / F.col("target") - 1))).first()[0]
        if miss is None or miss <= tolerance:
            return state
    raise RuntimeError(f"the duals did not settle: {miss}")


def marked(rows: DataFrame) -> DataFrame:
    """Adds a hash of all columns, by which equal rows are found and ties are ordered."""
    return rows.withColumn("_mix_mark", F.xxhash64(*rows.columns))


def in_pieces(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds _mix_count and _mix_piece to marked rows: more than CHUNK equal rows become one row for each CHUNK of them.

    Counts are summed on the map side first. A kept row stands for more than CHUNK others, so the broadcast
    table has at most a CHUNK-th of the rows.
    """
    key = ["doc_id", "_mix_size", "_mix_mark"]
    same = sizes.groupBy(*key).agg(F.count(F.lit(1)).alias("_mix_rows")).where(F.col("_mix_rows") > CHUNK)
    heavy = materialize(same.select(F.col("doc_id").alias("_mix_d"), F.col("_mix_size").alias("_mix_n"), F.col("_mix_mark").alias("_mix_m"), "_mix_rows"))
    single = lambda df: df.withColumn("_mix_count", F.lit(1).cast("long")).withColumn("_mix_piece", F.lit(0).cast("long"))
    if heavy.isEmpty():
        return single(rows)
    on = F.col("doc_id").eqNullSafe(F.col("_mix_d")) & (F.col("_mix_size") == F.col("_mix_n")) & (F.col("_mix_mark") == F.col("_mix_m"))
    light = single(rows.join(heavy, on, "left_anti"))
    kept = rows.join(heavy, on).dropDuplicates(key)
    kept = kept.withColumn("_mix_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_mix_rows") / CHUNK) - 1)))
    kept = kept.withColumn("_mix_count", F.least(F.lit(CHUNK), F.col("_mix_rows") - F.col("_mix_piece") * CHUNK).cast("long"))
    return light.unionByName(kept.select(*light.columns))


def mix(rows: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, sizes: DataFrame | None = None) -> DataFrame:
    """Adds source_size, target, rate and copies to rows of (doc_id, source, _mix_size, ...).

    sizes: (doc_id, source, _mix_size, _mix_mark) of the same rows as a written table, if they are costly to make.
    """
    rows = marked(rows)
    sizes = rows if sizes is None else sizes
    solved = solve_duals(source_targets(sizes.select("source", "_mix_size"), weights, cap))
    solved = materialize(
        solved.select(
            F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"),
            F.least(F.coalesce(F.exp("dual"), F.lit(0.0)), F.lit(float(cap))).alias("_mix_rate"),
            F.greatest(F.ceil(F.col("source_rows") / CHUNK), F.lit(1)).alias("_mix_chunks"),
        )
    )
    joined = in_pieces(rows, sizes).join(solved, F.col("source").eqNullSafe(F.col("_mix_source")))
    chunk = F.pmod(F.xxhash64("doc_id", "_mix_size", "_mix_mark", "_mix_piece"), F.col("_mix_chunks"))
    joined = joined.withColumn("_mix_chunk", chunk).drop("_mix_source", "_mix_chunks")
    inner = ["_mix_chunk", "_mix_mark", "_mix_piece", "_mix_count"]
    fields = [f for f in joined.schema.fields if f.name not in inner]
    schema = StructType([*fields, StructField("_mix_copies", LongType()), StructField("_mix_times", LongType())])

    def run(table: pa.Table) -> pa.Table:
        place, copies, times = round_chunk(table, cap)
        found = table.drop_columns(inner).take(pa.array(place))
        return found.append_column("_mix_copies", pa.array(copies)).append_column("_mix_times", pa.array(times))

    rounded = joined.groupBy("source", "_mix_chunk").applyInArrow(run, schema)
    return rounded.withColumn("_mix_time", F.explode(F.sequence(F.lit(1), F.col("_mix_times").cast("int")))).drop("_mix_time", "_mix_times")


def round_chunk(table: pa.Table, cap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a chunk's rows, whole copies of each and how many equal rows get them.

    The words owed are carried from each row to the next smaller one. Copies of a piece of equal rows are shared
    out evenly: some of its rows may get one copy more than the others.
    """
    keys = [("_mix_size", "descending"), ("doc_id", "ascending"), ("_mix_mark", "ascending"), ("_mix_piece", "ascending")]
    order = pc.sort_indices(table, sort_keys=keys).to_numpy()
    sizes, rates, counts = (table[c].to_numpy() for c in ("_mix_size", "_mix_rate", "_mix_count"))
    copies, owed = np.zeros(len(sizes), np.int64), 0.0
    for i in order:
        if sizes[i] > 0:
            owed += sizes[i] * rates[i] * counts[i]
            copies[i] = min(int(cap) * counts[i], max(0, math.floor(owed / sizes[i] + 0.5)))
            owed -= copies[i] * sizes[i]
    each, more = copies // counts, copies % counts
    place = np.concatenate([np.arange(len(sizes)), np.flatnonzero(more)])
    return place, np.concatenate([each, each[more > 0] + 1]), np.concatenate([counts - more, more[more > 0]])


def mix_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of ``docs``."""
    sized = docs.withColumn("_mix_size", word_count(F.col("text")))
    sizes = materialize(marked(sized).select("doc_id", "source", "_mix_size", "_mix_mark"))
    taken = mix(sized, weights, cap, sizes).where("_mix_copies > 0")
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*docs.columns)
