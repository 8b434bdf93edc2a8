"""Near copies for operator 9's place in a pipeline: five-word shingle sets with a Jaccard coefficient of 0.8 or more.

Texts with equal shingle sets are one class. Operator 9's vantage-point trees link the classes whose five-word SimHashes
differ in at most RADIUS bits. At a likeness of 0.8 fingerprints differ in about 10 of 64 bits, where a triangle
bound no longer parts anything, so the other links come from buckets: BANDS hashes of WIDTH minima each bring classes
together, and a pair of likeness 0.8 meets in no bucket with a probability of (1 - 0.8 ** WIDTH) ** BANDS, below one in
100,000. Every link is checked on the whole sets.

First each class is compared with leaders, the classes of its buckets that come first by hash; links join into components, and
buckets that lie in one component are done. Of the others, those of at most SMALL classes bring all their pairs of two
components. Larger ones that share classes are taken together and cut into blocks of at most BLOCK classes; a task compares two
blocks by a matrix product over the shingles that occur twice in them, and tells a spanning forest of the links. Blocks of one component
are not compared with each other. So every pair that meets in a bucket is compared or is in one component already: nothing is capped.

Nulls and odd rows: null, empty and blank texts are one class; a text under five words is one shingle; case
and white space are ASCII's. Repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from . import simhash
from .common import materialize
from .components import connected_components

SIZE = 5
#: Likeness of near copies, as a fraction.
LEAST, OF = 4, 5
BANDS, WIDTH = 64, 8
RADIUS = 2
#: Leaders of a bucket, and those that a class is compared with first. Classes of a bucket whose pairs are listed one by one.
LEADERS, TRIED, SMALL = 3, 3, 64
#: Classes and shingles of a block, and shingles that a matrix product takes at once. Texts that are hashed together.
BLOCK, HELD, COLUMNS = 2048, 4_000_000, 4096
SLICE = 1000
SEED = 42
_RNG = np.random.default_rng(5)
_TIMES = _RNG.integers(0, 1 << 31, BANDS * WIDTH).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, BANDS * WIDTH).astype(np.uint32)


def hashes(text: str | None, size: int = SIZE) -> np.ndarray:
    """64-bit hashes of the shingles of one text, repeats included."""
    words = (text or "").encode().lower().split()
    parts = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the shingles of one text."""
    return np.unique(hashes(text, size).astype(np.uint32))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A hash of each band's minima."""
    least = np.full(BANDS * WIDTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 128):
        np.minimum(least, (found[at : at + 128, None] * _TIMES + _PLUS).min(axis=0), out=least)
    rows = least.reshape(BANDS, WIDTH)
    return np.array([xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, class, n, fp, shingles, keys): mark is a hash of the text, class one of its shingle set, fp the SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                every = [hashes(t.as_py()) for t in batch.column(2)]
                fp = np.array([simhash.majority(h) for h in every], np.uint64).view(np.int64)
                sets = [np.unique(h.astype(np.uint32)) for h in every]
                of = np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                n = np.array([len(s) for s in sets], np.int32)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = pa.array(np.concatenate([*sets, np.empty(0, np.uint32)]).view(np.int32))
                keys = np.concatenate([*map(band_keys, sets), np.empty(0, np.int64)])
                each = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
                columns = [batch.column(0), batch.column(1), pa.array(of), pa.array(n), pa.array(fp), pa.ListArray.from_arrays(pa.array(ends), flat), pa.ListArray.from_arrays(each, pa.array(keys))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "class", "n", "fp", "shingles", "keys"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, class long, n int, fp long, shingles array<int>, keys array<long>")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets (class, shingles) are near copies."""
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("class").alias(c), F.col("shingles").alias(f"set_{c}")), c)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where(both * OF >= (F.size("set_a") + F.size("set_b") - both) * LEAST).select("a", "b")


def _labelled(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (class, n, key, root) of the buckets that hold more than one component."""
    rooted = shared.select("class", "n", "key").join(roots.withColumnRenamed("node", "class"), "class", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "class")))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("key")
    return materialize(rooted.join(mixed, "key", "left_semi"))


def _fits(a: str, b: str):
    return (F.col(a) * OF >= F.col(b) * LEAST) & (F.col(b) * OF >= F.col(a) * LEAST)


def print_pairs(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of classes (class, fp) of one fingerprint, or of two that operator 9's trees link; a spanning forest of them."""
    prints = materialize(classes.groupBy("fp").agg(F.min("class").alias("class")))
    same = classes.join(prints.select("fp", F.col("class").alias("b")), "fp").where("class <> b").select(F.col("class").alias("a"), "b")
    linked = simhash.near_links(prints, radius)
    for end, c in (("u", "a"), ("v", "b")):
        linked = linked.join(prints.select(F.col("fp").alias(end), F.col("class").alias(c)), end)
    return same.unionByName(linked.select("a", "b"))


def leader_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class with the leaders that it shares most buckets with, from members (class, n, key) of buckets."""
    least = [F.min(F.struct(F.xxhash64("class", F.lit(k)), "class", "n")).alias(f"_{k}") for k in range(LEADERS)]
    leaders = shared.groupBy("key").agg(*least).select("key", F.explode(F.array_distinct(F.array(*[F.struct(F.col(f"_{k}.class").alias("class"), F.col(f"_{k}.n").alias("n")) for k in range(LEADERS)]))).alias("c"))
    near = shared.join(leaders, "key").where(F.col("class") != F.col("c.class")).where(_fits("n", "c.n"))
    counts = near.groupBy(F.col("class").alias("a"), F.col("c.class").alias("b")).agg(F.count(F.lit(1)).alias("_m"))
    best = Window.partitionBy("a").orderBy(F.desc("_m"), "b")
    return counts.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= TRIED).select("a", "b")


def small_pairs(members: DataFrame) -> DataFrame:
    """All pairs (a, b) of two components in buckets of few classes, from members (class, n, key, root)."""
    a = members.select("key", F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    b = members.select("key", F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    return a.join(b, "key").where("a < b and root_a <> root_b").where(_fits("n_a", "n_b")).select("a", "b").distinct()


def compared(own: pa.Table, other: pa.Table | None) -> tuple[np.ndarray, np.ndarray]:
    """Links whose components are those of all near copies in one block or between two, as classes (u, v); tables have class, n, root, shingles."""
    tables = [own] if other is None else [own, other]
    classes, n, roots = (np.concatenate([t[c].to_numpy() for t in tables]) for c in ("class", "n", "root"))
    lists = [t["shingles"].combine_chunks() for t in tables]
    rows = np.repeat(np.arange(len(classes)), np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]))
    _, column, often = np.unique(np.concatenate([x.flatten().to_numpy() for x in lists]), return_inverse=True, return_counts=True)
    keep = often[column] > 1
    order = np.argsort(column[keep], kind="stable")
    rows, column = rows[keep][order], np.cumsum(often > 1)[column[keep][order]] - 1
    left = np.arange(own.num_rows)
    right = left if other is None else np.arange(own.num_rows, len(classes))
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(classes), COLUMNS), np.float32)
        part[rows[a:b], column[a:b] - at] = 1
        both += part[left] @ part[right].T
    near = both * (OF + LEAST) >= (n[left][:, None] + n[right][None, :]) * np.float32(LEAST)
    near &= roots[left][:, None] != roots[right][None, :]
    i, j = np.nonzero(near)
    parent = np.arange(len(classes))
    simhash._unite(parent, left[i], right[j])
    parent = simhash._find(parent, parent)
    moved = parent != np.arange(len(classes))
    return classes[moved], classes[parent[moved]]


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components in buckets of many classes, from members (class, n, key, root) and sets (class, shingles)."""
    firsts = materialize(members.groupBy("key").agg(F.min("class").alias("first")))
    edges = members.join(firsts, "key").select(F.col("class").alias("u"), F.col("first").alias("v"))
    groups = connected_components(edges)
    once = members.select("class", "n", "root").distinct().join(groups.select(F.col("node").alias("class"), F.col("root").alias("group")), "class", "left")
    once = materialize(once.withColumn("group", F.coalesce("group", "class")))
    # a component that fills blocks of its own has some; the classes of all others share blocks
    sizes = once.groupBy("group", "root").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_n"))
    blocks = lambda: F.greatest(F.ceil(F.sum("_m") / BLOCK), F.ceil(F.sum("_n") / HELD)).cast("int").alias("_blocks")
    sizes = sizes.withColumn("pure", F.when((F.col("_m") >= BLOCK // 4) | (F.col("_n") >= HELD // 4), F.col("root")))
    sizes = materialize(sizes)
    counts = materialize(sizes.groupBy("group", "pure").agg(blocks()))
    placed = once.join(sizes.select("group", "root", "pure"), ["group", "root"]).join(counts, (once["group"] == counts["group"]) & sizes["pure"].eqNullSafe(counts["pure"])).select(
        once["group"], "class", "n", once["root"], sizes["pure"], F.pmod(F.xxhash64("class", F.lit(3)), F.col("_blocks")).cast("int").alias("k")
    )
    placed = materialize(placed.withColumn("block", F.xxhash64(F.col("group"), F.coalesce("pure", F.lit(0)), F.col("pure").isNull(), F.col("k"))))
    known = materialize(placed.select("group", "pure", "block").distinct())
    other = known.select("group", F.col("pure").alias("pure_b"), F.col("block").alias("block_b"))
    pairs = known.join(other, "group").where("block <= block_b and (pure is null or pure_b is null or pure <> pure_b)")
    sides = pairs.select(F.explode(F.array(F.struct("block", F.lit(0).alias("side")), F.struct(F.col("block_b").alias("block"), F.lit(1).alias("side")))).alias("s"), F.xxhash64("block", "block_b").alias("pair"), (F.col("block") == F.col("block_b")).alias("own"))
    sides = sides.where("not own or s.side = 0").select("s.block", "s.side", "pair")
    filled = placed.select("class", "n", "root", "block").join(sets, "class")
    rows = filled.join(sides, "block").select("pair", "side", "class", "n", "root", "shingles")

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        own, other = (table.filter(pa.array(side == k)).combine_chunks() for k in (0, 1))
        u, v = compared(own, other if other.num_rows else None)
        return pa.table({"a": u, "b": v})

    return rows.groupBy("pair").applyInArrow(run, "a long, b long")


def class_roots(classes: DataFrame, prints: DataFrame) -> DataFrame:
    """(node, root) of each class that has a near copy, from classes (class, n, fp, keys) and prints (class, shingles)."""
    members = classes.select("class", "n", F.explode("keys").alias("key"))
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("key")
    shared = materialize(members.join(several, "key", "left_semi"))
    wanted = materialize(shared.select("class").distinct())
    sets = materialize(prints.select("class", "shingles").join(wanted, "class", "left_semi").dropDuplicates(["class"]))
    pairs = materialize(print_pairs(classes.select("class", "fp")).unionByName(leader_pairs(shared)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = materialize(alike(pairs, sets))

    def joined() -> DataFrame:
        return materialize(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    roots = joined()
    for few in (False, True):
        mixed = _labelled(shared, roots)
        sizes = materialize(mixed.groupBy("key").agg(F.count(F.lit(1)).alias("_m")))
        some = materialize(mixed.join(sizes.where(F.col("_m") <= SMALL if few else F.col("_m") > SMALL).select("key"), "key", "left_semi"))
        if some.isEmpty():
            continue
        found = materialize(alike(materialize(small_pairs(some)), sets) if few else block_links(some, sets))
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = joined()
    return roots


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, first) for each row of ``docs`` (doc_id, text): first is the least (doc_id, mark) of its near copies that have a doc_id."""
    prints = materialize(signed(docs))
    classes = materialize(prints.select("class", "n", "fp", "keys").dropDuplicates(["class"]))
    roots = class_roots(classes, prints)
    own = prints.select("doc_id", "mark", "class").join(roots.withColumnRenamed("node", "class"), "class", "left")
    rooted = materialize(own.select("doc_id", "mark", F.coalesce("root", "class").alias("root")))
    firsts = materialize(rooted.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first")))
    return rooted.join(firsts, "root", "left").select("doc_id", "mark", "first")
