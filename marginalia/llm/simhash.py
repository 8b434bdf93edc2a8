"""Operator 9: SimHash near-duplicate groups, found with vantage-point trees.

Fingerprints are 64-bit SimHashes of three-word shingles. Two link when at most ``radius`` bits
differ. A vantage-point tree over a bounded sample of the fingerprints deals all of them to
shards: a node sends a fingerprint inside or outside by its Hamming distance to the node's
vantage point, and the triangle bound says which other shards its ball reaches. A shard compares
its members with each other and with the visitors whose balls reach it, again by such a tree,
and reports a spanning forest of the links, which joins into components.

Nulls and odd rows: a null, empty or blank text has fingerprint zero and links like any other;
texts under three words are one shingle; a null doc_id never becomes a component_id (a component
without any id has a null one). Repeated rows keep one result row each. Further columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialize
from .components import connected_components

#: Fingerprints a shard holds, about.
SHARD = 3000
#: The shards' tree is fitted on 16 fingerprints of a shard, and on so many at least and at most, about; with more than
#: MOST_SAMPLE * SHARD / 16 fingerprints (750 million) shards grow with the input.
SAMPLE, MOST_SAMPLE = 60_000, 4_000_000
#: Members up to which a shard compares all pairs.
BRUTE = 192
SEED = 42


def text_fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of one text: a bit is set if over half of the shingles' hashes have it."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((text_fingerprint(t.as_py(), size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Tree:
    """Vantage-point tree over uint64 fingerprints; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int, seed: int = 7):
        self.radius, self.leaves, self._rng = radius, 0, np.random.default_rng(seed)
        self.root = self._grow(sample, leaf)

    def _grow(self, points: np.ndarray, leaf: int):
        if len(points) > leaf and (cut := best_cut(points, self.radius, self._rng)):
            vantage, limit, inside = cut
            return vantage, limit, self._grow(points[inside], leaf), self._grow(points[~inside], leaf)
        self.leaves += 1
        return self.leaves - 1

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fps, leaf, is member): each fingerprint once as a member, and as a visitor in other leaves its ball reaches.

        Of two fingerprints that a node parts, only the outer one visits the other's side; so each pair meets.
        """
        found: list[tuple[np.ndarray, int, bool]] = []

        def down(node, members: np.ndarray, visitors: np.ndarray) -> None:
            if isinstance(node, int):
                found.extend([(members, node, True), (visitors, node, False)])
                return
            vantage, limit, inner, outer = node
            d, e = distance(fps[members], vantage), distance(fps[visitors], vantage)
            near = members[(d > limit) & (d - self.radius <= limit)]
            down(inner, members[d <= limit], np.concatenate([near, visitors[e - self.radius <= limit]]))
            down(outer, members[d > limit], visitors[e + self.radius > limit])

        down(self.root, np.arange(len(fps)), np.arange(0))
        return (
            np.concatenate([i for i, _, _ in found]),
            np.concatenate([np.full(len(i), k) for i, k, _ in found]),
            np.concatenate([np.full(len(i), m) for i, _, m in found]),
        )


def distance(fps: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ vantage).astype(np.int16)


def best_cut(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 6):
    """Of some vantage points and distances, the cut with the fewest points near it; None if no cut parts the points well."""
    best, least = None, 0.75
    for vantage in rng.choice(points, tries):
        d = distance(points, vantage)
        for limit in {int(np.quantile(d, q)) for q in (0.35, 0.5, 0.65)}:
            share = float(np.mean(d <= limit))
            cost = float(np.mean((d > limit - radius) & (d <= limit + radius))) + abs(share - 0.5)
            if 0.1 <= share <= 0.9 and cost < least:
                best, least = (vantage, limit, d <= limit), cost
    return best


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = parent[x]
    while not np.array_equal(up := parent[x], x):
        x = up
    return x


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def shard_links(fps: np.ndarray, member: np.ndarray, radius: int) -> np.ndarray:
    """Position of each fingerprint's root among the links of one shard: members with members and visitors."""
    parent, rng = np.arange(len(fps)), np.random.default_rng(len(fps))

    def compare(members: np.ndarray, visitors: np.ndarray) -> None:
        rows, step = np.concatenate([members, visitors]), max(1, 4_000_000 // max(1, len(members)))
        for at in range(0, len(rows), step):
            block = rows[at : at + step]
            i, j = np.nonzero(np.bitwise_count(fps[block][:, None] ^ fps[members][None, :]) <= radius)
            _unite(parent, block[i], members[j])

    def down(members: np.ndarray, visitors: np.ndarray) -> None:
        if not len(members):
            return
        cut = best_cut(fps[members], radius, rng, 3) if len(members) > BRUTE else None
        if not cut:
            compare(members, visitors)
            return
        vantage, limit, inside = cut
        d, e = distance(fps[members], vantage), distance(fps[visitors], vantage)
        near = members[(d > limit) & (d - radius <= limit)]
        down(members[inside], np.concatenate([near, visitors[e - radius <= limit]]))
        down(members[~inside], visitors[e + radius > limit])

    down(np.flatnonzero(member), np.flatnonzero(~member))
    return _find(parent, np.arange(len(fps)))


def near_links(fps: DataFrame, radius: int = 2, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of distinct fingerprints (column fp) at most ``radius`` bits apart."""
    n = fps.count()
    every = max(1, -(-n // min(MOST_SAMPLE, max(sample, 16 * n // shard))))
    picked = fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").toPandas()["fp"].to_numpy(np.int64)
    tree = fps.sparkSession.sparkContext.broadcast(Tree(np.sort(picked).view(np.uint64), max(16, shard // every), radius))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame["fp"].to_numpy(np.int64)
            i, leaf, member = tree.value.route(values.view(np.uint64))
            yield pd.DataFrame({"leaf": leaf, "fp": values[i], "member": member})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame["fp"].to_numpy(np.int64)
        root = shard_links(values.view(np.uint64), frame["member"].to_numpy(bool), radius)
        moved = root != np.arange(len(values))
        return pd.DataFrame({"u": values[moved], "v": values[root[moved]]})

    routed = fps.select("fp").mapInPandas(route, "leaf int, fp long, member boolean")
    return routed.groupBy("leaf").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text)."""
    prints = materialize(fingerprints(docs))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(distinct, radius)).withColumnRenamed("node", "fp")
    labelled = materialize(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = materialize(labelled.join(materialize(ids), "root").select("fp", "component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")
