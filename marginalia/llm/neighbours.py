"""Operator 6: approximate nearest neighbours over learned partitions.

On a bounded sample of the vectors, the graph of nearest neighbours is cut into balanced partitions
(median splits, then label propagation under a capacity), and a softmax classifier learns which partitions
hold a vector's neighbours. It deals every row to its most probable partition, and a query to its most
probable ones until their probabilities add up to a share, the least one that reached the wanted recall on
a part of the sample that was not learned from. There candidates are reranked by exact distances in double
precision. The number of partitions follows the square root of the rows; only fewer than 160 distinct vectors,
which cannot be learned from, are one partition. Partitions and the queries sent to one are read in blocks of
bounded size, and equal query vectors are searched once, so a frequent vector gathers nowhere.

The sample is ``sample`` distinct vectors or 80 for each partition, at most MOST_SAMPLE vectors and SAMPLE_BYTES
bytes, so there are at most MOST_SAMPLE / 80 partitions.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of
another length than the most frequent one and rows without an id. Ties go to smaller ids. Rows that repeat
an id are candidates of their own, but never of a query with that id. Components may be of any size: distances
are scaled where squares would overflow. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Vectors to learn from, at least and at most, and their bytes.
SAMPLE, MOST_SAMPLE, SAMPLE_BYTES = 12_000, 40_000, 1 << 26
#: Rows of a block of candidates, and of a block of queries.
BLOCK, ASKED = 4096, 16_384
#: Sampled vectors of a partition at least, and rows of a partition by the root of all rows.
LEARNED, GROWTH = 80, 8
#: Share of true neighbours that the probed partitions must hold on the sample.
RECALL = 0.95
SALTS = 16


def clean_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>, salt int) of the vectors that take part; materialized."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    taken = rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    # the salt parts rows that repeat an id; the written table keeps it
    found = materialize(taken.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(4093)).cast("int")))
    sizes = found.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return found.where(F.size("v") == sizes.n) if sizes else found


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, whatever the size of their components."""
    most = np.abs(x).max(axis=1, initial=0.0)
    unit = np.where((most > 0) & np.isfinite(most), most, 1.0)
    return unit * np.sqrt(((x / unit[:, None]) ** 2).sum(axis=1))


def distances(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to a vector; scaled only where plain squares overflow or vanish."""
    with np.errstate(over="ignore", under="ignore"):
        apart = c - q
        plain = np.sqrt((apart * apart).sum(axis=1))
        odd = ~np.isfinite(plain) | (plain < 1e-140)
        if odd.any():
            half = c[odd] / 2 - q / 2  # of two vectors near the largest double the difference overflows
            plain[odd] = 2 * norms(half)
    return plain


def nearest_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of each row's k nearest other rows."""
    out, norm = np.empty((len(x), k), np.int64), (x * x).sum(axis=1)
    for at in range(0, len(x), 1024):
        d = norm[None, :] - 2 * x[at : at + 1024] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[at : at + 1024] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1), axis=1)
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """Partition of each row: few edges of the graph between partitions, sizes within ``slack``."""
    label, groups = np.zeros(len(x), np.int64), [(np.arange(len(x)), 0, parts)]
    while groups:
        own, first, count = groups.pop()
        if count == 1:
            label[own] = first
            continue
        centred = x[own] - x[own].mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order, half = own[np.argsort(centred @ axis, kind="stable")], count // 2
        cut = len(own) * half // count
        groups += [(order[:cut], first, half), (order[cut:], first + half, count - half)]
    capacity = int(np.ceil(slack * len(x) / parts))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < capacity:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i], moved = best[i], moved + 1
        if not moved:
            break
    return label


def train_classifier(x: np.ndarray, wanted: np.ndarray, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Softmax regression of partition shares (rows x parts) on vectors, by Adam; the last row of weights is the bias."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = (np.zeros((x1.shape[1], wanted.shape[1])) for _ in range(3))
    for t in range(1, steps + 1):
        p = softmax(x1 @ w)
        g = x1.T @ (p - wanted) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Router:
    """Classifier weights, length of a usual vector, and the probability that a query's partitions must add up to."""

    def __init__(self, weights: np.ndarray, length: float = 1.0, share: float = 1.0):
        self.weights, self.length, self.share = weights, length, share

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(np.hstack([features(x, self.length), np.ones((len(x), 1))]) @ self.weights)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The most probable partition of each row."""
        return self.probabilities(x).argmax(axis=1)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """Which partitions (rows x parts) each row must look into."""
        return within(self.probabilities(x), self.share)


def features(x: np.ndarray, length: float) -> np.ndarray:
    """Vectors in units that suit the classifier; far outliers are drawn in."""
    with np.errstate(over="ignore"):
        return np.clip(x / length, -8, 8) * np.sqrt(x.shape[1])


def within(p: np.ndarray, share: float) -> np.ndarray:
    """The most probable entries of each row, until they add up to the share."""
    order = np.argsort(-p, axis=1, kind="stable")
    sorted_ = np.take_along_axis(p, order, axis=1)
    out = np.zeros(p.shape, bool)
    np.put_along_axis(out, order, np.cumsum(sorted_, axis=1) - sorted_ < share, axis=1)
    return out


def fit(vectors: DataFrame, k: int = 10, sample: int = SAMPLE, recall: float = RECALL) -> Router:
    """Learn partitions and routing from a bounded sample of distinct vectors of (vec_id, v)."""
    n = vectors.count()
    first = vectors.select(F.size("v")).first()
    if first is None:
        return Router(np.zeros((1, 1)))
    wanted_parts = max(2, round(np.sqrt(n) / GROWTH))
    sample = int(min(max(sample, LEARNED * wanted_parts), MOST_SAMPLE, SAMPLE_BYTES // (8 * first[0])))
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(6)), F.lit(max(1, n // sample))) == 0).select("v").distinct()
    x = np.array([r.v for r in drawn.orderBy(F.xxhash64("v"), "v").limit(sample).collect()], float)
    parts = min(wanted_parts, len(x) // max(LEARNED, 8 * k))
    if parts < 2:
        return Router(np.zeros((first[0] + 1, 1)))
    length = float(np.median(norms(x)))
    z = features(x, length)
    graph = nearest_graph(z, k)
    label = balanced_partition(z, graph, parts)
    wanted = np.zeros((len(x), parts))
    np.add.at(wanted, (np.arange(len(x)), label), 1.0)
    np.add.at(wanted, (np.repeat(np.arange(len(x)), k), label[graph].ravel()), 1.0)
    apart = np.arange(len(x)) % 4 == 0  # what routing is measured on isn't learned from
    router = Router(train_classifier(z[~apart], wanted[~apart] / (k + 1)), length)
    p = router.probabilities(x)
    home = p.argmax(axis=1)[graph[apart]]
    for share in [*np.arange(0.02, 1, 0.02), 0.99, 0.999]:
        router.share = float(share)
        if np.take_along_axis(within(p[apart], share), home, axis=1).mean() >= recall:
            return router
    router.share = 1.0
    return router


def capped(ids: np.ndarray, most: int) -> np.ndarray:
    """Which of some ids in order are among the first ``most`` of their kind."""
    by = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(ids[by]) != 0]) if len(ids) else np.empty(0, np.int64)
    rank = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
    out = np.empty(len(ids), bool)
    out[by] = rank < most
    return out


def nearest_rows(ids: np.ndarray, c: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of c and distances for each row of q: enough that k rows, or all there are, stay without those of any one id."""
    alike = int(np.unique(ids, return_counts=True)[1].max())
    unit = float(max(np.abs(c).max(), np.abs(q).max()))
    cs = c / unit
    norm = (cs * cs).sum(axis=1)
    keep = min(k + alike, len(c)) - 1
    for at in range(0, len(q), 512):
        rough = norm[None, :] - 2 * (q[at : at + 512] / unit) @ cs.T
        limit = np.partition(rough, keep, axis=1)[:, keep]
        room = 1e-9 * (np.abs(limit) + norm.max() + 1e-300)
        for i, row in enumerate(rough):
            near = np.flatnonzero(row <= limit[i] + room[i])
            exact = distances(c[near], q[at + i])
            order = np.lexsort((ids[near], exact))
            order = order[capped(ids[near][order], k)][: k + min(k, alike)]
            yield near[order], exact[order]


def search(vectors: DataFrame, queries: DataFrame, router: Router, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found among all rows but those with its own id."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(router)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(part=shared.value.home(np.stack(frame["v"].to_numpy())).astype(np.int32))

    dealt = materialize(vectors.mapInPandas(deal, "vec_id long, v array<double>, salt int, part int"))
    sizes = {r.part: r.n for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = {p: -(-n // BLOCK) for p, n in sizes.items()}
    count = F.element_at(F.create_map(*[F.lit(x) for item in blocks.items() for x in item]), F.col("part"))
    asked = materialize(queries.select("v").distinct().withColumn("q", F.monotonically_increasing_id()))
    rounds = -(-asked.count() // ASKED) or 1  # blocks of queries
    blocked = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id", "salt", F.lit(9)), count).cast("int"))
    blocked = blocked.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).select("part", "block", "turn", "vec_id", "v")

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                at, part = np.nonzero(shared.value.probed(np.stack(frame["v"].to_numpy())))
                times = np.array([blocks.get(p, 0) for p in part.tolist()], np.int64)
                at, part = np.repeat(at, times), np.repeat(part, times)
                block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                yield pd.DataFrame({"q": frame["q"].to_numpy()[at], "v": frame["v"].to_numpy()[at], "part": part, "block": block})

    sent = asked.mapInPandas(send, "q long, v array<double>, part int, block int").withColumn("turn", F.pmod(F.xxhash64("q", F.lit(4)), F.lit(rounds)).cast("int"))

    def rerank(own: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        q, ids, scores = np.empty(0, np.int64), [np.empty(0, np.int64)], [np.empty(0)]
        if len(own) and len(questions):
            all_ids, c = own["vec_id"].to_numpy(np.int64), np.stack(own["v"].to_numpy())
            for rows, exact in nearest_rows(all_ids, c, np.stack(questions["v"].to_numpy()), k):
                ids.append(all_ids[rows])
                scores.append(exact)
            q = np.repeat(questions["q"].to_numpy(np.int64), [len(s) for s in scores[1:]])
        return pd.DataFrame({"q": q, "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    key = ["part", "block", "turn"]
    near = blocked.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(rerank, "q long, vec_id long, score double")
    alike = Window.partitionBy("q", "vec_id").orderBy("score")  # no list needs more than k rows of an id, nor 2 k rows
    first = Window.partitionBy("q").orderBy("score", "vec_id")
    best = near.withColumn("_k", F.row_number().over(alike)).where(F.col("_k") <= k).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= 2 * k)
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found")).join(asked, "q").drop("q")
    lists = materialize(lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    wanted = queries.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    other = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return wanted.join(lists, ["v", "salt"]).select("query_id", F.posexplode(other).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def read_share(vectors: DataFrame, queries: DataFrame, router: Router) -> float:
    """Share of all (query, row) pairs that a search compares."""
    shared = vectors.sparkSession.sparkContext.broadcast(router)

    def count(wide: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["v"].to_numpy())
                    yield pd.DataFrame({"part": np.nonzero(shared.value.probed(x))[1] if wide else shared.value.home(x)})

        return run

    rows, asked = (dict(f.select("v").mapInPandas(count(w), "part long").groupBy("part").count().collect()) for f, w in ((vectors, False), (queries, True)))
    pairs = sum(rows.values()) * queries.count()
    return sum(n * asked.get(p, 0) for p, n in rows.items()) / pairs if pairs else 0.0
