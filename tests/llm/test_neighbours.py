from pathlib import Path

import numpy as np
import pytest

from marginalia.llm import neighbours as n

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def brute(rows, k=10):
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max({len(v) for _, v in good}, key=lambda s: sum(len(v) == s for _, v in good)) if good else 0
    good = [(i, v) for i, v in good if len(v) == size]
    out = {}
    for q, v in good:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good if i != q)[:k]
    return out


def run(spark, rows):
    vectors = n.clean_vectors(spark.createDataFrame(rows, SCHEMA))
    router = n.fit(vectors)
    found = {}
    for r in n.search(vectors, vectors.where("vec_id % 100 = 0"), router).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(found[r.query_id])
    return found, router


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 9000)] + 0.5 * rng.normal(size=(9000, 16))
    x[3000:6000] = x[3000]  # a third of the rows is one vector
    rows = [(i, v.tolist(), "x", None) for i, v in enumerate(x)]
    found, router = run(spark, rows)
    assert router.parts > 1
    want = brute(rows)
    assert found.keys() == want.keys()
    hit = sum(len({i for _, i in found[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, hits in found.items():
        assert len(hits) == 10 and hits == sorted(hits)
        for s, i in hits:
            assert i != q and abs(s - np.sqrt(((x[q] - x[i]) ** 2).sum())) < 1e-12
    assert [i for _, i in found[3000]] == [i for _, i in want[3000]]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "", ""), (100, [1.0, 2.0], "", ""), (200, [0.0, 0.0], "", ""), (300, None, "", ""), (400, [nan, 1.0], "", ""), (500, [None, 1.0], "", ""), (600, [inf, 1.0], "", ""), (700, [], "", ""), (800, [1.0], "", ""), (None, [1.0, 1.0], "", ""), (7, [1.0, 2.5], "", ""), (7, [1.0, 2.5], "", ""), (5, [1.0, 1.5], "", "")]
    found, _ = run(spark, rows)
    assert found == brute(rows)
    assert found[0] == [(0.0, 100), (0.5, 5), (0.5, 7), (0.5, 7)]


def test_empty_and_alone(spark):
    assert run(spark, [])[0] == {}
    assert run(spark, [(0, [1.0, 2.0], "", "")])[0] == {}


def test_partition_is_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1000, 8))
    graph = n.nearest_graph(x, 5)
    d = ((x[:50, None] - x[None]) ** 2).sum(axis=2)
    d[np.arange(50), np.arange(50)] = np.inf
    assert (np.sort(graph[:50], axis=1) == np.sort(np.argsort(d, axis=1)[:, :5], axis=1)).all()
    sizes = np.bincount(n.balanced_partition(x, graph, 8), minlength=8)
    assert sizes.max() <= np.ceil(1.05 * 125) and sizes.sum() == 1000


def test_partitions_without_queries(spark):
    rng = np.random.default_rng(8)
    centres = 4 * rng.normal(size=(12, 16))
    rows = []
    for i in range(12_000):
        rows.append((i, (centres[0 if i % 100 == 0 else 1 + i % 11] + 0.3 * rng.normal(size=16)).tolist(), "x", None))
    found, router = run(spark, rows)
    assert router.parts > 4 and len(found) == 120 and all(len(hits) == 10 for hits in found.values())


def test_repeated_ids_leave_whole_lists(spark):
    rng = np.random.default_rng(3)
    rows = [(100, rng.normal(size=4).tolist(), "", "") for _ in range(6)] + [(i, rng.normal(size=4).tolist(), "", "") for i in range(1, 31)]
    rows += [(100, rows[0][1], "", "")] * 14 + [(7, rows[7][1], "", "")] * 12
    frame = spark.createDataFrame(rows, SCHEMA)
    vectors = n.clean_vectors(frame)
    out = n.search(vectors, vectors.where("vec_id = 100").dropDuplicates(["v"]), n.fit(vectors)).collect()
    lists = {}
    for q in range(6):
        lists[q] = sorted((float(np.sqrt(((np.array(rows[q][1]) - np.array(v)) ** 2).sum())), i) for i, v, *_ in rows if i != 100)[:10]
    got = sorted((r.score, r.vec_id, r["rank"]) for r in out)
    assert got == sorted((s, i, k + 1) for hits in lists.values() for k, (s, i) in enumerate(hits))


def test_components_of_any_size(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * (1e200 if i % 2 else 1e-200)).tolist(), "", "") for i in range(600)]
    found, _ = run(spark, rows)
    assert set(found) == {0, 100, 200, 300, 400, 500}
    for q, hits in found.items():
        assert len(hits) == 10 and all(i % 2 == 0 for _, i in hits)
        unit = np.array(rows[q][1]) / 1e-200
        assert np.allclose([s / 1e-200 for s, _ in hits], sorted(np.sqrt(((unit - np.array(v) / 1e-200) ** 2).sum()) for i, v, *_ in rows if i != q and i % 2 == 0)[:10])
    far = n.distances(np.array([[3e200, 4e200], [1.0, 1.0]]), np.zeros(2))
    assert np.allclose(far, [5e200, 2**0.5])


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").is_dir(), reason="the test tables are not here")
def test_recall_on_the_test_tables(spark):
    small = n.clean_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    assert n.fit(small).parts > 1
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = n.clean_vectors(frame)
    asked, router = vectors.where("vec_id % 100 = 0"), n.fit(vectors)
    found = {}
    for r in n.search(vectors, asked, router).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute([(r.vec_id, r.embedding) for r in frame.collect()])
    recall = np.mean([len(found[q] & {i for _, i in hits}) / len(hits) for q, hits in want.items()])
    share = n.read_share(vectors, asked, router)
    print(f"{router.parts} partitions, recall {recall:.3f}, {share:.2f} of all pairs compared")
    assert router.parts > 1 and recall >= 0.9 and share < 1
