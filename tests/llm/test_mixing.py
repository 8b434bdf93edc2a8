import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string, size string"


def plain_targets(sizes, weights, cap=3.0):
    """Share by weight, stop sources at their cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= cap * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def test_targets_rates_and_copies(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        source = rng.choice(["a"] * 12 + ["b", "é", "z", "tiny", None])
        rows.append((i, " ".join(["w"] * rng.randint(1, 60)), source, "x", "y"))
    rows += [(2000, None, "a", None, None), (2001, "\t\n ", "b", None, None), (2002, "", "empty", None, None), (None, "one two three", "b", None, None), (5, rows[5][1], rows[5][2], "x", "y"), (2003, "w " * 40000, "a", "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    size = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes, (1, 2, 3))
    out = mixing.mix(docs.withColumn("_mix_size", mixing.word_count(F.col("text")))).collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert r._mix_size == size(r.text) and r._mix_source_size == sizes[r.source]
        assert r._mix_target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r._mix_copies <= 3
        taken[r.source] += r._mix_copies * r._mix_size
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(40, 0.02 * t), s
    mixed = mixing.mix_documents(docs.repartition(3))
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: sum(r._mix_copies for r in out if r.doc_id == d) for d in {r.doc_id for r in out}} | {None: sum(r._mix_copies for r in out if r.doc_id is None)}) - Counter()


def test_single_source_and_empty(spark):
    one = mixing.mix(spark.createDataFrame([(1, "a b", None, "", "")], SCHEMA).withColumn("_mix_size", F.lit(2).cast("long"))).first()
    assert one._mix_copies == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_documents(empty).count() == 0
    blank = mixing.mix_documents(spark.createDataFrame([(1, "", "a", "", "")], SCHEMA))
    assert blank.count() == 0


def test_equal_rows_are_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    rows = [(7, "a b c", "s1")] * 2000 + [(None, "x", None)] * 900 + [(9, f"w{i} w", "s3") for i in range(300)] + [(i, "w " * (i % 9 + 1), "s2") for i in range(600)]
    found = []
    for parts in (1, 7):
        random.Random(parts).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        out = mixing.mix(docs.withColumn("_mix_size", mixing.word_count(F.col("text")))).collect()
        assert len(out) == len(rows) and all(0 <= r["_mix_copies"] <= 3 for r in out)
        taken, target = {}, {}
        for r in out:
            taken[r.source] = taken.get(r.source, 0) + r["_mix_copies"] * r["_mix_size"]
            target[r.source] = r["_mix_target"]
        assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 60 for s in taken), (taken, target)
        found.append(Counter((r.doc_id, r.text, r["_mix_copies"]) for r in out))
    assert found[0] == found[1]  # however the table is stored
    assert sum(n for (_, text, _), n in found[0].items() if text == "a b c") == 2000


def test_a_piece_shares_its_copies_evenly():
    table = mixing.pa.table({"doc_id": [1, 2, 3], "_mix_size": [10, 4, 0], "_mix_mark": [5, 6, 7], "_mix_piece": [0, 0, 0], "_mix_rate": [0.35, 0.5, 1.0], "_mix_count": [10, 1, 2]})
    place, copies, times = mixing.round_chunk(table, 3.0)
    # 35 of 100 words are owed: four rows of ten get a copy, five words too many; the next row of four words gets none
    assert sorted(zip(place, copies, times)) == [(0, 0, 6), (0, 1, 4), (1, 0, 1), (2, 0, 2)]
