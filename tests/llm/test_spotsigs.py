import hashlib
import random
import re

import pytest
from xxhash import xxh64_intdigest

from marginalia.llm import queries, spotsigs

SCHEMA = "doc_id long, text string, signatures string, edited string"


def xx(words):
    seed = 42
    for w in words:
        seed = xxh64_intdigest(w.encode(), seed)
    return seed & (1 << 31) - 1


def plain_signatures(text):
    words = re.sub(r"[^\w]|_", " ", (text or "").lower()).split()
    known, found = set(spotsigs.ANCHORS), set()
    for i, w in enumerate(words):
        if w in known:
            chain, parts = [], 1
            for x in words[i + 1 :]:
                parts += x in known
                if parts > spotsigs.REACH or len(chain) == spotsigs.CHAIN:
                    break
                if x not in known:
                    chain.append(x)
            found.add(xx([w, " ".join(chain)]))
    return sorted(found or {xx([w]) for w in words})


def corpus():
    rng = random.Random(8)
    rows = [(i * 3, " ".join(rng.choice(["the", "of", "Straße,", "é.", "la", "x1", "word", "thing", "zeta", "und", "-"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "no anchors... here zeta"), (506, " ".join(f"w{i}" for i in range(200)) + " the end"), (507, "wort " * 30), (503, "The. THE the"), (504, "the " * 20000), (505, rows[4][1])]
    return [(a, b, "x", "y") for a, b in rows]


def test_signatures_against_brute_force(spark):
    rows = corpus()
    out = {r.doc_id: r for r in spotsigs.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc, text, *_ in rows:
        assert out[doc].signatures == plain_signatures(text), (doc, text)


def test_query(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.op7_spotsigs(spark, str(tmp_path)).collect()}
    ordered = sorted((d, t or "") for d, t, *_ in rows)
    assert len(out) == len(rows)
    jaccard = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for k, (doc, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        sets = [set(plain_signatures(t)) for t in (text, edited, following)]
        r = out[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(sets[0], sets[1])) and r.near_next == pytest.approx(jaccard(sets[0], sets[2]))
        assert r.fingerprint == ",".join(f"{s:x}" for s in sorted(sets[0]))
    assert out[12].fingerprint == out[505].fingerprint


def test_one_row_repeated_rows_and_empty(spark, tmp_path):
    for k, rows in enumerate(([(1, "the cat sat", "", "")], [(1, "the cat sat", "", "")] * 3 + [(None, "of dogs bark", "", "")] * 2, [])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        out = queries.op7_spotsigs(spark, f"{tmp_path}/{k}").collect()
        assert len(out) == len(rows)
    assert [r.near_next for r in queries.op7_spotsigs(spark, f"{tmp_path}/0").collect()] == [1.0]


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(5)
    base = ["the " + " ".join(rng.choice(["of", "the", "in"]) + " " + "".join(rng.choices("abcdef", k=4)) for _ in range(40)) for _ in range(12)]
    rows = []
    for i in range(60):
        words = base[i % 12].split()
        for _ in range(i // 20):
            words[rng.randrange(len(words))] = "zzz"
        rows.append((i, " ".join(words), "x", "y"))
    prints = spotsigs.fingerprints(spark.createDataFrame(rows, SCHEMA))
    pairs, members = spotsigs.similar_pairs(prints, 0.8)
    of = {r.doc_id: r["class"] for r in members.collect()}
    found = {frozenset((r.a, r.b)) for r in pairs.collect()}
    sets = {d: set(plain_signatures(t)) for d, t, *_ in rows}
    for a in sets:
        for b in sets:
            if a < b:
                alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                assert (alike >= 0.8) == (of[a] == of[b] or frozenset((of[a], of[b])) in found)


def test_ranges_of_uneven_ids(spark, tmp_path):
    rng = random.Random(2)
    ids = [None] * 400 + [7] * 400 + list(range(10_000, 10_300)) + [1 << 62, -(1 << 62)] + [rng.randrange(1 << 40) for _ in range(100)]
    rows = [(d, f"text {k} the end of {rng.random()}", "x", "y") for k, d in enumerate(ids)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    ranged = spotsigs.in_ranges(spotsigs.texts(docs)).select("_range", "_id", "_hash").collect()
    ordered = sorted(ranged, key=lambda r: (r["_id"], r["_hash"]))
    assert [r["_range"] for r in ordered] == sorted(r["_range"] for r in ranged)
    sizes = [sum(r["_range"] == k for r in ranged) for k in {r["_range"] for r in ranged}]
    assert max(sizes) <= 250 and len(sizes) >= 10  # 75 a range on average
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op7_spotsigs(spark, str(tmp_path)).collect()
    key = lambda t: (v := xxh64_intdigest(t.encode(), 42), v - (1 << 64) if v >> 63 else v)[1]
    order = sorted((d if d is not None else -(1 << 63), key(t), t) for d, t, *_ in rows)
    edits = [t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][2][: len(t) // 4] for k, (_, _, t) in enumerate(order)]
    assert sorted(r.edited_sha256 for r in out) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in edits)
