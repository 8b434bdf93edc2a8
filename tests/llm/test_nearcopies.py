import random

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import nearcopies as n

SCHEMA = "doc_id long, text string, mark string, first string"


def plain_groups(rows, size=5):
    """Least id of each id's group by comparing all pairs of whole shingle sets."""
    sets = {}
    for d, text, *_ in rows:
        words = "".join(c.lower() if c < "\x80" else c for c in text or "").split()
        sets[d] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}
    ids = sorted(sets)
    root = {d: d for d in ids}
    links = 0

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                links += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}, links


def edited(rng, words, share):
    return [rng.choice("qwxyz") + w if rng.random() < share else w for w in words]


def groups_of(spark, rows):
    out = n.near_copies(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert len(out) == len(rows)
    return {r.doc_id: r.first.doc_id for r in out if r.doc_id is not None}


def test_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 5)))
    rows = []
    for g in range(40):
        base = [word() for _ in range(rng.choice([3, 6, 30, 90, 200]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.3])))))
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[0][1].upper()), (904, "a b"), (905, "A  b")]
    want, links = plain_groups(rows)
    assert links > 20 and groups_of(spark, rows) == want


@pytest.mark.parametrize("block,small", [(2048, 16), (40, 16), (40, 1), (7, 4)])
def test_a_large_group_of_edited_edits(spark, monkeypatch, block, small):
    monkeypatch.setattr(n, "SMALL", small)
    monkeypatch.setattr(n, "BLOCK", block)
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(10_000)}" for _ in range(120)]]
    for _ in range(299):
        texts.append(edited(rng, rng.choice(texts[-40:]), 0.02))
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(1000 + k, f"another text {k} of few words {rng.random()}") for k in range(100)]
    want, links = plain_groups(rows)
    assert links > 250 and groups_of(spark, rows) == want


def test_no_link_is_lost_in_buckets_of_a_thousand_classes(spark):
    """Copies at 0.8 of one text that are near nothing else: only that one text links them, and it is no leader."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    rows = [(k, " ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.025, 0.04])))) for k in range(1100)] + [(5000, " ".join(base))]
    want, links = plain_groups(rows)
    found = groups_of(spark, rows)
    lost = sum(found[d] != want[d] for d in want)
    assert links > 1000 and lost == 0


@pytest.mark.parametrize("columns", [3, 4096])
def test_blocks_against_plain_sets(monkeypatch, columns):
    monkeypatch.setattr(n, "COLUMNS", columns)
    rng = np.random.default_rng(2)
    base = rng.choice(5000, 60, replace=False)
    sets = []
    for _ in range(50):
        s = base.copy()
        at = rng.random(60) < rng.choice([0.02, 0.1, 0.2])
        s[at] = rng.choice(5000, at.sum())
        sets.append(np.unique(s).astype(np.int32))
    sets += [np.array([1], np.int32), np.array([1], np.int32)]
    table = pa.table({"class": np.arange(52) * 7, "n": np.array([len(s) for s in sets], np.int32), "root": np.arange(52), "shingles": pa.array(sets, pa.list_(pa.int32()))})

    def parts(u, v):
        root = {k * 7: k * 7 for k in range(52)}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(u, v, strict=True):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        return {k: top(k) for k in root}

    def plain(left, right):
        near = [(i * 7, j * 7) for i in left for j in right if i != j and len(set(sets[i]) & set(sets[j])) * 5 >= 4 * len(set(sets[i]) | set(sets[j]))]
        return parts([a for a, _ in near], [b for _, b in near])

    assert parts(*(x.tolist() for x in n.compared(table, None))) == plain(range(52), range(52))
    assert parts(*(x.tolist() for x in n.compared(table.slice(0, 20), table.slice(20)))) == plain(range(20), range(20, 52))
    one = table.set_column(2, "root", pa.array(np.zeros(52, np.int64)))
    assert len(n.compared(one, None)[0]) == 0


def test_odd_rows(spark):
    assert groups_of(spark, []) == {}
    rows = [(None, "x y z"), (7, "x y z"), (7, "x y z"), (7, "other words of the same id"), (3, "x y z")]
    out = n.near_copies(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.first.doc_id) for r in out) == [(0, 3), (3, 3), (7, 3), (7, 3), (7, 7)]
