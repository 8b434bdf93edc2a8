import random

import numpy as np
from xxhash import xxh64_intdigest

from marginalia.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes) and hashes)


def plain_components(rows, radius=2):
    prints = [plain_print(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (doc, *_), g in zip(rows, group, strict=True):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return sorted(((doc, p, least.get(g)) for (doc, *_), p, g in zip(rows, prints, group, strict=True)), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 120))), "x", None) for i in range(150)]
    for i in range(150, 260):
        base = rows[rng.randrange(150)][1].split(" ")
        if rng.random() < 0.7 and base:
            base[rng.randrange(len(base))] = "new"
        rows.append((i, " ".join(base).upper() if i % 3 else " ".join(base), "y", "z"))
    rows += [(260, None, None, None), (261, "", None, None), (262, " \t\n", None, None), (263, "one", None, None), (263, "one", None, None), (None, "one", None, None), (None, "alone here", None, None), (264, "long " * 30000, None, None)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found), key=str) == plain_components(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_meets_every_pair():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    fps[2000:] = fps[:2000] ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64))
    tree = simhash.Tree(fps[::3], 60, 2)
    assert tree.leaves > 8
    index, leaf, member = tree.route(fps)
    linked = {frozenset((i, i + 2000)) for i in range(2000)}
    met = set()
    for k in range(tree.leaves):
        own = index[leaf == k]
        root = simhash.shard_links(fps[own], member[leaf == k], 2)
        met |= {frozenset((int(own[i]), int(own[r]))) for i, r in enumerate(root) if i != r}
    assert linked <= met | {frozenset((i, i + 2000)) for i in range(2000) if fps[i] == fps[i + 2000]}
    assert sorted(index[member]) == list(range(4000))
