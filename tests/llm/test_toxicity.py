import itertools
import random

import numpy as np
import pytest

from marginalia.llm import toxicity as t

DOCS, LABELS = "doc_id long, text string, toxic string", "doc_id long, quality int, toxic int"


def plain_kernel(a, b):
    """Sum over all pairs of equal subsequences of DECAY to the letters they span."""
    total = 0.0
    for i in itertools.combinations(range(len(a)), t.ORDER):
        for j in itertools.combinations(range(len(b)), t.ORDER):
            if [a[x] for x in i] == [b[x] for x in j]:
                total += t.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_against_enumeration():
    rng = random.Random(1)
    some = ["".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(30)] + ["idiot", "i-d.iot", "ab"]
    marks = ["idiot", "abcd", "éabéa"]
    found = t.kernels(some, marks)
    for i, a in enumerate(some):
        for j, b in enumerate(marks):
            want = plain_kernel(a, b) / (plain_kernel(a, a) * plain_kernel(b, b)) ** 0.5 if len(a) >= t.ORDER else 0.0
            assert found[i, j] == pytest.approx(want, abs=1e-5)
    assert np.linalg.eigvalsh(t.kernels(some, [w for w in some if len(w) >= t.ORDER])[[len(w) >= t.ORDER for w in some]].astype(float)).min() > -1e-4


def test_words():
    assert t.words("An i-d.i!ot, i d i o t  É") == ["an", "idiot", "idiot", "é"]
    assert t.words(None) == t.words("  \n") == t.words("...") == []


def corpus(seed=3, n=500):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        text = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for w in rng.sample(["moron", "idiot", "pathetic", "vequtage", "vequmo", "vequais"], 3):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text) + ".", "x"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_and_tolerates_gaps(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(0, None, None), (None, 1, 1)], LABELS)
    model = t.fit(docs, marks)
    again = t.fit(docs.repartition(5), marks)
    assert np.allclose(model.alpha, again.alpha, atol=1e-5)
    probes = ["a mo-ron here", "a pathxetic there", "i d i o t", "p.a.t.h.e.t.i.c", "the vequron thing", "M O R O N", "you mor on"]
    clean = ["ther ononha endre", None, "", " ", "of the", "long " * 50000, "therandinhaofereshaandthere" * 2000]
    test = [(1000 + i, p, None) for i, p in enumerate(probes)] + [(2000 + i, p, None) for i, p in enumerate(clean)] + [(None, probes[0], None)] * 2
    found = t.score(docs.unionByName(spark.createDataFrame(test, DOCS)), model).collect()
    assert len(found) == len(rows) + len(test)
    truth = {i: toxic for i, _, toxic in labels}
    for r in found:
        if r.doc_id is None or r.doc_id in range(1000, 1007):
            assert r.score >= 0.3, r
        elif r.doc_id >= 2000:
            assert r.score < 0.3, r
    wrong = [r.doc_id for r in found if r.doc_id in truth and (r.score >= 0.3) != truth[r.doc_id]]
    assert len(wrong) <= 2


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "moron", None)], DOCS)
    assert t.fit(docs, spark.createDataFrame([], LABELS)) is None
    assert t.score(docs, None).first().score == 0.0
    rows, _ = corpus(n=40)
    assert t.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 0, 0) for i in range(40)], LABELS)) is None
