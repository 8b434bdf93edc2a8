"""Repeated passages and the FM-index against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import repeats
from marginalia.llm.fmindex import FMIndex, Wavelet, repeated_windows, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, window):
    words = [WORD.findall(t or "") for _, t in docs]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    found = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        found.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(found, key=repr)


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_words int, kept string").repartition(parts)


def planted(seed, n=120):
    """Unlike texts with shared passages, near copies, copies, periodic and odd rows."""
    rng = random.Random(seed)
    word = lambda k=400: f"w{rng.randrange(k)}"
    passages = [[word() for _ in range(k)] for k in (34, 35, 36, 52, 90)]
    base = [word() for _ in range(130)]
    docs = []
    for i in range(n):
        text = [word(3000) for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            text += p + [word(3000) for _ in range(rng.randint(0, 5))]
        if i % 3 == 0:  # near copies of one text
            text = base.copy()
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = word(9)
        docs.append((rng.choice([i, i, 5, None]), rng.choice([" ", "\n", " \t"]).join(text)))
    docs += [docs[4], docs[4], (500, None), (501, ""), (502, "ab cd " * 60), (503, "x " * 200), (504, "é ß z " * 50), (505, "q r s " * 12)]
    return docs


@pytest.mark.parametrize("window,size,shard", [(35, 8, 16_000), (12, 4, 40), (9, 9, 500), (5, 1, 60)])
def test_equals_plain_loops(spark, window, size, shard):
    docs = planted(window)
    found = repeats.without_repeats(frame(spark, docs), window, size, shard)
    want = plain(docs, window)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert any(0 < w[2] < w[1] for w in want)


def test_frequent_runs_change_no_result(spark, monkeypatch):
    docs = planted(3, 300)
    heavy = repeats.heavy_grams(frame(spark, docs), 8, 200_000, 20)
    assert 20 < len(heavy)
    calls = repeats.heavy_grams
    monkeypatch.setattr(repeats, "heavy_grams", lambda d, size: calls(d, size, 200_000, 20))
    assert sorted((tuple(r) for r in repeats.without_repeats(frame(spark, docs), 35).collect()), key=repr) == plain(docs, 35)


def test_a_passage_of_many_texts_makes_few_unlike_stretches(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(i, " ".join(f"w{rng.random()}" for _ in range(40)) + f" {passage} " + " ".join(f"w{rng.random()}" for _ in range(40))) for i in range(600)]
    table = frame(spark, docs)
    heavy = repeats.heavy_grams(table)
    assert len(heavy) == 53
    alike = repeats.anchored(table, heavy).groupBy("anchor", "mark").count()
    most = alike.groupBy("anchor").count().agg({"count": "max"}).first()[0]
    assert most <= 4  # 600 without the list of frequent runs
    assert {r.n_removed for r in repeats.without_repeats(table).collect()} == {60}


def test_empty_table(spark):
    assert repeats.without_repeats(frame(spark, [])).count() == 0


def test_words_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "bcd", "é" * 30, "\n"], k=300)).encode()
    monkeypatch.setattr(repeats, "BLOCK", 7)
    assert [w for part in repeats.blocks(text) for w in part] == text.split()


def test_wavelet_ranks_and_bits():
    rng = np.random.default_rng(2)
    for kinds in (1, 2, 3, 17, 64):
        text = rng.integers(0, kinds, 300)
        wavelet = Wavelet(text, kinds)
        symbols, at = rng.integers(0, kinds, 200), rng.integers(0, 301, 200)
        assert wavelet.rank(symbols, at).tolist() == [int((text[:a] == s).sum()) for s, a in zip(symbols, at, strict=True)]


def test_suffixes_and_counts_of_patterns():
    rng = np.random.default_rng(5)
    text = np.concatenate([rng.integers(1, 4, 400), [0]])
    order = suffixes(text, 4, 8)
    heads = [tuple(text[i : i + 8]) for i in order]
    assert heads == sorted(heads)
    index = FMIndex(text, 4, 8)
    for _ in range(100):
        at, k = rng.integers(0, 390), rng.integers(1, 9)
        low, high = np.array([0]), np.array([len(text)])
        for c in text[at : at + k][::-1]:
            low, high = index.extend(np.array([c]), low, high)
        assert int((high - low)[0]) == sum(np.array_equal(text[i : i + k], text[at : at + k]) for i in range(len(text)))


@pytest.mark.parametrize("kinds,depth", [(2, 1), (3, 40), (60_000, 9), (3_000_000, 17)])
def test_suffixes_of_any_alphabet(kinds, depth):
    rng = np.random.default_rng(kinds)
    text = np.append(rng.integers(0, min(kinds, 3), 300), kinds - 1)
    order = suffixes(text, kinds, depth)
    heads = [tuple(text[i : i + depth]) for i in order]
    assert sorted(order.tolist()) == list(range(301)) and heads == sorted(heads)


@pytest.mark.parametrize("span", [1, 2, 3, 5, 8, 28])
def test_leftmost_least(span):
    rng = np.random.default_rng(span)
    rank = rng.integers(0, 9, 200).astype(np.uint64) << np.uint64(40) | rng.integers(0, 9, 200).astype(np.uint64)
    want = [k + int(np.argmin(rank[k : k + span] >> np.uint64(21))) for k in range(200 - span + 1)]
    assert repeats.leftmost_least(rank, span).tolist() == want


def test_intervals_are_all_windows_that_occur_twice():
    rng = np.random.default_rng(6)
    pieces = [rng.integers(1, 3, k) for k in rng.integers(3, 30, 60)]
    text = np.concatenate([np.append(p, 0) for p in pieces])
    lengths = np.array([len(p) for p in pieces])
    starts = np.cumsum(lengths + 1) - lengths - 1
    window = 7
    counts = Counter(tuple(p[i : i + window]) for p in pieces for i in range(len(p) - window + 1))
    want = {(k, i) for k, p in enumerate(pieces) for i in range(len(p) - window + 1) if counts[tuple(p[i : i + window])] > 1}
    found = set()
    for piece, first, last in repeated_windows(FMIndex(text, 3, 32), text, starts, lengths, window):
        found |= {(int(k), w) for k, a, b in zip(piece, first, last, strict=True) for w in range(a, b + 1)}
    assert found == want and want
