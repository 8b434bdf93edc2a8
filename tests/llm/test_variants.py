"""Spelling variants against a plain loop over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    n = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if plain_near(w, v)] for w in n}
    form = {w: best for w, of in near.items() if of and n[best := min(of, key=lambda v: (-n[v], v))] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def test_equals_plain_loops(spark):
    rng = random.Random(4)
    stems = ["planet", "garden", "über-größe", "ñandúes", "aaaaaa", "mirror", "letter", "CAFÉ×÷ØÞ", "straße"]
    docs = []
    for i in range(250):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(stems)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "e", "é", "a", w[at] * 2]) + w[at + rng.randint(0, 1) :]
            words.append(rng.choice([w, w.upper(), w.title()]))
        docs.append((rng.choice([i, i, i, None, 7]), rng.choice([" ", ", ", "Ā", "1"]).join(words)))
    docs += [(300, None), (301, ""), (302, "a" * 3000 + " " + "a" * 2999), (302, "a" * 3000 + " " + "a" * 2999), (303, "a" * 3000 + " " + "a" * 2999)]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, word string").repartition(3)
    found = variants.variants(frame)
    assert dict(found.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    want = plain(docs)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[0]) == want
    assert sum(w[4] > 1 for w in want) > 50 and len({w[2] for w in want if w[1] and w[1] != w[2]}) > 0


def test_empty_table(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_are_read_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices(["one", "Two,three", "fünf", "x" * 40], k=500))
    want = Counter("".join(c.lower() if c < "\x80" else c for c in r).encode("latin-1") for r in RUN.findall(text))
    monkeypatch.setattr(variants, "BLOCK", 16)
    assert variants.runs(text) == want


@pytest.mark.parametrize("words", [["abc"], ["aab", "ab", "b", "", "aaaa"], ["é" * 50, "xyz"]])
def test_keys_of_deletions_are_those_of_the_shorter_words(words):
    whole, of, slot, key = variants.deletion_keys(words)
    for w, s, k in zip(of.tolist(), slot.tolist(), key, strict=True):
        assert variants.deletion_keys([words[w][:s] + words[w][s + 1 :]])[0][0] == k
    assert len(whole) == len(words) and key.dtype == np.uint64


def test_chains_of_forms_lead_to_their_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5"), ("y", "z")]
    found = dict(variants.last_forms(spark.createDataFrame(chain, "word string, form string")).collect())
    assert found == {w: "z" if w == "y" else "w37" for w, _ in chain}
