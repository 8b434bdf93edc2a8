import math
import random
import zlib

import numpy as np

from marginalia.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"aa": ["kala", "maki", "tulo", "rasi"], "bb": ["çöp", "gül", "ışık", "çiğ"], "cc": ["друг", "лес", "мир", "дом"]}


def corpus(n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(4, 40))).capitalize() + ".", lang, "x"))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    odd = [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "12 34 %%!", "aa", None), (None, "kala maki tulo", None, None), (1003, "kala " * 60000, None, None), (3, rows[3][1], rows[3][2], "x")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    model = langid.fit(docs.where(~langid.held_out(docs.doc_id)))
    found = langid.identify(docs, model).collect()
    assert len(found) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang, _ in rows}
    for r in found:
        assert 0 <= r.score <= 1
        if r.doc_id in truth:
            assert r.lang_pred == truth[r.doc_id]
        elif r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == "aa"
    split = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out(docs.doc_id).alias("h")).collect()}
    assert all(split[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    assert split[None]
    kept = langid.relabel(docs, model, 0.5).collect()
    assert len(kept) == len(found) - 3 and {r.lang for r in kept} == set(WORDS)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = langid.fit(empty)
    assert langid.identify(empty, model).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "abc", None, None)], SCHEMA), model).first().lang_pred == "und"


def plain_grams(text):
    """All n-grams of a text by loops, as strings."""
    runs = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    padded = f" {runs} "
    return [padded[i : i + n] for n in langid.ORDERS for i in range(len(padded) - n + 1)] if runs else []


def test_grams_against_plain_counts():
    texts = ["Ab, c", "ab  c", None, "", "12", "İıß ΟΔΟΣ x", "a\0b", "…é!", "word " * 300]
    row, bucket = langid.grams(texts)
    assert len(row) == len(bucket)
    names = {}
    for i, t in enumerate(texts):
        alone = langid.grams([t])[1]
        assert sorted(bucket[row == i]) == sorted(alone) and len(alone) == len(plain_grams(t))
        for g in plain_grams(t):
            names.setdefault(g, set())
    for g in names:  # an n-gram has one bucket wherever it stands
        inside = [set(langid.grams([t])[1]) for t in texts if g in plain_grams(t)]
        names[g] = set.intersection(*inside)
        assert names[g]


def test_probabilities_against_plain_bayes(spark):
    rows = corpus(90)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs)
    bucket_counts = {lang: {} for lang in WORDS}
    for _, text, lang, _ in rows:
        for b in langid.grams([text])[1].tolist():
            bucket_counts[lang][b] = bucket_counts[lang].get(b, 0) + 1
    texts = ["kala çöp", "мир tulo лес", "x", "gül maki " * 5000, None, "?"]
    langs, scores = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores.tolist(), strict=True):
        found = langid.grams([text])[1].tolist()
        if not found:
            assert (lang, score) == ("und", 0.0)
            continue
        posterior = {}
        for k in sorted(WORDS):
            own, total = bucket_counts[k], sum(bucket_counts[k].values()) + 0.1 * langid.BUCKETS
            posterior[k] = math.log(1 / 3) + sum(math.log((own.get(b, 0) + 0.1) / total) for b in found)
        assert lang == max(posterior, key=posterior.get)
        f = langid.WEIGHT * langid.EVIDENCE / (langid.EVIDENCE + len(found))
        want = 1 / sum(math.exp((v - posterior[lang]) * f) for v in posterior.values())
        assert abs(score - want) < 1e-3
    whole, slabbed = model.posteriors(texts[:4])[0], [model.posteriors([t])[0][0] for t in texts[:4]]
    assert np.allclose(whole, slabbed, rtol=1e-6)
