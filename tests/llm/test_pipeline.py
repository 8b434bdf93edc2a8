import random
from collections import Counter, defaultdict

import pytest

from marginalia.llm import pii
from test_mixing import plain_targets
from test_packing import PATH
from test_simhash import plain_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"aa": ["kala", "maki", "tulo", "rasi", "puro", "veso", "nilla"], "bb": ["çöp", "gül", "ışık", "çiğ", "yağmur", "köprü"], "cc": ["друг", "лес", "мир", "дом", "река", "поле"]}


def corpus():
    rng = random.Random(12)
    rows = []
    for i in range(150):
        lang = sorted(WORDS)[i % 3]
        text = " ".join(rng.choices(WORDS[lang], k=rng.randint(20, 120)))
        if i % 5 == 0:
            text += f" user{i}@mail.example.com and +1 (325) 555-{7000 + i} or 10.0.3.{i}"
        rows.append((i, text, lang, rng.choice(["s1", "s1", "s2", None]), len(text)))
    rows += [(200 + i, rows[i][1], rows[i][2], "s2", rows[i][4]) for i in range(20)]
    rows += [(300, None, "aa", "s1", None), (301, "", "aa", "s1", 0), (302, "12 34 !!", "aa", "s1", 8), (303, rows[3][1].upper(), None, "s1", rows[3][4])]
    return rows


def test_stages_against_plain_code(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = after[name] = spark.read.parquet(f"{tmp_path}/{k}")
    assert [n for n, _ in corpus_pipeline.STAGES] == list(after)
    for name in list(after)[:-1]:
        assert after[name].columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
    # language: texts without a letter go
    first = {r.doc_id: r for r in after["known_language"].collect()}
    assert set(first) == {d for d, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert all(first[d].lang == lang for d, _, lang, *_ in rows if d in first and lang)
    # copies: the smallest id of each group stays
    groups = plain_components([(d, first[d].text) for d in first])
    second = {r.doc_id: r for r in after["near_duplicates"].collect()}
    assert set(second) == {least for _, _, least in groups} and after["near_duplicates"].count() == len(second)
    # personal data
    third = {r.doc_id: r for r in after["without_personal_data"].collect()}
    assert set(third) == set(second)
    for d, r in third.items():
        spans = pii.base_spans(second[d].text)
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == pii.redact(second[d].text, spans) or len(spans) < r.text.count("<")
    # mix
    copies = Counter(r.doc_id for r in after["mixed_sources"].collect())
    sizes, taken = defaultdict(int), Counter()
    for r in third.values():
        sizes[r.source] += len(r.text.split())
        taken[r.source] += copies[r.doc_id] * len(r.text.split())
    assert max(copies.values()) <= 3
    for source, target in plain_targets(sizes, (1, 2, 3)).items():
        assert abs(taken[source] - target) <= 120
    # packing
    plain = tokenizers.Tokenizer.from_file(PATH)
    pieces = after["packed"].collect()
    want = Counter({d: n * (len(plain.encode(third[d].text, add_special_tokens=False).ids) + 1) for d, n in copies.items()})
    got, filled = Counter(), defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
        got[r.doc_id] += r.length
    assert got == want and max(filled.values()) <= 2048
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.ids_crc32) for r in run.collect()) == sorted((r.doc_id, r.ids_crc32) for r in pieces)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def linked_groups(rows):
    """Least (doc_id, text) of each component of pairs with a likeness of 0.8 or more."""
    sets, root = [five_words(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for row, r in zip(rows, root, strict=True):
        least[r] = min(row[0], least.get(r, row[0]))
    return sorted(least.values())


def test_word_edited_copies_go(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for base in range(30):
        words = [word() for _ in range(rng.randint(60, 200))]
        rows.append((base * 100, " ".join(words)))
        for copy in range(1, 4):  # at likeness about 0.95, 0.85, 0.7
            edited = list(words)
            for at in rng.sample(range(0, len(words), 5), max(1, len(words) * copy * copy // 200)):
                edited[at] = word()
            rows.append((base * 100 + copy, " ".join(edited)))
    words = [word() for _ in range(150)]
    for k in range(120):  # one group of many near copies
        edited = list(words)
        for at in rng.sample(range(150), rng.randint(1, 6)):
            edited[at] = word()
        rows.append((5000 + k, " ".join(edited)))
    docs = spark.createDataFrame([(d, t, "aa", "s1", len(t)) for d, t in rows], SCHEMA).repartition(4)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == linked_groups(rows) and len(kept) < len(rows) - 100


def test_two_texts_of_one_id(spark):
    own, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, own, "aa", "s1", 1), (5, own, "aa", "s1", 1), (5, other, "aa", "s1", 1), (5, other, "aa", "s1", 1), (7, third, "aa", "s1", 1), (7, own, "aa", "s1", 1), (7, other, "aa", "s1", 1)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, own), (5, other), (7, third)]
