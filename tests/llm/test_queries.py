"""The registered functions themselves, on small tables with odd rows: names, types, and what the columns say."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import pii, queries
from test_pii import plain_base
from test_repeats import plain as plain_repeats
from test_simhash import plain_components
from test_variants import plain as plain_variants

public_tokenizers = pytest.importorskip("public_tokenizers")


def documents():
    rng = random.Random(21)
    words = {"aa": ["the", "kala", "maki", "tulo", "rasi", "of", "veso"], "bb": ["çöp", "gül", "ışık", "çiğ", "und", "köprü", "İZMİR."]}
    rows = []
    for i in range(160):
        lang = "ab"[i % 2] * 2
        text = " ".join(rng.choices(words[lang], k=rng.randint(3, 60))) + f" {lang}" + "".join(rng.choices("abcdefghijklmnop", k=12))
        if i % 4 == 0:
            text = text.replace(" ", " moron idiot ", 1)
        if i % 7 == 0:
            text += f" a{i}@mail.example.com +1 (325) 555-{7000 + i} 10.0.3.{i}"
        rows.append((i, text, lang, rng.choice(["s1", "s1", "s2", None]), len(text), "x", 1))
    rows += [(200, None, "aa", None, None, None, None), (201, "", None, "s2", 0, None, None), (202, " \n", "aa", "s3", 2, None, None), (203, "12 %", "bb", "s1", 4, None, None)]
    return rows + [(3, rows[3][1], "bb", rows[3][3], 1, None, None)] * 3 + [(300, "maki tulo " * 4000, None, "s2", 40_000, None, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Parquet tables with extra columns whose names clash with results; and empty ones."""
    full, none = (str(tmp_path_factory.mktemp(n)) for n in ("full", "none"))
    rng = np.random.default_rng(2)
    labels = [(i, 1, int(i % 4 == 0), "x") for i in range(120)] + [(0, 1, None, "x"), (None, 1, 1, "x"), (4, 0, 1, "x")]
    vectors = [(i, rng.normal(size=5).tolist(), 0, 0.5) for i in range(0, 600, 2)] + [(None, [1.0] * 5, 0, 0.1), (100, None, 0, 0.1), (102, [0.0] * 5, 0, 0.1)]
    said = [(1, k, "user", f"message number {k} of one", 7) for k in range(5)] + [(1, 5, "user", "> message number 2 of one\nyes", 7), (None, None, None, None, None), (2, 0, "user", "", 1)]
    for name, rows, schema in (
        ("documents", documents(), "doc_id long, text string, lang string, source string, n_chars long, score string, shard int"), ("labels", labels, "doc_id long, quality int, toxic int, held_out string"),
        ("embeddings", vectors, "vec_id long, embedding array<double>, label int, score double"), ("conversations", said, "conv_id long, turn long, role string, text string, position int"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{none}/{name}.parquet")
    return full, none


COLUMNS = {
    "op1_kernel_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_pii_spans": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_quote_linking": {"conv_id": "bigint", "position": "bigint", "turn": "bigint", "text": "string", "reply_conv": "bigint", "reply_turn": "bigint"},
    "op4_entropy_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_learned_partitions": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_spotsigs": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op8_label_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_simhash_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_bin_completion": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op11_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op12_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op13_repeated_passages": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_rows_and_empty_tables(spark, tables, name):
    full, none = tables
    frame = queries.QUERIES[name](spark, full)
    assert COLUMNS[name].items() <= dict(frame.dtypes).items()
    rows = frame.collect()
    empty = queries.QUERIES[name](spark, none)
    assert COLUMNS[name].items() <= dict(empty.dtypes).items() and empty.count() == 0
    docs = documents()
    if "doc_id" in COLUMNS[name] and "piece" not in COLUMNS[name]:
        assert Counter(r.doc_id for r in rows) == Counter(d for d, *_ in docs)
    globals()[f"check_{name.split('_')[0]}"](rows, docs)


def held_out(doc, parts, part):
    return zlib.crc32(str(doc).encode()) % parts == part


def check_op1(rows, docs):
    assert all(r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    toxic = {d for d, t, *_ in docs if t and "moron" in t}
    assert not [(r.doc_id, r.score) for r in rows if r.predicted != (r.doc_id in toxic)]


def check_op2(rows, docs):
    text = {d: t or "" for d, t, *_ in docs}
    for r in rows:
        base = plain_base(text[r.doc_id])
        listed = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert set(listed) <= set(r.spans.split(",") if r.spans else [])


def check_op3(rows, docs):
    assert len(rows) == 8
    own = {r.turn: r for r in rows if r.conv_id == 1}
    assert (own[5].reply_conv, own[5].reply_turn, own[5].text) == (1, 2, "yes") and sorted(r["position"] for r in own.values()) == list(range(6))


def check_op4(rows, docs):
    size = Counter()
    for _, t, _, s, *_ in docs:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {d: s for d, _, _, s, *_ in docs}
    taken, target = Counter(), {}
    for r in rows:
        if r.doc_id in source:
            assert r.source_size == size[source[r.doc_id]] and r.taken <= 3 * r.size and (r.size == 0) <= (r.taken == 0)
            target[source[r.doc_id]] = r.target
            taken[source[r.doc_id]] += r.taken
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    assert all(target[s] <= 3 * size[s] + 1e-6 for s in target)
    assert all(abs(taken[s] - target[s]) <= 130 for s in target if s != "s2"), (taken, target)  # half of s2 is one document


def check_op5(rows, docs):
    lang = {d: x for d, _, x, *_ in docs}
    letters = {d: any(c.isalpha() for c in t or "") for d, t, *_ in docs}
    assert all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    assert not [(r.doc_id, r.lang_pred) for r in rows if r.lang_pred != ("und" if not letters[r.doc_id] else lang[r.doc_id] or "aa")]


def check_op6(rows, docs):
    by = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {0, 100, 200, 300, 400, 500}
    for q, hits in by.items():
        assert [r["rank"] for r in hits] == list(range(1, 11)) and all(r.vec_id != q for r in hits)
        assert [(r.score, r.vec_id) for r in hits] == sorted((r.score, r.vec_id) for r in hits)


def check_op7(rows, docs):
    text = {d: t or "" for d, t, *_ in docs}
    assert all(r.n_chars == len(text[r.doc_id]) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id == 3}) == 1


def check_op8(rows, docs):
    text = {d: (t or "").encode() for d, t, *_ in docs}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in rows)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in counts.items())


def check_op9(rows, docs):
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows)
    found = Counter((r.doc_id, r.component_id) for r in rows)
    assert found == Counter((d, least) for d, _, least in plain_components([(d, t) for d, t, *_ in docs]))


def check_op10(rows, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for d, t, *_ in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048


def check_op11(rows, docs):
    vectors = Counter([*range(0, 600, 2), None, 102])
    assert Counter(r.vec_id for r in rows) == Counter({v: 5 * k for v, k in vectors.items()})
    assert {r.n for r in rows} == {302} and all(r.identity_error <= 1e-4 for r in rows)
    assert abs(sum({r.component: r.explained for r in rows}.values()) - 1) < 1e-9


def check_op12(rows, docs):
    assert sorted((tuple(r) for r in rows), key=lambda r: r[0]) == plain_variants([(d, t) for d, t, *_ in docs])


def check_op13(rows, docs):
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in plain_repeats([(d, t) for d, t, *_ in docs], 35)]
    assert sorted(tuple(r) for r in rows) == sorted(want)
