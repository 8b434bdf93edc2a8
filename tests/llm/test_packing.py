import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string"


def fewest(counts, capacity):
    """Exact optimum of tiny cases by trying every placement."""
    items = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


def test_plans_use_everything_and_are_near_optimal():
    rng = random.Random(2)
    for _ in range(60):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(0, 11)))
        plan = packing.complete_bins(counts, 30)
        used = Counter()
        for filling, times in plan:
            assert sum(x * n for x, n in filling) <= 30
            for x, n in filling:
                used[x] += n * times
        assert used == counts
        assert sum(t for _, t in plan) <= fewest(counts, 30) + (sum(counts.values()) > 9)


def test_large_histogram_reaches_the_bound():
    rng = np.random.default_rng(4)
    counts = dict(Counter(np.minimum(2048, rng.lognormal(6, 1, 200_000).astype(int) + 1).tolist()))
    plan = packing.complete_bins(counts, 2048)
    total = sum(x * n for x, n in counts.items())
    assert sum(t for _, t in plan) <= -(-total // 2048) * 1.001


def test_documents(spark):
    rng = random.Random(9)
    words = ["The", "cat's", "naïve", "ÉCOLE", "x1y22", "a b", "tab\tsep", "<|endoftext|>", "%%%", "日本", "ﬁ", "é", "ΟΔΟΣ", "\x1c", " "]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 90))), "x") for i in range(120)]
    rows += [(7, rows[7][1], "x"), (None, "one two", None), (500, None, None), (501, "", None), (502, "word " * 9000, None)]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), PATH, capacity=64, with_ids=True).collect()
    plain = tokenizers.Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text, _ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[doc, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in out) == want
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64
    assert len(filled) <= -(-sum(r.length for r in out) // 64) + 2


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_ids_of_letters_and_marks_equal_the_tokenizer():
    rng = random.Random(5)
    own, plain = packing.Encoder(PATH), tokenizers.Tokenizer.from_file(PATH)
    letters = [c for c in map(chr, range(0x21, 0x2000)) if c.isalpha()]
    marks = [c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c)]
    texts = ["HABERLERİ: GÜNDEMİ!", "TÜRKİYE'DEKİ DÜNYADAKİ, DAHİ.", "Kİ.", "<|ENDOFTEXT|> a", "a<|endoftext|>b", "T̈ W̊ Y̊ H̱ J̌"]
    texts += [f"{c}{p}" for c in letters for p in ".:'"]
    texts += [f"{b}{m}" for b in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC5, 0x130, 0x3A3]) for m in marks]
    pool = [*"abcXYZ.,:'\"<|>-_ 012\n", "İ", "ß", "É", "é", "Σ", "ﬁ", "你", "̇", " ", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "😀", "Ｋ"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    for text, ids in zip(texts, own.encode(pa.array(texts, pa.string()), 0), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0], ascii(text)


def test_dominated_fillings():
    assert packing.dominates({7: 1}, {4: 1, 3: 1}) and packing.dominates({5: 1, 7: 1}, {4: 1, 3: 2}) and packing.dominates({5: 2}, {5: 1, 4: 1})
    assert not packing.dominates({4: 1, 3: 1}, {7: 1}) and not packing.dominates({6: 1, 4: 1}, {5: 2})
    left = {10: 1, 6: 1, 5: 2, 3: 2, 2: 1}
    kept = packing.fillings(left, 10, 20, 20)
    assert kept[0][0] == 0 and all(not packing.dominates(a, b) for _, a in kept for _, b in kept if a != b)
