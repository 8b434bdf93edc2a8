"""Operator 12: groups of spelling variants, by a symmetric-delete join.

Words are counted over all texts. Each word emits itself and its single deletions as hash keys, and keys meet in equi-joins:
a deletion with a whole word (one letter more or less), and a deletion with another word's deletion at the same place (one
letter replaced). So candidates are the near pairs and hash collisions alone, and the words that meet under a key
are at most as many as there are letters. Every candidate is checked on the words themselves. A word's form
is its most frequent near word, if that is frequent enough, and roots follow forms by doubling joins: n doubles
with each form, so chains are short.

Nulls and odd rows: a null or empty text has no words; a null doc_id counts as an empty one. Repeated rows are
counted again. A word of any length emits one key of 8 bytes for each letter, never the deletions themselves. Ties
between near words go to the smallest in code-point order. Further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fewest letters and occurrences of a word; a form is at least RATIO times as frequent.
LETTERS, OCCURRENCES, RATIO = 5, 3, 2
#: One in EDITED occurrences (by hash) loses a letter first.
EDITED = 97
#: Letters of a text that are read at once, distinct words that a task holds before it passes them on, letters whose keys are made at once.
BLOCK, HELD, KEYED = 1 << 20, 200_000, 1 << 20
_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]
#: Latin-1 bytes: A-Z become a-z, other letters stay, anything else parts words.
_TABLE = bytes((c + 32 if c < 0x5B else c) if c in _LETTERS else 0x20 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def runs(text: str) -> Counter:
    """How often each maximal run of letters is in a text, A-Z lower-cased; runs are Latin-1 bytes."""
    data = text.encode("latin-1", "replace").translate(_TABLE)  # whatever is beyond Latin-1 parts words
    found, at = Counter(), 0
    while at < len(data):
        end = data.find(b" ", min(at + BLOCK, len(data)))
        end = len(data) if end < 0 else end
        found.update(data[at:end].split(b" "))
        at = end
    found.pop(b"", None)
    return found


def edited(run: bytes, prefix: int) -> bytes:
    """The run, less a letter if the hash says so; prefix is the CRC of the document's id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % EDITED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) of at least so many letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                prefix = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for found, n in runs(text.as_py() or "").items():
                    if len(found) >= letters and len(word := edited(found, prefix)) >= letters:
                        held[word] += n
                if len(held) >= HELD:
                    yield passed()
        if held:
            yield passed()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, word, slot, key): a key of each word; and of each word without the letter at slot, over all words and slots.

    A key is the sum of a letter's hash times a power of its place, so that of a deletion follows from the sums before and behind it.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    slot = np.arange(len(codes)) - (ends - lengths)[of]
    powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, _BASE, np.uint64))
    mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    terms = (mixed ^ (mixed >> np.uint64(29))) * powers[slot]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    starts, whole = sums[ends - lengths], sums[ends] - sums[ends - lengths]
    before = sums[:-1] - starts[of]
    return whole, of, slot, before + (whole[of] - before - terms) * _INVERSE


def emitted(words: DataFrame) -> DataFrame:
    """(id, slot, key, first) of ``words`` (id, word): slot -1 has the word itself; first marks one slot of each distinct deletion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            part = np.cumsum([len(w) for w in words]) // KEYED
            for at in np.split(np.arange(len(words)), np.flatnonzero(np.diff(part)) + 1) if words else []:
                some = [words[i] for i in at]
                whole, of, slot, key = deletion_keys(some)
                letter = np.frombuffer("".join(some).encode("utf-32-le"), "<u4")
                first = (slot == 0) | (letter != np.roll(letter, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids[at], ids[at][of]])), pa.array(np.concatenate([np.full(len(at), -1), slot]).astype(np.int32)),
                        pa.array(np.concatenate([whole, key]).view(np.int64)), pa.array(np.concatenate([np.ones(len(at), bool), first])),
                    ],
                    ["id", "slot", "key", "first"],
                )

    return words.select("id", "word").mapInArrow(run, "id long, slot int, key long, first boolean")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), both ways, for each two of ``words`` (id, word, n) that differ by one inserted, deleted or replaced letter; with their word and n as word_a, n_a and so on."""
    keys = materialize(emitted(words))
    gone = keys.where("slot >= 0")
    other = gone.select(F.col("id").alias("b"), "slot", "key")
    replaced = gone.select(F.col("id").alias("a"), "slot", "key").join(other, ["key", "slot"]).where("a < b").select("a", "b", "slot")
    whole = keys.where("slot < 0").select(F.col("id").alias("b"), "key")
    shorter = gone.where("first").select(F.col("id").alias("a"), "slot", "key").join(whole, "key").select("a", "b", "slot")
    pairs = materialize(replaced.unionByName(shorter))
    for c in "ab":
        pairs = pairs.join(words.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}"), F.col("n").alias(f"n_{c}")), c)
    head, tail = (lambda w: F.expr(f"substr({w}, 1, slot)")), (lambda w: F.expr(f"substr({w}, slot + 2)"))
    same = (F.length("word_a") == F.length("word_b")) & (head("word_a") == head("word_b")) & (tail("word_a") == tail("word_b")) & (F.col("word_a") != F.col("word_b"))
    less = F.concat(head("word_a"), tail("word_a")) == F.col("word_b")
    near = materialize(pairs.where(same | less).drop("slot"))
    turned = near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("word_b").alias("word_a"), F.col("n_b").alias("n_a"), F.col("word_a").alias("word_b"), F.col("n_a").alias("n_b"))
    return near.unionByName(turned)


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root): the last word that ``links`` (word, form) lead to. Each round follows twice as many links as the one before."""
    current = materialize(links.select("word", F.col("form").alias("root")))
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialize(current.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        current = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return current


def variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``docs`` (doc_id, text) that is long and frequent enough."""
    counted = count_words(docs, letters).where(F.col("n") >= occurrences)
    words = materialize(counted.withColumn("id", F.monotonically_increasing_id()))  # ids are fixed once written
    best = near_pairs(words).groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "word_b")).alias("best"))
    joined = words.join(best.withColumnRenamed("a", "id"), "id", "left")
    likely = -F.col("best.less") >= ratio * F.col("n")
    formed = materialize(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(likely, F.col("best.word_b")).alias("form"), F.when(likely, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = last_forms(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
