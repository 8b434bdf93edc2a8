"""Operator 5: language ID by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of anything but letters become one blank, and all 1- to 3-grams are
hashed into BUCKETS counters. Training counts come from a bounded sample, drawn evenly by a hash of
doc_id: about ``per_lang`` documents of each language. The log-probability matrix (BUCKETS x languages)
is broadcast; whole texts are scored batch by batch in numpy, as the product of a sparse matrix (texts x buckets)
with it. The language is the one of the greatest posterior; neighbouring n-grams overlap, so the score is the
posterior share of evidence made as weak as that of a short text, in the same order.

Nulls and odd rows: a null text or one without a letter is ``und`` with score 0; so is every text if
there is nothing to learn from. Rows with null lang are never learned from, nor rows with a null
doc_id, which count as held out. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Training documents of each language, about.
PER_LANG = 1500
#: A score's evidence grows with the n-grams of a text towards this many, each of this weight. Predictions use all evidence.
EVIDENCE, WEIGHT = 600, 0.25
#: Characters that are scored together, and n-grams looked up at once.
SLAB, LOOKED_UP = 1 << 18, 1 << 18
UNKNOWN = "und"


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all n-grams of some texts, repeats included, by order and row; none of a text without a letter.

    The texts are one array: a blank before the first word of each and one behind each word.
    """
    lowered = [(t or "").lower() for t in texts]
    chars = np.frombuffer("".join(f"\0{t}\0" for t in lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(lowered)), [len(t) + 2 for t in lowered])
    letter = _letters()[chars]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a blank behind each word
    keep[np.cumsum([0] + [len(t) + 2 for t in lowered[:-1]])[: len(lowered)]] = True
    keep &= np.bincount(row, letter, len(lowered)).astype(bool)[row]
    chars, row = np.where(letter, chars, np.uint32(32))[keep], row[keep]
    rows, found, rolled = [], [], np.zeros(len(chars), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(chars) < n:
            break
        rolled = (rolled[: len(chars) - n + 1] * np.uint32(0x01000193)) ^ chars[n - 1 :]
        if n in ORDERS:
            inside = row[: len(chars) - n + 1] == row[n - 1 :]
            rows.append(row[n - 1 :][inside])
            found.append(((rolled * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(16))[inside])
    return np.concatenate([*rows, np.empty(0, np.int64)]), np.concatenate([*found, np.empty(0, np.uint32)])


def slabs(texts: list[str | None], size: int = SLAB) -> Iterator[slice]:
    """Runs of texts of about that many characters together."""
    start = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t or "") > size:
            yield slice(start, k)
            start, held = k, 0
        held += len(t or "") + 2
    if held:
        yield slice(start, len(texts))


class Model:
    """Languages, log-probabilities (buckets x languages) and log-priors."""

    def __init__(self, langs: list[str], counts: np.ndarray, priors: np.ndarray, smooth: float = 0.1):
        self.langs = langs
        smoothed = counts + smooth
        self.logp = np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32)
        self.prior = np.log(priors / priors.sum())

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-posteriors of each text up to a constant (texts x languages), and its number of n-grams."""
        row, bucket = grams(texts)
        out = np.tile(self.prior, (len(texts), 1))
        for at in range(0, len(row), LOOKED_UP):
            own = row[at : at + LOOKED_UP]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            # the rows of an order ascend, so they are distinct between two falls
            np.add.at(out, own[starts], np.add.reduceat(self.logp[bucket[at : at + LOOKED_UP]], starts, axis=0, dtype=np.float64))
        return out, np.bincount(row, minlength=len(texts))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        langs, scores = [], np.zeros(len(texts))
        for part in slabs(texts):
            found, n = self.posteriors(texts[part])
            best = found.argmax(axis=1)
            weak = (found - found.max(axis=1, keepdims=True)) * (WEIGHT * EVIDENCE / (EVIDENCE + n))[:, None]
            scores[part] = np.where(n > 0, 1 / np.exp(weak).sum(axis=1), 0.0)
            langs += [self.langs[k] if m else UNKNOWN for k, m in zip(best.tolist(), n.tolist(), strict=True)]
        return langs, scores


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from rows of (doc_id, text, lang) with a language and a text."""
    docs = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.ones((BUCKETS, 1)), np.ones(1))
    steps = F.create_map(*[F.lit(x) for lang in langs for x in (lang, -(-counts[lang] // per_lang))])
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.element_at(steps, F.col("lang"))) == 0)
    number = {lang: i for i, lang in enumerate(langs)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for frame in frames:
            texts, which = frame["text"].tolist(), frame["lang"].map(number).to_numpy(np.int64)
            for part in slabs(texts):
                row, bucket = grams(texts[part])
                total += np.bincount(which[part][row] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        which, bucket = np.nonzero(total)
        yield pd.DataFrame({"k": which, "bucket": bucket, "n": total[which, bucket]})

    found = sample.mapInPandas(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((BUCKETS, len(langs)))
    table[found["bucket"], found["k"]] = found["n"]
    return Model(langs, table, np.array([counts[lang] for lang in langs], float))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def relabel(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` (text, lang, ...) whose prediction is a language with at least this score, lang being the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            new = pa.array(langs, pa.string())
            keep = pa.array((scores >= least) & (np.array(langs, object) != UNKNOWN), pa.bool_())
            yield batch.set_column(batch.schema.get_field_index("lang"), "lang", new).filter(keep)

    return docs.mapInArrow(run, docs.schema)
