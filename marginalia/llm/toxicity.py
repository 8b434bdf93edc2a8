"""Operator 1: toxicity by a subsequence string-kernel SVM with Nystrom landmarks.

The kernel of two words is the gap-weighted count of common subsequences of ORDER letters, normalised; gaps and
inserted letters only lower it. Landmarks are words that tell toxic documents from others, and some common ones;
with the kernel between landmarks K, a word's features are K^-1/2 k(word), so its decision is a weighted sum of
its kernels with the landmarks. A sentence is as toxic as its worst word, or its worst pair of short adjacent
words taken as one; a document's probability follows from its TOP worst different words.

Labels are those of documents, so sentences are labelled by multiple-instance learning: a first SVM parts the
telling words from common ones; then, in each round, the sentences of toxic documents that it takes for toxic,
and the worst one of a toxic document if it comes near, are positive, all sentences of clean documents are
negative, and the SVM is fitted anew to their worst words, to words disguised by a letter more, and to clean words that
look toxic. Scores are calibrated on the sampled documents by logistic regression.

Learning is bounded by parameters of ``fit``: ``sample`` labelled documents (toxic, clean) are looked at whole;
``telling`` words and ``landmarks`` (toxic, common) are taken from all their words, and ``instances`` (toxic, clean) worst words of
sentences, the most frequent and the hardest ones, are fitted in a round.

Words are runs between white space, lower-cased, without ASCII punctuation, so "i-d-i-o-t" is a word; single
letters in a row are one word; long ones are looked at in overlapping windows. Null, empty and blank texts
have the score of a text without toxic words. Rows with null doc_id count as held out; a doc_id labelled
twice is toxic if any label is, one with several texts is learned from by the least of them. Repeated rows are
scored each; other columns are ignored. Without toxic examples every score is 0.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Subsequence length, and decay of a letter or gap.
ORDER, DECAY = 3, 0.7
#: Sampled labelled documents (toxic, clean), telling words, landmarks (toxic, common), instances of a round (toxic, clean).
SAMPLE, TELLING, LANDMARKS, INSTANCES = (1000, 2000), 400, (28, 4), (3000, 6000)
#: Letters of a word that are compared at once, those of both words of a pair at most, and worst words that a document is judged by.
WINDOW, PAIRED, TOP = 20, 4, 3
#: Cached words of a worker, texts that are scored together, and parts that the sample is dealt to.
CACHE, SLICE, PARTS = 700_000, 2500, 24
#: Weights of the clean words that look toxic and of disguised words, those of the sentences of a class being 1 together.
HARD, DISGUISED = 3.0, 0.2
#: Weight of documents with a disguised word alone in the calibration, that of the toxic documents being 1.
HIDDEN = 0.2
#: Decisions below the floor are alike; words above NEAR look toxic.
FLOOR, NEAR = -1.5, -0.9
_SINGLES = re.compile(rb"(?:(?<=\s)|\A)(?:[a-z0-9]\s){2,}[a-z0-9](?=\s|\Z)")
_SHAPE = bytes(32 if chr(c).isspace() and c < 128 else 97 for c in range(256))
_PUNCTUATION = string.punctuation.encode()
SENTENCE = re.compile(r"[.!?\n|]+\s*")


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def prepared(text: str | None) -> bytes:
    """Lower-case UTF-8 without ASCII punctuation, single letters in a row joined."""
    plain = (text or "").lower().encode("utf-8", "replace").translate(None, _PUNCTUATION)
    if b" a a a " in b" %b " % plain.translate(_SHAPE):
        plain = _SINGLES.sub(lambda m: b"".join(m.group().split()), plain)
    return plain


def words(text: str | None) -> list[str]:
    return [w.decode() for w in prepared(text).split()]


def word_windows(text: str) -> list[str]:
    return [text] if len(text) <= WINDOW else [text[i : i + WINDOW] for i in range(0, len(text) - WINDOW // 2, WINDOW // 2)]


def _codes(texts: list[str], pad: int) -> np.ndarray:
    """Letters by position: (longest, texts)."""
    wide = max(map(len, texts))
    flat = np.frombuffer("".join(t.ljust(wide, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), "<i4").reshape(len(texts), wide)
    return np.ascontiguousarray(np.where(flat == 0, pad, flat).T)


def raw_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted common subsequences of column pairs of a (n, pairs) and b (m, pairs or 1)."""
    same = (a[:, None, :] == b[None, :, :]).astype(np.float32) * np.float32(DECAY**2)
    ends = same
    for _ in range(ORDER - 1):
        rows, both = np.zeros_like(ends), np.zeros_like(ends)
        for i in range(1, len(a)):
            rows[i] = rows[i - 1] * np.float32(DECAY) + ends[i - 1]
        for j in range(1, len(b)):
            both[:, j] = both[:, j - 1] * np.float32(DECAY) + rows[:, j - 1]
        ends = same * both
    return ends.sum(axis=(0, 1))


def self_kernel(texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts), np.float32)
    for at in range(0, len(texts), 1024):
        out[at : at + 1024] = raw_kernel(_codes(texts[at : at + 1024], -1), _codes(texts[at : at + 1024], -2))
    return out


def kernels(texts: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernels (texts x landmarks) of words; texts are at most WINDOW letters long.

    Words with fewer than ORDER letters in common have no subsequence of that length in common, so their kernel
    is 0 without looking further.
    """
    out = np.zeros((len(texts), len(landmarks)), np.float32)
    order = sorted((i for i, t in enumerate(texts) if len(t) >= ORDER), key=lambda i: len(texts[i]))
    own = self_kernel(landmarks)
    for at in range(0, len(order), 2048):  # words of about one length
        part = np.array(order[at : at + 2048])
        some = [texts[i] for i in part]
        codes, norm = _codes(some, -1), self_kernel(some)
        for k, landmark in enumerate(landmarks):
            shared = np.zeros(len(some), np.int8)
            for letter in set(landmark):
                shared += np.minimum((codes == ord(letter)).sum(axis=0), landmark.count(letter)).astype(np.int8)
            close = np.flatnonzero(shared >= ORDER)
            if len(close):
                out[part[close], k] = raw_kernel(codes[:, close], _codes([landmark], -2)) / np.sqrt(norm[close] * own[k])
    return out


class Model:
    """Landmarks and their weights; ``judge`` makes a document's worst decisions a probability (its last weight is the shift)."""

    def __init__(self, landmarks: list[str], alpha: np.ndarray, bias: float, judge: np.ndarray | None = None):
        self.landmarks, self.alpha, self.bias, self.judge = landmarks, alpha, bias, judge

    def decide(self, some: list[str]) -> np.ndarray:
        """Decision of each word."""
        parts = [word_windows(w) for w in some]
        flat = [p for ps in parts for p in ps]
        if not flat:
            return np.zeros(0)
        values = np.empty(len(flat))
        for at in range(0, len(flat), 32768):
            values[at : at + 32768] = kernels(flat[at : at + 32768], self.landmarks) @ self.alpha + self.bias
        firsts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        return np.maximum(np.maximum.reduceat(values, firsts), FLOOR).round(4)

    def probability(self, worst: np.ndarray) -> np.ndarray:
        """Of documents by their worst decisions (documents x TOP)."""
        return 1 / (1 + np.exp(-np.clip(worst @ self.judge[:-1] + self.judge[-1], -40, 40)))


class Scorer:
    """Decisions of texts; words are looked up, new ones decided together."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def turned(self, model: Model) -> Scorer:
        """Scorer of a model with the same landmarks; kernels are kept, as learning goes over the same words in each round."""
        if not hasattr(self, "vectors"):
            self.vectors: dict[str, np.ndarray] = {}
        self.model, self.cache = model, {}
        return self

    def _decide(self, new: list[str]) -> list[float]:
        if not hasattr(self, "vectors"):
            return self.model.decide(new).tolist()
        parts = {w: word_windows(w) for w in new}
        unknown = sorted({p for ps in parts.values() for p in ps if p not in self.vectors})
        self.vectors.update(zip(unknown, kernels(unknown, self.model.landmarks), strict=True))
        if not new:
            return []
        values = np.array([self.vectors[p] for ps in parts.values() for p in ps]) @ self.model.alpha + self.model.bias
        firsts = np.cumsum([0] + [len(ps) for ps in parts.values()][:-1])
        return np.maximum(np.maximum.reduceat(values, firsts), FLOOR).round(4).tolist()

    def _values(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, list[str]]:
        """Decision of each entry, and the dictionary."""
        found = coded.dictionary.to_pylist()
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = [w for w in found if w not in self.cache]
        self.cache.update(zip(new, self._decide(new), strict=True))
        return np.fromiter(map(self.cache.__getitem__, found), float, len(found))[coded.indices.to_numpy()], found

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """The TOP worst decisions of different words of each text (texts x TOP), and its worst word."""
        split = pc.ascii_split_whitespace(pa.array([prepared(t) for t in texts], pa.binary()).cast(pa.string()))
        flat = split.flatten()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        short = pc.utf8_length(flat).to_numpy() <= PAIRED
        pair = np.flatnonzero(short[:-1] & short[1:] & (row[:-1] == row[1:])) if len(flat) > 1 else np.empty(0, np.int64)
        joined = pc.binary_join_element_wise(flat.take(pa.array(pair)), flat.take(pa.array(pair + 1)), "")
        rows, values, names = [], [], []
        for some, of in ((flat, row), (joined, row[pair])):
            coded = some.dictionary_encode()
            value, found = self._values(coded)
            high = np.flatnonzero(value > FLOOR)
            rows.append(of[high])
            values.append(value[high])
            names += [found[i] for i in coded.indices.to_numpy()[high]]
        rows, values = np.concatenate(rows), np.concatenate(values)
        top, worst = np.full((len(texts), TOP), FLOOR), [""] * len(texts)
        seen: set[tuple[int, str]] = set()
        used = np.zeros(len(texts), np.int64)
        for i in np.lexsort((np.arange(len(rows)), -values)).tolist():
            at, name = int(rows[i]), names[i]
            if used[at] < TOP and (at, name) not in seen:
                seen.add((at, name))
                top[at, used[at]] = values[i]
                if not used[at]:
                    worst[at] = name
                used[at] += 1
        return top, worst


_scorers: dict[tuple, Scorer] = {}


def scorer(model: Model, learning: bool = False) -> Scorer:
    """One for each worker process and model; while learning, one for the landmarks."""
    key = (learning, *model.landmarks) if learning else (learning, *model.landmarks, model.alpha.tobytes(), model.bias)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key].turned(model) if learning else _scorers[key]


def decisions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, decisions, worst) of each row of ``docs`` (doc_id, text): the TOP worst decisions, and the worst word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                top, worst = own.texts(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(top) + 1, dtype=np.int32) * TOP), pa.array(top.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(worst, pa.string())], ["doc_id", "decisions", "worst"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, decisions array<double>, worst string")


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most so many toxic and clean documents that are not held out; materialized."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(sample[0]).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample[1]))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return materialize(one.repartition(PARTS, "doc_id"))


def telling_words(sample: DataFrame, least: float = 20.0, most: int = TELLING) -> tuple[list[tuple[str, float]], list[str]]:
    """Words of significantly more toxic documents with their G statistic, and words that both kinds have.

    A document counts through its longest word, so that copies and near copies count once.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                own = {p for w in set(words(text)) for p in word_windows(w)}
                doc = zlib.crc32(max(own, key=lambda x: (len(x), x), default="").encode())
                rows += [(w, doc, toxic) for w in own if len(w) >= ORDER]
            yield pd.DataFrame(rows, columns=["word", "doc", "toxic"])

    seen = materialize(
        sample.mapInPandas(cut, "word string, doc long, toxic int").groupBy("word").agg(
            F.countDistinct(F.when(F.col("toxic") == 1, F.col("doc"))).alias("a"), F.countDistinct(F.when(F.col("toxic") == 0, F.col("doc"))).alias("b")
        )
    )
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not n1:
        return [], []
    rate = n1 / (n1 + n0)
    term = lambda k, share: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / ((F.col("a") + F.col("b")) * share))).otherwise(0.0)
    scored = seen.withColumn("g", 2 * (term("a", rate) + term("b", max(1e-9, 1 - rate)))).where(F.col("a") * n0 > F.col("b") * n1 * 8)
    found = scored.where(F.col("g") >= min(least, 4.0 + n1)).orderBy(F.desc("g"), "word").limit(most).collect()
    taken = {r.word for r in found}
    common = seen.where("a > 0 and b > 0" if n0 else "a > 0").orderBy(F.desc("b"), "word").limit(200).collect()
    return [(r.word, r.g) for r in found], [r.word for r in common if r.word not in taken]


def pick_landmarks(telling: list[tuple[str, float]], common: list[str], sizes: tuple[int, int] = LANDMARKS) -> list[str]:
    """Telling words that the chosen ones cover least, weighed by their statistic, then common words."""
    names = [w for w, _ in telling]
    k = kernels(names, names)
    cover, chosen = np.zeros(len(names)), []
    weight = np.sqrt([g for _, g in telling])
    while len(chosen) < min(sizes[0], len(names)):
        best = int(np.argmax(weight * (1.01 - cover) * ~np.isin(np.arange(len(names)), chosen)))
        chosen.append(best)
        cover = np.maximum(cover, k[:, best])
    return [names[i] for i in chosen] + common[: sizes[1]]


def disguised(words_: list[str]) -> list[str]:
    """Each word with one letter more, at two places inside."""
    letters = string.ascii_lowercase
    return sorted({w[:cut] + letters[(7 * k + cut) % 26] + w[cut:] for k, w in enumerate(words_) for cut in (len(w) // 2, max(1, len(w) // 3))})


def svm(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Primal squared-hinge SVM by Newton steps on the active rows; the last weight is the bias."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    loss = lambda w: (weights * np.maximum(0, 1 - y * (x1 @ w)) ** 2).sum() + (penalty * w * w).sum()
    w = np.zeros(x1.shape[1])
    active, best = np.ones(len(y), bool), loss(w)
    for _ in range(rounds):
        xa, wa = x1[active], weights[active, None]
        step = np.linalg.solve(xa.T @ (wa * xa) + np.diag(penalty), xa.T @ (wa[:, 0] * y[active])) - w
        size = 1.0
        while (now := loss(w + size * step)) > best and size > 1e-3:
            size /= 2
        if now >= best - 1e-9 * best:
            break
        w, best = w + size * step, now
        active = y * (x1 @ w) < 1
    return w


def witnesses(text: str, toxic: int, own: Scorer) -> list[tuple[str, float]]:
    """(worst word, decision) of the sentences of a document that multiple-instance learning takes.

    Of toxic documents these are sentences that look toxic, and the worst one if it comes near; of clean ones all.
    Sentences with the same worst word count once.
    """
    top, worst = own.texts(SENTENCE.split(text))
    best: dict[str, float] = {}
    for w, d in zip(worst, top[:, 0].tolist(), strict=True):
        best[w] = max(d, best.get(w, FLOOR))
    most = max(best.values())
    return [(w, d) for w, d in best.items() if w and (not toxic or d > 0 or d == most > NEAR)]


def instances(sample: DataFrame, model: Model, most: tuple[int, int] = INSTANCES) -> dict[int, list[tuple[str, int, float]]]:
    """Worst words of the witnesses by label (1: toxic) with their numbers of documents and decisions."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = scorer(shared.value, learning=True)
        for frame in frames:
            rows = [(w, toxic, d) for text, toxic in zip(frame["text"], frame["toxic"], strict=True) for w, d in witnesses(text, toxic, own)]
            yield pd.DataFrame(rows, columns=["word", "toxic", "d"])

    seen = materialize(sample.mapInPandas(run, "word string, toxic int, d double").groupBy("word", "toxic").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")))
    order = {1: [F.desc("n"), F.desc("d"), F.col("word")], 0: [F.desc("d"), F.col("word")]}
    return {y: [(r.word, r.n, r.d) for r in seen.where(F.col("toxic") == y).orderBy(*order[y]).limit(most[1 - y]).collect()] for y in (1, 0)}


def judged(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Worst decisions (documents x TOP) and labels of the sample."""
    seen = decisions(sample.select("doc_id", "text"), model).join(sample.select("doc_id", "toxic"), "doc_id").orderBy("doc_id").toPandas()
    return np.stack(seen["decisions"].to_numpy()), seen["toxic"].to_numpy(float)


def fit(
    docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, telling: int = TELLING, landmarks: tuple[int, int] = LANDMARKS, instances_: tuple[int, int] = INSTANCES,
) -> Model | None:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic) that are not held out; None without toxic examples."""
    drawn = labelled_sample(docs, labels, sample)
    told, common = telling_words(drawn, most=telling)
    if not told:
        return None
    names = pick_landmarks(told, common, landmarks)
    return learn(told, common, names, lambda model: instances(drawn, model, instances_), lambda model: judged(drawn, model))


def learn(
    told: list[tuple[str, float]], common: list[str], names: list[str], find: Callable[[Model], dict], judge: Callable[[Model], tuple],
    rounds: int = 3, hard: float = HARD, disguise: float = DISGUISED, hidden: float = HIDDEN,
) -> Model:
    """A model from telling words with their statistics, common words and landmarks; ``find`` gives the instances of a round, ``judge`` worst decisions and labels of documents."""
    values, vectors = np.linalg.eigh(kernels(names, names).astype(float))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T  # K^-1/2
    masked = {m: g for w, g in told for m in disguised([w]) if len(m) <= WINDOW}  # a disguised word counts as its word's statistic
    extra, strength = list(masked), np.array(list(masked.values()))
    known: dict[str, np.ndarray] = {}

    def trained(groups: list[tuple[list[str], list[float], int, float]]) -> Model:
        """Groups of (words, weights, label, weight of the group)."""
        groups = [([w[:WINDOW] for w in some], weights, y, share) for some, weights, y, share in groups if some]
        new = sorted({w for some, *_ in groups for w in some} - known.keys())
        known.update(zip(new, kernels(new, names) @ root, strict=True))
        x = np.array([known[w] for some, *_ in groups for w in some])
        y = np.concatenate([np.full(len(g[0]), float(g[2])) for g in groups])
        weight = np.concatenate([g[3] * np.array(g[1], float) / np.sum(g[1]) for g in groups]) * len(y)
        w = svm(x, y, weight)
        return Model(names, root @ w[:-1], float(w[-1]))

    ones = lambda some: [1.0] * len(some)
    first = ([w for w, _ in told], [g for _, g in told])
    model = trained([(*first, 1, 1.0), (extra, strength, 1, disguise), (common, ones(common), -1, 1.0)])
    for _ in range(rounds):
        found = find(model)
        groups = [(found[1], 1, 1.0), (found[0], -1, 1.0), ([x for x in found[0] if x[2] > NEAR], -1, hard)]
        model = trained([([w for w, *_ in g], [n**0.5 for _, n, _ in g], y, share) for g, y, share in groups] + [(extra, strength, 1, disguise), (common, ones(common), -1, 0.2)])
    top, toxic = judge(model)
    alone = np.full((len(extra), TOP), FLOOR)
    alone[:, 0] = model.decide(extra)  # documents with one disguised word
    share = hidden * toxic.sum() * strength / strength.sum()
    model.judge = calibrate(np.vstack([top, alone]), np.r_[toxic, np.ones(len(extra))], np.r_[np.ones(len(top)), share])
    return model


def calibrate(worst: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression of the label on the worst decisions, with softened labels; the last weight is the shift.

    No weight is negative: a worse word never lowers the score.
    """
    n1, n0 = (weight * toxic).sum(), (weight * (1 - toxic)).sum()
    y = np.where(toxic > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    used = np.ones(worst.shape[1] + 1, bool)
    while True:
        x = np.hstack([worst, np.ones((len(worst), 1))])[:, used]
        ridge = np.r_[np.full(x.shape[1] - 1, 1e-2), 1e-6]
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            h = x.T @ ((weight * p * (1 - p) + 1e-9)[:, None] * x) + np.diag(ridge)
            w = w - np.clip(np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w), -2, 2)
        out = np.zeros(len(used))
        out[used] = w
        if (out[:-1] >= 0).all():
            return out
        used[int(np.argmin(out[:-1]))] = False


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text)."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    odds = sum((F.col("decisions")[k] * float(w) for k, w in enumerate(model.judge[:-1])), F.lit(float(model.judge[-1])))
    return decisions(docs, model).select("doc_id", (1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-40.0)), F.lit(40.0))))).alias("score"))
