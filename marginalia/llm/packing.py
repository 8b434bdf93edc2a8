"""Operator 10: pack documents into token sequences by bin completion.

Documents become token ids plus an end id; longer ones are cut into pieces of ``capacity`` tokens. Only
lengths matter for packing, and there are at most ``capacity`` of them, so the plan is made on the driver
from a histogram of that size, whatever the number of documents: bin completion takes the largest
remaining length, enumerates undominated fillings of the room beside it, least waste first, and branches
over them, bounded by waste; best-fit decreasing gives the first incumbent. A filling is repeated while
its lengths last. The plan says which ranks of a length go to which sequences; pieces get their rank
within their length in Spark, and so their sequence and offset.

Nulls and odd rows: a null or empty text is the end id alone. Repeated rows and ids are packed each; a
null doc_id passes through. Other columns are ignored. An empty table has no sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rank_within

CAPACITY = 2048
#: Fillings tried beside a document, steps of enumeration for them, and nodes of the whole search.
BRANCHES, STEPS, NODES = 3, 400, 6_000
#: Cached words of a tokenizer, and texts that are encoded together.
CACHE, SLICE = 400_000, 2500
#: Plain Latin letters, which stay single letters in the tokenizer's normal form, then ASCII punctuation without an
#: apostrophe: two words for the tokenizer. U+0130 is not among them, as its small form is a letter and a mark.
TAILED = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~]+)")


class Encoder:
    """Little-endian ids of texts; words are looked up, unknown ones encoded together.

    A word is a run between ASCII white space, which the tokenizer drops and joins nothing across. Words of ASCII
    alone are looked up in lower case, as the tokenizer ignores their case; others are left as they are, since it
    composes letters and marks before it lowers them. Texts that hold a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a word in lower case may look like a special token
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, texts: pa.Array, end: int) -> list[bytes]:
        """Ids of each text (a string array without nulls) and the end id, as bytes."""
        tail = np.array([end], "<u4").tobytes()
        odd = np.zeros(len(texts), bool)
        for special in self.special:
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", texts))
        flat = split.flatten()
        coded = pc.if_else(pc.string_is_ascii(flat), pc.ascii_lower(flat), flat).dictionary_encode()
        if len(self.cache) > CACHE:
            self.cache.clear()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        self._learn({w for w in words if w not in self.cache})
        found = [self.cache[w] for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start, pool = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u4")
        at = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[at])])
        ids = pool[np.repeat(start[at] - ends[:-1], size[at]) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[split.offsets.to_numpy() - split.offsets[0].as_py()]).tolist()
        out = [ids[a:b] + tail for a, b in zip(bounds, bounds[1:], strict=False)]
        for k in np.flatnonzero(odd):
            out[k] = np.array(self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes() + tail
        return out

    def _learn(self, new: set[bytes]) -> None:
        letters, others, tailed = [], [], []
        for word in sorted(new):
            text = word.decode()
            if text.isalpha():
                letters.append(text)
            elif found := TAILED.fullmatch(text):
                tailed.append((word, *found.groups()))
            else:
                others.append(text)
        for part, into in ((1, letters), (2, others)):
            more = {t[part] for t in tailed}
            into += sorted(m for m in more if (b := m.encode()) not in self.cache and b not in new)
        self._learn_letters(letters)
        self._learn_each(others)
        for word, stem, marks in tailed:
            self.cache[word] = self.cache[stem.encode()] + self.cache[marks.encode()]

    def _learn_letters(self, texts: list[str]) -> None:
        """Words of letters only are one text here, parted at the ids that end words."""
        for at in range(0, len(texts), 4096):
            part = texts[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):  # a letter that the tokenizer's normal form takes apart
                self._learn_each(part)
                continue
            raw, start = ids.tobytes(), 0
            for text, stop in zip(part, (4 * ends).tolist(), strict=True):
                self.cache[text.encode()] = raw[start:stop]
                start = stop

    def _learn_each(self, texts: list[str]) -> None:
        for at in range(0, len(texts), 20_000):
            part = texts[at : at + 20_000]
            for text, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.cache[text.encode()] = np.array(found.ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each piece of each document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), SLICE):
                rows = []
                for k, ids in enumerate(own.encode(pc.fill_null(texts.slice(at, SLICE), ""), end)):
                    for n, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        rows.append((at + k, n, start, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                row, n, start, length, crc, parts = zip(*rows, strict=True)
                columns = [batch.column(0).take(pa.array(row)), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4") for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


Filling = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: (filling with its largest length, times)."""
    left, plan = dict(counts), []
    for length in sorted(left, reverse=True):
        while left.get(length, 0):
            filling, room = {length: 1}, capacity - length
            for other in sorted((x for x in left if x <= room), reverse=True):
                if take := min(room // other, left[other] - filling.get(other, 0)):
                    filling[other] = filling.get(other, 0) + take
                    room -= take * other
            plan.append(_use(left, filling))
    return plan


def _use(left: dict[int, int], filling: dict[int, int]) -> tuple[Filling, int]:
    """Take a filling as often as it lasts."""
    times = min(left[x] // n for x, n in filling.items())
    for x, n in filling.items():
        left[x] -= times * n
        if not left[x]:
            del left[x]
    return tuple(sorted(filling.items(), reverse=True)), times


def fillings(left: dict[int, int], largest: int, capacity: int, allowed: int) -> list[tuple[int, dict[int, int]]]:
    """(waste, filling) around the largest length: undominated ones found within STEPS, least waste first, at most BRANCHES.

    A filling whose room would still hold a remaining length is dominated, and so are all others if one
    length fills the room, or those whose documents fit into a kept filling's. Wasteful ones beyond ``allowed`` are
    left out if there is another.
    """
    room = capacity - largest
    if not room:
        return [(0, {largest: 1})]
    spare = dict(left)
    spare[largest] -= 1
    if spare.get(room, 0) > 0:
        return [(0, {largest: 1, room: 1} if room != largest else {largest: 2})]
    sizes = sorted((x for x, n in spare.items() if n and x <= room), reverse=True)
    if not sizes:
        return [(room, {largest: 1})]
    found: list[tuple[int, int, dict[int, int]]] = []
    present, steps = set(sizes), 0

    def down(k: int, room: int, chosen: dict[int, int], items: int) -> bool:
        """True to stop: enough without waste, or out of steps."""
        nonlocal steps
        steps += 1
        if room in present and spare[room] > chosen.get(room, 0) and (k < len(sizes) and room <= sizes[k]):
            found.append((0, items + 1, chosen | {room: chosen.get(room, 0) + 1}))
            return len([f for f in found if not f[0]]) >= BRANCHES or steps > STEPS
        extended = False
        for i in range(k, len(sizes)):
            x = sizes[i]
            if x > room or spare[x] <= chosen.get(x, 0):
                continue
            extended = True
            if down(i, room - x, chosen | {x: chosen.get(x, 0) + 1}, items + 1):
                return True
        if not extended and all(x > room or spare[x] <= chosen.get(x, 0) for x in sizes[-3:]):
            found.append((room, items, chosen))
        return steps > STEPS

    down(0, room, {}, 0)
    if not found:
        chosen, free = {}, room
        for x in sizes:
            if take := min(free // x, spare[x]):
                chosen[x], free = take, free - take * x
        found.append((free, 0, chosen))
    found.sort(key=lambda f: (f[0], f[1], sorted(f[2].items(), reverse=True)))
    kept: list[tuple[int, dict[int, int]]] = []
    for waste, _, chosen in found:
        if kept and (waste > allowed or len(kept) == BRANCHES):
            break
        if not any(dominates(better, chosen) for _, better in kept):
            kept.append((waste, chosen))
    return [(waste, {**chosen, largest: chosen.get(largest, 0) + 1}) for waste, chosen in kept]


def dominates(a: dict[int, int], b: dict[int, int], steps: int = 200) -> bool:
    """True if the documents of filling b fit into those of a, each of a taken as a bin: whatever packs beside a then packs beside b.

    Documents of both go to themselves; the rest is tried largest first, and False after ``steps`` tries.
    """
    bins = [x for x, n in a.items() for _ in range(n - b.get(x, 0))]
    rest = sorted((x for x, n in b.items() for _ in range(n - a.get(x, 0))), reverse=True)
    if sum(rest) > sum(bins) or len(rest) > 12:
        return False

    def place(k: int) -> bool:
        nonlocal steps
        if k == len(rest):
            return True
        for room in sorted(set(bins)):
            steps -= 1
            if steps > 0 and room >= rest[k]:
                at = bins.index(room)
                bins[at] -= rest[k]
                if place(k + 1):
                    return True
                bins[at] = room
        return False

    return place(0)


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used; together they use up ``counts``."""
    counts = {x: n for x, n in counts.items() if n > 0}
    incumbent = best_fit(counts, capacity)
    fewest = sum(t for _, t in incumbent)
    total = sum(x * n for x, n in counts.items())
    least = -(-total // capacity)
    budget = nodes

    def search(first: int) -> None:
        """Depth first without recursion; an entry is (state, plan, waste so far)."""
        nonlocal incumbent, fewest, budget
        stack = [(dict(counts), (), 0)]
        while stack and fewest > least and budget > 0:
            left, plan, waste = stack.pop()
            budget -= 1
            allowed = (fewest - 1) * capacity - total
            if waste > allowed:
                continue
            if not left:
                incumbent, fewest = _unrolled(plan), sum(t for _, t in _unrolled(plan))
                continue
            nexts = []
            for lost, filling in fillings(left, max(left), capacity, allowed - waste)[:first]:
                state = dict(left)
                used = _use(state, filling)
                nexts.append((state, (plan, used), waste + lost * used[1]))
            stack += reversed(nexts)

    search(1)
    search(BRANCHES)
    return incumbent


def _unrolled(plan: tuple) -> list[tuple[Filling, int]]:
    out = []
    while plan:
        plan, used = plan
        out.append(used)
    return out[::-1]


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to materialized pieces (doc_id, piece, length, ids_crc32)."""
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for filling, times in complete_bins(counts, capacity):
        offset = 0
        for length, n in filling:
            rows.append((length, used[length], n, sequence, offset))
            used[length] += n * times
            offset += length * n
        sequence += times
    plan = pd.DataFrame(sorted(rows), columns=["length", "rank", "n", "sequence", "offset"]).astype(np.int64)
    shared = parts.sparkSession.sparkContext.broadcast(plan)

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        key = plan["length"].to_numpy() * (1 << 44) + plan["rank"].to_numpy()
        for batch in frames:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            n, inside = plan["n"].to_numpy()[at], rank - plan["rank"].to_numpy()[at]
            ids = pa.array(plan["sequence"].to_numpy()[at] + inside // n)
            offset = pa.array(plan["offset"].to_numpy()[at] + inside % n * length)
            yield batch.drop_columns(["_rank"]).append_column("sequence_id", ids).append_column("offset", offset)

    ranked = rank_within(parts, ["length"], F.struct("doc_id", "piece", "ids_crc32"), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for documents (doc_id, text)."""
    return pack(materialize(pieces(docs, tokenizer, capacity, end, with_ids)), capacity)
