"""Operator 2: personal data by patterns and a semi-Markov conditional random field.

Base spans follow fixed patterns (email, ip, card, phone) over the whole text and always stay. The
semi-Markov CRF adds spans that the patterns miss (telephone numbers without a plus sign, spelled-out or
bracketed addresses, card numbers with other separators): windows around digits and at-signs are cut into tokens, every token run of bounded length
that could be an entity (and has valid digits) is a candidate segment scored by features of the whole
span, and dynamic programming chooses boundaries and types of all entities together. It learns by maximum
likelihood from a bounded sample of windows (``sample`` in all, ``of_document`` of a document, both drawn by hashes)
whose base spans are the labels, each also in disguised variants, and from look-alikes (dates with times, order and
article numbers, decimals, section numbers) made of the same digits, which are no entities.

Nulls and odd rows: a null text is empty and has no span. Repeated rows are rows of their own; a null
doc_id passes through; other columns are ignored. Offsets are code points, ends exclusive. Without any
base span to learn from only base spans are found. All scans are linear in the text's length.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Windows that the model learns from, and those of one document, at most.
SAMPLE, OF_DOCUMENT = 600, 50
#: Characters of context around digits and at-signs, and tokens of an entity at most.
CONTEXT, LONGEST = 48, 18

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A look-behind keeps long digit runs linear; a match can never start inside a run.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]+|(?<=[\[({<])\s?at\s?(?=[\])}>])", re.I)
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
#: What may stand between two groups of a card's digits, and between two parts of an ip address.
CARD_GAPS = frozenset([" ", "-", ".", "/", "_", "  "])
IP_LOOSE = re.compile(r"(?<![0-9])(?=([0-9]{1,3}(?:(?: ?[\[({<] ?(?:\.|dot) ?[\])}>] ?| ?\. ?| dot )[0-9]{1,3}){3})(?![0-9]))", re.I)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), "email"
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans by the fixed patterns, by start, then kind as listed."""
    found = list(_emails(text)) if "@" in text else []
    if re.search("[0-9]", text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := only_digits(m.group())) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Merged surroundings of all triggers."""
    start, end = 0, None
    for m in TRIGGER.finditer(text):
        if end is None or m.start() - CONTEXT > end:
            if end is not None:
                yield start, min(end, len(text))
            start = max(0, m.start() - CONTEXT)
        end = m.end() + CONTEXT
    if end is not None:
        yield start, min(end, len(text))


def _features(tokens: list[str], i: int, j: int, kind: str) -> list[str]:
    """Features of the whole span tokens[i:j] under one kind."""
    span = "".join(tokens[i:j])
    digits = only_digits(span)
    left, right = tokens[i - 1] if i else "\n", tokens[j] if j < len(tokens) else "\n"
    side = lambda t: "d" if t[0].isdigit() else "w" if t[0].isalpha() else "s" if t.isspace() else t[0]
    joins = j + 1 < len(tokens) and right in ".-@()" and tokens[j + 1][0].isalnum()
    before = i >= 2 and left in ".-+@(" and tokens[i - 2][0].isalnum()
    lengths = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    gaps = {g for g in re.split("[0-9]+", span)[1:-1] if g}
    out = [kind, f"{kind} gaps {len(gaps)}"]
    out.append(f"ip alone {not (joins or before or _goes_on(tokens, i, j))}" if kind == "ip" else f"{kind} at {'@' in span}" if kind == "email" else f"{kind} shortest {min(3, *lengths, 3)}")
    out += [f"{kind} left {side(left)}", f"{kind} right {side(right)}", f"{kind} joins {joins} {before}"]
    if kind == "email":
        out.append(f"email goes on {_label_end(tokens, _dot_end(tokens, j)) > 0}")
        out.append(f"email cut {left[0].isalnum() or left in '._%+-'}")
    if kind in ("card", "phone"):
        out += [f"{kind} longest {min(8, max(lengths))}", f"{kind} head {min(5, lengths[0])}", f"{kind} year {digits[:2] in ('19', '20') and lengths[0] in (4, 8, 12)}"]
        out += [f"{kind} digits {len(digits)}", f"{kind} first {span[0] if span[0] in '+(' else 'd'}", f"{kind} groups {min(6, len(re.findall('[0-9]+', span)))}"]
    return out


def _goes_on(tokens: list[str], i: int, j: int) -> bool:
    """Whether digits follow or precede tokens[i:j] with nothing but a separator between."""
    near = lambda ts: next((t for t in ts if not t.isspace() and t not in ".-/_[](){}<>" and t.lower() != "dot"), "")
    return near(tokens[j : j + 5])[:1].isdigit() or near(tokens[max(0, i - 5) : i][::-1])[:1].isdigit()


def _dot_end(tokens: list[str], k: int) -> int:
    """Token after a dot at k, written or spelled out; 0 if there is none."""
    if k < len(tokens) and tokens[k] == ".":
        return k + 1
    k += k < len(tokens) and tokens[k] == " "
    if k and k + 2 < len(tokens) and tokens[k] in "[({<" and tokens[k + 1].lower() == "dot" and tokens[k + 2] in "])}>":
        return k + 3 + (k + 3 < len(tokens) and tokens[k + 3] == " ")
    return 0


def _label_end(tokens: list[str], k: int) -> int:
    """Token after a host name's label at k; 0 if there is none."""
    end = k
    while 0 < end < len(tokens) and (tokens[end].isascii() and tokens[end].isalnum() or tokens[end] == "-"):
        end += 1
    return end if end > k else 0


def candidates(tokens: list[str]) -> list[tuple[int, int, str, list[str]]]:
    """(first token, end token, kind, features) of all runs of tokens that could be an entity."""
    found, place = [], _places(tokens)
    for m in IP_LOOSE.finditer("".join(tokens)):
        ends = (place.get(m.start(1)), place.get(m.end(1)))
        if None not in ends and all(int(p) <= 255 for p in re.findall("[0-9]+", m.group(1))):
            found.append((*ends, "ip"))
    for i, token in enumerate(tokens):
        if token[0] in "0123456789+(":
            digits, plain = 0, True
            for j in range(i, min(len(tokens), i + LONGEST)):
                t = tokens[j]
                if "0" <= t[0] <= "9":
                    digits += len(t)
                elif t not in " ().-+/" and t not in CARD_GAPS or t == "+" and j > i:
                    break
                else:
                    plain &= t in CARD_GAPS
                if digits > 19:
                    break
                if not "0" <= t[0] <= "9":
                    continue
                if digits >= 12 and plain and luhn(only_digits("".join(tokens[i : j + 1]))):
                    found.append((i, j + 1, "card"))
                if 9 <= digits <= 15:
                    found.append((i, j + 1, "phone"))
        spelled = token.lower() == "at" and 0 < i < len(tokens) - 1 and tokens[i - 1] in "[({<" and tokens[i + 1] in "])}>"
        if token == "@" or spelled:
            first, starts = i - spelled, []
            first -= spelled and first > 0 and tokens[first - 1] == " "
            while first > 0 and i - first < LONGEST and (tokens[first - 1].isascii() and tokens[first - 1].isalnum() or tokens[first - 1] in "._%+-"):
                first -= 1
                starts += [first] if tokens[first].isalnum() else []
            k = i + 1 + spelled
            k += spelled and k < len(tokens) and tokens[k] == " "
            k, labels = _label_end(tokens, k), 1
            while k and (at := _dot_end(tokens, k)) and (k := _label_end(tokens, at)) and labels < LONGEST:
                labels += 1
                found += [(a, k, "email") for a in starts]
    return [(i, j, kind, _features(tokens, i, j, kind)) for i, j, kind in sorted(set(found), key=lambda c: (c[1], c[0], c[2]))]


def _places(tokens: list[str]) -> dict[int, int]:
    """Number of the token that begins at a code point; the end belongs to the one after the last."""
    at, place = 0, {}
    for k, t in enumerate(tokens):
        place[at] = k
        at += len(t)
    place[at] = len(tokens)
    return place


class SemiCrf:
    """Weights of span features; tokens outside entities score 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def scores(self, cands: list[tuple[int, int, str, list[str]]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, -0.5) for f in c[3]) for c in cands]

    def decode(self, n: int, cands: list[tuple[int, int, str, list[str]]]) -> list[int]:
        """Numbers of the chosen candidates: best segmentation of n tokens."""
        best, back, k = [0.0] * (n + 1), [-1] * (n + 1), 0
        scores = self.scores(cands)
        for t in range(1, n + 1):
            best[t] = best[t - 1]
            while k < len(cands) and cands[k][1] == t:
                if (s := best[cands[k][0]] + scores[k]) > best[t]:
                    best[t], back[t] = s, k
                k += 1
        chosen, t = [], n
        while t > 0:
            if back[t] >= 0:
                chosen.append(back[t])
                t = cands[back[t]][0]
            else:
                t -= 1
        return chosen[::-1]

    @staticmethod
    def fit(examples: list[tuple[int, list[tuple[int, int, str, list[str]]], set[int]]], rounds: int = 12, rate: float = 0.5, decay: float = 1e-3) -> SemiCrf:
        """Maximum likelihood; an example is (tokens, candidates, numbers of the true candidates)."""
        names = {f: k for k, f in enumerate(sorted({f for _, cs, _ in examples for c in cs for f in c[3]}))}
        w = np.full(len(names), -0.1)
        coded = [(n, cs, [np.array([names[f] for f in c[3]]) for c in cs], gold) for n, cs, gold in examples if cs]
        for turn in range(rounds):
            step = rate / (1 + 0.3 * turn)
            for n, cs, feats, gold in coded:
                shares = marginals(n, cs, [float(w[f].sum()) for f in feats])
                for k, f in enumerate(feats):
                    off = (k in gold) - shares[k]
                    if abs(off) > 1e-4:
                        w[f] += step * off
            w *= 1 - decay
        return SemiCrf({f: float(w[k]) for f, k in names.items()})


def marginals(n: int, cands: list[tuple], scores: list[float]) -> list[float]:
    """Probability of each candidate among all segmentations of n tokens, by forward and backward sums."""
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    ends, starts = {}, {}
    for k, c in enumerate(cands):
        ends.setdefault(c[1], []).append(k)
        starts.setdefault(c[0], []).append(k)
    for t in range(1, n + 1):
        ahead[t] = _logsum([ahead[t - 1], *(ahead[cands[k][0]] + scores[k] for k in ends.get(t, ()))])
    for t in range(n - 1, -1, -1):
        behind[t] = _logsum([behind[t + 1], *(behind[cands[k][1]] + scores[k] for k in starts.get(t, ()))])
    return [math.exp(min(0.0, ahead[c[0]] + s + behind[c[1]] - ahead[n])) for c, s in zip(cands, scores, strict=True)]


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if len(values) > 1 else top


def example(window: str, spans: list[Span]) -> tuple[int, list, set[int]]:
    """Tokens, candidates and which of them are the spans."""
    tokens = TOKEN.findall(window)
    place, cands = _places(tokens), candidates(tokens)
    true, free = {(place.get(a), place.get(b), kind) for a, b, kind in spans}, 0
    gold = set()
    for k, c in enumerate(cands):  # by end: of overlapping spans the first to end is the label
        if c[:3] in true and c[0] >= free:
            gold.add(k)
            free = c[1]
    return len(tokens), cands, gold


#: Ways to write what the patterns don't expect: separators of a telephone number's groups, an address's two signs, the
#: separators of a card's groups, the dots of an ip address; and the lengths of groups into which digits are cut anew.
SEPARATORS, SIGNS = (None, " ", ".", "-", " ", "/"), ((" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "))
CARD_MARKS, IP_DOTS = (".", "/", ".", "/", " - ", "."), ("[.]", " . ", "(dot)")
PHONE_GROUPS, CARD_GROUPS = (None, None, None, (3, 4, 9), (2, 2, 2, 2, 9), (3, 9)), ((4, 4, 4, 4, 9),) * 3 + ((4, 6, 9),) * 2 + ((5, 5, 9),)
VARIANTS = 6


def _grouped(digits: str, lengths: tuple[int, ...]) -> list[str]:
    """Digits cut into groups of these lengths; a last one of a single digit joins the one before."""
    out = []
    for n in lengths:
        out, digits = [*out, digits[:n]] if digits else out, digits[n:]
    return out if len(out[-1]) > 1 or len(out) == 1 else [*out[:-2], out[-2] + out[-1]]


def _rewritten(window: str, spans: list[Span], piece_of: Callable[[str, str], str | None], entity: bool) -> tuple[str, list[Span]]:
    """The window with each span written anew; the spans of entities move along, None leaves one as it is."""
    out, new, done = "", [], 0
    for a, b, kind in spans:
        if a < done:
            continue
        piece = piece_of(window[a:b], kind)
        out += window[done:a]
        if entity or piece is None:
            new.append((len(out), len(out) + len(window[a:b] if piece is None else piece), kind))
        out, done = out + (window[a:b] if piece is None else piece), b
    return out + window[done:], new


def disguised(window: str, spans: list[Span], variant: int = 0) -> tuple[str, list[Span]]:
    """The window with its entities written as the patterns don't expect."""

    def piece_of(piece: str, kind: str) -> str:
        if kind == "phone":
            short = re.sub(r"^\+[0-9]{1,3} (?=\()", "", piece).lstrip("+")
            piece = short if 9 <= len(only_digits(short)) <= 15 else piece.lstrip("+")
            mark, lengths = SEPARATORS[variant], PHONE_GROUPS[variant]
            return piece if mark is None else mark.join(_grouped(only_digits(piece), lengths) if lengths else re.findall("[0-9]+", piece))
        if kind == "email":
            name, _, host = piece.partition("@")
            at, dot = SIGNS[variant % 3]
            return f"{name}{at}{host.replace('.', dot)}"
        if kind == "card":
            return CARD_MARKS[variant].join(_grouped(only_digits(piece), CARD_GROUPS[variant]))
        return IP_DOTS[variant % 3].join(piece.split("."))

    return _rewritten(window, spans, piece_of, True)


def lookalike(window: str, spans: list[Span], variant: int = 0) -> tuple[str, list[Span]]:
    """The window with its telephone numbers, cards and ip addresses turned into numbers of other kinds; addresses stay."""

    def piece_of(piece: str, kind: str) -> str | None:
        d, form = only_digits(piece), variant % 3
        if kind == "phone":
            day = f"20{d[0]}{d[1]}-0{int(d[2]) % 9 + 1}-1{d[3]}"
            if variant < 3:
                return (f"{day} 1{d[4]}:2{d[5]}:3{d[6]}", f"#{d}", f"978-{d[0]}-{d[1:3]}-{d[3:9].ljust(6, '1')}-{d[-1]}")[form]
            return (f"{day.replace('-', '.')} 1{d[4]}.3{d[5]}", d[:10], f"978-{d[:3]}-{d[3:8]}-{d[-2]}-{d[-1]}")[form]
        if kind == "card":
            return (f"{d[:-7]}.{d[-7:]}", f"{d[:3]}/{d[3:]}", f"{d[0]}.{d[1:]}")[form]
        if kind == "ip":
            return (piece.replace(".", " . ") + f" . {d[0]}", f"{d[0]} . " + piece.replace(".", " . "), f"{piece.replace('.', '[.]')}[.]{d[-1]}")[form]
        return None

    return _rewritten(window, spans, piece_of, False)


def fit(docs: DataFrame, sample: int = SAMPLE, of_document: int = OF_DOCUMENT) -> SemiCrf:
    """Learn from at most ``sample`` windows of (text), ``of_document`` of one text; the same rows give the same weights."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                spans = base_spans(text)
                own = sorted(windows(text), key=lambda w: zlib.crc32(text[w[0] : w[1]].encode("utf-8", "surrogatepass")))[:of_document]
                rows += [{"at": a, "window": text[a:b], "spans": ",".join(f"{k}:{s - a}:{e - a}" for s, e, k in spans if a <= s and e <= b)} for a, b in own]
            yield pd.DataFrame(rows, columns=["at", "window", "spans"])

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text rlike '[0-9@]'")
    n = texts.count()
    picked = texts.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(max(1, n // (2 * sample)))) == 0)
    cuts = picked.mapInPandas(cut, "at long, window string, spans string")
    rows = cuts.select("window", "spans").distinct().orderBy(F.xxhash64("window"), "window").limit(sample).collect()
    examples = []
    for r in rows:
        spans = sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in r.spans.split(",") if x)
        examples.append(example(r.window, spans))
        if spans:
            examples += [example(*make(r.window, spans, v)) for make in (disguised, lookalike) for v in range(VARIANTS)]
    return SemiCrf.fit(examples) if any(g for _, _, g in examples) else SemiCrf()


def added_spans(text: str, base: list[Span], model: SemiCrf) -> list[Span]:
    """The model's spans that touch no base span."""
    if not model.weights:
        return []
    found = []
    for a, b in windows(text):
        tokens = TOKEN.findall(text[a:b])
        cands = candidates(tokens)
        if not cands:
            continue
        starts = [a]
        for t in tokens:
            starts.append(starts[-1] + len(t))
        chosen = [(starts[cands[k][0]], starts[cands[k][1]], cands[k][2]) for k in model.decode(len(tokens), cands)]
        found += [s for s in chosen if all(s[1] <= x[0] or x[1] <= s[0] for x in base if x[1] > a and x[0] < b)]
    return found


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each stretch of overlapping spans becomes the first one's kind in angle brackets."""
    out, done, at = [], 0, 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = done = max(done, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: SemiCrf, redacted: bool = False) -> DataFrame:
    """(doc_id, base, spans) of each row, and its redacted text if asked for; spans are written kind:start:end, comma-joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(texts: list[str]) -> list[tuple]:
        rows = []
        for text in texts:
            base = base_spans(text)
            every = sorted(base + added_spans(text, base, shared.value), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
            rows.append((_listed(base), _listed(every), hashlib.sha256(_listed(base).encode()).hexdigest(), redact(text, every) if redacted else None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = scan([t or "" for t in texts.to_pylist()])
            if redacted:
                new = pa.array([x[3] if t.is_valid else None for x, t in zip(found, texts, strict=True)], pa.string())
                yield batch.set_column(batch.schema.get_field_index("text"), "text", new)
            else:
                columns = [pa.array([x[k] for x in found], pa.string()) for k in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans", "base_sha256"])

    if redacted:
        return docs.mapInArrow(run, docs.schema)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base string, spans string, base_sha256 string")
