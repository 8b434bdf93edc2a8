"""Folding, token estimates, snippets and fingerprints. Pure functions first, Arrow UDFs below."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# What the tools count as white space, and costs and limits that results depend on.
SPACE = "\t\n\x0b\x0c\r \xa0  -     　﻿"
CHARS_PER_TOKEN = {"ascii": 4.0, "code": 3.0, "cjk": 1.7, "other": 2.0}
SAFETY, FRAMING = 1.15, 40
SNIPPET_WINDOW, SNIPPET_LEAD, SNIPPET_HEAD, SNIPPET_WINDOWS, SNIPPET_JOIN = 160, 60, 220, 2, " … "
CJK_RANGES = "ᄀ-ᇿ　-ヿ㇀-䶿一-鿿가-힯豈-﫿＀-￯\U00020000-\U0003ffff"

_SPACES = re.compile(f"[{SPACE}]+")
_CJK = re.compile(f"[{CJK_RANGES}]")
_FENCE = re.compile(f"[{SPACE}]{{0,3}}(`{{3,}}|~{{3,}})")


def fold(text: str) -> str:
    """The form in which texts are matched: NFKC, then lower case."""
    return unicodedata.normalize("NFKC", text).lower()


def compact(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def utf16_length(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


class Fences:
    """Follows code fences through the lines of a text."""

    def __init__(self):
        self.open = ""

    def marker(self, line: str) -> bool | None:
        """None: no marker; True: it opens or closes a fence; False: a marker inside another fence."""
        found = _FENCE.match(line)
        if not found:
            return None
        if not self.open:
            self.open = found.group(1)
            return True
        if found.group(1)[0] == self.open[0] and len(found.group(1)) >= len(self.open):
            self.open = ""
            return True
        return False


def character_counts(text: str) -> dict[str, int]:
    """Characters by cost; each line is charged its newline, markers of fences nothing."""
    counts = dict.fromkeys(CHARS_PER_TOKEN, 0)

    def charge(piece: str, key: str) -> None:
        low = len(piece.encode("ascii", "ignore"))
        wide = len(_CJK.findall(piece)) if low < len(piece) else 0
        counts[key] += low
        counts["cjk"] += wide
        counts["other"] += len(piece) - low - wide

    if "```" not in text and "~~~" not in text:
        charge(text + "\n", "ascii")
        return counts
    fences = Fences()
    for line in text.split("\n"):
        if not fences.marker(line):
            charge(line + "\n", "code" if fences.open else "ascii")
    return counts


def tokens_of(counts: dict[str, int]) -> int:
    c = CHARS_PER_TOKEN
    return math.ceil((counts["ascii"] / c["ascii"] + counts["code"] / c["code"] + counts["cjk"] / c["cjk"] + counts["other"] / c["other"]) * SAFETY)


def estimate_tokens(text: str) -> int:
    return tokens_of(character_counts(text))


def truncate_to_tokens(text: str, budget: int) -> str:
    """Longest prefix within the budget. The estimate is searched by halving, as it follows no formula."""
    if budget <= 0:
        return ""
    if estimate_tokens(text) <= budget:
        return text
    fits, over = 0, len(text)
    while over - fits > 1:
        middle = (fits + over) // 2
        if estimate_tokens(text[:middle]) <= budget:
            fits = middle
        else:
            over = middle
    return text[:fits]


def content_fingerprint(body: str) -> str:
    return hashlib.sha256(compact(unicodedata.normalize("NFC", body)).encode("utf-8", "surrogatepass")).hexdigest()


def fold_with_map(text: str) -> tuple[str, list[int]]:
    """Folded text and, for each of its characters, where its source starts.

    Source characters that can combine stay together: a base with its marks, Hangul jamo, half-width voicing marks.
    """
    out, places, at = [], [], 0
    joins = lambda c: unicodedata.combining(c) > 0 or "ᅠ" <= c <= "ᇿ" or c in "ﾞﾟ"
    while at < len(text):
        end = at + 1
        while end < len(text) and joins(text[end]):
            end += 1
        piece = fold(text[at:end])
        out.append(piece)
        places += [at] * len(piece)
        at = end
    return "".join(out), places


def snippet(text: str, terms: list[str]) -> str:
    """Up to two windows around first occurrences of terms in the compacted text, else its head."""
    if not text:
        return ""

    def cut(start: int, end: int) -> str:
        return ("..." if start else "") + text[start:end] + ("..." if end < len(text) else "")

    plain = text.isascii()
    folded, places = (text.lower(), None) if plain else fold_with_map(text)
    hits = sorted(h for t in terms if (h := folded.find(t)) >= 0)
    windows: list[tuple[int, int]] = []
    for hit in hits:
        anchor = hit if plain else places[hit]
        if len(windows) < SNIPPET_WINDOWS and not any(a <= anchor < b for a, b in windows):
            start = max(0, anchor - SNIPPET_LEAD)
            windows.append((start, min(len(text), start + SNIPPET_WINDOW)))
    return SNIPPET_JOIN.join(cut(a, b) for a, b in windows) if windows else cut(0, min(SNIPPET_HEAD, len(text)))


def term_density(text: str, terms: list[str]) -> float:
    """Share of the terms in the text, at least 0.1; 1 without terms."""
    if not terms:
        return 1.0
    folded = fold(text)
    return max(0.1, sum(t in folded for t in terms) / len(terms))


@F.pandas_udf(StringType())
def fold_udf(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


@F.pandas_udf(StringType())
def compact_udf(s: pd.Series) -> pd.Series:
    return s.map(compact, na_action="ignore")


@F.pandas_udf(StringType())
def content_fingerprint_udf(s: pd.Series) -> pd.Series:
    return s.fillna("").map(content_fingerprint)


@F.pandas_udf(StructType([StructField(k, LongType()) for k in CHARS_PER_TOKEN]))
def character_counts_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([character_counts(t) for t in s.fillna("")], columns=list(CHARS_PER_TOKEN), dtype=np.int64)


def snippet_udf(terms: list[str]):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: snippet(t, terms))

    return run


def tokens_expr(counts: Column) -> Column:
    """Estimated tokens of a struct of character counts."""
    c = CHARS_PER_TOKEN
    raw = counts["ascii"] / c["ascii"] + counts["code"] / c["code"] + counts["cjk"] / c["cjk"] + counts["other"] / c["other"]
    return F.ceil(raw * SAFETY).cast("long")


def compact_expr(text: Column) -> Column:
    """JVM form of ``compact``."""
    escaped = "".join(c if c == "-" else f"\\u{ord(c):04x}" for c in SPACE)
    return F.trim(F.regexp_replace(text, f"[{escaped}]+", " "))


def count_occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))) / len(term.encode())).cast("long")
