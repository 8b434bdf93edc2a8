"""Filtered, scored and paged search over notes.

Any query term keeps a note; scores add up. Terms are literals, so the score is one JVM expression; snippets
are made for the page only.
"""

from __future__ import annotations

import datetime
import math
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.markdown import project_body
from ..functions.text import CJK_RANGES, _SPACES, compact_udf, count_occurrences, fold, fold_udf, snippet_udf

# Weights of the score and limits of a page.
TITLE, PATH, TAG, BODY_MOST, PHRASE = 10, 4, 5, 8, 4
PAGE, PAGE_MOST, HALF_LIFE_DAYS = 10, 50, 30.0


@dataclass(frozen=True)
class Term:
    text: str
    whole: bool


def _has_cjk(text: str) -> bool:
    return re.search(f"[{CJK_RANGES}]", text) is not None


def _pieces(token: str, spark: SparkSession | None) -> list[str]:
    """Words of a token without spaces between them, by the JVM's ICU; bigrams where that is not at hand."""
    if not _has_cjk(token):
        return []
    words = []
    try:
        text = spark._jvm.com.ibm.icu.text
        breaks = text.BreakIterator.getWordInstance(spark._jvm.com.ibm.icu.util.ULocale("ja"))
        breaks.setText(token)
        utf16, start, end = token.encode("utf-16-le"), 0, breaks.next()
        while end != -1:
            if breaks.getRuleStatus() >= 100:
                words.append(utf16[2 * start : 2 * end].decode("utf-16-le"))
            start, end = end, breaks.next()
    except (AttributeError, TypeError):  # no session, or a JVM without ICU
        words = [token[i : i + 2] for i in range(len(token) - 1)]
    lone = lambda w: len(w) == 1 and "ぁ" <= w <= "ゟ"
    return [w for w in words if w != token and not lone(w)]


def tokenize(query: str | None, spark: SparkSession | None = None) -> list[Term]:
    """Distinct folded words of a query in order, words of unsegmented ones after each."""
    found: dict[str, Term] = {}
    for token in _SPACES.split(fold(query or "")):
        if token and token not in found:
            found[token] = Term(token, True)
            for piece in _pieces(token, spark):
                found.setdefault(piece, Term(piece, False))
    return list(found.values())


def parse_date(value: str | None, name: str) -> datetime.datetime | None:
    """ISO 8601 only; without a zone it is UTC."""
    if value is None:
        return None
    try:
        found = datetime.datetime.fromisoformat(value)
    except ValueError:
        raise ValueError(f"{name} must be an ISO 8601 date or date-time") from None
    return found if found.tzinfo else found.replace(tzinfo=datetime.timezone.utc)


def prefix_of(value: str | None) -> str | None:
    return unicodedata.normalize("NFC", value).removeprefix("./") or None if value else None


def in_scope(
    notes: DataFrame, client: str | None = None, project: str | None = None, root: str | None = None, path_prefix: str | None = None,
    tags: Sequence[str] = (), updated_after: str | None = None, updated_before: str | None = None,
) -> DataFrame:
    """Notes that pass the filters; an empty value is no filter. Tags must all be there, whatever their case."""
    for name, value in (("client", client), ("project", project), ("root", root)):
        if value:
            notes = notes.where(F.col(name) == value)
    if prefix := prefix_of(path_prefix):
        notes = notes.where(F.col("local_path").startswith(prefix))
    if (after := parse_date(updated_after, "updated_after")) is not None:
        notes = notes.where(F.col("effective_ts") >= F.lit(after))
    if (before := parse_date(updated_before, "updated_before")) is not None:
        notes = notes.where(F.col("effective_ts") <= F.lit(before))
    lowered = F.transform("tags", F.lower)
    for tag in tags:
        notes = notes.where(F.array_contains(lowered, tag.lower()))
    return notes


def clamp_weight(weight: float | None) -> float:
    return min(float(weight), 1.0) if weight is not None and math.isfinite(weight) and weight > 0 else 0.0


def positive_or(value: float | None, fallback: float) -> float:
    return float(value) if value is not None and math.isfinite(value) and value > 0 else fallback


def _containing(term: Column):
    return lambda x: F.contains(x, term)


def score_columns(terms: Sequence[Term], weight: float = 0.0, half_life: float = HALF_LIFE_DAYS, now: str | None = None, plain: bool = True) -> dict[str, Column]:
    """Parts of the score. plain: titles, paths and tags need no more than lower case to be folded."""
    body = F.coalesce(F.col("folded_body"), F.lit(""))
    form = F.lower if plain else fold_udf
    title, path = form(F.coalesce("title", F.lit(""))), form(F.coalesce("path", F.lit("")))
    tags = F.split(form(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "\u0001")), "\u0001")
    parts = {k: F.lit(0.0) for k in ("title", "path", "tags", "body", "phrase")}
    for term in terms:
        t = F.lit(term.text)
        count = count_occurrences(body, term.text)
        parts["title"] += F.when(F.contains(title, t), TITLE).otherwise(0)
        parts["path"] += F.when(F.contains(path, t), PATH).otherwise(0)
        parts["tags"] += F.when(F.exists(tags, _containing(t)), TAG).otherwise(0)
        parts["body"] += F.least(count, F.lit(BODY_MOST))
        if term.whole and len(terms) > 1:
            parts["phrase"] += F.when((count > 0) | F.contains(title, t), PHRASE).otherwise(0)
    text = sum(parts.values(), F.lit(0.0))
    moment = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    age = F.greatest(F.lit(0.0), (F.unix_micros(moment) - F.unix_micros(F.col("effective_ts"))) / F.lit(86_400e6))
    parts["recency"] = text * weight * F.pow(F.lit(2.0), -age / half_life) if weight else F.lit(0.0)
    return parts


def ranked(notes: DataFrame, query: str | None = None, order: str | None = None, recency_weight: float | None = None, half_life: float | None = None, now: str | None = None, plain: bool = True, **filters) -> tuple[DataFrame, list[Column], list[Term]]:
    """Matches with their scores, the columns that order them, and the terms."""
    terms = tokenize(query, notes.sparkSession)
    weight = clamp_weight(recency_weight)
    parts = score_columns(terms, weight, positive_or(half_life, HALF_LIFE_DAYS), now, plain)
    found = in_scope(notes, **filters).withColumns({f"score_{k}": v.cast("double") for k, v in parts.items()})
    found = found.withColumn("score", sum((F.col(f"score_{k}") for k in parts), F.lit(0.0)))
    if terms:
        found = found.where(F.col("score") > 0)
    order = order or ("relevance" if terms else "recent" if weight > 0 else "path")
    first = {"relevance": [F.desc("score")], "recent": [F.desc("effective_ts")], "path": []}[order]
    return found, [*first, F.collate(F.col("path"), "UNICODE"), F.col("path")], terms


def search(notes: DataFrame, query: str | None = None, limit: int | None = None, offset: int | None = None, explain: bool = False, compact: Column | None = None, observed: Observation | None = None, **options) -> DataFrame:
    """A page of results with snippets, best first; ``rank`` (from 1) keeps the order when it is written. ``observed`` gets total_count."""
    found, order, terms = ranked(notes, query, **options)
    if observed:
        found = found.observe(observed, F.count(F.lit(1)).alias("total_count"))
    size, skip = min(max(PAGE if limit is None else limit, 1), PAGE_MOST), max(offset or 0, 0)
    page = found.orderBy(*order).offset(skip).limit(size)
    page = page.withColumn("rank", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + skip).cast("int"))  # PAGE_MOST rows at most
    texts = compact if compact is not None else compact_udf("body")
    columns = ["rank", "id", "path", "title", "client", "project", "tags", "score", "root", *[c for c in ("modified_at", "updated_at") if c in found.columns], "effective_ts", "size_bytes"]
    return page.select(*columns, *([c for c in found.columns if c.startswith("score_")] if explain else []), snippet_udf([t.text for t in terms])(texts).alias("snippet"))


def page_and_total(notes: DataFrame, query: str | None = None, **request) -> tuple[DataFrame, int]:
    """A page of results and how many notes match, from one scan: matches are counted on their way to the page's sort.

    The page, PAGE_MOST rows at most, is held by the driver.
    """
    counted = Observation()
    found = search(notes, query, observed=counted, **request)
    rows = found.collect()
    return notes.sparkSession.createDataFrame(rows, found.schema), counted.get["total_count"]


def total_count(notes: DataFrame, query: str | None = None, **options) -> DataFrame:
    """One row: how many notes match."""
    found, _, _ = ranked(notes, query, **options)
    return found.agg(F.count(F.lit(1)).alias("total_count"))


def list_projects(notes: DataFrame, client: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Notes and latest change of the files of each client and project, in their order."""
    scoped = in_scope(notes, client=client, tags=tags)
    by = scoped.groupBy(F.coalesce("client", F.lit("unknown")).alias("client"), F.coalesce("project", F.lit("uncategorized")).alias("project"))
    found = by.agg(F.count(F.lit(1)).alias("document_count"), F.max("modified_at").alias("latest"))
    return found.orderBy(F.collate(F.col("client"), "UNICODE"), F.collate(F.col("project"), "UNICODE"))


def compat_search(notes: DataFrame, query: str, base_url: str, **options) -> DataFrame:
    """id, title and url of a page of results."""
    return search(notes, query, **options).select("id", "title", document_url(F.col("path"), base_url).alias("url"))


def compat_fetch(notes: DataFrame, base_url: str) -> DataFrame:
    """id, title, text, url and metadata (texts) of each note."""
    pairs = [("path", F.col("path")), ("client", F.col("client")), ("project", F.col("project")), ("tags", F.array_join("tags", ", "))]
    metadata = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda _, v: v.isNotNull())
    return notes.select("id", "title", F.col("body").alias("text"), document_url(F.col("path"), base_url).alias("url"), metadata.alias("metadata"))


def document_url(path: Column, base_url: str) -> Column:
    """Each part of the path percent-encoded; the encoder for forms differs in a few characters, which are put right."""
    encoded = F.url_encode(path)
    for form, plain in (("+", "%20"), ("%2F", "/"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    return F.concat(F.lit(base_url.rstrip("/") + "/"), encoded)


FETCHED = StructType(
    [StructField("body", StringType()), StructField("truncated", BooleanType()), StructField("total_chars", LongType()), StructField("sections_matched", ArrayType(StringType()))]
)


def fetch(notes: DataFrame, sections: Sequence[str] | None = None, max_chars: int | None = None, plain: bool = False) -> DataFrame:
    """Public columns of notes with their bodies, or the parts of them that are asked for.

    plain: no body has characters beyond the basic plane, so the JVM can count them.
    """

    @F.pandas_udf(FETCHED)
    def part(s: pd.Series) -> pd.DataFrame:
        found = [project_body(b, False, list(sections) if sections else None, max_chars) for b in s.fillna("")]
        return pd.DataFrame(found, columns=[f.name for f in FETCHED.fields]).astype(object).where(lambda x: x.notna(), None)

    public = notes.select("id", "path", "title", "client", "project", "tags", "root", "effective_ts", "size_bytes", "body")
    if sections is None and max_chars is None:
        return public
    if sections is None and plain:
        cut = F.char_length("body") > max_chars
        columns = {"truncated": cut, "total_chars": F.char_length("body").cast("long"), "sections_matched": F.lit(None).cast("array<string>"), "body": F.when(cut, F.substring("body", 1, max_chars)).otherwise(F.col("body"))}
        return public.withColumn("body", F.coalesce("body", F.lit(""))).withColumns(columns)
    return public.withColumn("_part", part("body")).select(*[c for c in public.columns if c != "body"], "_part.*")


def lookup(notes: DataFrame, reference: str, roots: Sequence[str] = ()) -> DataFrame:
    """The note that a reference means: its id, else its path, with or without ``.md``.

    Where notes have roots, named in their order by ``roots``, ``name:path`` means that root, and a path without a root the
    first root that has it. Raises if the id names several notes, or an id and another note's path are the same.
    """
    name, sign, rest = reference.partition(":")
    routed = bool(sign) and name in roots
    local = unicodedata.normalize("NFC", rest if routed else reference)
    local = local if local.lower().endswith(".md") else f"{local}.md"
    owner = F.col("root") == name if routed else F.lit(True)
    if not roots:
        owner = F.lit(True)
    place = F.col("local_path") if roots else F.col("path")
    by_path, by_id = (place == local) & owner, F.col("id") == reference
    hits = notes.where(by_id | by_path).select("path", "root", by_id.alias("by_id"), by_path.alias("by_path"))
    turn = F.array_position(F.array(*[F.lit(r) for r in roots]), F.col("root")) if roots else F.lit(0)
    # three ids are enough to tell one from several, and the first root's path to tell which it is
    named = hits.where("by_id").select("path").distinct().orderBy("path").limit(3)
    placed = hits.where("by_path").select("path", turn.alias("turn")).distinct().orderBy("turn", "path").limit(1)
    ids, paths = ([r.path for r in f.collect()] for f in (named, placed))
    if ids and len({*ids, *paths}) > 1:
        raise LookupError(f"{reference} is ambiguous: {', '.join(sorted({*ids, *paths})[:3])}")
    found = ids or paths
    if not found:
        raise LookupError(f"no note {reference}")
    return notes.where(F.col("path") == found[0]).dropDuplicates(["path"])
