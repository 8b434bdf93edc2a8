"""Project dossiers: a summary, state notes within a budget, and recent notes, sessions and operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.markdown import outline
from ..functions.text import CHARS_PER_TOKEN, compact_udf
from ..operators.tables import snapshot
from .context import Purse, check_budget

# Names and limits of the sections.
SESSION_CLIENT, SESSION_TAG, STATE_TAG = "claude-code", "claude-code-session", "project-state"
RECENT, SESSIONS, OPS, SNIPPET = 10, 5, 10, 240

#: Characters of a token at most.
CHARS_MOST = max(CHARS_PER_TOKEN.values())

OUTLINE = ArrayType(StructType([StructField("heading", StringType()), StructField("level", LongType()), StructField("heading_path", ArrayType(StringType())), StructField("start_line", LongType()), StructField("chars", LongType()), StructField("est_tokens", LongType())]))


@F.pandas_udf(OUTLINE)
def outline_udf(s: pd.Series) -> pd.Series:
    return s.fillna("").map(outline)


def _latest_first():
    return [F.desc("effective_ts"), F.collate(F.col("path"), "UNICODE"), F.col("path")]


def of_project(notes: DataFrame, project: str, client: str | None = None) -> DataFrame:
    if not project or not project.strip():
        raise ValueError("a dossier needs a project")
    mine = notes.where(F.col("project") == project)
    return mine.where(F.col("client") == client) if client is not None else mine


def is_session():
    return F.coalesce((F.col("client") == SESSION_CLIENT) & F.array_contains("tags", SESSION_TAG), F.lit(False))


def summary(mine: DataFrame) -> DataFrame:
    return mine.agg(F.count(F.lit(1)).alias("doc_count"), F.max("effective_ts").alias("latest"), F.sort_array(F.collect_set("root")).alias("roots"))


def recent_docs(mine: DataFrame, limit: int = RECENT) -> DataFrame:
    page = mine.where(~is_session()).orderBy(*_latest_first()).limit(limit)
    return page.select("id", "path", "root", "title", F.col("effective_ts").alias("updated_at"), "size_bytes", F.substring(compact_udf("body"), 1, SNIPPET).alias("snippet"))


def recent_sessions(mine: DataFrame, limit: int = SESSIONS) -> DataFrame:
    """Only the newest session has an outline."""
    page = mine.where(is_session()).orderBy(*_latest_first()).limit(limit)
    newest = mine.where(is_session()).orderBy(*_latest_first()).limit(1).select("path", outline_udf("body").alias("outline"))
    return page.select("id", "path", "root", "title", F.col("effective_ts").alias("updated_at"), "size_bytes").join(F.broadcast(newest), "path", "left")


def ops_recent(notes: DataFrame, project: str, limit: int = OPS) -> DataFrame:
    """Of all notes, those that name the project as their target."""
    return notes.where(F.col("target_repo") == project).orderBy(*_latest_first()).limit(limit).select("path", "root", F.col("effective_ts").alias("date"))


STATE = "id string, path string, root string, title string, updated_at timestamp, est_tokens long, truncated boolean, text string"


def state_docs(mine: DataFrame, token_budget: int | None = None, tag: str = STATE_TAG) -> DataFrame:
    """Notes with the state tag, latest first, until the budget is used up.

    A note of n characters takes n / CHARS_MOST tokens at least, so notes behind a running sum of the budget's tokens
    are not read; the rest, about as much text as the budget holds and one note more, are packed in one group.
    """
    budget = check_budget(token_budget)
    order = _latest_first()
    first = mine.where(F.array_contains("tags", tag)).select("path", "effective_ts", F.greatest(F.char_length(F.coalesce("body", F.lit(""))) / CHARS_MOST, F.lit(1.0)).alias("_least"))
    first = first.orderBy(*order).limit(budget)  # a note takes a token at least
    before = F.sum("_least").over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    near = snapshot(first.withColumns({"_before": before, "place": place}).where(F.coalesce("_before", F.lit(0.0)) <= budget).select("path", "place"))
    rows = mine.join(F.broadcast(near), "path").select("id", "path", "root", "title", F.col("effective_ts").alias("updated_at"), "body", "place")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        purse, out = Purse(budget), []
        for row in rows.sort_values("place", kind="stable").itertuples():
            deal = purse.buy(row.path, row.body or "")
            if deal is None:
                break
            text, used = deal
            out.append((row.id, row.path, row.root, row.title, row.updated_at, used, len(text) < len(row.body or ""), text))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in STATE.split(", ")])

    return rows.groupBy().applyInPandas(run, STATE)


def project_state(notes: DataFrame, project: str, client: str | None = None, token_budget: int | None = None, include: tuple[str, ...] = (), state_tag: str = STATE_TAG) -> dict[str, DataFrame]:
    """The dossier's sections; none named means all."""
    mine = of_project(notes, project, client)
    parts = {
        "state_docs": lambda: state_docs(mine, token_budget, state_tag), "recent_docs": lambda: recent_docs(mine),
        "sessions": lambda: recent_sessions(mine), "ops": lambda: ops_recent(notes, project),
    }
    return {"summary": summary(mine)} | {k: make() for k, make in parts.items() if not include or k in include}
