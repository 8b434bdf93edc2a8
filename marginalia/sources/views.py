"""Notes and session archives built from the test tables, alike in SQL (``NOTES_SQL``, ``SESSIONS_SQL``).

Their texts are stable under NFKC, so folding is ``lower`` here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Clock of the queries.
NOW = "2024-06-01 00:00:00"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str, linked: bool = True) -> DataFrame:
    """``documents`` as notes: tags from ``labels``, a link from each note to another, every fifth one with a dead link.

    Without ``linked``, links are left empty, which saves counting the notes.
    """
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    count = docs.agg(F.count(F.lit(1))).first()[0] if linked else 0
    none = F.array().cast("array<string>")
    number = lambda c: F.lpad(c.cast("string"), 8, "0")
    doc = F.col("doc_id")
    tagged = labels.select("doc_id", F.array(F.concat(F.lit("quality-"), F.col("quality")), F.concat(F.lit("toxic-"), F.col("toxic"))).alias("tags"))
    target = F.concat(F.lit("doc-"), number((doc * 7 + 1) % max(1, count)))
    path = F.concat_ws("", F.lit("projects/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc-"), number(doc), F.lit(".md"))
    return docs.join(tagged, "doc_id", "left").select(
        F.concat(F.lit("doc-"), number(doc)).alias("id"), path.alias("path"), path.alias("local_path"), F.lit(None).cast("string").alias("root"),
        F.concat(F.lit("Doc "), doc.cast("string")).alias("title"), F.col("lang").alias("client"), F.col("source").alias("project"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.array().cast("array<string>").alias("source_refs"), F.array().cast("array<string>").alias("aliases"),
        F.when(doc % 11 == 0, F.concat(F.lit("src"), (doc % 20).cast("string"))).alias("target_repo"),
        F.col("text").alias("body"), F.lower("text").alias("folded_body"),
        (F.when(doc % 5 == 0, F.array(target, F.concat(F.lit("missing-"), number(doc)))).otherwise(F.array(target)) if linked else none).alias("wiki_links"), none.alias("md_links"),
        F.octet_length("text").cast("long").alias("size_bytes"), _hours(doc % 3000).alias("effective_ts"), _hours(doc * 5 % 4000).alias("modified_at"),
        F.when(doc % 3 != 0, F.date_format(_hours(doc % 3000), "yyyy-MM-dd")).alias("updated_at"), F.when(doc % 4 == 1, F.concat(F.lit("kind-"), (doc % 3).cast("string"))).alias("fm_type"),
    )


def _hours(count: Column) -> Column:
    return F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=count.cast("int"))


def linked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes in two roots, with every kind of link: paths of any root and of the own one, names, titles, aliases, Markdown links, references."""
    plain = notes(spark, sf_dir, linked=False)
    others = [c for c in plain.columns if c not in ("id", "path", "local_path", "root", "title", "aliases", "wiki_links", "md_links", "source_refs")]
    count = max(1, _read(spark, sf_dir, "documents").count())
    base = plain.withColumn("d", F.regexp_extract("id", r"([0-9]+)$", 1).cast("long"))
    to = (F.col("d") * 7 + 1 + F.floor(F.col("d") / 3) % 2) % count
    text = lambda c: c.cast("string")
    root = lambda d: F.when(d % 2 == 0, "main").otherwise("side")
    name = lambda d: F.when(d % 10 == 9, F.concat(F.lit("shared-"), text(d % 50))).otherwise(F.concat(F.lit("doc-"), F.lpad(text(d), 8, "0")))
    stem = lambda d: F.concat(F.when(d % 10 == 9, F.concat(F.lit("g"), text(d))).otherwise(F.concat(F.lit("f"), text(d % 5))), F.lit("/"), name(d))
    path = lambda d: F.concat(root(d), F.lit(":"), stem(d), F.lit(".md"))
    d, kind = F.col("d"), F.col("d") % 6
    wiki = F.when(kind == 0, F.concat(root(to), F.lit(":"), stem(to))).when(kind == 1, stem(to)).when(kind == 2, name(to)).when(kind == 3, F.concat(F.lit("Doc "), text(to))).when(kind == 4, F.concat(F.lit("alias-"), text(to))).otherwise(F.concat(F.lit("missing-"), text(d)))
    md = F.when(d % 3 == 0, F.array(F.concat(F.lit("../"), stem(to), F.lit(".md")))).when(d % 3 == 1, F.array(path(to))).otherwise(F.array().cast("array<string>"))
    return base.select(
        F.concat(F.lit("n-"), text(d)).alias("id"), path(d).alias("path"), F.concat(stem(d), F.lit(".md")).alias("local_path"), root(d).alias("root"),
        F.concat(F.lit("Doc "), text(F.when(d % 13 == 0, d % 40).otherwise(d))).alias("title"),
        F.when(d % 4 == 0, F.array(F.concat(F.lit("alias-"), text(d)), F.concat(F.lit("alias-"), text(d % 300)))).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.array(wiki).alias("wiki_links"), md.alias("md_links"), F.when(d % 7 == 0, F.array(path(to))).otherwise(F.array().cast("array<string>")).alias("source_refs"), *others,
    )


NOTES_SQL = """
notes AS (
  SELECT 'doc-' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS id,
    'projects/' || d.lang || '/' || d.source || '/doc-' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') || '.md' AS path,
    'Doc ' || CAST(d.doc_id AS VARCHAR) AS title, d.lang AS client, d.source AS project,
    CASE WHEN l.doc_id IS NULL THEN CAST([] AS VARCHAR[]) ELSE ['quality-' || CAST(l.quality AS VARCHAR), 'toxic-' || CAST(l.toxic AS VARCHAR)] END AS tags,
    CASE WHEN d.doc_id % 11 = 0 THEN 'src' || CAST(d.doc_id % 20 AS VARCHAR) END AS target_repo,
    d.text AS body, lower(d.text) AS folded_body, strlen(d.text) AS size_bytes,
    'doc-' || lpad(CAST((d.doc_id * 7 + 1) % (SELECT count(*) FROM documents) AS VARCHAR), 8, '0') AS link,
    d.doc_id % 5 = 0 AS dead, 'missing-' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS dead_link,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id % 3000 AS INTEGER)) AS effective_ts,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id * 5 % 4000 AS INTEGER)) AS modified_at,
    CASE WHEN d.doc_id % 3 <> 0 THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id % 3000 AS INTEGER)), '%Y-%m-%d') END AS updated_at,
    CASE WHEN d.doc_id % 4 = 1 THEN 'kind-' || CAST(d.doc_id % 3 AS VARCHAR) END AS fm_type
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


LINKED_SQL = """
numbered AS (SELECT d.doc_id AS d, (d.doc_id * 7 + 1 + d.doc_id // 3 % 2) % (SELECT count(*) FROM documents) AS t, d.source AS project, d.text AS body, d.doc_id % 3000 AS hours FROM documents d),
stems AS (SELECT *, CASE WHEN d % 2 = 0 THEN 'main' ELSE 'side' END AS root, CASE WHEN t % 2 = 0 THEN 'main' ELSE 'side' END AS t_root,
  CASE WHEN d % 10 = 9 THEN 'shared-' || d % 50 ELSE 'doc-' || lpad(CAST(d AS VARCHAR), 8, '0') END AS name, CASE WHEN t % 10 = 9 THEN 'shared-' || t % 50 ELSE 'doc-' || lpad(CAST(t AS VARCHAR), 8, '0') END AS t_name,
  CASE WHEN d % 10 = 9 THEN 'g' || d ELSE 'f' || d % 5 END AS folder, CASE WHEN t % 10 = 9 THEN 'g' || t ELSE 'f' || t % 5 END AS t_folder FROM numbered),
nodes AS (SELECT *, folder || '/' || name AS stem, root || ':' || folder || '/' || name || '.md' AS path, 'Doc ' || CASE WHEN d % 13 = 0 THEN d % 40 ELSE d END AS title,
  t_root || ':' || t_folder || '/' || t_name AS t_place, t_folder || '/' || t_name AS t_stem, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(hours AS INTEGER)) AS effective_ts FROM stems),
aliases AS (SELECT DISTINCT root, path, alias FROM (SELECT root, path, 'alias-' || d AS alias FROM nodes WHERE d % 4 = 0 UNION ALL SELECT root, path, 'alias-' || d % 300 FROM nodes WHERE d % 4 = 0)),
raw_wiki AS (SELECT path AS src, root, CASE d % 6 WHEN 0 THEN t_place WHEN 1 THEN t_stem WHEN 2 THEN t_name WHEN 3 THEN 'Doc ' || t WHEN 4 THEN 'alias-' || t ELSE 'missing-' || d END AS raw FROM nodes),
names AS (SELECT root, name, count(*) AS c, min(path) AS path FROM nodes GROUP BY 1, 2),
wiki AS (SELECT w.src, w.raw, w.root, coalesce(p.path, l.path, CASE WHEN k.c = 1 THEN k.path END) AS target FROM raw_wiki w LEFT JOIN nodes p ON p.path = w.raw || '.md'
  LEFT JOIN nodes l ON l.root = w.root AND l.stem = w.raw LEFT JOIN names k ON k.root = w.root AND k.name = w.raw),
hints AS (SELECT w.src, w.raw, n.path AS note, 0 AS rank FROM wiki w JOIN nodes n ON n.root = w.root AND n.name = w.raw WHERE target IS NULL
  UNION ALL SELECT w.src, w.raw, n.path, 1 FROM wiki w JOIN nodes n ON n.root = w.root AND n.title = w.raw WHERE target IS NULL
  UNION ALL SELECT w.src, w.raw, a.path, 2 FROM wiki w JOIN aliases a ON a.root = w.root AND a.alias = w.raw WHERE target IS NULL),
raw_md AS (SELECT path AS src, root, CASE WHEN d % 3 = 0 THEN '../' || t_stem || '.md' ELSE t_place || '.md' END AS raw, t_stem, d % 3 = 0 AS near FROM nodes WHERE d % 3 < 2),
md AS (SELECT m.src, m.raw, coalesce(p.path, l.path) AS target FROM raw_md m LEFT JOIN nodes p ON p.path = m.raw LEFT JOIN nodes l ON m.near AND l.root = m.root AND l.stem = m.t_stem),
links AS (SELECT DISTINCT src, raw, target FROM (SELECT src, raw, target FROM wiki UNION ALL SELECT * FROM md)),
edges AS (SELECT DISTINCT src, target AS dst FROM links WHERE target IS NOT NULL AND target <> src)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as session archives: a level-2 heading for each turn. A conversation is one note, so one row."""
    turns = _read(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    bodies = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    path = F.concat(F.lit("sessions/"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit(".md"))
    return bodies.select("conv_id", path.alias("path"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("body"))


SESSIONS_SQL = """
parts AS (SELECT conv_id, turn, '## ' || role || ' ' || CAST(turn AS VARCHAR) || chr(10) || text AS part FROM conversations),
sessions AS (SELECT conv_id, 'sessions/' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '.md' AS path, string_agg(part, chr(10) ORDER BY turn, part) AS body FROM parts GROUP BY conv_id)"""
