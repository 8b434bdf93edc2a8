"""A corpus pipeline of five operators; each stage's rows are written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import langid, mixing, nearcopies, packing, pii
from marginalia.llm.common import materialize, read_table
from marginalia.llm.queries import tokenizer_path
from marginalia.operators.tables import delete_tables, written

#: A document stays if its predicted language has at least this score.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the model is sure of, go; lang becomes the prediction.

    The model learns from the documents that have a language. Null and empty texts have no letter and go.
    """
    model = langid.fit(docs)
    kept = langid.relabel(docs, model, LEAST_SCORE)
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id.

    Near duplicates have a Jaccard coefficient of 0.8 or more on five-word shingles; operator 9's fingerprints and trees
    link the closest, see ``nearcopies`` for the others. Rows without a doc_id have no
    identity to compare by and stay; of rows that share a doc_id and a text one stays.
    """
    copies = nearcopies.near_copies(docs).where("doc_id is not null")
    kept = materialize(copies.where("doc_id = first.doc_id and mark = first.mark").select("doc_id", "mark").distinct())
    marked = docs.where("doc_id is not null").withColumn("mark", F.xxhash64(F.col("text").cast("string")))
    found = marked.join(kept, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    return found.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in angle brackets; n_chars follows. No document goes."""
    redacted = pii.find(docs, pii.fit(docs), redacted=True)
    return redacted.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources (weights 1, 2, 3, repeating) takes it."""
    return mixing.mix_documents(docs, weights=(1, 2, 3), cap=3.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences, and where they are packed."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048, end=0).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("known_language", known_language),
    ("near_duplicates", near_duplicates),
    ("without_personal_data", without_personal_data),
    ("mixed_sources", mixed_sources),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables of a stage go when the next one's rows are written."""
    docs = read_table(spark, sf_dir, "documents")
    before = written(spark)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        delete_tables(spark, [p for p in written(spark)[:-1] if p not in before])
    return docs


#: Language models, fingerprints, entity models, tilting and packing have no SQL form.
ORACLE_SQL = None
