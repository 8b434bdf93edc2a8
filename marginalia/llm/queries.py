"""The queries of this subpackage, and the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, neighbours, packing, pii, quotes, repeats, sharding, simhash, spotsigs, toxicity, variants, whitening
from .common import materialize, read_table


def op1_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    count = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], "base_sha256", "spans")


def op3_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(read_table(spark, sf_dir, "conversations"))


def op4_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sizes = materialize(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("_mix_size")))
    return mixing.mix(sizes, weights=(1, 2, 3), cap=3.0).select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"), F.col("_mix_rate").alias("rate"), F.col("_mix_copies").alias("copies"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.clean_vectors(read_table(spark, sf_dir, "embeddings"))
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), neighbours.fit(vectors), k=10)


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint("signatures").alias("fingerprint"), spotsigs.fingerprint("edited_signatures").alias("edited_fingerprint"),
        spotsigs.likeness("signatures", "edited_signatures").alias("near_edited"), spotsigs.likeness("signatures", "next_signatures").alias("near_next"),
    )


def op8_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sharding.shard_documents(docs, shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, radius=2).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048, end=0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened_components(read_table(spark, sf_dir, "embeddings"), components=32)
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read_table(spark, sf_dir, "documents"), letters=5, occurrences=3, ratio=2)


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(read_table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kernel_toxicity": op1_kernel_toxicity,
    "op2_pii_spans": op2_pii_spans,
    "op3_quote_linking": op3_quote_linking,
    "op4_entropy_mixing": op4_entropy_mixing,
    "op5_language_id": op5_language_id,
    "op6_learned_partitions": op6_learned_partitions,
    "op7_spotsigs": op7_spotsigs,
    "op8_label_sharding": op8_label_sharding,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_bin_completion": op10_bin_completion,
    "op11_whitening": op11_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_repeated_passages": op13_repeated_passages,
}
ORACLE_SQL: dict[str, str] = {}
