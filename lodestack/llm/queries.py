"""The registered queries of this subpackage: opN_<name>(spark, sf_dir), and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bloom_cascade, embedding_dedup, lattice_lm, line_cleaning, minhash, mixing, periodic_runs, pii_votes, sentence_spans, subword_classifier, token_ids, whitening, winnowing
from lodestack.llm.oracles import ORACLES
from lodestack.llm.shared import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice_lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def op3_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_votes.find(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, pii_votes.KINDS), F.sha2(pii_votes.written(F.col("base")), 256).alias("base_sha256"), pii_votes.written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_cleaning.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "kept_words")


#: Host and path prefix, verdict.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op6_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_cascade.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose sentences, with the text that is left."""
    return sentence_spans.changed_documents(table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digests(docs: DataFrame) -> DataFrame:
    return token_ids.read_dataset(*token_ids.write_dataset(docs, word_tokenizer()))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op9_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


def op11_kmeans_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), loops=True)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_source_mixing": op2_source_mixing,
    "op3_pii_votes": op3_pii_votes,
    "op4_subword_quality": op4_subword_quality,
    "op5_line_cleaning": op5_line_cleaning,
    "op6_bloom_cascade": op6_bloom_cascade,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_token_ids": op8_token_ids,
    "op9_minhash_join": op9_minhash_join,
    "op10_winnowing": op10_winnowing,
    "op11_kmeans_dedup": op11_kmeans_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}

__all__ = ["ORACLES", "QUERIES"]
