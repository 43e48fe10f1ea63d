"""The corpus pipeline: quality rules, near-duplicates, decontamination, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
other columns come with them. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import line_cleaning, minhash, mixing, queries, token_ids, winnowing
from lodestack.llm.shared import drop_kept, keep, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them; the others lose their failing lines. Rows are judged each."""
    ship(spark)
    out = line_cleaning.clean_lines(docs).filter("kept")
    return out.withColumn("text", F.col("cleaned")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays, with all its rows if it repeats its id; rows
    without an id stay."""
    ship(spark)
    gone = minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; rows are told apart by id and text, so one without an id, or
    one of several texts of an id, goes by its own text."""
    ship(spark)
    hits = winnowing.contaminated(docs, queries.table(spark, sf_dir, "benchmark"))
    gone = hits.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    same = (winnowing.text_key(F.col("text")) == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that each source's target takes, in the order of the schedule; a second pass repeats a document's row.
    Null and empty texts are never taken."""
    ship(spark)
    return mixing.mix(docs).select(*COLUMNS)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the mixed documents, written and read back, in ascending doc_id order as the operator's files have it."""
    ship(spark)
    return queries.token_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_ids),
]

#: SQL can state neither the tokenizer nor the shuffled schedule: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: DataFrame | None = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"stage-{k}")
            if before is not None:
                drop_kept(before)
            before = docs
    return docs
