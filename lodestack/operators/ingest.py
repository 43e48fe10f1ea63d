"""Ingestion: gates, chunk rows, outcomes; note writes and reindexing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.textops import chunks, note_header

TEXT_BYTES, PDF_BYTES = 200_000, 20_000_000
EXTENSIONS = ("txt", "md", "pdf")


def gates(docs: DataFrame, most: int = TEXT_BYTES, most_pdf: int = PDF_BYTES) -> DataFrame:
    """(filename, text) with outcome: ok, unsupported_format, unsupported_parser (no PDF reader here) or too_large."""
    ext = F.lower(F.substring_index("filename", ".", -1))
    kind = F.when(~ext.isin(*EXTENSIONS), "unsupported_format").when(F.octet_length("text") > F.when(ext == "pdf", most_pdf).otherwise(most), "too_large").when(ext == "pdf", "unsupported_parser").otherwise("ok")
    return docs.withColumn("outcome", kind)


def chunk_rows(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, chunk_index, chunk_count, text, ok: a chunk of white space alone is refused."""
    cut = docs.select("doc_id", chunks(F.col("text"), most).alias("parts"))
    return cut.select("doc_id", F.size("parts").alias("chunk_count"), F.posexplode("parts").alias("chunk_index", "text")).withColumn("ok", F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def chunk_specs(docs: DataFrame, most: int) -> DataFrame:
    """(filename, tag, chunk_index, chunk_count, text) of docs(filename, tag, text): chunks as an index takes them."""
    cut = docs.select("filename", "tag", chunks(F.col("text"), most).alias("parts"))
    return cut.select("filename", "tag", F.size("parts").alias("chunk_count"), F.posexplode("parts").alias("chunk_index", "text"))


def outcomes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad"))
    out = docs.select("doc_id").join(sums, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("chunk_count"), F.coalesce("bad", F.lit(0)).alias("failed"), (F.coalesce("bad", F.lit(0)) == 0).alias("ok"))


def reindexed(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """An index of (doc_id, chunk_index, sha256) after its sources fresh were chunked anew: their rows replace the old
    ones, the stale tail of a source that shrank goes, other sources stay."""
    others = index.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti")
    return others.unionByName(fresh.select(*index.columns))


def append_note(path: str, notes: DataFrame) -> int:
    """Validate and append notes(scope, status, branch, commit_sha, body); returns how many were written."""
    bad = notes.filter(F.coalesce(F.trim("body") == "", F.lit(True)) | (F.col("status").isNull() != F.col("branch").isNull()))
    if not bad.isEmpty():
        raise ValueError("invalid_content: a note is blank, or has a status without its source or the reverse")
    written = notes.withColumn("header", note_header(F.col("scope"), F.col("status"), F.col("branch"), F.col("commit_sha")))
    n = written.count()
    if not n:
        raise ValueError("nothing to write")
    written.write.mode("append").parquet(path)
    return n
