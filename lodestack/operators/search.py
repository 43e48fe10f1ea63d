"""Literal, keyword and vector search, with limits per scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.textops import headings, tokens
from lodestack.sources.tables import lines


def _named(query: str) -> str:
    if not query.strip():
        raise ValueError("invalid_query: the query is blank")
    return query


def literal(files: DataFrame, query: str, ignore_case: bool = False, area: str | None = None) -> DataFrame:
    """Lines that hold a literal. An area that no file has widens to all files."""
    return any_literal(files, [query], ignore_case, area)


def any_literal(files: DataFrame, queries: list[str], ignore_case: bool = False, area: str | None = None) -> DataFrame:
    """Lines that hold one of some literals, in one pass; a text is cut into lines only if it holds one itself."""
    wanted = [_named(q).lower() if ignore_case else _named(q) for q in queries]
    holds = lambda c: reduce(lambda a, b: a | b, (F.contains(F.lower(c) if ignore_case else F.col(c), F.lit(q)) for q in wanted))
    return lines(in_area(files, area).filter(holds("text"))).filter(holds("line"))


def in_area(files: DataFrame, area: str | None) -> DataFrame:
    """Files of an area: of two segments or more, all below it; of one or none, only those right in it. An area that no
    file has widens to all files."""
    if area is None:
        return files
    chosen = files.filter(F.startswith("path", F.lit(f"{area}/")) if "/" in area else F.col("area") == area)
    return files if chosen.isEmpty() else chosen


def top_of(hits: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n of each scope, with their rank."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n)


def keyword(files: DataFrame, query: str, hits: int = 5) -> DataFrame:
    """Exact-string hits of each repo, without a score."""
    return top_of(literal(files, query), "repo", [F.col("doc_id"), F.col("line_no")], hits).withColumn("score", F.lit(None).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def scored(vectors: DataFrame, query_id: int) -> DataFrame:
    """Cosine of every vector to one of them. The query is one row: its vector and norm go into the plan as a literal."""
    row = vectors.filter(F.col("vec_id") == query_id).select(F.col("embedding").cast("array<double>").alias("q"), F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm")).first()
    query, norm = (row["q"], row["norm"]) if row else ([], 0.0)
    own = F.col("embedding")
    cos = dot(own, F.array(*map(F.lit, query)).cast("array<double>")) / (F.sqrt(dot(own, own)) * F.lit(norm))
    return vectors.select("vec_id", F.col("label").cast("long").alias("scope"), F.round(cos, 6).alias("score")).filter(F.lit(row is not None))


def neighbours(chunks: DataFrame, hits: DataFrame, radius: int) -> DataFrame:
    """Chunks within ``radius`` of a hit's chunk of the same source."""
    around = hits.select("doc_id", F.col("chunk_index").alias("hit"), F.explode(F.sequence(F.greatest(F.col("chunk_index") - radius, F.lit(0)), F.col("chunk_index") + radius)).alias("chunk_index"))
    return chunks.join(around.select("doc_id", "chunk_index").distinct(), ["doc_id", "chunk_index"])


def file_index(files: DataFrame) -> DataFrame:
    return files.select("path", "area", F.sha2(F.col("text"), 256).alias("sha256"), headings(F.col("text")).alias("headings"))


def areas(files: DataFrame) -> DataFrame:
    """(area, n_files, first_path, last_path): counts and bounds; a listing of an area's paths is rows, not one value."""
    return files.groupBy("area").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def find_cost(files: DataFrame, query: str) -> DataFrame:
    """What reading every matching file whole would cost, against the matching lines alone."""
    whole = files.filter(F.contains("text", F.lit(query))).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(tokens(F.col("text"))), F.lit(0)).alias("find_tokens"))
    some = literal(files, query).agg(F.count(F.lit(1)).alias("n_hits"), F.coalesce(F.sum(tokens(F.col("line"))), F.lit(0)).alias("recall_tokens"))
    both = whole.withColumn("one", F.lit(1)).join(some.withColumn("one", F.lit(1)), "one").drop("one")  # one row each
    ratio = F.when(F.col("find_tokens") > 0, F.round(F.col("recall_tokens") / F.col("find_tokens"), 6)).otherwise(0.0)
    return both.withColumn("ratio", ratio).withColumn("beats_find", F.col("recall_tokens") < F.col("find_tokens"))
