"""Canonical tables of the engine, derived from the star schema, document and web tables of a data folder.

files(path, area, repo, doc_id, text), lines(+ line_no, line), notes(note_id, status, branch, commit_sha, header, body),
nodes(id, label, kind), links(source, target, relation, origin), triples, code(repo, path, text),
runner_events(ord, event, runner, ts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.textops import area_of, note_header


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return table(spark, sf_dir, "documents").select(path.alias("path"), area_of(path).alias("area"), F.col("source").alias("repo"), "doc_id", "text")


def lines(found: DataFrame) -> DataFrame:
    """A row a line, numbered from 1, in the files' own order of lines."""
    rest = [c for c in found.columns if c != "text"]
    return found.select(*rest, F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).select(*rest, (F.col("pos") + 1).alias("line_no"), "line")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: the status by id, the source as branch, a digest as commit."""
    tail = F.pmod("doc_id", F.lit(10))
    status = F.when(tail <= 5, "confirmed").when(tail <= 8, "provisional").otherwise("superseded")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), "lang", F.col("source").alias("branch"), status.alias("status"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("commit_sha"), F.col("text").alias("body"))
    return docs.withColumn("header", note_header(F.lit("top"), F.col("status"), F.col("branch"), F.col("commit_sha")))


#: Rows that one task holds while it tells equal keys apart: its memory does not grow with the table.
ROWS_A_TASK = 500_000


def distinct(df: DataFrame) -> DataFrame:
    """Distinct rows of a table's key columns, dealt over as many tasks as its rows are worth; their number is read from
    the files' footers."""
    return df.repartition(max(1, -(-df.count() // ROWS_A_TASK)), *df.columns).distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as a typed graph. Keys are told apart as numbers, before they become texts."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    def edges(name: str, src: tuple[str, str], relation: str, dst: tuple[str, str]) -> DataFrame:
        own = distinct(table(spark, sf_dir, name).select(src[1], dst[1]))
        return own.select(key(*src).alias("source"), key(*dst).alias("target"), F.lit(relation).alias("relation"), F.lit(name).alias("origin"))

    parts = [
        edges("orders", ("customer", "o_custkey"), "placed", ("order", "o_orderkey")),
        edges("customer", ("customer", "c_custkey"), "in", ("nation", "c_nationkey")),
        edges("supplier", ("supplier", "s_suppkey"), "in", ("nation", "s_nationkey")),
        edges("nation", ("nation", "n_nationkey"), "in", ("region", "n_regionkey")),
        edges("lineitem", ("supplier", "l_suppkey"), "supplies", ("part", "l_partkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"), ("part", "p_partkey", "p_name")]
    out = None
    for kind, key, name in kinds:
        own = table(spark, sf_dir, kind).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.col(name).alias("label"), F.lit(kind).alias("kind"))
        out = own if out is None else out.unionByName(own)
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("label"), F.lit("order").alias("kind"))
    return out.unionByName(orders)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts with a validity interval: open orders have no end."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("subject"),
        F.lit("placed").alias("predicate"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("object"),
        F.col("o_orderdate").alias("valid_from"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("valid_until"),
    )


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source texts for the linker: nations define identifiers, customers use them."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    defs = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("repo"), F.concat(F.lit("schemas/"), F.col("n_nationkey").cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("export default {\n  name: '"), F.col("n_name"), F.lit("',\n  title: 't',\n  type: 'document',\n};")).alias("text")
    )
    customer = table(spark, sf_dir, "customer")
    uses = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_mktsegment").alias("repo"), F.concat(F.lit("src/"), F.col("c_custkey").cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("const q =\n  `*[_type == '"), F.col("n_name"), F.lit("']`\nconst r = `*[_type in ['"), F.col("n_name"), F.lit("',\n  'other', 'a\"]]`\nconst s = `*[_type == '"), F.col("n_name"), F.lit("']`")).alias("text")
    )
    return defs.unionByName(uses)


def runner_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in {"signup": "runner_attempt", "view": "runner_attempt", "click": "runner_success", "purchase": "fallback_triggered", "error": "runner_failure"}.items() for x in pair))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), names[F.col("event_type")].alias("event"), F.concat(F.lit("runner-"), F.pmod("user_id", F.lit(4)).cast("string")).alias("runner"), F.col("ts").alias("at"))
