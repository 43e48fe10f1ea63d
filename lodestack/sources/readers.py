"""Readers of what lies in folders: text trees, graph documents, metric lines, manifests, personas.

Schemas are explicit; nothing is inferred. A missing folder or file is an empty table where the contract says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.textops import area_of, capped

#: Folders never walked, files that a reindex takes, and files a context crawl may read, in order.
IGNORED = (".git", "node_modules", "dist", "build", "coverage")
REINDEXED = ("ts", "md", "yaml", "yml")

GRAPH = (
    "nodes array<struct<id:string,label:string,norm_label:string,file_type:string,source_file:string,source_location:string,_origin:string>>, "
    "links array<struct<source:string,target:string,relation:string,source_file:string,source_location:string,confidence_score:double,_origin:string>>"
)
METRIC = "event string, runner string, timestamp timestamp, detail string"
MANIFEST = "path string, area string, sha256 string, headings array<struct<level:int,text:string,line:int>>"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


TREE = "path string, area string, text string, modified timestamp"


def text_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """(path, area, text, modified) of the files below a folder, ignored folders left out. Files that are no UTF-8 have
    null text; a folder that is not there is an empty table."""
    if not exists(spark, root):
        return spark.createDataFrame([], TREE)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if extensions:
        raw = raw.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    base = F.lit(root.rstrip("/").split("://")[-1].lstrip("/"))
    files = raw.load(root).withColumn("path", F.expr("substring_index(path, ':', -1)")).withColumn("path", F.regexp_replace("path", "^/+", ""))
    inside = files.withColumn("path", F.substr("path", F.length(base) + 2))
    kept = inside.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))
    return kept.select("path", area_of(F.col("path")).alias("area"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("modified"))


def graph_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and links of a graph document, in their order. A document node whose place is not ``L<n>`` fails the read."""
    whole = spark.read.schema(GRAPH).option("multiLine", "true").json(path)
    nodes = whole.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*").withColumnRenamed("_origin", "origin")
    bad = (F.col("file_type") == "document") & ~F.coalesce(F.col("source_location").rlike(r"^L\d+$"), F.lit(False))
    nodes = nodes.withColumn("source_location", F.when(bad, F.raise_error(F.concat(F.lit("document node without a line: "), F.coalesce("id", F.lit("?"))))).otherwise(F.col("source_location")))
    links = whole.select(F.posexplode("links").alias("ord", "l")).select("ord", "l.*").withColumnRenamed("_origin", "origin")
    return nodes, links


def metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of run events; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], METRIC)
    return spark.read.schema(METRIC).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """A file index as written by ``write_manifest``; None where there is none."""
    return spark.read.schema(MANIFEST).parquet(path) if exists(spark, path) else None


def write_manifest(index: DataFrame, path: str) -> None:
    index.select("path", "area", "sha256", "headings").write.mode("overwrite").parquet(path)


def requested(files: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of names(path): those that were read, with their text, and those missing."""
    return names.join(files, "path"), names.join(files, "path", "left_anti")


def first_of(files: DataFrame, candidates: list[str]) -> DataFrame:
    """The first of ranked candidate names that exists."""
    ranks = files.sparkSession.createDataFrame(list(enumerate(candidates)), "rank int, path string")
    return files.join(F.broadcast(ranks), "path").orderBy("rank").limit(1)


def context(files: DataFrame, groups: list[list[str]], lines: int = 40, chars: int = 1_200) -> DataFrame:
    """(name, path, excerpt) of a bounded crawl: of each group of candidate names the first that is there, its text cut to
    so many lines and characters. A name is the group's first candidate."""
    ranked = [(g[0], k, p) for g in groups for k, p in enumerate(g)]
    ranks = files.sparkSession.createDataFrame(ranked, "name string, rank int, path string")
    found = files.join(ranks, "path")
    first = found.groupBy("name").agg(F.min_by(F.struct("path", "text"), "rank").alias("f"))
    return first.select("name", "f.path", capped(F.col("f.text"), lines, chars).alias("excerpt"))


INVENTORY = "collection string, points long"


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """An inventory as ``writes.write_inventory`` left it; unlike other readers it fails where there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no inventory at {path}: write it first")
    return spark.read.schema(INVENTORY).json(path)


PERSONA = "tier string, scope_id string, display_name string, sections array<struct<heading:string,body:string>>, parents array<struct<tier:string,scope_id:string>>"


def personas(spark: SparkSession, path: str) -> DataFrame:
    """Personas as ``writes.write_persona`` left them; none where there is no folder."""
    return spark.read.schema(PERSONA).parquet(path) if exists(spark, path) else spark.createDataFrame([], PERSONA)


ORG_TREE = "repo_path string, owner string, ord long"


def org_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORG_TREE).json(path) if exists(spark, path) else spark.createDataFrame([], ORG_TREE)
