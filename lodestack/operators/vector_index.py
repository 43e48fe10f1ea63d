"""Vector search by inverted lists: every vector is filed under its nearest centroid, and a search reads few lists.

An index is a folder: ``rows`` (the vectors, partitioned by list, so that a search's scan prunes), ``lists`` (centroids and
sizes) and ``probes`` (how many lists a search reads, by default as many as held the wanted share of the true neighbours of
a sample of its own vectors). Centroids are fitted on at most about ``FIT_ROWS`` vectors, chosen by hash; every vector is
filed. What is found is ranked by its exact cosine, so reading all lists gives the exact answer.

Vectors that are null, empty or zero, or hold null or non-finite components, have no cosine and are not filed. All others
must be of one length. Ties go to the least id; scores are rounded to six places first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIT_ROWS, MOST_LISTS = 50_000, 4_096
#: Vectors of the index whose true neighbours tell how many lists to read, and the share of these to be read.
TRIED, WANTED, TRIED_HITS = 200, 0.95, 10
#: Rows of a list, and queries to it, that are compared by one task.
ROWS_A_TASK, QUERIES_A_TASK = 8_192, 2_048

FOUND = "query_id long, vec_id long, scope long, score double"


def scorable(vector: Column) -> Column:
    """Whether a vector has a cosine."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(vector, lambda c: c != 0), F.lit(False))


def _some(df: DataFrame, rows: int, n: int, salt: int) -> DataFrame:
    """About so many of n rows, by a hash of their ids."""
    return df.filter(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * rows / max(n, 1))


def build(vectors: DataFrame, path: str, lists: int | None = None) -> None:
    """Index vectors(vec_id, scope, embedding) in a new folder."""
    spark = vectors.sparkSession
    good = vectors.filter(scorable(F.col("embedding"))).select("vec_id", F.col("scope").cast("long").alias("scope"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = good.count()
    if n == 0:
        spark.createDataFrame([], "vec_id long, scope long, embedding array<double>, list int").write.partitionBy("list").parquet(f"{path}/rows")
        spark.createDataFrame([], "list int, center array<double>, n long").write.parquet(f"{path}/lists")
        spark.createDataFrame([(0,)], "probes int").write.parquet(f"{path}/probes")
        return
    k = min(lists or max(1, round(n**0.5)), MOST_LISTS, n)
    features = good.withColumn("features", array_to_vector("embedding"))
    if k > 1:
        model = KMeans(k=k, distanceMeasure="cosine", maxIter=10, initSteps=2, seed=1).fit(_some(features, FIT_ROWS, n, 1).coalesce(8))
        filed, centers = model.transform(features), [c.tolist() for c in model.clusterCenters()]
    else:
        filed, centers = features.withColumn("prediction", F.lit(0)), [[1.0] * len(good.first().embedding)]
    filed.select("vec_id", "scope", "embedding", F.col("prediction").alias("list")).hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/rows")
    sizes = rows(spark, path).groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    spark.createDataFrame(list(enumerate(centers)), "list int, center array<double>").join(sizes, "list", "left").fillna(0, ["n"]).write.parquet(f"{path}/lists")
    spark.createDataFrame([(_probes(spark, path, n),)], "probes int").write.parquet(f"{path}/probes")


def rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id long, scope long, embedding array<double>, list int").parquet(f"{path}/rows")


def centroids(spark: SparkSession, path: str) -> tuple[list[int], np.ndarray]:
    """The lists that hold vectors, at most MOST_LISTS, and their unit centroids."""
    of = spark.read.parquet(f"{path}/lists").filter("n > 0").orderBy("list").collect()
    c = np.array([r.center for r in of], float).reshape(len(of), len(of[0].center) if of else 0)
    return [r.list for r in of], c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)


def probes(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/probes").first().probes


def _probes(spark: SparkSession, path: str, n: int) -> int:
    """The number of nearest lists that hold the WANTED share of the true neighbours of about TRIED vectors."""
    lists, c = centroids(spark, path)
    tried = _some(rows(spark, path), TRIED, n, 2).select(F.col("vec_id").alias("query_id"), "embedding").limit(4 * TRIED)
    near = search(spark, path, tried, TRIED_HITS, probe=len(lists))
    of = near.join(rows(spark, path).select("vec_id", "list"), "vec_id").join(tried, "query_id").select("list", "embedding").collect()
    if not of:
        return len(lists)
    x = np.array([r.embedding for r in of])
    order = np.argsort(np.argsort(-(x @ c.T), axis=1), axis=1)
    place = {v: i for i, v in enumerate(lists)}
    held = np.sort(order[np.arange(len(of)), [place[r.list] for r in of]])
    return int(held[min(len(held) - 1, int(np.ceil(WANTED * len(held))) - 1)]) + 1


def nearest_lists(vectors: np.ndarray, lists: list[int], c: np.ndarray, probe: int) -> list[list[int]]:
    s = vectors @ c.T
    return [[lists[j] for j in row] for row in np.argsort(-s, axis=1, kind="stable")[:, :probe]]


def near(spark: SparkSession, path: str, vector: list[float], hits: int = 5, probe: int | None = None, scope: int | None = None, min_score: float | None = None) -> DataFrame:
    """(vec_id, scope, score, rank): the best vectors of an index for one vector, by exact cosine among the lists nearest
    to it. The scan reads the folders of these lists alone. Scores under min_score are left out."""
    lists, c = centroids(spark, path)
    none = spark.createDataFrame([], "vec_id long, scope long, score double, rank int")
    x = np.array(vector, float)
    if not lists or not np.isfinite(x).all() or not x.any():
        return none
    chosen = nearest_lists(x[None, :], lists, c, probe or probes(spark, path))[0]
    own = F.col("embedding")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    score = F.round(dot(own, F.lit(x.tolist())) / (F.sqrt(dot(own, own)) * F.lit(float(np.sqrt(x @ x)))), 6)
    found = rows(spark, path).filter(F.col("list").isin(chosen))
    if scope is not None:
        found = found.filter(F.col("scope") == scope)
    scored = found.select("vec_id", "scope", score.alias("score"))
    if min_score is not None:
        scored = scored.filter(F.col("score") >= min_score)
    best = scored.orderBy(F.desc("score"), "vec_id").limit(hits)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))  # as many rows as hits


def _probed(batches: Iterator[pa.RecordBatch], lists: list[int], c: np.ndarray, probe: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = np.array(batch.column(1).to_pylist(), float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest_lists(x, lists, c, probe), pa.list_(pa.int32()))], ["query_id", "embedding", "lists"])


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    x = np.array(column.to_pylist(), float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(queries: pa.Table, found: pa.Table) -> pa.Table:
    """The best rows of a block for each query of a block."""
    out = {"query_id": [], "vec_id": [], "scope": [], "score": []}
    if queries.num_rows and found.num_rows:
        most = queries["hits"][0].as_py()
        ids, scopes = found["vec_id"].to_numpy(), np.array(found["scope"].to_pylist(), object)
        s = np.round(_unit(queries["embedding"]) @ _unit(found["embedding"]).T, 6)
        names = queries["query_id"].to_pylist()
        for q, name in enumerate(names):
            kept = np.arange(len(ids))
            if len(ids) > most:
                kept = np.flatnonzero(s[q] >= np.partition(s[q], len(ids) - most)[len(ids) - most])
            top = kept[np.lexsort((ids[kept], -s[q, kept]))][:most]
            for column, values in zip(out.values(), ([name] * len(top), ids[top].tolist(), scopes[top].tolist(), s[q, top].tolist()), strict=True):
                column.extend(values)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})


def search(spark: SparkSession, path: str, queries: DataFrame, hits: int = 5, probe: int | None = None) -> DataFrame:
    """(query_id, vec_id, scope, score, rank): the same for many queries(query_id, embedding), a number that may grow with
    the table. Queries meet the rows of their lists block by block, both of bounded size, and bring their best ones."""
    lists, c = centroids(spark, path)
    good = queries.filter(scorable(F.col("embedding"))).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    if not lists:
        return spark.createDataFrame([], FOUND).withColumn("rank", F.lit(0))
    probe = min(probe or probes(spark, path), len(lists))
    asked = good.mapInArrow(lambda b: _probed(b, lists, c, probe), "query_id long, embedding array<double>, lists array<int>").select("query_id", "embedding", F.explode("lists").alias("list"))
    parts = spark.read.parquet(f"{path}/lists").filter("n > 0").select("list", F.ceil(F.col("n") / ROWS_A_TASK).cast("int").alias("r_parts"))
    asks = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES_A_TASK).cast("int").alias("q_parts"))
    sizes = parts.join(asks, "list")  # at most MOST_LISTS rows
    dealt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = asked.join(sizes, "list").withColumn("q", dealt("query_id", F.col("q_parts"))).withColumn("r", F.explode(upto("r_parts"))).select("list", "q", "r", "query_id", "embedding", F.lit(hits).alias("hits"))
    right = rows(spark, path).join(sizes, "list").withColumn("r", dealt("vec_id", F.col("r_parts"))).withColumn("q", F.explode(upto("q_parts"))).select("list", "q", "r", "vec_id", "scope", "embedding")
    keys = ("list", "q", "r")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= hits)
