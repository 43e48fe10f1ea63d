"""Registered queries over indexes, streams with state and long histories, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators import graph, text_index, vector_index
from lodestack.plans.recall_queries import QUERIES  # noqa: F401
from lodestack.plans.registry import FILES, LINES, ORACLES, QUERY, query
from lodestack.sources import tables as T
from lodestack.sources.shared import scratch
from lodestack.streaming import index, state

# ------------------------------------------------------------------ indexes


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    """The vectors, and as queries those whose id is divisible by 100."""
    v = T.table(spark, d, "embeddings").select("vec_id", F.col("label").alias("scope"), "embedding")
    return v, v.filter(F.pmod("vec_id", F.lit(100)) == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, label::BIGINT AS scope, round(list_cosine_similarity(embedding::DOUBLE[], x), 6) AS score FROM embeddings, q)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10"""
)
def vector_index_all_lists(spark, d):
    """All lists are read: the exact answer."""
    vectors, queries = _vectors(spark, d)
    path = scratch(spark, "vector-index")
    vector_index.build(vectors, path)
    return vector_index.search(spark, path, queries, 10, probe=vector_index.MOST_LISTS)


@query()
def vector_index_search(spark, d):
    """As many lists are read as the index found to be worth it."""
    vectors, queries = _vectors(spark, d)
    path = scratch(spark, "vector-index")
    vector_index.build(vectors, path)
    return vector_index.search(spark, path, queries, 10)


@query(ORACLES["literal_search"])
def literal_index_search(spark, d):
    path = scratch(spark, "text-index")
    text_index.build(T.files(spark, d), path)
    found = text_index.search(spark, path, [QUERY + " ", "thonand"])
    return found.select("doc_id", "path", "line_no", "line", F.sha2("line", 256).alias("line_sha"))


@query(f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE contains(lower(line), 'the th') OR contains(lower(line), 'ß')")
def literal_index_search_ci(spark, d):
    path = scratch(spark, "text-index")
    text_index.build(T.files(spark, d), path, ignore_case=True)
    return text_index.search(spark, path, ["The Th", "ß"], ignore_case=True).select("doc_id", "line_no")


# ------------------------------------------------------------------ streams


def _deliver(parts: list[DataFrame], source: str, work) -> None:
    """Each part comes to a folder, and is worked off before the next one comes."""
    for part in parts:
        part.write.mode("append").parquet(source)
        work()


def _thirds(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    """df in n parts of the order of a key, by its least and greatest."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return [df]
    part = F.least(F.floor((F.col(key) - low) * n / F.lit(high - low + 1)), F.lit(n - 1))
    return [df.filter(part == k) for k in range(n)]


@query(
    """WITH e AS (SELECT user_id AS note_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'superseded' WHEN 'view' THEN 'provisional' ELSE event_type END AS to_status, event_type FROM events),
f AS (SELECT note_id, arg_min(to_status, seq) AS status, arg_min(event_type, seq) AS summary FROM e WHERE to_status IN ('confirmed', 'superseded') GROUP BY note_id)
SELECT note_id, coalesce(status, 'provisional') AS status, summary, count(*) AS n_events, count(*) - max((status IS NOT NULL)::INT) AS n_rejected FROM e LEFT JOIN f USING (note_id) GROUP BY ALL"""
)
def lifecycle_stream(spark, d):
    """Events of notes in two runs over one checkpoint, and what became of each note."""
    kind = F.col("event_type")
    to = F.when(kind == "purchase", "confirmed").when(kind == "error", "superseded").when(kind == "view", "provisional").otherwise(kind)
    events = T.table(spark, d, "events").select(F.col("user_id").cast("long").alias("note_id"), F.col("event_id").cast("long").alias("seq"), to.alias("to"), kind.alias("summary"), F.col("ts").cast("timestamp").alias("at"))
    source, out, at = (scratch(spark, f"lifecycle-{x}") for x in ("in", "out", "state"))
    _deliver(_thirds(events, "seq", 2), source, lambda: state.run(state.lifecycle(spark.readStream.schema(state.EVENT).parquet(source)), out, at))
    rows = spark.read.schema(state.TRANSITION).parquet(out)
    counts = rows.groupBy("note_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(~F.col("accepted")).alias("n_rejected"))
    return state.settled(rows).join(counts, "note_id")


@query(ORACLES["pending_branch_shas"])
def pending_stream(spark, d):
    """Shas stashed and taken in three batches: as if all had come at once."""
    e = T.table(spark, d, "events").select(F.pmod("user_id", F.lit(50)).cast("string").alias("branch"), F.col("event_id").cast("long").alias("ord"), F.when(F.col("event_type") == "click", "take").otherwise("stash").alias("op"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("sha"))
    source, out, at = (scratch(spark, f"pending-{x}") for x in ("in", "out", "state"))
    _deliver(_thirds(e, "ord", 3), source, lambda: state.run(state.taken(spark.readStream.schema(state.STEP).parquet(source)), out, at))
    return spark.read.schema(state.TAKEN).parquet(out).select(F.col("branch").cast("long").alias("branch"), "ord", "sha")


@query(
    f"""WITH {FILES}, l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT path, text || CASE WHEN quality = 0 THEN ' (revised)' ELSE '' END AS t FROM files LEFT JOIN l USING (doc_id) WHERE coalesce(toxic, 0) <> 1)
SELECT path, sha256(t) AS sha256, strlen(t)::BIGINT AS n_bytes FROM f"""
)
def continuous_index_state(spark, d):
    """All documents, then those of low quality revised and the toxic ones removed, then all of the second delivery again:
    what the index holds in the end."""
    files = T.files(spark, d).select("doc_id", "path", "text")
    labels = T.table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    at = lambda hour: F.lit(f"2026-01-01 0{hour}:00:00").cast("timestamp").alias("modified")
    revised = F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.concat("text", F.lit(" (revised)"))).alias("text")
    second = files.join(labels.filter("quality = 0 or toxic = 1"), "doc_id").select("path", revised, at(2))
    source, target, checkpoint = (scratch(spark, f"index-{x}") for x in ("in", "files", "state"))
    _deliver([files.select("path", "text", at(1)), second, second], source, lambda: index.follow(spark, source, target, checkpoint))
    sizes = index.current(spark, target).groupBy("path").agg(F.sum(F.octet_length("text")).alias("n"))
    return index.files(spark, target).join(sizes, "path", "left").select("path", "sha256", F.coalesce("n", F.lit(0)).cast("long").alias("n_bytes"))


# ------------------------------------------------------------------ long histories


@query("SELECT event_id AS id FROM events WHERE event_id <= (SELECT (min(event_id) + max(event_id)) // 2 FROM events) UNION SELECT min(event_id) - 1 FROM events")
def linear_history(spark, d):
    """Every event as a commit whose parent is the one before: what the middle one reaches."""
    events = T.table(spark, d, "events")
    commits = events.select(F.col("event_id").alias("source"), (F.col("event_id") - 1).alias("target"))
    tip = events.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("id")).filter("id is not null")
    return graph.ancestors(commits, tip)
