"""Guarded writes: notes with their chunks, cascades of sinks, edges, collections, metrics, composed files.

Every write validates first and appends through Spark's own writers, so a lost task leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.textops import FLIGHT, chunks, flight, note_header, spliced
from lodestack.operators.scopes import COLLECTION_NAME, SCOPE_NAME, violations
from lodestack.sources.readers import exists
from lodestack.sources.shared import cut
from lodestack.streaming.index import write_epoch

#: Chunks of a note's index.
CHUNK_BYTES = 4_000


@dataclass
class Written:
    """What became of a write: ok, where, how many notes and chunks, and an error's code and text."""

    ok: bool
    layer: str
    notes: int = 0
    chunks: int = 0
    code: str | None = None
    error: str | None = None
    failed_parts: list[str] = field(default_factory=list)


def note_chunks(notes: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """(note_id, scope, chunk_index, chunk_count, text) of notes(note_id, scope, body)."""
    cut = notes.select("note_id", "scope", chunks(F.col("body"), most).alias("parts"))
    return cut.select("note_id", "scope", F.size("parts").alias("chunk_count"), F.posexplode("parts").alias("chunk_index", "text")).filter(F.trim("text") != "")


def remember(notes: DataFrame, scopes: DataFrame, path: str, layer: str = "vector") -> Written:
    """Validate notes(note_id, scope, status, branch, commit_sha, body), append them and, unless the layer is ``file``,
    their chunks. Codes: invalid_content, unknown_scope (with the names that are known), nothing_indexed."""
    blank = F.coalesce(F.trim("body") == "", F.lit(True)) | (F.col("status").isNull() != F.col("branch").isNull())
    if notes.isEmpty() or not notes.filter(blank).isEmpty():
        return Written(False, layer, code="invalid_content", error="a note is blank, or has a status without its branch or the reverse")
    if not notes.join(scopes.select("scope"), "scope", "left_anti").isEmpty():
        known = sorted(r[0] for r in scopes.select("scope").distinct().limit(50).collect())
        return Written(False, layer, code="unknown_scope", error=f"known scopes: {', '.join(known)}")
    written = notes.withColumn("header", note_header(F.col("scope"), F.col("status"), F.col("branch"), F.col("commit_sha")))
    rows = note_chunks(notes)
    n = 0 if layer == "file" else rows.count()
    if layer != "file" and not n:
        return Written(False, layer, code="nothing_indexed", error="no chunk to index")
    written.write.mode("append").parquet(f"{path}/notes")
    if layer != "file":
        rows.write.mode("append").parquet(f"{path}/chunks")
    return Written(True, layer, written.count(), n)


def remember_cascade(sinks: Sequence[tuple[str, Callable[[], Written]]], layer: str | None = None) -> Written:
    """A named layer is tried alone. Else the first sink that succeeds; the failures before it are its failed parts."""
    if layer is not None:
        named = [write for name, write in sinks if name == layer]
        return named[0]() if named else Written(False, layer, code="unknown_layer", error=f"no layer {layer}")
    failed: list[str] = []
    for name, write in sinks:
        try:
            out = write()
        except Exception as e:  # a sink that cannot write is reported, the next one is tried
            out = Written(False, name, code="write_failed", error=str(e).splitlines()[0])
        if out.ok:
            out.failed_parts = failed
            return out
        failed.append(f"{name}: {out.code}")
    return Written(False, "", code="all_layers_failed", failed_parts=failed)


def new_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of wanted(src, predicate, dst, ...) those that edges lack, each once: what an insert-if-absent appends."""
    key = ["src", "predicate", "dst"]
    return wanted.dropDuplicates(key).join(edges.select(*key), key, "left_anti").select(*edges.columns)


def append_edges(path: str, wanted: DataFrame) -> int:
    """Insert-if-absent into an edge table in a folder, made if it is not there; returns how many edges were new. New edges
    are written once before they are appended, so the append does not read what it writes to."""
    spark = wanted.sparkSession
    held = spark.read.schema(wanted.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], wanted.schema)
    fresh = cut(new_edges(held, wanted), "edges")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def bulk_index(files: DataFrame, target: str, epoch: int, most_bytes: int, most: int = CHUNK_BYTES) -> DataFrame:
    """``bulk_indexed`` of files(path, text), and those without an error written to a continuous index as one epoch. What
    failed keeps its version of before."""
    outcome = cut(bulk_indexed(files, most_bytes, most), "outcome")
    good = files.select("path", "text").join(outcome.filter("error is null").select("path"), "path", "left_semi")
    write_epoch(good.withColumn("modified", F.lit(None).cast("timestamp")), epoch, target, most)
    return outcome


def bulk_indexed(files: DataFrame, most_bytes: int, most: int = CHUNK_BYTES) -> DataFrame:
    """(path, n_chunks, error) of files(path, text): every file has its outcome and none stops the others. A text that is
    no UTF-8 (null), is blank or is too large is an error."""
    error = F.when(F.col("text").isNull(), "unreadable").when(F.octet_length("text") > most_bytes, "too_large").when(F.trim("text") == "", "empty")
    return files.select("path", F.when(error.isNull(), F.size(chunks(F.col("text"), most))).otherwise(0).alias("n_chunks"), error.alias("error"))


def create_collection_and_scope(collections: DataFrame, scopes: DataFrame, name: str, scope: str, dimension: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collections with one more, then scopes with one more, and (collection_created, scope_written, error): a failure of
    the second step tells that the first one stands."""
    spark = collections.sparkSession
    tell = lambda made, mapped, error: spark.createDataFrame([(made, mapped, error)], "collection_created boolean, scope_written boolean, error string")
    new = spark.createDataFrame([(name, scope, dimension)], "collection string, scope string, dimension int")
    if new.filter(F.col("collection").rlike(COLLECTION_NAME) & (F.col("dimension") > 0)).isEmpty():
        return collections, scopes, tell(False, False, "malformed collection")
    made = collections.filter(F.col("collection") == name).isEmpty()
    grown = collections.unionByName(new.select("collection", "dimension"), allowMissingColumns=True) if made else collections
    held = scopes.filter(F.col("scope") == scope).limit(1).collect()
    if held:
        same = held[0]["collection"] == name
        return grown, scopes, tell(made, False, None if same else f"scope is mapped to {held[0]['collection']}")
    if new.filter(F.col("scope").rlike(SCOPE_NAME)).isEmpty():
        return grown, scopes, tell(made, False, "malformed scope")
    return grown, scopes.unionByName(new.select("scope", "collection"), allowMissingColumns=True), tell(made, True, None)


def with_status(text: Column, to: Column) -> Column:
    """A note's text with the status of its header line rewritten and nothing else; a text whose first line is no header
    fails the write."""
    first = F.substring_index(text, "\n", 1)
    rest = F.substr(text, F.length(first) + 1)
    new = F.concat(F.regexp_extract(first, rf"^(.*?)\b{FLIGHT}", 1), F.lit("status="), to, F.regexp_extract(first, r"\bstatus=(?:provisional|confirmed|superseded)\b(.*)$", 1))
    return F.when(flight(first).isNull(), F.raise_error(F.lit("the first line is no note header"))).otherwise(F.concat(new, rest))


def with_outcome(text: Column, summary: Column) -> Column:
    """A note's text with one more outcome section; what is there stays."""
    return F.concat(text, F.when(text.endswith("\n"), "\n").otherwise("\n\n"), F.lit("## Lifecycle outcome\n"), summary, F.lit("\n"))


def record_metric(spark, path: str, event: str, runner: str, at: str, detail: str | None = None) -> None:
    """Append one event as a JSON line."""
    row = spark.createDataFrame([(event, runner, at, detail)], "event string, runner string, timestamp string, detail string")
    row.coalesce(1).write.mode("append").json(path)


def write_inventory(inventory: DataFrame, path: str) -> int:
    """Write (collection, points) in order of name; returns the number of collections, for the count metric."""
    inventory.orderBy("collection").write.mode("overwrite").json(path)
    return inventory.count()


def write_persona(personas: DataFrame, path: str) -> int:
    """Append personas(tier, scope_id, display_name, sections, parents) that are all valid; else nothing is written."""
    wrong = violations(F.col("tier"), F.col("scope_id"), F.col("display_name"), F.col("sections"), F.col("parents"))
    bad = personas.select("scope_id", wrong.alias("v")).filter(F.size("v") > 0).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['scope_id']}: {', '.join(r['v'])}" for r in bad))
    personas.write.mode("append").parquet(path)
    return personas.count()


def composed(existing: Column, level0: Column, level1: Column, tier: Column) -> Column:
    """A harness file's text with its managed block made of the parts that are there, in this order."""
    parts = F.filter(F.array(level0, level1, tier), lambda p: F.coalesce(F.trim(p), F.lit("")) != "")
    return spliced(F.coalesce(existing, F.lit("")), F.array_join(parts, "\n\n"))
