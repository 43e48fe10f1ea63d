"""Literal search by an n-gram index: posting lists of trigrams by text, the rarest ones intersected, candidates verified.

A gram is three consecutive bytes of the UTF-8 text, as one number under 2 ** 24: a literal is in a text only if all its
grams are. An index is a folder: ``postings`` (gram, doc_id), in runs that are each in the order of both, so that a search's
scan skips all pages but those of its grams and a frequent gram is spread over many files. A run has the texts of one task,
up to some millions of rows; it is written where it is made, so that postings, which are many times the texts' words, are
neither shuffled nor sorted over all. ``grams`` (gram, n), the lengths of the lists; ``texts``, in the order of doc_id, in small row groups, so that only those of candidates are read. Literals of
under three bytes, which have no gram, scan the texts. Every literal's result is that of a scan.

Null texts hold nothing and are not filed. With ignore_case the index holds the grams of the lower-cased texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.search import any_literal
from lodestack.sources.shared import cut

GRAM = 3
#: Posting lists that are intersected: more are rarely worth their reading.
RAREST = 8
#: Candidates up to which their ids go into the scan of the texts as a filter, and up to which they are sent to it; of more,
#: a join would shuffle all texts, so all are scanned.
PUSHED = 10_000
SENT = 1_000_000
ROW_GROUP = 8 << 20
PAGE = 64 << 10
#: Postings of a run, of a text more at most.
RUN = 4_000_000


def grams_of(text: bytes) -> np.ndarray:
    """The distinct grams of a text, in order."""
    b = np.frombuffer(text, np.uint8).astype(np.int32)
    if len(b) < GRAM:
        return np.zeros(0, np.int32)
    every = np.sort((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])
    return every[np.concatenate(([True], every[1:] != every[:-1]))]


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of postings of (doc_id, text as bytes). A posting is sorted as one number: its gram, then its text's place."""
    grams: list[np.ndarray] = []
    ids: list[int] = []
    held = 0

    def run() -> Iterator[pa.RecordBatch]:
        own = np.array(ids, np.int64)
        order = np.argsort(own, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        packed = np.concatenate([g.astype(np.int64) << 32 | p for g, p in zip(grams, place, strict=True)])
        packed.sort()
        own = own[order]
        for at in range(0, len(packed), 500_000):
            part = packed[at : at + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array((part >> 32).astype(np.int32)), pa.array(own[part & 0xFFFFFFFF])], ["gram", "doc_id"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = grams_of(text.as_buffer())
            if len(found):
                grams.append(found)
                ids.append(doc_id)
                held += len(found)
            if held >= RUN:
                yield from run()
                grams, ids, held = [], [], 0
    if held:
        yield from run()


def build(files: DataFrame, path: str, ignore_case: bool = False) -> None:
    """Index files(doc_id, text, ...), whose ids are their own, in a new folder."""
    spark = files.sparkSession
    held = files.filter("doc_id is not null and text is not null")
    small = {"parquet.block.size": str(ROW_GROUP)}
    held.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.options(**small).parquet(f"{path}/texts")
    stored = spark.read.parquet(f"{path}/texts").select("doc_id", (F.lower("text") if ignore_case else F.col("text")).cast("binary").alias("text"))
    stored.mapInArrow(_posted, "gram int, doc_id long").write.options(**small, **{"parquet.page.size": str(PAGE)}).parquet(f"{path}/postings")
    postings(spark, path).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram int, doc_id long").parquet(f"{path}/postings")


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/texts")


def rarest(spark: SparkSession, path: str, literal: str) -> list[int] | None:
    """The grams of a literal with the shortest lists; none if it is too short to have any; None if a gram is in no text."""
    wanted = grams_of(literal.encode()).tolist()
    if not wanted:
        return []
    found = spark.read.schema("gram int, n long").parquet(f"{path}/grams").filter(F.col("gram").isin(wanted)).collect()  # as many rows as the literal has grams
    if len(found) < len(wanted):
        return None
    return [r.gram for r in sorted(found, key=lambda r: (r.n, r.gram))[:RAREST]]


def candidates(spark: SparkSession, path: str, grams: list[int]) -> DataFrame:
    """doc_id of the texts that hold all of some grams."""
    held = postings(spark, path).filter(F.col("gram").isin(grams))
    return held.groupBy("doc_id").count().filter(F.col("count") == len(grams)).select("doc_id")


def search(spark: SparkSession, path: str, literals: list[str], ignore_case: bool = False) -> DataFrame:
    """Lines that hold one of some literals, as ``search.any_literal`` finds them. ignore_case: as the index was built."""
    every, chosen = texts(spark, path), None
    for literal in literals:
        grams = rarest(spark, path, literal.lower() if ignore_case else literal)
        if grams == []:  # this literal has to scan, so all do
            return any_literal(every, literals, ignore_case)
        if grams is not None:
            own = candidates(spark, path, grams)
            chosen = own if chosen is None else chosen.unionByName(own)
    if chosen is None:
        return any_literal(every.filter("false"), literals, ignore_case)
    chosen = cut(chosen.distinct(), "candidates")  # asked twice below
    few = [r.doc_id for r in chosen.limit(PUSHED + 1).collect()]
    if len(few) <= PUSHED:
        near = every.filter(F.col("doc_id").isin(few))
    else:
        near = every.join(F.broadcast(chosen), "doc_id", "left_semi") if chosen.count() <= SENT else every
    return any_literal(near, literals, ignore_case)
