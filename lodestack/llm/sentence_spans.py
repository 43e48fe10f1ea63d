"""Substring dedup by sliding sentence spans.

A sentence ends with a word that ends in . ! or ?, closing quotes and brackets after it aside, or at a line break. One of
more than LONGEST words is cut where its words say so, each piece taken as a sentence: of every LONGEST consecutive words
that begin no sentence, the one of the least hash begins a piece. So no piece is longer, and where a passage is cut hangs
on its own words, but for LONGEST at either side. From every sentence begins one run: the fewest consecutive sentences, at
least RUN of them, that hold at least RUN_WORDS words. Runs are hashed and joined over the whole corpus; the first of equal
runs, by document id and place, stays, and sentences that any other covers are removed.

Two copies of a passage of n words are cut alike from at most its word LONGEST (counted from 0) to at least its word
n - LONGEST. With 2 * LONGEST + RUN_WORDS <= 50 and RUN * LONGEST <= RUN_WORDS, all copies of over 50 words share a run,
whatever stands around them.

Null, empty and blank texts have no sentences. Rows that repeat an id and a text count as one document; of rows that
repeat an id with other texts the one of the least text hash comes first. Rows without an id are left alone and make
nothing else a repeat. Extra columns pass through ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.shared import drop_kept_since, keep, kept_so_far
from lodestack.llm.text import BASE, BASE_INV, BYTE, Words, byte_texts, in_chunks, mix

RUN = 3
RUN_WORDS = 30
LONGEST = 10

#: Closing quotes and brackets, which may follow the stop of a sentence.
CLOSERS = tuple(c.encode() for c in "\"')]}’”“»›")


def _stops(w: Words) -> np.ndarray:
    """Whether each word ends in a stop, closers after it aside."""
    ends = w.ends.copy()
    at = np.arange(len(ends))
    while len(at):
        shorter = np.zeros(len(at), np.int64)
        for c in CLOSERS:
            closes = ends[at] - w.starts[at] > len(c)
            for k, byte in enumerate(reversed(c), 1):
                closes &= w.bytes[ends[at] - k] == byte
            shorter[closes] = len(c)
        ends[at] -= shorter
        at = at[shorter > 0]
    return np.isin(w.bytes[ends - 1], np.frombuffer(b".!?", np.uint8))


def _slid(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of every ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x, have = least(x[:-step], x[step:]), have + step
    return x


def _cuts(hashes: np.ndarray, begins_one: np.ndarray) -> np.ndarray:
    """Whether each word begins a sentence or a piece. Words of equal least hashes all do."""
    if len(hashes) < LONGEST:
        return begins_one
    rank = np.where(begins_one, np.uint64(0), hashes | np.uint64(1))
    edge = np.zeros(LONGEST - 1, np.uint64)
    return begins_one | (_slid(np.concatenate([edge, _slid(rank, LONGEST, np.minimum), edge]), LONGEST, np.maximum) == rank)


class Sentences:
    """begin, end: word range of each sentence; first, last: sentence range of each text."""

    def __init__(self, texts: list[bytes]) -> None:
        self.words = w = Words(texts, BYTE)
        n = len(w.starts)
        breaks = np.concatenate([[0], np.cumsum(w.bytes == 10)])
        begins = np.zeros(0, np.int64)
        if n:
            begins_one = np.ones(n, bool)
            begins_one[1:] = _stops(w)[:-1] | (breaks[w.starts[1:]] > breaks[w.ends[:-1]])
            begins_one[w.first[w.first < w.last]] = True
            begins = np.flatnonzero(_cuts(w.hashes, begins_one))
        self.begin, self.end = begins, np.append(begins[1:], n) if n else begins
        self.first, self.last = np.searchsorted(begins, w.first), np.searchsorted(begins, w.last)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first sentence within the text, sentence after the last, hash) of every run."""
        n = len(self.words.starts)
        k = len(self.begin)
        if not k:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        text = np.repeat(np.arange(len(self.first)), self.last - self.first)
        stop = np.maximum(np.arange(k) + RUN - 1, np.searchsorted(self.end, self.begin + RUN_WORDS))
        fits = stop < self.last[text]
        at, stop, text = np.flatnonzero(fits), stop[fits], text[fits]
        with np.errstate(over="ignore"):
            power = np.full(n + 1, BASE, np.uint64)
            inverse = np.full(n + 1, BASE_INV, np.uint64)
            power[0] = inverse[0] = 1
            power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words.hashes * power[:-1])])
            a, b = self.begin[at], self.end[stop]
            h = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        return text, at - self.first[text], stop + 1 - self.first[text], h


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), byte_texts(batch.column(2))
        for lo, hi in in_chunks(texts):
            text, first, stop, h = Sentences(texts[lo:hi]).runs()
            again = np.ones(len(h), bool)  # the text holds the run before
            order = np.lexsort((first, h, text))
            if len(h):
                again[order[0]] = False
                again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[lo:hi][text]), pa.array(keys[lo:hi][text]), pa.array(first), pa.array(stop), pa.array(again)], ["h", "doc_id", "key", "first", "stop", "again"])


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text) of the rows with an id; key: a hash of the text."""
    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, key, first, stop, first_id): runs that are not the first of their kind; key: hash of the text that holds
    the run; first_id: the document of the first."""
    texts = _keyed(docs)
    runs = texts.mapInArrow(_runs, "h long, doc_id long, key long, first long, stop long, again boolean")
    # a repeat within its own document needs no join; of the others the first document of each run is enough
    places = runs.filter("not again").select("h", "doc_id", "key", "first", "stop")
    least = keep(places.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").select("h", "first_id"), "span-firsts")
    out = places.join(least, "h").filter("doc_id <> first_id").select("doc_id", "key", "first", "stop", "first_id")
    out = out.unionByName(runs.filter("again").select("doc_id", "key", "first", "stop", F.col("doc_id").alias("first_id")))
    # ids of several texts: among those the one of the least key comes first
    several = keep(texts.groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x < y").select("doc_id"), "span-several")
    if several.isEmpty():
        return out
    own = places.join(several, "doc_id", "left_semi")
    least = own.groupBy("h", "doc_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key")).filter("first_key < last_key").select("h", "doc_id", "first_key")
    near = own.join(least, ["h", "doc_id"]).filter("key <> first_key")
    return out.unionByName(near.select("doc_id", "key", "first", "stop", F.col("doc_id").alias("first_id")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, spans) to the columns before them, the text left, numbers of sentences and of those removed."""
    for batch in batches:
        texts, spans = byte_texts(batch.column("text")), batch.column("spans").to_pylist()
        left, n, gone = [], [], []
        for t, own in zip(texts, spans, strict=True):
            s = Sentences([t])
            k = len(s.begin)
            cover = np.zeros(k + 1, np.int64)
            for x in own:
                cover[x["first"]] += 1
                cover[x["stop"]] -= 1
            removed = np.cumsum(cover)[:k] > 0
            edges = np.append(s.words.starts[s.begin], len(t)) if k else np.zeros(1, np.int64)
            left.append((t[: edges[0]] + b"".join(t[edges[i] : edges[i + 1]] for i in np.flatnonzero(~removed))).decode())
            n.append(k)
            gone.append(int(removed.sum()))
        rest = [c for c in batch.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(left, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*rest, "text", "n_sentences", "n_removed"])


def _changed(docs: DataFrame) -> DataFrame:
    mark = kept_so_far()
    by_doc = keep(repeated_runs(docs).groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "stop")).alias("spans"), F.array_sort(F.collect_set("first_id")).alias("first_ids")), "span-cuts")
    drop_kept_since(docs.sparkSession, mark, by_doc)
    rows = by_doc.join(_keyed(docs), ["doc_id", "key"]).select("doc_id", "key", "first_ids", "text", "spans")
    return rows.mapInArrow(_cut, "doc_id long, key long, first_ids array<long>, text string, n_sentences long, n_removed long")


def changed_documents(docs: DataFrame) -> DataFrame:
    """The documents that lose sentences: doc_id, first_ids (documents that hold the first copies), text (what is
    left), n_sentences, n_removed."""
    return _changed(docs).drop("key")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All documents, those of ``changed_documents`` with what is left of their texts."""
    new = _changed(docs).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("text").alias("_text")).dropDuplicates(["_id", "_key"])
    out = docs.join(new, (F.col("doc_id") == F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_key")), "left")
    return out.withColumn("text", F.coalesce("_text", "text")).select(*docs.columns)
