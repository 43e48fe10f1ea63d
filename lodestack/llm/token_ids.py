"""Token ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their frequency rank in the whole corpus, so the 256 most frequent take one data byte. Two control
bits an id give its number of data bytes (1 to 4); control bytes and data bytes are kept apart, and a table of all 256
control bytes decodes four ids at a time.

A dataset is a folder: ``segments`` (Parquet, one row a run of documents: file, segment, start within the file, the
documents' ids and lengths, control bytes, data bytes) in ascending doc_id order over the files, and ``ranks`` (rank,
id). Spark's writer commits it, so a lost task leaves nothing behind and is run again.

Null and empty texts give the end id alone. Rows that repeat an id are documents of their own, ordered by a hash of the
text and the text; null ids come first. Files are cut by range of (id, hash of text), so one id may fill several. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.shared import keep
from lodestack.llm.text import BYTE_LOWER, IS_WHITE, Words, byte_texts, in_chunks

END_ID = 1
#: Bytes of text a segment is cut at.
SEGMENT_BYTES = 2 << 20
#: Tasks of about so many bytes of text, but not more than so many tasks; a task's files hold so many segments at most.
BYTES_A_TASK, MOST_TASKS, SEGMENTS_A_FILE = 32 << 20, 20_000, 64
#: Words whose ids a worker remembers before it starts anew; it bounds memory and changes no result.
REMEMBERED = 2_000_000

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.concatenate([size - 1, np.zeros(-len(v) % 4, np.uint8)]).reshape(-1, 4).astype(np.uint8)
    control = padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6
    held = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[held].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by look-up of the control bytes."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


class Tokens:
    """Ids of whole texts, by a memory of the ids of words.

    The tokenizer drops white space, folds case and splits letters from punctuation before it merges, so a text's ids
    are its words' ids in order; a final full stop or comma after an ASCII letter is a word of its own. Words that may
    hold a special token are never folded. The memory is sorted arrays: some 20 bytes a word.
    """

    MARK, GROUP = "|", 200

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint16)

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, where each word's begin and how many it has. Words are encoded in groups with a mark between
        them; those that hold the mark themselves, and groups that do not come apart as they should, one by one."""
        alone = [i for i, w in enumerate(words) if self.MARK in w]
        together = np.delete(np.arange(len(words)), alone)
        groups = [together[i : i + self.GROUP] for i in range(0, len(together), self.GROUP)]
        at, size, flat, used = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32), [], 0
        for group, got in zip(groups, self._encode([f" {self.MARK} ".join([words[i] for i in g]) for g in groups]), strict=True):
            marks = np.flatnonzero(got == self.mark)
            if len(marks) != len(group) - 1:
                alone += group.tolist()
                continue
            at[group] = used + np.append(0, marks + 1)
            size[group] = np.append(marks, len(got)) - np.append(0, marks + 1)
            flat.append(got)
            used += len(got)
        for i, got in zip(alone, self._encode([words[i] for i in alone]), strict=True):
            at[i], size[i] = used, len(got)
            flat.append(got)
            used += len(got)
        return np.concatenate(flat), at, size

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        flat, at, size = self._ids_of(words)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at + np.int32(len(self.flat))), np.insert(self.size, where, size)
        self.flat = np.concatenate([self.flat, flat])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by END_ID; and how many each text has."""
        w = _Parts(texts)
        if not len(w.hashes):
            return np.full(len(texts), END_ID, np.uint16), np.ones(len(texts), np.int64)
        keys, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        new = np.arange(len(keys)) if not len(self.keys) else np.flatnonzero(self.keys[self._slots(keys)] != keys)
        if len(new):
            self._learn(keys[new], [w.word(i).decode() for i in first[new]])
        slot = self._slots(keys)[inverse]
        size, at = self.size[slot], self.at[slot]
        ends = np.cumsum(size, dtype=np.int64)
        flat = self.flat[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])
        return np.insert(flat, upto[w.last], END_ID), upto[w.last] - upto[w.first] + 1


class _Parts(Words):
    def __init__(self, texts: list[bytes]) -> None:
        super().__init__(texts, BYTE_LOWER)
        b = self.bytes
        bar = np.flatnonzero((b[:-1] == 60) & (b[1:] == 124))  # "<|"
        for i in np.unique(np.searchsorted(self.starts, bar, "right") - 1):  # few: by the bytes as they are
            self.hashes[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8).digest(), "little"))

    def bounds(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = self.bytes
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        mark = np.flatnonzero((b == 46) | (b == 44))
        mark = mark[(mark > 0) & (mark < len(b) - 1)]
        cut = mark[letter[b[mark - 1]] & IS_WHITE[b[mark + 1]]]
        return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


_tokens: dict[str, Tokens] = {}


def _tokens_of(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums = _tokens_of(path), np.zeros(1 << 16, np.int64)
        for batch in batches:
            texts = byte_texts(batch.column(0))
            for lo, hi in in_chunks(texts, SEGMENT_BYTES):
                sums += np.bincount(tokens.ids(texts[lo:hi])[0], minlength=1 << 16)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(sums[seen])], ["id", "n"])

    return run


def _write(path: str, rank_of: np.ndarray):
    schema = pa.schema([("file", pa.int64()), ("segment", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, file = _tokens_of(path), TaskContext.get().partitionId()
        segment = start = 0
        for batch in batches:
            ids, texts = batch.column(0), byte_texts(batch.column(1))
            for lo, hi in in_chunks(texts, SEGMENT_BYTES):
                flat, n = tokens.ids(texts[lo:hi])
                control, data = encode(rank_of[flat])
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([segment]), pa.array([start]), pa.array([ids.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], schema=schema)
                segment, start = segment + 1, start + len(flat)

    return run


def _read(id_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["lengths"], np.int64)
                ids = id_of[decode(row["control"], row["data"], int(n.sum()))].astype("<u4")
                ends = np.cumsum(n)
                starts = ends - n
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([row["file"]] * len(n), pa.int64()), pa.array(row["start"] + starts), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "file", "start", "n_tokens", "ids_crc32"])

    return run


def write_dataset(docs: DataFrame, tokenizer: str, n_tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the ids of all documents; returns (segments, ranks) as read back.

    tokenizer: path of a tokenizers file that drops white space and folds case, present on every worker.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranks = keep(
        texts.select("text").mapInArrow(_count(tokenizer), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id", "n"), "ids-ranks"
    )
    listed = ranks.select("rank", "id").collect()  # no more rows than the vocabulary has ids
    rank_of = np.zeros(1 << 16, np.uint32)
    for rank, i in listed:
        rank_of[i] = rank
    if n_tasks is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_tasks = min(MOST_TASKS, max(1, -(-size // BYTES_A_TASK)))
    place = F.col("doc_id").asc_nulls_first(), F.col("key").asc()
    ordered = texts.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))).repartitionByRange(int(n_tasks), *place).sortWithinPartitions(*place, "text")
    segments = ordered.select("doc_id", "text").mapInArrow(_write(tokenizer, rank_of), "file long, segment long, start long, doc_ids array<long>, lengths array<long>, control binary, data binary")
    segments = keep(segments, "ids-segments", SEGMENTS_A_FILE)
    return segments, ranks


def read_dataset(segments: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, decoded from the files."""
    listed = ranks.select("rank", "id").collect()
    id_of = np.zeros(max(1, len(listed)), np.uint32)
    for rank, i in listed:
        id_of[rank] = i
    docs = segments.mapInArrow(_read(id_of), "doc_id long, file long, start long, n_tokens long, ids_crc32 long")
    held = segments.groupBy("file").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = held.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(before, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
