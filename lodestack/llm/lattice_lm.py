"""LM scoring by subword lattice likelihood.

The pieces and their scores are an existing vocabulary file's. The scores weight all segmentations: a piece's probability
is the file's, mixed with the share that expectation-maximisation over all segmentations of the training words gives it
(``FILE_SHARE`` is the file's part, so it stays however large the corpus). Training words are entries of the same unigram
vocabulary beside the pieces: a word's count less an absolute discount; what is discounted goes to the pieces that spell
it. A document's probability is the marginal over every segmentation of its words, whole or spelled, by a forward
recursion in log space; no piece spans a word break, so the recursion runs once for each distinct word of the corpus.
Byte pieces make every text possible. Words of LONG_WORD bytes and more (texts without white space) are parted where no
piece crosses, and run by windows of places: their memory is the word's bytes, and 8 bytes for each byte of a stretch
that has no such places while its pieces are counted.

Distinct words, with their counts in the training documents, are gathered by a shuffle. The HEAVY_WORDS most frequent
are looked up where the documents are read; the rest, few of each document's tokens, meet their documents by a join.

Null, empty and blank texts have the end token alone. Rows that repeat an id are documents of their own; a null id is
like any id whose checksum is null: not held out. With no training documents every count is 0 and the pieces keep the
file's scores. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, inf, log1p

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.shared import drop_kept, keep
from lodestack.llm.text import BASE, BASE_INV, BYTE, BYTE_LOWER, Words, byte_texts, hash_spans, in_chunks, mix, powers

HEAVY_WORDS = 120_000
ROUNDS = 3
#: The part of the pieces' weight that is shared out by the file's scores; the rest by expected counts.
FILE_SHARE = 0.2
CELLS = 1 << 19
#: Words that a task works on together, so that words of one length are many, and their bytes.
GROUP, GROUP_BYTES = 60_000, 32 << 20
#: Bytes of a word from which it is cut where no piece crosses; of a stretch without such cuts from which it goes place by place.
LONG_WORD, LONG_STRETCH = 512, 512
#: Places of a long word looked at together.
PLACES = 1 << 16


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


class Pieces:
    """A vocabulary as byte strings (a leading space for a word's begin) and their log probabilities."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, longest: int) -> None:
        self.keys, self.logp, self.longest = keys, logp, longest

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        """A sentencepiece file; its scores, ranks below zero, start the probabilities by Zipf's law."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                piece, weight = bytes([int(model.id_to_piece(i)[1:-1], 16)]), 1e-6
            elif model.is_control(i) or model.is_unknown(i):
                continue
            else:
                piece, weight = model.id_to_piece(i).replace("▁", " ").encode(), 1 / (10 - model.get_score(i))
            if b" " not in piece[1:]:
                found[piece] = found.get(piece, 0.0) + weight
        keys = np.concatenate([_whole_key(p) for p in found])
        order = np.argsort(keys)
        weights = np.array(list(found.values()))[order]
        return cls(keys[order], np.log(weights / weights.sum()), max(map(len, found)))

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "logp": self.logp, "longest": self.longest}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash's piece, or -1: by a table of the leading bits, and a search where two pieces share those."""
        if not hasattr(self, "table"):
            slot = (self.keys >> np.uint64(44)).astype(np.int64)
            self.table, self.shared = np.zeros(1 << 20, np.int32), np.zeros(1 << 20, bool)
            self.table[slot] = np.arange(len(slot))
            self.shared[slot[1:][slot[1:] == slot[:-1]]] = True  # keys are sorted
        slot = (h >> np.uint64(44)).astype(np.int32)
        at = self.table[slot]
        crowded = self.shared[slot]
        if crowded.any():
            at[crowded] = np.minimum(np.searchsorted(self.keys, h[crowded]), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)


def _sums(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers(BASE, rows.shape[1] + 1), powers(BASE_INV, rows.shape[1] + 1)
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[rows] * power[:-1], axis=1, out=out[:, 1:])
    return out, inverse


def _keys_of(sums: np.ndarray, inverse: np.ndarray, d: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[:, d:] - sums[:, :-d]) * inverse[: sums.shape[1] - d] + np.uint64(d))


def _whole_key(piece: bytes) -> np.ndarray:
    sums, inverse = _sums(np.frombuffer(piece, np.uint8)[None, :])
    return _keys_of(sums, inverse, len(piece))[0]


def _log_sum(parts: np.ndarray) -> np.ndarray:
    top = parts.max(axis=0)
    return top + np.log(np.exp(parts - top).sum(axis=0))


def lattice(rows: np.ndarray, pieces: Pieces, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """For byte strings of one length: log marginals; with weights, also the weighted expected count of each piece."""
    n, length = rows.shape
    sums, inverse = _sums(rows)
    most = min(pieces.longest, length)
    logp = np.append(pieces.logp, -np.inf)  # -1: no piece
    found = [pieces.find(_keys_of(sums, inverse, d)).T for d in range(1, most + 1)]  # found[d-1][i]: piece at i of length d
    logs = [logp[f] for f in found]
    ahead = np.full((length + 1, n), -np.inf)
    ahead[0] = 0
    for j in range(1, length + 1):
        ahead[j] = _log_sum(np.stack([ahead[j - d] + logs[d - 1][j - d] for d in range(1, min(most, j) + 1)]))
    if weights is None:
        return ahead[length], None
    back = np.full((length + 1, n), -np.inf)
    back[length] = 0
    for i in range(length - 1, -1, -1):
        back[i] = _log_sum(np.stack([back[i + d] + logs[d - 1][i] for d in range(1, min(most, length - i) + 1)]))
    which, used = [], []
    for d, (f, p) in enumerate(zip(found, logs, strict=True), 1):
        i, word = np.nonzero(f >= 0)
        which.append(f[i, word])
        used.append(np.exp(ahead[i, word] + p[i, word] + back[i + d, word] - ahead[length, word]) * weights[word])
    return ahead[length], np.bincount(np.concatenate(which), np.concatenate(used), minlength=len(pieces.keys))


def by_length(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pieces: Pieces, before: bytes = b"") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, byte rows) of spans of one length, each after the bytes ``before``, few enough to stay small."""
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    lo, pad = 0, len(before)
    while lo < len(order):
        size = int(ranked[lo]) + pad
        hi = min(int(np.searchsorted(ranked, size - pad, "right")), lo + max(1, CELLS // (size * min(size, pieces.longest))))
        at = order[lo:hi]
        rows = np.empty((len(at), size), np.uint8)
        rows[:, :pad] = np.frombuffer(before, np.uint8)
        rows[:, pad:] = data[starts[at][:, None] + np.arange(size - pad)]
        yield at, rows
        lo = hi


def stretches(data: np.ndarray, pieces: Pieces) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(begins, ends) of the stretches of a byte string between places that no piece crosses, by windows of places. Every
    segmentation has a cut at such a place, so marginals multiply."""
    n, reached, open_at = len(data), 0, 0
    for lo in range(0, n, PLACES):
        hi = min(n, lo + PLACES)
        sums, inverse = _sums(data[None, lo : min(n, hi + pieces.longest - 1)])
        far = np.arange(lo + 1, hi + 1)  # where the longest piece from each place ends; each byte is a piece
        for d in range(2, min(pieces.longest, sums.shape[1] - 1) + 1):
            at = np.flatnonzero(pieces.find(_keys_of(sums, inverse, d)[0, : hi - lo]) >= 0)
            far[at] = lo + at + d
        far = np.maximum(np.maximum.accumulate(far), reached)
        reached = int(far[-1])
        cuts = np.flatnonzero(far == np.arange(lo + 1, hi + 1)) + lo + 1
        if len(cuts):
            yield np.append(open_at, cuts[:-1]), cuts
            open_at = int(cuts[-1])


def _places(data: np.ndarray, lo: int, hi: int, pieces: Pieces) -> list[list[tuple[int, int]]]:
    """(length, piece) of the pieces from each place of data[lo:hi]."""
    sums, inverse = _sums(data[None, lo : min(len(data), hi + pieces.longest - 1)])
    out: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
    for d in range(1, min(pieces.longest, sums.shape[1] - 1) + 1):
        found = pieces.find(_keys_of(sums, inverse, d)[0, : hi - lo])
        at = np.flatnonzero(found >= 0)
        for i, f in zip(at.tolist(), found[at].tolist(), strict=True):
            out[i].append((d, f))
    return out


def _add(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    if x < y:
        x, y = y, x
    return x if y == -inf else x + log1p(exp(y - x))


def place_by_place(data: np.ndarray, pieces: Pieces, counted: np.ndarray | None = None, weight: float = 1.0) -> float:
    """Log marginal of one long byte string, by windows of places; with ``counted``, expected counts are added to it,
    which takes the forward values, 8 bytes a place."""
    n, logp = len(data), pieces.logp.tolist()
    windows = range(0, n, PLACES)
    kept = np.empty(n + 1) if counted is not None else None
    ahead = [0.0] + [-inf] * pieces.longest
    for lo in windows:
        hi = min(n, lo + PLACES)
        ahead += [-inf] * (hi - lo)
        for i, at in enumerate(_places(data, lo, hi, pieces)):
            here = ahead[i]
            for d, f in at:
                ahead[i + d] = _add(ahead[i + d], here + logp[f])
        if kept is not None:
            kept[lo:hi] = ahead[: hi - lo]
        ahead = ahead[hi - lo :]
    total = ahead[0]
    if kept is None:
        return total
    back = [0.0] + [-inf] * pieces.longest  # of the places from hi on
    for lo in reversed(windows):
        hi = min(n, lo + PLACES)
        back = [-inf] * (hi - lo) + back
        forward, used, which = kept[lo:hi].tolist(), [], []
        at = _places(data, lo, hi, pieces)
        for i in range(hi - lo - 1, -1, -1):
            here, rest = -inf, forward[i] - total
            for d, f in at[i]:
                value = back[i + d] + logp[f]
                here = _add(here, value)
                which.append(f)
                used.append(rest + value)
            back[i] = here
        np.add.at(counted, which, np.exp(used) * weight)
        back = back[: pieces.longest + 1]
    return total


def long_word(data: np.ndarray, pieces: Pieces, counted: np.ndarray | None = None) -> float:
    """Log marginal of a word of any length: equal stretches between cuts once, long ones place by place."""
    total = 0.0
    for starts, ends in stretches(data, pieces):
        for i in np.flatnonzero(ends - starts > LONG_STRETCH):
            total += place_by_place(data[starts[i] : ends[i]], pieces, counted)
        short = np.flatnonzero(ends - starts <= LONG_STRETCH)
        _, first, times = np.unique(hash_spans(data, starts[short], ends[short], BYTE), return_index=True, return_counts=True)
        first = short[first]
        for at, rows in by_length(data, starts[first], (ends - starts)[first], pieces):
            logs, used = lattice(rows, pieces, None if counted is None else times[at].astype(float))
            total += float(logs @ times[at])
            if counted is not None:
                counted += used
    return total


def spans_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of binary values and the offsets of each."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), offsets


def marginals(words: pa.Array, pieces: Pieces, counted: np.ndarray | None = None) -> np.ndarray:
    """Log marginal of each word after a space; expected counts are added to ``counted``."""
    data, offsets = spans_of(words)
    sizes, out = np.diff(offsets), np.empty(len(words))
    short = np.flatnonzero(sizes < LONG_WORD)
    for at, rows in by_length(data, offsets[short], sizes[short], pieces, b" "):
        out[short[at]], used = lattice(rows, pieces, None if counted is None else np.ones(len(at)))
        if counted is not None:
            counted += used
    for i in np.flatnonzero(sizes >= LONG_WORD):
        out[i] = long_word(np.append(np.uint8(32), data[offsets[i] : offsets[i + 1]]), pieces, counted)
    return out


def grouped(batches: Iterator[pa.RecordBatch], most: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``most`` rows or GROUP_BYTES, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= most or sum(b.nbytes for b in held) >= GROUP_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(learn, text) to (word, n in training texts, n in all), summed by piece of a batch."""
    for batch in batches:
        learn, texts = batch.column(0).to_numpy(zero_copy_only=False), byte_texts(batch.column(1))
        for lo, hi in in_chunks(texts, 2 << 20):
            w = Words(texts[lo:hi], BYTE_LOWER)
            if not len(w.hashes):
                continue
            _, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            every = np.bincount(inverse)
            trained = np.bincount(inverse, learn[lo:hi][w.doc].astype(float)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([w.word(i).lower() for i in first], pa.binary()), pa.array(trained), pa.array(every)], ["word", "c", "n"])


def _expect(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(pieces.keys))
        for batch in grouped(batches):
            marginals(batch.column(0), pieces, sums)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(sums[seen])], ["piece", "n"])

    return run


def _marginals(pieces: Pieces, discount: float, total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches):
            whole = np.maximum(batch.column(1).to_numpy() - discount, 0) / total
            with np.errstate(divide="ignore"):
                out = np.logaddexp(np.log(whole), marginals(batch.column(0), pieces))
            data, offsets = spans_of(batch.column(0))
            keys = hash_spans(data, offsets[:-1], offsets[1:], BYTE)  # as Words has it: words are lower-cased
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.columns[1:], pa.array(out)], ["h", "c", "n", "logp"])

    return run


def train(words: DataFrame, ends: int, pieces: Pieces, rounds: int = ROUNDS) -> tuple[Pieces, float, float, float]:
    """From words(word, c): the pieces with new probabilities, the discount of a word's count, the sum of all counts of
    the vocabulary, and the end token's log probability."""
    known = words.select("word", "c").filter("c > 0")
    one, two, distinct, tokens = known.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    discount = min(0.9, max(0.1, one / (one + 2 * two))) if one + two else 0.5
    total, by_file = 1.0, np.exp(pieces.logp)
    for _ in range(rounds if distinct else 0):
        counts = np.zeros(len(pieces.keys))
        for r in known.select("word").mapInArrow(_expect(pieces), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
            counts[r["piece"]] += discount * r["n"]
        counts = (1 - FILE_SHARE) * counts + FILE_SHARE * counts.sum() * by_file
        total = tokens - discount * distinct + counts.sum() + ends
        pieces = Pieces(pieces.keys, np.log(counts / total), pieces.longest)
    return pieces, discount, total, float(np.log(max(ends, 0.1) / max(total, 1.0)))


def _score(keys: np.ndarray, c: np.ndarray, logp: np.ndarray):
    """Rows (row, doc_id, held, n, known, base, score) of documents, and (row, h, n) of words not among the keys."""
    log_c, known = np.append(np.log10(c + 1.0), 0), np.append(c > 0, False).astype(float)
    logp = np.append(logp, 0)
    names = ["row", "doc_id", "held", "n", "known", "base", "score", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = byte_texts(batch.column(2))
            for lo, hi in in_chunks(texts):
                w, k = Words(texts[lo:hi], BYTE_LOWER), hi - lo
                at = np.minimum(np.searchsorted(keys, w.hashes), max(0, len(keys) - 1))
                at = np.where(keys[at] == w.hashes, at, len(c)) if len(keys) else np.full(len(w.hashes), len(c))
                rows = np.arange(row, row + k)
                row += k
                sums = [np.bincount(w.doc, x[at], k).astype(float) for x in (known, log_c, logp)]
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0).slice(lo, k), batch.column(1).slice(lo, k), pa.array(w.last - w.first), *map(pa.array, sums), none], names)
                rest = at == len(c)
                pair = np.stack([w.doc[rest].astype(np.uint64), w.hashes[rest]])
                by = np.lexsort(pair)
                pair = pair[:, by]
                begins = np.flatnonzero(np.append(True, (pair[:, 1:] != pair[:, :-1]).any(axis=0))) if pair.shape[1] else np.zeros(0, np.int64)
                m = len(begins)
                times = np.diff(np.append(begins, pair.shape[1]))
                empty = pa.nulls(m, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[pair[0, begins].astype(np.int64)]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.array(times), empty, empty, empty, pa.array(pair[1, begins].view(np.int64))], names
                )

    return run


def _most_frequent(words: DataFrame, most: int) -> DataFrame:
    """At most so many of the words of highest n: those above a threshold, found from counts by magnitude."""
    step = F.floor(F.log2("n") * 16)
    left, least = most, None
    for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():  # 16 rows a doubling
        left -= r["words"]
        if left < 0:
            break
        least = r["least"]
    return words.select("h", "c", "logp").filter(F.lit(False) if least is None else F.col("n") >= least)


def score(docs: DataFrame, vocabulary: str, parts: int = 7, part: int = 2) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    vocabulary: path of a sentencepiece file on the driver. Documents whose checksum modulo ``parts`` is ``part`` are
    held out of all learning. base_score is the add-one unigram model's.
    """
    held = held_out(F.col("doc_id"), parts, part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), "text")
    words = keep(texts.select(~F.col("held"), "text").mapInArrow(_gather, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-words")
    ends = texts.filter(~F.col("held")).count()
    c, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = c + ends, v + (ends > 0)
    pieces, discount, mass, end = train(words, ends, Pieces.from_file(vocabulary))
    scored = keep(words.mapInArrow(_marginals(pieces, discount, mass), "h long, c long, n long, logp double"), "lm-scored")
    heavy = _most_frequent(scored, HEAVY_WORDS).toPandas()
    drop_kept(words)
    keys = heavy["h"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(keys)
    parts_of = keep(
        texts.mapInArrow(_score(keys[by], heavy["c"].to_numpy(np.int64)[by], heavy["logp"].to_numpy(float)[by]), "row long, doc_id long, held boolean, n long, known double, base double, score double, h long"), "lm-parts"
    )
    rest = parts_of.filter("h is not null").select("row", "h", F.col("n").alias("times")).join(scored.select("h", "c", "logp"), "h")
    rest = rest.select("row", (F.col("times") * (F.col("c") > 0).cast("int")).cast("double").alias("known"), (F.col("times") * F.log10(F.col("c") + 1.0)).alias("base"), (F.col("times") * F.col("logp")).alias("score"))
    whole = parts_of.filter("h is null").select("row", "doc_id", "held", "n", "known", "base", "score")
    sums = whole.unionByName(rest, allowMissingColumns=True).groupBy("row").agg(*(F.max(x).alias(x) for x in ("doc_id", "held", "n")), *(F.sum(x).alias(x) for x in ("known", "base", "score")))
    n = F.col("n") + 1
    return sums.select(
        "doc_id",
        F.col("held").alias("held_out"),
        n.alias("n_tokens"),
        (F.round("known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + 1)) - n * float(np.log10(total + distinct + 1))).alias("base_score"),
        ((F.col("score") + end) / float(np.log(10))).alias("score"),
    )
