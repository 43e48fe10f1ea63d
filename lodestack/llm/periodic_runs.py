"""Periodic runs of words within documents: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of consecutive words with smallest period q and length of at least max(LEAST, 2 * q) that no
neighbouring word extends. It overlaps itself, moved by q, in length - q >= LEAST / 2 words, so every word of a run lies in
a ``K``-gram, K = LEAST / 2, that its document holds twice. All other words are masked; a run lies whole in one of the
segments between them.

Main and Lorentz's divide and conquer runs level by level over a segment, all blocks of a size at once: a run that crosses
the middle m of a block has words m and m + q, or m - q and m, agree forwards and backwards over at least q words. Such
agreement is measured by galloping over prefix hashes, to the ends of the segment, so runs come out whole. Pairs that a run
already found explains are skipped, so a text of one word repeated costs what any text does. Found runs are verified word
by word; should two different stretches ever have had equal hashes, the segment is done anew with other bases.

Null, empty and blank texts have no words and no run; every row is answered by itself, so repeated rows and ids repeat
their answer; extra columns are not read. A long text stands alone: some 60 bytes for each byte of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestack.llm.text import BYTE, Words, byte_texts, in_chunks, mix, powers

LEAST = 12
K = LEAST // 2
PRIME = (1 << 31) - 1
#: Pairs of a level that are looked at together.
_AT_ONCE = 1 << 18
_GRAM = powers(0xD6E8FEB86659FD93, K)
#: Runs of at least so many words explain pairs of later blocks.
_EXPLAINS = 64


def _reduced(v: np.ndarray) -> np.ndarray:
    """v modulo PRIME, v < 2 ** 63."""
    v = (v & np.uint64(PRIME)) + (v >> np.uint64(31))
    v = (v & np.uint64(PRIME)) + (v >> np.uint64(31))
    return np.where(v >= PRIME, v - np.uint64(PRIME), v)


class _Agreement:
    """How far stretches of a word sequence agree, by two prefix hashes modulo PRIME."""

    def __init__(self, ids: np.ndarray, seed: int) -> None:
        self.n = len(ids)
        value = mix(ids.astype(np.uint64) + np.uint64(seed * 0x1F123BB5 + 1)) % np.uint64(PRIME)
        self.sums, self.powers = [], []
        for k in (1, 2):
            base = pow(3 + 2 * seed + k, 0x5DEECE66 + k, PRIME)
            p = np.ones(self.n + 1, np.uint64)
            done = 1
            while done <= self.n:
                more = min(done, self.n + 1 - done)
                p[done : done + more] = _reduced(p[:more] * np.uint64(pow(base, done, PRIME)))
                done += more
            sums = np.zeros(self.n + 1, np.uint64)
            sums[1:] = np.cumsum(_reduced(value * p[:-1])) % np.uint64(PRIME)
            self.sums.append(sums)
            self.powers.append(p)

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of that size at i and at j > i are equal."""
        out = np.ones(len(i), bool)
        for sums, p in zip(self.sums, self.powers, strict=True):
            a = sums[i + size] + np.uint64(PRIME) - sums[i]
            b = sums[j + size] + np.uint64(PRIME) - sums[j]
            out &= _reduced(_reduced(a) * p[j - i]) == _reduced(b)
        return out

    def reach(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """Words that agree from i and j > i on: forwards with step 1; backwards, ending before i and j, with step -1."""
        most = self.n - j if step > 0 else i.copy()
        known, size = np.zeros(len(i), np.int64), np.ones(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):  # gallop
            s = np.minimum(size[live], most[live] - known[live])
            at = known[live] if step > 0 else -known[live] - s
            ok = self.equal(i[live] + at, j[live] + at, s)
            known[live[ok]] += s[ok]
            size[live[ok]] *= 2
            size[live[~ok]] = s[~ok]
            live = live[ok & (known[live] < most[live])]
        bound = np.minimum(known + size, most)  # the agreement ends before this word, where known < most
        live = np.flatnonzero(bound - known > 1)
        while len(live):  # halve
            s = (bound[live] - known[live]) // 2
            at = known[live] if step > 0 else -known[live] - s
            ok = self.equal(i[live] + at, j[live] + at, s)
            known[live[ok]] += s[ok]
            bound[live[~ok]] = known[live[~ok]] + s[~ok]
            live = live[bound[live] - known[live] > 1]
        return known


def _merged(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), the least period of each stretch."""
    if not len(runs):
        return np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _true(ids: np.ndarray, runs: np.ndarray) -> bool:
    return all(np.array_equal(ids[s : e - q], ids[s + q : e]) for s, e, q in runs.tolist())


def segment_runs(ids: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Rows (start, end, period) of all runs of a sequence of word ids; longest: a bound on their length."""
    for seed in range(1 << 20):
        runs = _main_lorentz(ids, _Agreement(ids, seed), longest or len(ids))
        if _true(ids, runs):
            return runs
    raise RuntimeError("no bases told the words of a segment apart")


def _main_lorentz(ids: np.ndarray, agreement: _Agreement, longest: int) -> np.ndarray:
    n, found = len(ids), np.zeros((0, 3), np.int64)
    over_end, over_period = np.zeros(n, np.int64), np.ones(n, np.int64)  # of a long run over each word
    over_size = np.zeros(n, np.int64)
    half = 8  # a block of 8 words holds no run
    while half < 2 * n:
        wide = min(half, longest // 2)  # of no use: longer periods
        pairs = (n + half - 1) // (2 * half) * wide
        for lo in range(0, pairs, _AT_ONCE):
            t = np.arange(lo, min(pairs, lo + _AT_ONCE), dtype=np.int64)
            mid, p = t // wide * (2 * half) + half, t % wide + 1
            new = []
            for i, j in ((mid, mid + p), (mid - p, mid)):
                inside = np.flatnonzero(j < n)
                a, b = i[inside], j[inside]
                meets = (ids[a] == ids[b]) | ((a > 0) & (ids[a - 1] == ids[b - 1]))
                a, b = a[meets], b[meets]
                q = b - a
                unknown = (b >= over_end[a]) | (q % over_period[a] != 0)
                a, b, q = a[unknown], b[unknown], q[unknown]
                back, on = agreement.reach(a, b, -1), agreement.reach(a, b, 1)
                run = (back + on >= q) & (back + on + q >= LEAST)
                new.append(np.stack([a - back, b + on, q], axis=1)[run])
            fresh = _merged(np.concatenate(new))
            for s, e, q in fresh[fresh[:, 1] - fresh[:, 0] >= _EXPLAINS].tolist():
                if over_size[s] < e - s or over_size[(s + e) // 2] < e - s:
                    longer = over_size[s:e] < e - s
                    over_size[s:e][longer], over_end[s:e][longer], over_period[s:e][longer] = e - s, e, q
            found = _merged(np.concatenate([found, fresh])) if len(fresh) else found
        half *= 2
    return found


def runs_of(hashes: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
    """Rows (start, end, period) of all runs of a sequence of word hashes, by start, then period. doc: the number of each
    word's document, rising; no run reaches over two of them. What survives the mask, of all documents, is one sequence
    for Main-Lorentz, its words told apart by their segments."""
    n = len(hashes)
    if n < LEAST:
        return np.zeros((0, 3), np.int64)
    doc = np.zeros(n, np.int64) if doc is None else doc
    with np.errstate(over="ignore"):
        mixed = mix(hashes)
        grams = mix(doc[: n - K + 1].astype(np.uint64) + np.uint64(1))
        for k in range(K):
            grams += mixed[k : n - K + 1 + k] * _GRAM[k]
    whole = np.flatnonzero(doc[: n - K + 1] == doc[K - 1 :])
    order = whole[np.argsort(grams[whole], kind="stable")]
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(n + 1, np.int8)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    held = np.flatnonzero(twice)
    inside = np.zeros(n, bool)
    for k in range(K):
        inside[held + k] = True
    cut = np.ones(n, bool)
    cut[1:] = ~inside[:-1] | (doc[1:] != doc[:-1])
    begins = np.flatnonzero(inside & cut)
    at = np.flatnonzero(inside)
    segment = np.searchsorted(begins, at, "right") - 1
    at = at[np.bincount(segment, minlength=len(begins))[segment] >= LEAST] if len(at) else at
    if not len(at):
        return np.zeros((0, 3), np.int64)
    segment = np.searchsorted(begins, at, "right") - 1
    with np.errstate(over="ignore"):
        ids = np.unique(mix(mixed[at] + mix(segment.astype(np.uint64))), return_inverse=True)[1]
    runs = segment_runs(ids, int(np.bincount(segment).max()))
    runs = np.stack([at[runs[:, 0]], at[runs[:, 1] - 1] + 1, runs[:, 2]], axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def looped(n: int, doc_id: int | None) -> np.ndarray:
    """The word that stands at each place of a text of n words: itself, or for one document in ten, by a checksum of its
    id, a stretch that repeats from some word on. A document without an id is left as it is."""
    at = np.arange(n)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return at


#: Bytes of a text whose words are made objects all together.
_SPLIT_AT_ONCE = 1 << 22
COLUMNS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _joined_sha256(w: Words, text: bytes, first: int, at: np.ndarray) -> str:
    """Of the words ``at`` of a text whose words begin with number ``first``."""
    if len(text) <= _SPLIT_AT_ONCE:
        words = text.split()
        return hashlib.sha256(b" ".join([words[i] for i in (at - first).tolist()])).hexdigest()
    digest = hashlib.sha256()
    for lo in range(0, len(at), 1 << 16):
        digest.update((b" " if lo else b"") + b" ".join([w.word(i) for i in at[lo : lo + (1 << 16)].tolist()]))
    return digest.hexdigest()


def _answers(batches: Iterator[pa.RecordBatch], loops: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = pa.array(batch.column(0)).to_pylist()
        texts = byte_texts(batch.column(1))
        for lo, hi in in_chunks(texts):
            w = Words(texts[lo:hi], BYTE)
            bounds = list(zip(w.first.tolist(), w.last.tolist(), strict=True))
            at = np.arange(len(w.hashes))
            if loops:
                for k, (a, b) in enumerate(bounds):
                    at[a:b] = a + looped(b - a, names[lo + k])
            every = runs_of(w.hashes[at], w.doc)
            kept = ~dropped(len(at), every)
            of = np.searchsorted(every[:, 0], np.append(w.first, len(at)))
            rows = []
            for k, (a, b) in enumerate(bounds):
                runs = every[of[k] : of[k + 1]] - np.array([a, a, 0])
                size = runs[:, 1] - runs[:, 0]
                best = tuple(x.tolist() for x in runs[np.lexsort((runs[:, 2], runs[:, 0], -size))[0]]) if len(runs) else None
                listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs.tolist())
                longest = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
                rows.append((names[lo + k], b - a, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), _joined_sha256(w, texts[lo + k], a, at[a:b][kept[a:b]])))
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            columns = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], columns)


def periodic_runs(docs: DataFrame, loops: bool = False) -> DataFrame:
    """A row for each document(doc_id, text): its number of runs, the longest one (ties: the least start, then period) and
    digests of all runs and of the words that are left when each run is cut to its first period. loops: for one document
    in ten a stretch of its words is repeated first, as ``looped`` says."""
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(lambda batches: _answers(batches, loops), f"doc_id long, {COLUMNS}")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts = byte_texts(batch.column(1))
        for lo, hi in in_chunks(texts):
            w, runs, left = Words(texts[lo:hi], BYTE), [], []
            for a, b in zip(w.first.tolist(), w.last.tolist(), strict=True):
                of = runs_of(w.hashes[a:b])
                runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in of.tolist()])
                left.append(b" ".join([w.word(i) for i in (a + np.flatnonzero(~dropped(b - a, of))).tolist()]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(runs, kind), pa.array(left)], ["doc_id", "runs", "collapsed"])


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed): every run of each document, and its words, one space between, with each run cut to its
    first period."""
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(_spans, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
