"""Expressions over texts (JVM side) and their numpy counterparts for Arrow batches.

A word is a run of characters other than space and U+0009..U+000D; lower-casing touches A-Z only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MASK = (1 << 64) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+")))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# ---------------------------------------------------------------- numpy side


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


BYTE = _splitmix(256, 11)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers, from 0, of a 64-bit number."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


#: Words of up to so many bytes are hashed together; longer ones, should there be any, one by one.
_LONG_WORD = 1 << 12
_POWERS = powers(BASE, _LONG_WORD)
#: Bytes of words hashed at once: the arrays for it take some 50 bytes each.
_AT_ONCE = 1 << 18


def _hash_of_long(values: np.ndarray) -> np.uint64:
    """Sum of values[k] * BASE**k, by pieces."""
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for lo in range(0, len(values), _LONG_WORD):
            part = values[lo : lo + _LONG_WORD]
            total += (part * _POWERS[: len(part)]).sum() * np.uint64(pow(BASE, lo, 1 << 64))
    return total


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64 bits of each span of bytes: the sum of table[byte] * BASE**place, mixed with the length."""
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint64)
    long = np.flatnonzero(sizes > _LONG_WORD)
    for i in long:
        out[i] = _hash_of_long(table[data[starts[i] : ends[i]]])
    short = np.flatnonzero(sizes <= _LONG_WORD) if len(long) else np.arange(len(starts))
    upto = np.cumsum(sizes[short])
    lo = 0
    while lo < len(short):
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + _AT_ONCE, "right")))
        at, size = starts[short[lo:hi]], sizes[short[lo:hi]]
        first = upto[lo:hi] - size - before
        place = np.arange(upto[hi - 1] - before) - np.repeat(first, size)
        with np.errstate(over="ignore"):
            out[short[lo:hi]] = np.add.reduceat(table[data[np.repeat(at, size) + place]] * _POWERS[place], first)
        lo = hi
    with np.errstate(over="ignore"):
        return mix(out + sizes.astype(np.uint64))


class Words:
    """The words of a list of UTF-8 texts laid end to end, a newline after each.

    starts, ends: byte positions of each word; doc: index of its text; hashes: 64 bits a word;
    first, last: word range of each text. Some 10 bytes for each byte of text, so a long text can stand alone.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray = BYTE, white: np.ndarray = IS_WHITE) -> None:
        self.data = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(self.bytes) + 1, np.int8)
        inside[1:] = ~white[self.bytes]
        step = np.diff(inside)
        del inside
        self.starts, self.ends = self.bounds(np.flatnonzero(step == 1), np.flatnonzero(step == -1))
        del step
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        bounds = np.searchsorted(self.starts, self.begins)
        self.first, self.last = bounds[:-1], bounds[1:]
        self.doc = np.repeat(np.arange(len(texts)), self.last - self.first)
        self.hashes = hash_spans(self.bytes, self.starts, self.ends, table)

    def bounds(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of what is taken as words; here the runs between white space."""
        return starts, ends

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def in_chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, so that working arrays stay small; a longer text stands alone."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield begin, i
            begin, total = i, 0
        total += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)
