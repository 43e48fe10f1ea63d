"""URL filters by a cascade of Bloom filters.

The keys of a url are its host and parent domains, each with the path's prefixes of the lengths that the rules use; the
universe is every key of the corpus. Level 1 encodes the listed keys, level 2 those keys of the universe that level 1
holds wrongly, level 3 the listed keys that level 2 holds wrongly, and so on until a level holds nothing wrongly. The
first level that lacks a key then answers for every key of the universe exactly, so urls are judged without a join: one
join, of the distinct keys with the list, tells the universe's listed keys when the cascade is built.

Level 1 is sized by the universe: it holds wrongly about as many other keys as are listed, which takes bits in proportion
to the list and to the logarithm of the universe's size; so level 2 is no larger, however large the corpus. Deeper levels
have BITS bits an entry. Levels are built in tasks by ranges of WORDS 64-bit words, merged by bitwise or and sent to the
driver as packed ranges: the bits themselves, not a row for each. They are broadcast while all together stay below
MOST_BITS (32 MB), as for some millions of rules; a longer list is matched by a join on the keys, with the same result.

A null url, or one without ``://``, has an empty host and path and no keys; its verdict is the default. An empty rule list
lets every url have the default. Of equal rules the last listed counts. Rows that repeat, and rows without an id, are
judged each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.shared import drop_kept_since, keep, kept_so_far
from lodestack.llm.text import let, lower_ascii, mix

BITS = 10
HASHES = 5
MOST_BITS = 1 << 28
WORDS = 1 << 12
LEVELS = 60


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every (domain + path prefix) that a rule could have, the longest first."""
    if not lengths:
        return F.array().cast("array<string>")
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda x: x.isNotNull())
    labels = F.split(host, r"\.")
    domains = let(labels, lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), ".")))
    joined = let(prefixes, lambda ps: F.flatten(F.transform(domains, lambda d: F.transform(ps, lambda p: F.concat(d, p)))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(joined, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)))


def _positions(h: np.ndarray, bits: int, level: int) -> np.ndarray:
    """[HASHES, n] bit positions of 64-bit keys."""
    with np.errstate(over="ignore"):
        one, two = mix(h + np.uint64(2 * level + 1)), mix(h ^ np.uint64(0xABCDEF + level)) | np.uint64(1)
        return np.stack([(one + np.uint64(i) * two) % np.uint64(bits) for i in range(HASHES)]).astype(np.int64)


class Level:
    def __init__(self, number: int, bits: int, data: bytes) -> None:
        self.number, self.bits, self.data = number, bits, data

    def has(self, h: np.ndarray) -> np.ndarray:
        at = _positions(h, self.bits, self.number)
        held = np.frombuffer(self.data, np.uint8)
        return (held[at >> 3] >> (at & 7) & 1).all(axis=0)


def listed(levels: list[Level], h: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed: the parity of the first level that lacks it."""
    out, open_ = np.zeros(len(h), bool), np.ones(len(h), bool)
    for level in levels:
        open_ &= level.has(h)
        # a key that all levels so far hold is, for now, what the last of them encodes
        out = np.where(open_, level.number % 2 == 1, out)
    return out


def _build(number: int, bits: int):
    """Keys (h) to (range, bits of the range) where a task sets some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(-(-bits // (64 * WORDS)) * WORDS * 8, np.uint8)
        for batch in batches:
            at = _positions(batch.column(0).to_numpy().view(np.uint64), bits, number).ravel()
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        ranges = held.reshape(-1, WORDS * 8)
        where = np.flatnonzero(ranges.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int64)), pa.array([ranges[i].tobytes() for i in where], pa.binary())], ["at", "part"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, bits) by bitwise or, within a task that has all rows of its ranges."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(part, np.uint8)
            held[at] = own | held[at] if at in held else own
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["at", "part"])


def _still(level: Level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(level.has(batch.column(0).to_numpy().view(np.uint64))))

    return run


def first_bits(n: int, others: int) -> int:
    """Bits of the first level, with n of its own keys, for it to hold about n of the others wrongly."""
    rate = min(0.5, n / max(others, 1))
    return math.ceil(n * max(BITS, HASHES / -math.log1p(-(rate ** (1 / HASHES))))) if n else 0


def cascade(keys: DataFrame, most_bits: int = MOST_BITS) -> list[Level] | None:
    """keys(h, listed): distinct keys of the universe. Levels until one holds nothing wrongly; None if too large."""
    levels: list[Level] = []
    used = 0
    inside, outside = keys.filter("listed").select("h"), keys.filter("not listed").select("h")
    for number in range(1, LEVELS):
        n = inside.count()
        bits = max(64, first_bits(n, outside.count()) if number == 1 else BITS * n)
        used += bits
        if used > most_bits:
            return None
        data = bytearray(-(-bits // (64 * WORDS)) * WORDS * 8)
        for r in inside.mapInArrow(_build(number, bits), "at long, part binary").repartition("at").mapInArrow(_merge, "at long, part binary").collect():  # bits / 8 bytes
            data[r["at"] * WORDS * 8 : (r["at"] + 1) * WORDS * 8] = r["part"]
        level = Level(number, bits, bytes(data))
        levels.append(level)
        wrong = keep(outside.mapInArrow(_still(level), "h long"), "bloom-wrong")
        if wrong.isEmpty():
            return levels
        inside, outside = wrong, inside
    raise RuntimeError("the cascade did not end")


def _first_listed(levels: list[Level]):
    """Of each url's keys, longest first, the first that is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column("keys"), batch.column("hashes")
            flat = keys.flatten()
            sizes = keys.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(batch)), sizes)
            good = np.flatnonzero(listed(levels, hashes.flatten().to_numpy().view(np.uint64)))
            of, first = np.unique(owner[good], return_index=True)
            at = np.full(len(batch), -1)
            at[of] = good[first]
            rule = flat.take(pa.array(at, mask=at < 0)).cast(pa.string())
            rest = [c for c in batch.schema.names if c not in ("keys", "hashes")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), rule], [*rest, "rule"])

    return run


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow", most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row. rules: (host + path prefix, verdict); the longest that fits wins."""
    spark, mark = pages.sparkSession, kept_so_far()
    by_rule = dict(rules)
    lengths = sorted({len(r) - r.find("/") if "/" in r else 0 for r in by_rule})
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    rows = spark.createDataFrame(list(by_rule.items()) or [("", default)], "rule string, verdict string")
    verdicts = F.create_map(*(F.lit(x) for pair in by_rule.items() for x in pair)) if len(by_rule) <= 1000 and by_rule else None
    on = rows.select(F.xxhash64("rule").alias("h")).distinct().withColumn("listed", F.lit(True))
    every = urls.select(F.explode("keys").alias("k")).select(F.xxhash64("k").alias("h")).distinct()
    universe = keep(every.join(on, "h", "left").select("h", F.coalesce("listed", F.lit(False)).alias("listed")), "bloom-keys")
    levels = cascade(universe, most_bits)
    drop_kept_since(spark, mark)
    if levels is not None:
        found = urls.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k))).mapInArrow(_first_listed(levels), "page_id long, host string, path string, rule string")
    else:
        # a row's keys are told apart by its own content, not by a number of the row, which a rerun task could give anew;
        # equal rows find equal rules
        named = urls.select("page_id", "host", "path", "keys").distinct()
        hit = named.select("page_id", "host", "path", F.posexplode("keys").alias("at", "key")).join(rows.select(F.col("rule").alias("key")), "key")
        best = hit.groupBy("page_id", "host", "path").agg(F.min_by("key", "at").alias("rule")).select(F.col("page_id").alias("_id"), F.col("host").alias("_host"), F.col("path").alias("_path"), "rule")
        same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))
        found = urls.join(best, same, "left").select("page_id", "host", "path", "rule")
    if verdicts is not None:
        return found.withColumn("verdict", F.coalesce(F.try_element_at(verdicts, F.coalesce("rule", F.lit(""))), F.lit(default)))
    return found.join(rows, "rule", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
