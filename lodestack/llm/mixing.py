"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a seeded hash, laid end to end and cut into blocks of equal tokens. Golden-ratio
points, mapped through the sources' cumulative shares, name the source of every slot; the r-th slot of a source takes
its block r modulo its number of blocks, so a second pass over a source begins only when the first is complete. A slot's
number is its position in the mix: every prefix of the schedule holds the sources in their shares, but for some slots.
``taken`` tells each document's first and last slot, and ``mix`` gives its rows in the order of their slots. Slots that
the points leave a source short of (discrepancy, some slots at most) close the schedule; points beyond its need are void.

Targets: the total is shared by weight, a target stops at ``max_repeats`` times its source's size and the excess is
shared anew by weight among the others. A source's taken words equal its rounded target. Null text has size 0; a null
source is a source of its own, ordered last; documents of size 0 are never taken. Rows that repeat are documents of
their own. Extra columns are ignored by ``taken`` and carried by ``mix``.

The table of sources has a row a source and is ordered in one task: meant for thousands of sources, not one for each host.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.shared import drop_kept, keep
from lodestack.llm.text import word_count, words_of

BLOCK_TOKENS = 256
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
SEED = 20

#: Sources up to which their table (some 100 bytes a row) is broadcast; beyond, the joins shuffle.
BROADCAST_SOURCES = 10_000
DOCS_A_BUCKET = 2_048
SLOTS_A_CHUNK = 8_192
CELLS = 4_096


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sources(source, source_size, n_docs) with sid (their order), weight and target. One row a source."""
    every = Window.partitionBy()
    ranked = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("sid", F.lit(len(weights)))))
    caps = weighed.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = caps.withColumn(
        "level",
        (F.lit(total_share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    water = level.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(every)["level"])
    return water.select("sid", "source", "source_size", "n_docs", "weight", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


def _with_slots(t: DataFrame, block: int) -> DataFrame:
    """Blocks of a source, words to take, slots that this needs, and the interval of shares."""
    size, quota = F.col("source_size"), F.col("quota")
    t = t.withColumn("quota", F.round("target").cast("long")).withColumn("blocks", F.ceil(size / block).cast("long"))
    passes = F.when(size > 0, F.floor(quota / F.greatest(size, F.lit(1)))).otherwise(0).cast("long")
    t = t.withColumn("slots", (passes * F.col("blocks") + F.ceil((quota - passes * size) / block)).cast("long"))
    upto = F.sum("slots").over(Window.orderBy("sid"))
    whole = F.greatest(F.sum("slots").over(Window.partitionBy()), F.lit(1))
    return t.withColumn("hi", upto / whole).withColumn("lo", (upto - F.col("slots")) / whole)


def golden(slot: Column) -> Column:
    """The golden-ratio point of a slot's number, in 32-bit arithmetic: the sequence begins anew after 2**32 slots."""
    step, half = 2654435769, F.lit((1 << 16) - 1)
    low = slot.bitwiseAND(half) * step
    high = F.shiftleft((F.shiftright(slot, 16).bitwiseAND(half) * step).bitwiseAND(half), 16)
    return ((low + high).bitwiseAND(F.lit((1 << 32) - 1)) + F.lit(0.5)) / F.lit(float(1 << 32))


class Plan:
    """places(doc_id, sid, at, size, key): documents in their shuffled order; sources; slots(sid, block, epoch, taken);
    takes(sid, at, doc_id, epoch, begin, end, first_slot, last_slot): the words of a document that an epoch takes, and the
    slots in which they are. points: the point in [0, 1) of a slot's number."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, max_repeats=MAX_REPEATS, block: int = BLOCK_TOKENS, seed: int = SEED, points: Callable[[Column], Column] = golden) -> None:
        spark: SparkSession = docs.sparkSession
        body = F.coalesce("text", F.lit(""))
        sized = docs.select("doc_id", "source", word_count(body).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "source", body).bitwiseAND(F.lit((1 << 63) - 1)).alias("key"))
        sized = keep(sized, "mix-sizes")
        sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        sources = keep(_with_slots(targets(sums, weights, total_share, max_repeats), block), "mix-sources")
        self.few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
        self.sources = sources
        known = self._small(sources.select("sid", F.col("source").alias("of"), "n_docs"))
        placed = sized.join(known, F.col("source").eqNullSafe(F.col("of")))
        buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / DOCS_A_BUCKET)).cast("long")
        placed = placed.withColumn("bucket", F.shiftright(F.shiftright("key", 32) * buckets, 31))
        firsts = (
            placed.groupBy("sid", "bucket").agg(F.sum("size").alias("held")).withColumn("first", F.coalesce(F.sum("held").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("held")
        )
        inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(firsts, ["sid", "bucket"])
        self.places = keep(placed.select("doc_id", "sid", "key", "size", (F.col("first") + F.col("within")).alias("at")), "mix-places")
        self.slots = self._slots(spark, block, points)
        drop_kept(sized)
        self.takes = self._takes(block)

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def _slots(self, spark: SparkSession, block: int, points: Callable[[Column], Column]) -> DataFrame:
        n = self.sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
        cells = self.sources.filter("slots > 0").select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
        named = spark.range(n).withColumn("point", points(F.col("id"))).withColumn("cell", F.floor(F.col("point") * CELLS)).join(self._small(cells), "cell").filter("point >= lo and point < hi").select("id", "sid", F.floor(F.col("id") / SLOTS_A_CHUNK).alias("chunk"))
        counts = named.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
        firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
        ranked = named.withColumn("k", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("id")) - 1).join(firsts, ["sid", "chunk"]).select("id", "sid", (F.col("first") + F.col("k")).alias("rank"))
        # what discrepancy left open, some slots of a source, closes the schedule
        have = counts.groupBy("sid").agg(F.sum("n").alias("n"))
        closing = self.sources.join(have, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("slots > n").select(F.lit(n).alias("id"), "sid", F.explode(F.sequence(F.col("n"), F.col("slots") - 1)).alias("rank"))
        s = ranked.unionByName(closing).join(self._small(self.sources.select("sid", "blocks", "source_size", "quota", "slots")), "sid").filter("rank < slots")
        s = s.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.pmod("rank", "blocks"))
        left = F.col("quota") - F.col("epoch") * F.col("source_size") - F.col("block") * block
        return s.select("id", "sid", "rank", "epoch", "block", F.least(F.lit(block), F.col("source_size") - F.col("block") * block, left).alias("taken"))

    def _takes(self, block: int) -> DataFrame:
        end = F.col("at") + F.col("size")
        pieces = self.places.filter("size > 0").select("doc_id", "sid", "at", "size", "key", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))).alias("block"))
        begins = F.col("block") * block
        pieces = pieces.withColumn("lo", F.greatest(F.col("at") - begins, F.lit(0))).withColumn("hi", F.least(end - begins, F.lit(block)))
        got = pieces.join(self.slots, ["sid", "block"]).withColumn("hi", F.least("hi", "taken")).filter("hi > lo")
        shift = F.col("block") * block - F.col("at")
        return got.groupBy("sid", "at", "doc_id", "key", "size", "epoch").agg(
            F.min(F.col("lo") + shift).alias("begin"), F.max(F.col("hi") + shift).alias("end"), F.min("id").alias("first_slot"), F.max("id").alias("last_slot")
        )


def taken(docs: DataFrame, **how) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, taken, first_slot and last_slot (null if not taken)."""
    plan = Plan(docs, **how)
    sums = plan.takes.groupBy("sid", "at", "doc_id").agg(F.sum(F.col("end") - F.col("begin")).alias("n"), F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot"))
    sums = sums.withColumnRenamed("doc_id", "id").alias("t")
    out = plan.places.alias("p").join(sums, (F.col("p.sid") == F.col("t.sid")) & (F.col("p.at") == F.col("t.at")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("size") > 0), "left")
    out = out.select("doc_id", F.col("p.sid").alias("sid"), "size", F.coalesce("n", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot")
    return out.join(plan._small(plan.sources.select("sid", "source", "source_size", "target")), "sid").drop("sid")


def mix(docs: DataFrame, seed: int = SEED, position: str | None = None, **how) -> DataFrame:
    """The mixed documents in the order of the schedule: a row for each document and pass that takes it, with the words
    taken as its text, by the first slot that holds some of them; ``position``: a name for a column of that slot.

    A document taken whole keeps its text as it is; one cut by its source's target has its words joined by spaces.
    """
    plan = Plan(docs, seed=seed, **how)
    key = F.xxhash64(F.lit(seed), "doc_id", "source", F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 63) - 1))
    named = plan.takes.select(F.col("key").alias("_key"), F.coalesce("doc_id", F.lit(-1)).alias("_of"), "size", "epoch", "begin", "end", F.col("first_slot").alias("_slot"))
    named = named.withColumnsRenamed({"size": "_size", "epoch": "_epoch", "begin": "_begin", "end": "_end"})
    texts = docs.withColumn("_k", key).withColumn("_id", F.coalesce("doc_id", F.lit(-1)))
    # rows that repeat have a take each: one of them stands for all
    texts = texts.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_id").orderBy("_k"))).filter("_n = 1")
    out = texts.join(named, (F.col("_k") == F.col("_key")) & (F.col("_id") == F.col("_of")))
    whole = (F.col("_begin") == 0) & (F.col("_end") == F.col("_size"))
    part = F.array_join(F.slice(words_of(F.col("text")), F.col("_begin").cast("int") + 1, (F.col("_end") - F.col("_begin")).cast("int")), " ")
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    out = out.orderBy("_slot", "_k", "_id", "_epoch")
    return out.select(*docs.columns, *([F.col("_slot").alias(position)] if position else []))
