"""Benchmark decontamination by winnowing, built-in functions only.

Training and test texts are cut into k-grams of words; of every window of w consecutive k-grams the smallest hash is
kept as a fingerprint. Both sides choose the same fingerprint for the same k + w - 1 words, so joining fingerprints
finds every shared span of at least that length (10 words here). A joined fingerprint carries the k-gram hashes around
it, and is extended on both sides to the exact shared windows.

An item of fewer than k + w - 1 words, but not none, is one window of its own length, looked up among the documents'
n-grams of that length. Documents first meet the distinct windows of all items; which items hold a window is told once a
document's windows are gathered, so a passage of many items costs a document its windows and, after that, its items.

Null and empty texts have no words. Rows are told apart by id and text: rows that repeat both have equal hits. Items that
repeat an id count as one item; items without an id are ignored. Extra columns of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.text import let, lower_ascii

GRAM = 5
WINDOW = 6
SPAN = GRAM + WINDOW - 1
#: Rows of test fingerprints up to which the test side is broadcast (about 150 bytes a row); beyond, both sides shuffle.
BROADCAST_ROWS = 200_000

#: Bits of the bit array for each hash of the test side, and the most (half a megabyte): beyond, more rows meet the join.
BITS_EACH, MOST_BITS = 16, 1 << 22

BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased words of digits, a-z and characters beyond U+007F."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK), lambda x: x != "")


def grams(words: Column, n: int) -> Column:
    """Hash of each n consecutive words, by position."""
    return F.slice(F.transform(words, lambda x, i: F.xxhash64(x, *(F.get(words, i + j) for j in range(1, n)))), F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def bit_array(hashes: DataFrame) -> Column:
    """The bits of a column ``h`` as an array<long> literal; a power of two of them, BITS_EACH a distinct hash."""
    n = hashes.agg(F.count_distinct("h")).first()[0]
    size = min(MOST_BITS, 64 << max(0, (n * BITS_EACH // 64 - 1).bit_length()))
    slot = F.pmod(F.col("h"), F.lit(size))
    longs = [0] * (size // 64)
    # at most MOST_BITS / 64 rows
    for r in hashes.select(F.floor(slot / 64).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        longs[r["at"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<long>")


def maybe(bits: Column, h: Column) -> Column:
    """Whether a hash may be among those of a bit array; true of all that are."""
    slot = F.pmod(h, F.size(bits).cast("long") * 64)
    return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1


def fingerprints(words: Column, among: Column | None = None) -> Column:
    """array<struct<p, h, around>>: each k-gram that is the smallest of a window, with the hashes from p - 5 to p + 5;
    only those that may be in the bit array ``among``."""

    def chosen(h: Column) -> Column:
        listed = (lambda x: F.lit(True)) if among is None else (lambda x: maybe(among, x))
        smallest = F.slice(F.transform(h, lambda x, i: F.least(x, *(F.get(h, i + j) for j in range(1, WINDOW)))), F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return let(
            smallest,
            lambda m: F.filter(
                F.transform(
                    h,
                    # h[p] is the smallest of some window that holds it if it equals the largest of those windows' smallest
                    lambda x, p: F.when(
                        listed(x) & (x == F.greatest(*(F.get(m, p - j) for j in range(WINDOW)))),
                        F.struct(p.alias("p"), x.alias("h"), F.array(*(F.get(h, p + j) for j in range(1 - WINDOW, WINDOW))).alias("around")),
                    ),
                ),
                lambda s: s.isNotNull(),
            ),
        )

    return let(words, lambda w: let(grams(w, GRAM), chosen))


def _met(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows of items that documents hold, (doc_id, key, n, h, item_around, at): n words at each index of at; and
    the items of each such window, (n, h, item_around, item_id)."""
    test = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), item_words(F.col("text")).alias("w"))
    prints = test.select("item_id", F.explode(fingerprints(F.col("w"))).alias("f")).select(F.lit(SPAN).alias("n"), F.col("f.h").alias("h"), F.col("f.around").alias("item_around"), "item_id")
    short = test.filter((F.size("w") > 0) & (F.size("w") < SPAN))
    lengths = sorted(r[0] for r in short.select(F.size("w")).distinct().collect())  # at most SPAN - 1 values

    train = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col("text")).alias("key"), item_words(F.col("text")).alias("w"))
    found = (
        train.select("doc_id", "key", F.explode(fingerprints(F.col("w"), bit_array(prints))).alias("f"))
        .select("doc_id", "key", F.col("f.p").alias("p"), F.col("f.h").alias("h"), F.col("f.around").alias("around"))
        .join(small(prints.select("n", "h", "item_around").distinct(), broadcast_rows), "h")
    )
    reach = WINDOW - 1
    same = lambda k: F.get("around", k) == F.get("item_around", k)
    at = F.filter(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda k: F.when(same(k) & same(k + reach), F.col("p") - reach + k)), lambda x: x.isNotNull())
    windows = found.select("doc_id", "key", "n", "h", "item_around", at.alias("at")).filter(F.size("at") > 0)
    if not lengths:
        return windows, prints

    # one pass over the documents: the n-grams of all the lengths, told apart by n
    keys = F.array(*(F.when(F.size("w") == n, F.get(grams(F.col("w"), n), F.lit(0))) for n in lengths))
    listed = short.select(F.size("w").alias("n"), F.array_max(keys).alias("h"), F.array().cast("array<bigint>").alias("item_around"), "item_id")
    bits = bit_array(listed)

    def placed(n: int) -> Column:
        every = F.transform(grams(F.col("w"), n), lambda h, i: F.when(maybe(bits, h), F.struct(F.lit(n).alias("n"), i.alias("at"), h.alias("h"))))
        return F.filter(every, lambda s: s.isNotNull())

    every = F.flatten(F.array(*map(placed, lengths)))
    grams_of = train.select("doc_id", "key", F.explode(every).alias("g")).select("doc_id", "key", "g.n", "g.h", F.array("g.at").alias("at"))
    held = grams_of.join(small(listed.select("n", "h", "item_around").distinct(), broadcast_rows), ["n", "h"])
    return windows.unionByName(held), prints.unionByName(listed)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if it has no more rows than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_windows(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, key, item_id, at, n): each occurrence in a document of a window of an item; key: hash of the document's
    text; at: index of the window's first word."""
    windows, holders = _met(docs, items, doc_id, item_id, broadcast_rows)
    return windows.join(small(holders, broadcast_rows), ["n", "h", "item_around"]).select("doc_id", "key", "item_id", F.explode("at").alias("at"), "n")


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, key): documents that hold a window of any item, each once; key: hash of the document's text."""
    return _met(docs, items, doc_id, item_id, broadcast_rows)[0].select("doc_id", "key").distinct()


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row a document: n_words, n_hit (words inside any shared window), n_items, items (their ids, sorted as
    strings) and contaminated."""
    windows, holders = _met(docs, items, doc_id, item_id, broadcast_rows)
    # a document's windows are gathered before their items are told, so items that share a passage do not multiply them
    gathered = windows.groupBy("doc_id", "key").agg(F.collect_set(F.struct("n", "at")).alias("places"), F.collect_set(F.struct("n", "h", "item_around")).alias("met"))
    starts = F.flatten(F.transform("places", lambda x: F.transform(x["at"], lambda at: F.named_struct(F.lit("at"), at, F.lit("n"), x["n"]))))
    covered = F.aggregate(
        F.array_sort(starts),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(a["end"], x["at"]))).alias("n"), F.greatest(a["end"], x["at"] + x["n"]).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    each = gathered.select("doc_id", "key", covered.alias("n_hit"), F.explode("met").alias("m")).select("doc_id", "key", "n_hit", "m.*")
    got = (
        each.join(small(holders, broadcast_rows), ["n", "h", "item_around"])
        .groupBy(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"))
        .agg(F.max("n_hit").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    words = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col("text")).alias("key"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    out = words.join(got, (F.col("key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size(F.coalesce("items", none)), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
