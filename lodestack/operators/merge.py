"""Merging hit lists: hybrid merge, parallel dedupe, order by source, ranking and packing into a token budget.

Hits carry an explicit ``ord``; no result depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.textops import excerpt, tokens
from lodestack.sources.shared import cut

#: Rank of a layer, the lower the earlier; any other layer ranks as file.
LAYER_RANK = {"meta": 0, "enterprise": 1, "project": 2, "vector": 3, "file": 4}


def hybrid(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Full outer merge of (scope, source, chunk, score, ord) with (scope, source, chunk, ord): match_type semantic,
    keyword or both; vector hits first, in their order, then keyword hits."""
    v, k = vector.alias("v"), keyword.alias("k")
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("scope", "source", "chunk")]
    both = v.join(k, same[0] & same[1] & same[2], "full_outer")
    kind = F.when(F.col("k.ord").isNull(), "semantic").when(F.col("v.ord").isNull(), "keyword").otherwise("both")
    out = both.select(*(F.coalesce(f"v.{c}", f"k.{c}").alias(c) for c in ("scope", "source", "chunk")), F.col("v.score").alias("score"), kind.alias("match_type"), F.col("v.ord").isNull().cast("int").alias("late"), F.coalesce("v.ord", "k.ord").alias("o"))
    return numbered(out, [F.col("late"), F.col("o")], "scope").drop("late", "o")


def dedupe(hits: DataFrame) -> DataFrame:
    """Of hits of the same (source, chunk) the first by ord stays; the other layers that found it are listed."""
    key = Window.partitionBy("source", "chunk")
    out = hits.withColumn("n", F.row_number().over(key.orderBy("ord"))).withColumn("layers", F.collect_set("layer").over(key))
    return out.filter("n = 1").select("source", "chunk", "layer", "ord", F.array_join(F.array_sort(F.array_except("layers", F.array("layer"))), ",").alias("also_matched"))


def numbered(df: DataFrame, order: list[Column], within: str | None = None) -> DataFrame:
    """``df`` with ``rank``, from 1, in one order over all rows, or over those of each value of a column. Rows are dealt by
    ranges of the order and numbered within them, so no task has them all, nor all of a frequent value; the ranges are
    written once, as their bounds come from a sample."""
    keys = [within] if within else []
    placed = cut(df.repartitionByRange(*map(F.col, keys), *order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("n"))  # a row a range, and one more where a value ends in it
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_range").alias("_r"), *(F.col(k).alias("_k") for k in keys), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    numbers = placed.withColumn("_own", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_k"))
    return numbers.join(before, same).withColumn("rank", (F.col("_before") + F.col("_own")).cast("int")).select(*df.columns, "rank")


def by_source(hits: DataFrame) -> DataFrame:
    """Order of first appearance of the source, then chunk (none as 0), then ord: as column ``rank``."""
    firsts = hits.groupBy("source").agg(F.min("ord").alias("_first"))
    return numbered(hits.join(firsts, "source"), [F.col("_first"), F.coalesce("chunk", F.lit(0)), F.col("ord")]).select(*hits.columns, "rank")


def layer_rank(layer: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for pair in LAYER_RANK.items() for x in pair))
    return F.coalesce(F.try_element_at(ranks, F.lower(F.coalesce(layer, F.lit("")))), F.lit(4))


def ranked(hits: DataFrame, within: str | None = None, collation: str | None = None) -> DataFrame:
    """Layer, then keyword matches, then score, then source and chunk: these by code points, or by a collation, as UNICODE,
    in which accents and case come after letters; texts equal in it go by code points. ``within``: rank each group by
    itself, as for hits already cut to a top list."""
    name = F.concat_ws("\u0000", F.coalesce("source", F.lit("")), F.coalesce(F.col("chunk").cast("string"), F.lit("")))
    if collation:
        hits, name = in_collation(hits, name, collation)
        out = ranked_by(hits, name, within)
        return out.drop("_key")
    return ranked_by(hits, [name], within)


def in_collation(df: DataFrame, text: Column, collation: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with a key, and an order by that key, in which texts sort as the collation has them."""
    keyed = df.withColumn("_key", text)
    return keyed, [F.collate("_key", collation), F.col("_key")]


def ranked_by(hits: DataFrame, name: list[Column], within: str | None) -> DataFrame:
    order = [layer_rank(F.col("layer")), (F.coalesce("match_type", F.lit("")) != "keyword").cast("int"), F.coalesce("score", F.lit(0.0)).desc(), *name]
    if within is None:
        return numbered(hits, order)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy(*order)))


def rendered(hit: Column, index: Column) -> Column:
    """A hit as text, numbered from 1."""
    trust = F.when(hit["match_type"] == "keyword", "keyword-exact").when(hit["score"].isNotNull(), F.concat(F.lit("score "), F.format_string("%.2f", hit["score"]))).otherwise("score ?")
    head = F.concat((index + 1).cast("string"), F.lit(". ["), hit["layer"], F.lit(" · "), trust, F.lit("] "), F.coalesce(hit["source"], F.lit("(unknown)")), F.when(hit["chunk"].isNotNull(), F.concat(F.lit(" chunk "), hit["chunk"].cast("string"))).otherwise(""))
    ex = excerpt(hit["text"])
    return F.concat(head, F.when(ex != "", F.concat(F.lit("\n   > "), ex)).otherwise(""))


def packed(ranked_hits: DataFrame, group: str, budget: int, most: int | None) -> DataFrame:
    """Greedy packing by rank for each group: the first hit always fits, one over the budget is skipped, later smaller
    ones may still fit, no more than ``most`` are shown (None: as many as the key's own field ``most`` says). A group's
    hits are those already cut to a top list."""
    limit = F.col(f"{group}.most") if most is None else F.lit(most)
    hits = ranked_hits.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "layer", "match_type", "score", "source", "chunk", "text"))).alias("hits"))
    start = F.struct(F.array().cast("array<string>").alias("shown"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("skipped"))

    def step(a: Column, h: Column) -> Column:
        text = rendered(h, F.size(a["shown"]))
        full = F.size(a["shown"]) >= limit
        over = (a["used"] > 0) & (a["used"] + tokens(text) > budget)
        return F.when(full, a).when(over, F.struct(a["shown"].alias("shown"), a["used"].alias("used"), (a["skipped"] + 1).alias("skipped"))).otherwise(F.struct(F.concat(a["shown"], F.array(text)).alias("shown"), (a["used"] + tokens(text)).alias("used"), a["skipped"].alias("skipped")))

    return hits.select(group, F.aggregate("hits", start, step).alias("p")).select(group, F.size("p.shown").alias("n_shown"), F.col("p.used").alias("tokens"), F.col("p.skipped").alias("skipped"), F.array_join("p.shown", "\n").alias("bundle"))
