"""What happens to hits between search and reader: status filter, layer merge, bundles within a token budget.

Hits carry scope, source and an explicit ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.textops import flight, tokens
from lodestack.operators import merge
from lodestack.operators.lifecycle import visible

BREAK = "<!-- variable part -->"
GRAPH_SCOPE = "code-graph"


def filtered(hits: DataFrame, headers: DataFrame, branch: str | None, all_provisional: bool = False) -> DataFrame:
    """Hits whose source shows to a caller on ``branch``. headers(source, header): first lines of note files; a source
    without one, or with a line that is no header, is shown."""
    seen = hits.join(headers.select("source", flight(F.col("header")).alias("_flight")), "source", "left")
    return seen.filter(visible(F.col("_flight"), branch, all_provisional)).drop("_flight")


def recounted(hits: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, n_hits): hits left of every scope that was asked; the row without a scope has all of them."""
    by_scope = scopes.select("scope").distinct().join(hits.groupBy("scope").agg(F.count(F.lit(1)).alias("n")), "scope", "left")
    return by_scope.rollup("scope").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"))


def with_graph(hits: DataFrame, graph: DataFrame) -> DataFrame:
    """hits(scope, scope_ord, source, score, ord) with graph(source, score, ord) hits in the first scope, which is then
    ordered by score; without graph hits every scope keeps its order; without scopes the graph's own scope is made.
    ``rank`` is the place within the scope, numbered by ranges, as one scope may hold most hits; missing scores are last."""
    first = hits.orderBy("scope_ord").limit(1).select("scope", "scope_ord").collect()
    scope, scope_ord = (first[0]["scope"], first[0]["scope_ord"]) if first else (GRAPH_SCOPE, 0)
    some = not graph.isEmpty()
    late = graph.select(F.lit(scope).alias("scope"), F.lit(scope_ord).alias("scope_ord"), "source", "score", "ord", F.lit(1).alias("late"))
    every = hits.select("scope", "scope_ord", "source", "score", "ord", F.lit(0).alias("late")).unionByName(late)
    by_score = F.when((F.col("scope") == scope) & F.lit(some), F.coalesce("score", F.lit(float("-inf")))).otherwise(F.lit(0.0))
    return merge.numbered(every, [by_score.desc(), F.col("late"), F.col("ord")], "scope").drop("late")


def stable_prefix(scope: Column, shared: Column, role: Column, url: Column) -> Column:
    """A header that is the same, byte by byte, for a scope, shared scope and role, so that prompt caches keep it."""
    given = lambda c, name: F.coalesce(F.nullif(c, F.lit("")), F.lit(name))
    s, t, r, u = given(scope, "?"), given(shared, "top"), given(role, "?"), given(url, "(service)")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("<!-- stable part scope="), s, F.lit(" shared="), t, F.lit(" role="), r, F.lit(" -->")),
        F.lit("Pointers to earlier notes follow the break. Open a file only where its pointer matters."),
        F.concat(F.lit("Scope: "), s, F.lit(". Shared: "), t, F.lit(". Ask at "), u, F.lit("/recall, tell at "), u, F.lit("/remember.")),
    )


def bundles(ranked_hits: DataFrame, group: str, prefix: Column, budget: int, most: int, most_tokens: int) -> DataFrame:
    """For each group the bundle of the largest number of hits, ``most`` at first, whose whole text fits ``most_tokens``
    (with none left it is taken as it is), and its statistics. A group's hits are those already cut to a top list, so all
    numbers from most to 0 are tried at once."""
    tried = ranked_hits.withColumn("most", F.explode(F.sequence(F.lit(most), F.lit(0), F.lit(-1))))
    packed = merge.packed(tried.withColumn("_key", F.struct(F.col(group).alias("g"), F.col("most").alias("most"))), "_key", budget, None)
    packed = packed.select(F.col("_key.g").alias(group), F.col("_key.most").alias("most"), "n_shown", "skipped", "bundle")
    text = F.concat_ws("\n\n", prefix, F.lit(BREAK), "bundle")
    sized = packed.select(group, "most", "n_shown", "skipped", text.alias("text"), tokens(prefix).alias("prefix_tokens"), tokens(F.col("bundle")).alias("delta_tokens"), tokens(text).alias("total_tokens"))
    fits = (F.col("total_tokens") <= most_tokens) | (F.col("most") == 0)
    best = Window.partitionBy(group).orderBy(F.desc("most"))
    return sized.filter(fits).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
