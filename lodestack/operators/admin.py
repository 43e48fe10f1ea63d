"""Inventory, placement, scopes, org tree, personas and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks in a collection's name.
PROJECT, ENTERPRISE = "project-", "enterprise-"
#: Memory levels that take part in a recall, with the layers that serve them.
LEVELS = ((2, "Graph", ("graph", "code-graph")), (3, "Vector", ("vector", "keyword")), (4, "File doc store", ("file",)))


def placement(name: Column) -> Column:
    """struct<scope, org_tree_path, needs_override> of a collection's name; null for a blank one."""
    low = F.lower(F.trim(name))
    p, e = low.contains(PROJECT), low.contains(ENTERPRISE)
    after = lambda mark: F.expr("NULL").cast("string") if mark is None else F.substr(F.trim(name), F.locate(mark, low) + len(mark))
    scope = F.when(p & ~e, "project").otherwise("enterprise")
    rest = F.when(p & e, F.trim(name)).when(p, after(PROJECT)).when(e, after(ENTERPRISE)).otherwise(F.trim(name))
    rest = F.regexp_replace(rest, "^[-_]+|[-_]+$", "")
    path = F.concat(F.lit("org/"), scope, F.lit("/"), F.when(rest == "", F.trim(name)).otherwise(rest))
    return F.when(F.trim(name) != "", F.struct(scope.alias("scope"), path.alias("org_tree_path"), (p == e).alias("needs_override")))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of new over those of old by key; a replaced row keeps its old place."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return both.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns), F.coalesce("o.ord", "n.ord").alias("ord"))


def scope_of(role: Column, explicit: Column, repo: Column) -> Column:
    """struct<scope, escalate>: explicit, then by role (orchestrator, architect, developer), then repo, then top."""
    low = F.lower(F.coalesce(role, F.lit("")))
    orchestrates = low.contains("orch") | (low == "top") | low.contains("queen")
    architect, develops = low.contains("architect"), low.contains("dev") | low.contains("engineer")
    home = F.coalesce(F.nullif(repo, F.lit("")), F.lit("top"))
    pair = lambda scope, escalate: F.struct(scope.alias("scope"), escalate.alias("escalate"))
    told = F.nullif(explicit, F.lit(""))
    return F.when(told.isNotNull(), pair(told, low.contains("orch") | architect)).when(orchestrates, pair(F.lit("top"), F.lit(True))).when(architect, pair(home, F.lit(True))).when(develops, pair(home, F.lit(False))).when(F.nullif(repo, F.lit("")).isNotNull(), pair(home, F.lit(False))).otherwise(pair(F.lit("top"), F.lit(True)))


def repo_name(value: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(value, r"^(git@[^:]+:|https?://[^/]+/)", ""), r"(\.git)?/*$", "")
    return F.lower(F.substring_index(plain, "/", -1))


def run_metrics(events: DataFrame) -> DataFrame:
    n = lambda name: F.count_if(F.col("event") == name)
    out = events.agg(n("runner_attempt").alias("attempts"), n("fallback_triggered").alias("fallbacks"), n("runner_success").alias("successes"), n("runner_failure").alias("failures"))
    return out.withColumn("fallback_rate", F.coalesce(F.round(F.try_divide("fallbacks", "attempts"), 6), F.lit(0.0)))


def levels_of(configured: DataFrame) -> DataFrame:
    """(scope, level, label, active) of configured(scope, layer): a row for each scope and level. Layers that no level has
    count for none; a scope that names only such has all its levels inactive."""
    known = F.col("layer").isin(*(x for _, _, served in LEVELS for x in served))
    on = configured.groupBy("scope").agg(F.collect_set(F.when(known, F.col("layer"))).alias("on"))  # as many as there are names of layers
    rows = F.array(*(F.struct(F.lit(i).alias("level"), F.lit(label).alias("label"), F.arrays_overlap(F.array(*map(F.lit, served)), "on").alias("active")) for i, label, served in LEVELS))
    return on.select("scope", F.inline(rows))


def config_report(answers: DataFrame) -> DataFrame:
    """(config, hits, tokens, avg_latency) of recall answers(config, hits, tokens, latency), one an answer; a null latency
    counts in no average."""
    return answers.groupBy("config").agg(F.sum("hits").alias("hits"), F.round(F.sum("tokens"), 4).alias("tokens"), F.round(F.avg("latency"), 4).alias("avg_latency"))


def with_fallback(wanted: DataFrame, stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """For wanted(tier, scope_id): the stored body, else the tier's default; origin tells which."""
    out = wanted.join(stored, ["tier", "scope_id"], "left").join(defaults, "tier", "left")
    return out.select("tier", "scope_id", F.coalesce("body", "default_body").alias("body"), F.when(F.col("body").isNotNull(), "stored").otherwise("default").alias("origin"))


def runner_order(runners: DataFrame, configured: dict[str, int], defaults: dict[str, int]) -> DataFrame:
    """runners(chain, name, priority, ord) with their place in each chain: by the runner's own priority, else the
    configured one, else the default one, unknown names last; equal ones in their given order."""

    def of(values: dict[str, int]) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)).cast("map<string,int>"), F.col("name")) if values else F.lit(None).cast("int")

    ranked = runners.withColumn("effective", F.coalesce("priority", of(configured), of(defaults), F.lit(2**31 - 1)))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("chain").orderBy("effective", "ord")))
