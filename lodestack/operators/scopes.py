"""Scopes, collections and personas: guarded writes and validation, as plans over small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.textops import tag

#: Forms of names and tiers of personas.
SCOPE_NAME = "^[a-z0-9][a-z0-9_-]*$"
COLLECTION_NAME = "^[A-Za-z0-9][A-Za-z0-9_.-]*$"
TIERS = ("meta", "enterprise", "project")


def add_scope(scopes: DataFrame, name: str, collection: str, ladder: list[str]) -> DataFrame:
    """scopes(scope, collection, ladder) with one more. The same mapping again changes nothing; a name that maps to
    another collection, a malformed name or a ladder of unknown scopes is refused."""
    spark = scopes.sparkSession
    new = spark.createDataFrame([(name, collection, ladder)], "scope string, collection string, ladder array<string>")
    if new.filter(F.col("scope").rlike(SCOPE_NAME) & F.col("collection").rlike(COLLECTION_NAME)).isEmpty():
        raise ValueError(f"400: malformed scope or collection name: {name!r}, {collection!r}")
    held = scopes.filter(F.col("scope") == name).limit(1).collect()
    if held:
        if held[0]["collection"] != collection:
            raise ValueError(f"409: {name} is mapped to {held[0]['collection']}")
        return scopes
    unknown = new.select(F.explode("ladder").alias("scope")).join(scopes, "scope", "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"422: unknown scopes in the ladder: {sorted(r['scope'] for r in unknown.collect())}")
    return scopes.unionByName(new)


def collections_of(wanted: DataFrame, scopes: DataFrame, fallback: str) -> DataFrame:
    """wanted(scope) with its collection; fallback_used where the scope has none."""
    out = wanted.join(scopes.select("scope", "collection"), "scope", "left")
    return out.select("scope", F.coalesce("collection", F.lit(fallback)).alias("collection"), F.col("collection").isNull().alias("fallback_used"))


def ladder_of(scopes: DataFrame) -> DataFrame:
    """(scope, step, searched): the scope itself, then its ladder in order."""
    return scopes.select("scope", F.posexplode(F.concat(F.array("scope"), F.coalesce("ladder", F.array().cast("array<string>")))).alias("step", "searched"))


def violations(tier: Column, scope_id: Column, display: Column, sections: Column, parents: Column) -> Column:
    """array<string> of what is wrong with a persona; empty if it is valid. Parents may be of global tiers only."""
    found = F.array(
        F.when(~F.coalesce(tier.isin(*TIERS), F.lit(False)), "unknown tier"),
        F.when(F.coalesce(F.trim(scope_id), F.lit("")) == "", "scope_id is blank"),
        F.when(F.coalesce(F.trim(display), F.lit("")) == "", "display name is blank"),
        F.when(F.coalesce(F.size(sections), F.lit(0)) <= 0, "no sections"),
        F.when(F.exists(sections, lambda s: F.trim(s["heading"]) == ""), "a section without a heading"),
        F.when(F.exists(parents, lambda p: ~p["tier"].isin("meta", "enterprise")), "a parent of a tier that is not global"),
    )
    return F.filter(found, lambda v: v.isNotNull())


def remember_scope(tier: Column, scope_id: Column) -> Column:
    """struct<scope, tag> under which a persona's notes go."""
    return F.struct(F.when(tier.isin(*TIERS), tier).otherwise("project").alias("scope"), tag(scope_id).alias("tag"))


def rendered(sections: Column) -> Column:
    """Sections as Markdown, blank runs collapsed."""
    parts = F.transform(sections, lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), s["body"]))
    return F.trim(F.regexp_replace(F.array_join(parts, "\n\n"), "\n{3,}", "\n\n"))


def parent_sections(personas: DataFrame) -> DataFrame:
    """(tier, scope_id, ord, parent_tier, parent_id, display_name): pointers to each persona's parents."""
    refs = personas.select("tier", "scope_id", F.posexplode("parents").alias("ord", "p")).select("tier", "scope_id", "ord", F.col("p.tier").alias("parent_tier"), F.col("p.scope_id").alias("parent_id"))
    names = personas.select(F.col("tier").alias("parent_tier"), F.col("scope_id").alias("parent_id"), "display_name")
    return refs.join(names, ["parent_tier", "parent_id"], "left")


def disposed(drafts: DataFrame, tier: str, scope_id: str, state: str, at: str) -> DataFrame:
    """Drafts with one moved to approved or discarded; it keeps when."""
    if state not in ("approved", "discarded"):
        raise ValueError(f"unknown disposition: {state}")
    this = (F.col("tier") == tier) & (F.col("scope_id") == scope_id) & (F.col("state") == "draft")
    return drafts.withColumn("disposed_at", F.when(this, F.lit(at)).otherwise(F.col("disposed_at"))).withColumn("state", F.when(this, F.lit(state)).otherwise(F.col("state")))


def listed(personas: DataFrame) -> DataFrame:
    """(tier, scope_id) of personas(tier, scope_id, state) that are no drafts."""
    return personas.filter(F.coalesce(F.col("state"), F.lit("")) != "draft").select("tier", "scope_id")
