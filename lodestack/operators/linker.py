"""Cross-corpus links: definitions and usages of identifiers, and their join."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.textops import once
from lodestack.sources.shared import cut

#: The forms in which source texts define and use an identifier.
QUOTED = r"(['\"`])([A-Za-z0-9_-]+)\1"
DEFINED = r"\bname\s*:\s*(['\"`])([A-Za-z0-9_-]+)\1[\s\S]{0,400}?\btype\s*:\s*(['\"`])document\3"
EQUAL = r"\b_type\s*==\s*(['\"`])([A-Za-z0-9_-]+)\1"
LISTED = r"\b_type\s+in\s*\[([^\]]*)\]"

#: Hits of one recall.
MOST_HITS = 50


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def placed(text: Column, pattern: str, group: int) -> Column:
    """array<struct<whole, name, breaks>> of a pattern's matches; breaks: line breaks before the match, counted from the
    gaps between the matches, so that equal matches have their own lines. Matches of a text are folded: some thousands."""

    def of(parts: Column) -> Column:
        step = F.transform(parts, lambda p: _breaks(p["gap"]) + _breaks(p["whole"]))
        upto = F.aggregate(step, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))
        return once(upto, lambda u: F.transform(parts, lambda p, i: F.struct(p["whole"].alias("whole"), p["name"].alias("name"), (F.get(u, i) - _breaks(p["whole"])).alias("breaks"))))

    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return once(F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), names.alias("name")), lambda p: p), of)


def _found(files: DataFrame, places: Column, kind: str) -> DataFrame:
    rows = files.select("repo", "path", F.explode(places).alias("x"))
    return rows.select("repo", "path", F.lit(kind).alias("kind"), F.col("x.name").alias("identifier"), (F.col("x.breaks") + 1).alias("line"))


def definitions(files: DataFrame) -> DataFrame:
    able = files.filter(F.contains("text", F.lit("name")) & F.contains("text", F.lit("document")))  # words of the pattern
    return _found(able, placed(F.col("text"), DEFINED, 2), "definition")


def usages(files: DataFrame) -> DataFrame:
    """Equality forms, and each quoted name of a list form, at its own line."""

    def of_list(whole: Column) -> Column:
        body_at = F.instr(whole["whole"], "[")
        before = whole["breaks"] + _breaks(F.substr(whole["whole"], F.lit(1), body_at))
        return F.transform(placed(whole["name"], QUOTED, 2), lambda q: F.struct(q["whole"].alias("whole"), q["name"].alias("name"), (q["breaks"] + before).alias("breaks")))

    listed = F.flatten(F.transform(placed(F.col("text"), LISTED, 1), of_list))
    return _found(files, placed(F.col("text"), EQUAL, 2), "usage").unionByName(_found(files, listed, "usage"))


@dataclass(frozen=True)
class Scheme:
    """A pluggable way to find (repo, path, kind, identifier, line) in files(repo, path, text)."""

    name: str
    definitions: Callable[[DataFrame], DataFrame]
    usages: Callable[[DataFrame], DataFrame]


SCHEMES = {"document-types": Scheme("document-types", definitions, usages)}


def scanned(files: DataFrame, schemes: list[Scheme]) -> tuple[DataFrame, DataFrame]:
    """Definitions and usages by all schemes, with the scheme's name."""
    found = []
    for side in ("definitions", "usages"):
        out = None
        for s in schemes:
            own = getattr(s, side)(files).withColumn("scheme", F.lit(s.name))
            out = own if out is None else out.unionByName(own)
        found.append(out)
    return found[0], found[1]


def by_identifier(items: DataFrame, query: str) -> DataFrame:
    """Items whose identifier is the query, case aside; only if there are none, those that contain it."""
    low = F.lit(query.lower())
    held = cut(items.filter(F.contains(F.lower("identifier"), low)), "items")  # the texts are searched once for both
    exact = held.filter(F.lower("identifier") == low)
    return held if exact.isEmpty() else exact


def linked(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Definitions with each usage of the same identifier; cross_repo tells whether the repos differ."""
    d = defs.select("identifier", F.col("repo").alias("def_repo"), F.col("path").alias("def_path"))
    u = uses.select("identifier", F.col("repo").alias("use_repo"), F.col("path").alias("use_path"), F.col("line").alias("use_line"))
    return d.join(u, "identifier").withColumn("cross_repo", F.col("def_repo") != F.col("use_repo"))


def orphans(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Usages of identifiers that nothing defines."""
    return uses.join(defs.select("identifier").distinct(), "identifier", "left_anti")


def hits(defs: DataFrame, uses: DataFrame, query: str, scheme: str = "document-types", most: int | None = MOST_HITS) -> DataFrame:
    """(content, source, line) of one recall: definitions that match, then their usages; without a definition, usages
    alone. The first ``most`` by kind, identifier, repo, path, line; None: all, in no order."""
    found = by_identifier(defs, query)
    at = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    if found.isEmpty():
        content = F.format_string('Usage: "%s" used in %s (no definition found)', "identifier", "repo")
        out = by_identifier(uses, query).select(F.lit(2).alias("k"), "identifier", "repo", "path", "line", content.alias("content"), at.alias("source"))
    else:
        content = F.format_string('Definition: "%s" (%s) in %s', F.col("identifier"), F.lit(scheme), F.col("repo"))
        heads = found.select(F.lit(0).alias("k"), "identifier", "repo", "path", "line", content.alias("content"), at.alias("source"))
        far = F.format_string('Cross-repo usage: "%s" used in %s (defined in %s)', "identifier", "use_repo", "def_repo")
        near = F.format_string('Same-repo usage: "%s" used in %s', "identifier", "use_repo")
        both = linked(found, uses).withColumn("content", F.when(F.col("cross_repo"), far).otherwise(near))
        place = F.concat("use_path", F.lit(":"), F.col("use_line").cast("string"))
        out = heads.unionByName(both.select(F.lit(1).alias("k"), "identifier", F.col("use_repo").alias("repo"), F.col("use_path").alias("path"), F.col("use_line").alias("line"), "content", place.alias("source")))
    if most is not None:
        out = out.orderBy("k", "identifier", "repo", "path", "line", "content").limit(most)
    return out.select("content", "source", "line")
