"""Scalar expressions of the write and recall hooks: queries, identifiers, statuses, topics, summaries, sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.textops import either, once

#: Statuses a hook may write, and the content types a crawl takes.
STATUSES = ("in-progress", "reviewed", "full-send")
CONTENT_TYPE = r"(?i)^(text/|application/xhtml\+xml)"
SUMMARY_CHARS = 4_000
CUT = "\n…[truncated]"


def picked_query(*fields: Column) -> Column:
    """The first field that is there and not empty; else empty."""
    return F.coalesce(either(*fields), F.lit(""))


def identifiers(ticket: Column, story: Column, query: Column) -> Column:
    """array<string>: ticket and story, if given and different; without them a query that is itself an identifier."""
    given = F.filter(F.array(either(ticket), F.when(F.coalesce(story != ticket, F.lit(True)), either(story))), lambda x: x.isNotNull())
    own = F.coalesce(query.rlike(r"^[\w./-]{6,}$") & query.rlike(r"[\d-]"), F.lit(False))
    return F.when(F.size(given) > 0, given).when(own, F.array(query)).otherwise(F.array().cast("array<string>"))


def status(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.when(low.isin(*STATUSES), low).otherwise("in-progress")


def positive(value: Column, fallback: float) -> Column:
    """A text's number, if it is above zero; else the fallback."""
    n = value.try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n).otherwise(F.lit(fallback))


def topic(*parts: Column) -> Column:
    """Parts that are not blank, trimmed, a blank line between them."""
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda p: F.trim(p)), lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n")


def path_for_scope(path: Column, scope: Column) -> Column:
    """An org tree path with its second segment replaced."""
    return F.concat(F.lit("org/"), scope, F.lit("/"), F.array_join(F.slice(F.split(path, "/"), F.lit(3), F.greatest(F.size(F.split(path, "/")) - 2, F.lit(0))), "/"))


def note_id(file: Column) -> Column:
    """The time stamp that a note's file name begins with; else the name without its extension."""
    stamp = F.regexp_extract(file, r"^(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-\d{3}Z)", 1)
    return F.when(stamp != "", stamp).otherwise(F.regexp_replace(file, r"\.md$", ""))


def source_summary(read: Column, missing: Column, most: int = SUMMARY_CHARS) -> Column:
    """Of read: array<struct<name, excerpt>> a section each, cut at ``most`` characters; if nothing was read, which names
    were looked for."""
    whole = F.array_join(F.transform(read, lambda s: F.concat(F.lit("## "), s["name"], F.lit("\n"), s["excerpt"])), "\n\n")
    cut = once(whole, lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(CUT))).otherwise(t))
    return F.when(F.size(read) > 0, cut).otherwise(F.concat(F.lit("No named source is there (looked for: "), F.array_join(missing, ", "), F.lit(")")))


def subsections(markdown: Column, heading: str) -> Column:
    """array<struct<heading, body>> of the ``###`` sections below one ``##`` section; without the section, or with none
    below it, the read fails."""

    def within(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: F.trim(x)), F.lit(f"## {heading}"))
        after = F.slice(lines, F.greatest(at, F.lit(1)).cast("int") + 1, F.size(lines))
        upto = F.array_position(F.transform(after, lambda x: x.startswith("## ")), True)
        body = F.array_join(F.when(upto > 0, F.slice(after, F.lit(1), upto.cast("int") - 1)).otherwise(after), "\n")
        cut = F.split(F.concat(F.lit("\n"), body), "\n### ")
        parts = F.filter(F.slice(cut, F.lit(2), F.size(cut)), lambda p: F.trim(p) != "")  # what stands before the first is none
        made = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("heading"), F.trim(F.regexp_replace(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 1), r"^\s+|\s+$", "")).alias("body")))
        return F.when((at > 0) & (F.size(parts) > 0), made).otherwise(F.raise_error(F.lit(f"no sections below: {heading}")))

    return once(F.split(markdown, "\n"), within)


def has_command(groups: Column, script: str) -> Column:
    """Whether some hook of array<struct<hooks: array<struct<command>>>> runs a script."""
    return F.coalesce(F.exists(groups, lambda g: F.exists(F.coalesce(g["hooks"], F.array().cast("array<struct<command:string>>")), lambda h: F.coalesce(F.contains(h["command"], F.lit(script)), F.lit(False)))), F.lit(False))


def fetched(content_type: Column, body: Column, most: int) -> Column:
    """ok, content_type (a kind that a crawl does not take) or too_large."""
    return F.when(~F.coalesce(content_type.rlike(CONTENT_TYPE), F.lit(False)), "content_type").when(F.octet_length(body) > most, "too_large").otherwise("ok")


def stale(indexed: Column, modified: Column) -> Column:
    """True if a file changed after it was indexed; else null: nothing is marked."""
    return F.when(modified > indexed, True)
