"""Note lifecycle: visibility, transitions, reconciliation, drift audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.textops import flight

#: The transitions a status may make.
ALLOWED = (("provisional", "confirmed"), ("provisional", "superseded"))


def visible(header: Column, branch: str | None, all_provisional: bool = False) -> Column:
    """No header or confirmed: yes. Superseded: no, unless all are asked for. Provisional: on its own branch, or all."""
    own = F.coalesce(header["branch"] == F.lit(branch), F.lit(False))
    return F.when(header.isNull() | (header["status"] == "confirmed"), True).when(F.lit(all_provisional), True).when(header["status"] == "provisional", own).otherwise(False)


def visible_notes(notes: DataFrame, branch: str | None, all_provisional: bool = False) -> DataFrame:
    return notes.filter(visible(flight(F.col("header")), branch, all_provisional))


def may_change(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for a, b in ALLOWED:
        out = out | ((old == a) & (new == b))
    return F.coalesce(out, F.lit(False))


def apply_events(notes: DataFrame, events: DataFrame) -> DataFrame:
    """Notes with the status that events(kind: branch or commit, value, to) give to provisional ones they match.

    The matcher's OR is two equi-joins. A note that several events match takes the least target, so that the result does
    not depend on their order; later runs change nothing, as only provisional notes are looked at.
    """
    open_notes = notes.filter("status = 'provisional'")
    hits = None
    for kind, column in (("branch", "branch"), ("commit", "commit_sha")):
        own = events.filter(F.col("kind") == kind).select(F.col("value").alias(column), "to")
        part = open_notes.join(own, column).select("note_id", "to")
        hits = part if hits is None else hits.unionByName(part)
    target = hits.groupBy("note_id").agg(F.min("to").alias("to"))
    return notes.join(target, "note_id", "left").withColumn("status", F.coalesce("to", "status")).withColumn("changed", F.col("to").isNotNull()).drop("to")


def missing(notes: DataFrame, indexed: DataFrame) -> DataFrame:
    """Notes that the index lacks: one anti-join."""
    return notes.join(indexed.select("note_id"), "note_id", "left_anti")


def audit(notes: DataFrame, ancestors: DataFrame, known: DataFrame, refs: DataFrame, merged: DataFrame) -> DataFrame:
    """Provisional notes classified: verified-merged, still-open, ambiguous or out-of-scope."""
    flag = lambda df, c, name: df.select(F.col(c)).distinct().withColumn(name, F.lit(True))
    out = notes.filter("status = 'provisional'")
    for df, c, name in ((ancestors, "commit_sha", "reached"), (known, "commit_sha", "seen"), (refs, "branch", "live"), (merged, "branch", "named")):
        out = out.join(flag(df, c, name), c, "left")
    kind = F.when(F.col("reached"), "verified-merged").when(F.col("seen") | F.col("live"), "still-open").when(F.col("named"), "ambiguous").otherwise("out-of-scope")
    return out.withColumn("classification", kind).drop("reached", "seen", "live", "named")
