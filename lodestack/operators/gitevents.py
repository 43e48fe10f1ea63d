"""Events of a version store as lifecycle events: merges promote, deleted branches supersede."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The null object in both lengths, the prefix of local branches, and the subjects of merge commits.
NULL_OBJECTS = ("0" * 40, "0" * 64)
HEADS = "refs/heads/"
MERGED_BRANCH = r"Merge branch '([^']+)'"
MERGED_REQUEST = r"Merge pull request #\d+ from [^/]+/(\S+)"


def ref_lines(text: Column) -> Column:
    """array<struct<old, new, ref>> of lines with exactly three fields; others are passed over."""
    fields = F.transform(F.split(text, "\n"), lambda x: F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " "))
    three = F.filter(fields, lambda f: (F.size(f) == 3) & (F.get(f, F.lit(0)) != ""))
    return F.transform(three, lambda f: F.struct(F.get(f, F.lit(0)).alias("old"), F.get(f, F.lit(1)).alias("new"), F.get(f, F.lit(2)).alias("ref")))


def deleted_branches(transactions: DataFrame) -> DataFrame:
    """From transactions(ord, state, text): (ord, branch, commit_sha) of local branches that a committed transaction
    deleted; commit_sha: what they pointed to."""
    rows = transactions.filter("state = 'committed'").select("ord", F.explode(ref_lines(F.col("text"))).alias("r")).select("ord", "r.*")
    return rows.filter(F.col("new").isin(*NULL_OBJECTS) & F.col("ref").startswith(HEADS)).select("ord", F.substr("ref", F.lit(len(HEADS) + 1)).alias("branch"), F.col("old").alias("commit_sha"))


def supersede_events(deleted: DataFrame) -> DataFrame:
    """(kind, value, to) events for ``lifecycle.apply_events``."""
    return deleted.select(F.lit("branch").alias("kind"), F.col("branch").alias("value"), F.lit("superseded").alias("to")).distinct()


def merged_branch(subject: Column) -> Column:
    """The branch that a merge commit's subject names; null if it names none."""
    return F.coalesce(F.nullif(F.regexp_extract(subject, MERGED_BRANCH, 1), F.lit("")), F.nullif(F.regexp_extract(subject, MERGED_REQUEST, 1), F.lit("")))


def promote_events(merges: DataFrame, default_branch: str) -> DataFrame:
    """From merges(branch, subject, commits: array of shas): (kind, value, to) events of merges into the default branch
    that brought commits; the branch that the subject names, if any, and every commit."""
    here = merges.filter((F.col("branch") == default_branch) & (F.size(F.coalesce("commits", F.array().cast("array<string>"))) > 0))
    named = here.select(F.lit("branch").alias("kind"), merged_branch(F.col("subject")).alias("value")).filter("value is not null")
    shas = here.select(F.lit("commit").alias("kind"), F.explode("commits").alias("value"))
    return named.unionByName(shas).distinct().withColumn("to", F.lit("confirmed"))


def default_status(branch: Column, default_branch: Column) -> Column:
    """What a note written on a branch begins as."""
    return F.when(branch == default_branch, "confirmed").otherwise("provisional")


def taken(events: DataFrame) -> DataFrame:
    """From events(branch, ord, op: stash or take, sha): each take with the sha stashed last since the take before; a take
    consumes it, so a second one gets null."""
    in_order = Window.partitionBy("branch").orderBy("ord")
    turn = F.coalesce(F.sum((F.col("op") == "take").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = events.withColumn("turn", turn)
    since = Window.partitionBy("branch", "turn").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("op") == "stash", F.col("sha")), ignorenulls=True).over(since)
    return numbered.withColumn("sha", last).filter("op = 'take'").select("branch", "ord", "sha")
