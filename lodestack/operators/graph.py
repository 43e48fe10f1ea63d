"""Graph operators over links(source, target, relation, origin) and nodes(id, label, kind)."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.reach import reachable
from lodestack.sources.shared import cut


def degrees(links: DataFrame) -> DataFrame:
    """Links at each node; a loop counts twice. One scan: both ends leave each link together."""
    return links.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def stats(nodes: DataFrame, links: DataFrame) -> DataFrame:
    by_origin = links.groupBy(F.coalesce("origin", F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("links").alias("what"), "name", "n")
    return by_origin.unionByName(nodes.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("what"), "name", "n"))


def focus(nodes: DataFrame, links: DataFrame, skip: Column) -> DataFrame:
    """The node of most links that ``skip`` does not name, ties to the least id; if it names all, of all nodes."""
    every = nodes.join(degrees(links), "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"), skip.cast("int").alias("skipped"))
    return every.orderBy("skipped", F.desc("degree"), "id").limit(1).select("id", "label", "degree")


def matching(nodes: DataFrame, query: str, columns: list[str], partly: list[str] | None = None) -> DataFrame:
    """Nodes of which a column equals the query, case aside; only if there are none, those that contain it, in the same
    columns or in those given by ``partly``."""
    low = F.lit(query.lower())
    any_of = lambda names, test: reduce(lambda a, b: a | b, (F.coalesce(test(F.lower(c)), F.lit(False)) for c in names))
    exact = nodes.filter(any_of(columns, lambda c: c == low))
    return nodes.filter(any_of(partly or columns, lambda c: F.contains(c, low))) if exact.isEmpty() else exact


def touching(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links of which either end is among ids(id): two equi-joins, as an OR of both would be a nested loop."""
    one, other = ids.select(F.col("id").alias("source")), ids.select(F.col("id").alias("target"))
    return links.join(one, "source", "left_semi").unionByName(links.join(one, "source", "left_anti").join(other, "target", "left_semi").select(links.columns))


def labelled(links: DataFrame, nodes: DataFrame) -> DataFrame:
    names = nodes.groupBy("id").agg(F.min("label").alias("label"))
    out = links
    for end in ("source", "target"):
        own = names.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        out = out.join(own, end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    return out


def traverse(links: DataFrame, start: DataFrame, depth: int | None, reverse: bool = False, paths: bool = False) -> DataFrame:
    """(id, parent, relation, depth): a row for each link from a node first reached one level before, also to nodes
    already seen; a node is expanded once. Links and each level are written, so that the next does not recompute them; the
    loop ends with the depth (None: no bound) or an empty frontier.

    paths: also ``via``, the chain of links from the start in the links' own direction; a node reached by several links
    of a level goes on with the least chain.
    """
    here, there = ("target", "source") if reverse else ("source", "target")
    if depth is None or depth > 1:
        links = cut(links.select("source", "target", "relation"))  # once, not anew for every level
    way = [F.col("via")] if paths else []
    frontier = start.select("id", *([F.col("id").alias("via")] if paths else [])).distinct()
    seen, out = frontier.select("id"), None
    chain = (F.col(there), "relation", "via") if reverse else ("via", "relation", F.col(there))
    step = [F.format_string("%s --%s--> %s", *chain).alias("via")] if paths else []
    for level in count(1) if depth is None else range(1, depth + 1):
        if frontier.isEmpty():
            break
        rows = links.join(frontier.select(F.col("id").alias(here), *way), here).select(F.col(there).alias("id"), F.col(here).alias("parent"), "relation", F.lit(level).alias("depth"), *step)
        if depth is None or level < depth:
            rows = cut(rows)
            fresh = rows.groupBy("id").agg(F.min("via").alias("via")) if paths else rows.select("id").distinct()
            frontier = cut(fresh.join(seen, "id", "left_anti"))
            seen = seen.unionByName(frontier.select("id"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        none = links.limit(0).select(F.col("source").alias("id"), F.col("source").alias("parent"), "relation", F.lit(0).alias("depth"))
        return none.withColumn("via", F.col("id")) if paths else none
    return out


def walk_back(edges: DataFrame, start: str, most: int = 20) -> DataFrame:
    """(ord, src, predicate, dst, depth, via) of edges(src, predicate, dst, created_at) that lead to ``start``: breadth
    first, the edges of a node by created_at, src and predicate, ``most`` at most in all. As no level has more rows than
    that, each is a top list and its order costs no sort of the table."""
    spark = edges.sparkSession
    queue = spark.createDataFrame([(start, 0, start)], "dst string, turn long, onward string")
    seen, out, depth, left = {start}, [], 0, most
    while left > 0:
        depth += 1
        rows = edges.join(F.broadcast(queue), "dst").orderBy("turn", "created_at", "src", "predicate").limit(left)  # the queue has ``most`` rows at most
        found = rows.select("src", "predicate", "dst", "onward").collect()
        if not found:
            break
        fresh = []
        for r in found:
            via = f"{r['src']} --{r['predicate']}--> {r['onward']}"
            out.append((len(out) + 1, r["src"], r["predicate"], r["dst"], depth, via))
            if r["src"] not in seen:
                seen.add(r["src"])
                fresh.append((r["src"], len(out), via))
        left = most - len(out)
        if not fresh:
            break
        queue = spark.createDataFrame(fresh, "dst string, turn long, onward string")
    return spark.createDataFrame(out, "ord int, src string, predicate string, dst string, depth int, via string")


def layer_hits(links: DataFrame, start: str, depth: int) -> DataFrame:
    """(text, source, match_type, score): the links at a node with score 1.0, and what it depends on with 0.9."""
    ids = links.sparkSession.createDataFrame([(start,)], "id string")
    edges = touching(links, ids).select(F.concat_ws(" ", "source", "relation", "target").alias("text"), F.coalesce("origin", F.lit("edge")).alias("source"), F.lit("graph_edge").alias("match_type"), F.lit(1.0).alias("score"))
    reached = traverse(links, ids, depth, paths=True)
    deps = reached.select(F.format_string("Depends on: %s (via %s)", "id", "via").alias("text"), F.col("via").alias("source"), F.lit("graph_traversal").alias("match_type"), F.lit(0.9).alias("score"))
    return edges.unionByName(deps)


def place(file: Column, location: Column) -> Column:
    """``file:location``, the file alone, or ``unknown``."""
    return F.when(F.coalesce(file, F.lit("")) == "", "unknown").when(F.coalesce(location, F.lit("")) == "", file).otherwise(F.concat(file, F.lit(":"), location))


def node_hits(nodes: DataFrame) -> DataFrame:
    """(id, content, source) of nodes(id, label, file_type, source_file, source_location); a document node whose place is
    not ``L<n>`` fails the read."""
    at = place(F.col("source_file"), F.col("source_location"))
    bad = (F.col("file_type") == "document") & ~F.coalesce(F.col("source_location").rlike(r"^L\d+$"), F.lit(False))
    plain = F.format_string("%s (%s) -- %s", F.col("label"), F.coalesce("file_type", F.lit("unknown")), at)
    content = F.when(bad, F.raise_error(F.concat(F.lit("document node without a line: "), "id"))).when(F.col("file_type") == "document", F.format_string('Doc: "%s" -- %s', F.col("label"), at)).otherwise(plain)
    return nodes.select("id", content.alias("content"), at.alias("source"))


def link_hits(links: DataFrame, nodes: DataFrame, score: Column | None = None) -> DataFrame:
    """(source, target, content, score) of links, named by the labels of their ends; score: a confidence, else null."""
    named = labelled(links, nodes)
    content = F.format_string("%s --%s--> %s", "source_label", "relation", "target_label")
    return named.select("source", "target", content.alias("content"), (F.lit(None).cast("double") if score is None else score).alias("score"))


#: What names a file as a test.
TEST_FILE = r"(?i)(^|/)(__tests__|tests?|specs?|androidTest|commonTest|iosTest)(/|$)|(Tests?|Specs?)\.(kt|swift|java|py)$|\.(test|spec)\.[jt]sx?$"


def is_test_file(path: Column) -> Column:
    return F.coalesce(path.rlike(TEST_FILE), F.lit(False))


def ancestors(commits: DataFrame, tips: DataFrame, depth: int | None = None) -> DataFrame:
    """Every commit reachable from tips(id) over commits(source: child, target: parent), tips included; only by so many
    levels where a depth is given. Without one, a linear history takes as many rounds as its length has binary digits."""
    if depth is None:
        return reachable(commits, tips)
    reached = traverse(commits, tips, depth)
    return reached.select("id").unionByName(tips.select("id")).distinct()


def ancestry(commits: DataFrame, tips: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(id) with ``state``: ancestor (reached from the tips), other (a known commit) or unknown."""
    reached = ancestors(commits, tips).withColumn("reached", F.lit(True))
    known = commits.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("known", F.lit(True))
    out = asked.join(reached, "id", "left").join(known, "id", "left")
    return out.select("id", F.when(F.col("reached"), "ancestor").when(F.col("known"), "other").otherwise("unknown").alias("state"))


def first_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
