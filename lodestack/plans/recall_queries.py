"""Registered queries of the recall path, the write path, version events and hooks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import hooks
from lodestack.functions import textops as X
from lodestack.operators import admin, gitevents, graph, ingest, lifecycle, linker, merge, recall, scopes, search, writes
from lodestack.plans.registry import FILES, LINKS, NODES, NOTES, ORACLES, QUERIES, SCORES, _keyword_hits, _vector_hits, query
from lodestack.sources import tables as T

# ------------------------------------------------------------------ recall

SHOWN = f"WITH {NOTES}, hits AS (SELECT source AS scope, doc_id FROM documents WHERE contains(text, 'thin')), shown AS (SELECT h.scope, h.doc_id FROM hits h LEFT JOIN notes n ON n.note_id = h.doc_id AND n.note_id % 11 <> 0 WHERE n.status IS NULL OR n.status = 'confirmed' OR (n.status = 'provisional' AND n.branch = 'src3'))"


def _shown(spark, d):
    hits = _keyword_hits(spark, d)
    headers = T.notes(spark, d).filter(F.pmod("note_id", F.lit(11)) != 0).select(F.col("note_id").alias("source"), "header")
    return hits, recall.filtered(hits, headers, "src3")


@query(f"{SHOWN} SELECT scope, doc_id FROM shown")
def hits_by_status(spark, d):
    return _shown(spark, d)[1].select("scope", F.col("source").alias("doc_id"))


@query(f"{SHOWN}, n AS (SELECT s.scope, count(shown.doc_id) AS n_hits FROM (SELECT DISTINCT scope FROM hits) s LEFT JOIN shown USING (scope) GROUP BY s.scope) SELECT scope, n_hits FROM n UNION ALL SELECT NULL, coalesce(sum(n_hits), 0)::BIGINT FROM n")
def hits_recounted(spark, d):
    hits, shown = _shown(spark, d)
    return recall.recounted(shown, hits)


@query(
    f"""WITH {SCORES}, v AS (SELECT scope, vec_id, score, row_number() OVER (PARTITION BY scope ORDER BY vec_id) AS ord FROM scores WHERE score >= 0.1),
top AS (SELECT min(scope) AS scope FROM v), g AS (SELECT (SELECT scope FROM top) AS scope, 1000000 + o_orderkey AS vec_id, o_orderkey % 10 / 10.0::DOUBLE AS score, o_orderkey AS ord FROM orders),
u AS (SELECT *, 0 AS late FROM v UNION ALL SELECT *, 1 FROM g)
SELECT scope, vec_id, score, row_number() OVER (PARTITION BY scope ORDER BY CASE WHEN scope = (SELECT scope FROM top) THEN score ELSE 0 END DESC, late, ord)::INT AS rank FROM u"""
)
def layer_merge(spark, d):
    v = search.scored(T.table(spark, d, "embeddings"), 0).filter("score >= 0.1")
    v = v.select(F.col("scope"), F.col("scope").alias("scope_ord"), F.col("vec_id").alias("source"), "score", F.col("vec_id").alias("ord"))
    g = T.table(spark, d, "orders").select((F.col("o_orderkey") + 1_000_000).alias("source"), (F.pmod("o_orderkey", F.lit(10)) / 10).alias("score"), F.col("o_orderkey").alias("ord"))
    return recall.with_graph(v, g).select("scope", F.col("source").alias("vec_id"), "score", "rank")


@query("SELECT '<!-- stable part scope=' || n_name || ' shared=' || CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE 'top' END || ' role=? -->' || chr(10) || 'Pointers to earlier notes follow the break. Open a file only where its pointer matters.' || chr(10) || 'Scope: ' || n_name || '. Shared: ' || CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE 'top' END || '. Ask at (service)/recall, tell at (service)/remember.' AS prefix, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def stable_prefixes(spark, d):
    both = T.table(spark, d, "nation").join(T.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    shared = F.when(F.pmod("n_nationkey", F.lit(2)) == 0, F.col("r_name"))
    return both.select("n_nationkey", recall.stable_prefix(F.col("n_name"), shared, F.lit(""), F.lit(None).cast("string")).alias("prefix"))


#: Ten hits a source: those of pack_budget, ranked within their scope.
PACKED = """p AS (SELECT source AS scope, lang || '/' || doc_id AS source, CASE WHEN contains(text, 'thin') THEN 'keyword' ELSE 'semantic' END AS match_type, CASE WHEN contains(text, 'thin') THEN NULL ELSE (doc_id % 100) / 100.0::DOUBLE END AS score, text FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY match_type <> 'keyword', coalesce(score, 0) DESC, source || chr(0)) AS rank FROM p),
t AS (SELECT *, '. [vector · ' || CASE WHEN match_type = 'keyword' THEN 'keyword-exact' WHEN score IS NOT NULL THEN 'score ' || printf('%.2f', score) ELSE 'score ?' END || '] ' || source || CASE WHEN ex <> '' THEN chr(10) || '   > ' || ex ELSE '' END AS tail FROM
  (SELECT *, CASE WHEN length(x) > 320 THEN left(x, 320) || ' …' ELSE x END AS ex FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM ranked)))"""


def _ranked(spark, d, most):
    keyed = F.contains("text", F.lit("thin"))
    docs = T.table(spark, d, "documents").select(
        F.col("source").alias("scope"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("source"), F.lit(None).cast("int").alias("chunk"), F.lit("vector").alias("layer"),
        F.when(keyed, "keyword").otherwise("semantic").alias("match_type"), F.when(keyed, F.lit(None)).otherwise(F.pmod("doc_id", F.lit(100)) / 100).cast("double").alias("score"), "text",
    )
    return merge.ranked(docs, "scope").filter(F.col("rank") <= most)


@query(
    f"""WITH RECURSIVE {PACKED}, walk(scope, most, rank, n, used, skipped, bundle) AS (
  SELECT DISTINCT scope, m, 0::BIGINT, 0, 0::BIGINT, 0, '' FROM p, unnest([4, 3, 2, 1, 0]) u(m)
  UNION ALL SELECT w.scope, w.most, w.rank + 1,
    CASE WHEN w.n >= w.most OR (w.used > 0 AND w.used + c > 600) THEN w.n ELSE w.n + 1 END,
    CASE WHEN w.n >= w.most OR (w.used > 0 AND w.used + c > 600) THEN w.used ELSE w.used + c END,
    CASE WHEN w.n < w.most AND w.used > 0 AND w.used + c > 600 THEN w.skipped + 1 ELSE w.skipped END,
    CASE WHEN w.n >= w.most OR (w.used > 0 AND w.used + c > 600) THEN w.bundle ELSE w.bundle || CASE WHEN w.n > 0 THEN chr(10) ELSE '' END || (w.n + 1) || t.tail END
  FROM walk w JOIN t ON t.scope = w.scope AND t.rank = w.rank + 1, LATERAL (SELECT ceil(length((w.n + 1) || t.tail) / 4.0)::BIGINT AS c) WHERE w.rank < 10),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY scope, most ORDER BY rank DESC) = 1),
sized AS (SELECT *, ceil(length('stable part of ' || scope) / 4.0)::BIGINT AS prefix_tokens, ceil(length(bundle) / 4.0)::BIGINT AS delta_tokens, ceil(length('stable part of ' || scope || chr(10) || chr(10) || '{recall.BREAK}' || chr(10) || chr(10) || bundle) / 4.0)::BIGINT AS total_tokens FROM last)
SELECT scope, most, n AS n_shown, skipped, prefix_tokens, delta_tokens, total_tokens FROM sized WHERE total_tokens <= 260 OR most = 0 QUALIFY row_number() OVER (PARTITION BY scope ORDER BY most DESC) = 1"""
)
def capped_bundles(spark, d):
    prefix = F.concat(F.lit("stable part of "), "scope")
    return recall.bundles(_ranked(spark, d, 10), "scope", prefix, 600, 4, 260).drop("text")


# ------------------------------------------------------------------ graph and linker

EDGES = f"{LINKS}, edges AS (SELECT source AS src, relation AS predicate, target AS dst, CASE origin WHEN 'supplier' THEN '2026-01-01' ELSE '2026-01-02' END AS created_at FROM links)"


@query(
    f"""WITH {EDGES}, one AS (SELECT *, row_number() OVER (ORDER BY created_at, src, predicate) AS o FROM edges WHERE dst = 'region:1'),
two AS (SELECT e.*, one.o + row_number() OVER (ORDER BY one.o, e.created_at, e.src, e.predicate) * 0 AS turn FROM edges e JOIN one ON e.dst = one.src)
SELECT ord::INT AS ord, src, predicate, dst, depth, via FROM (
  SELECT o AS ord, src, predicate, dst, 1 AS depth, src || ' --in--> region:1' AS via FROM one
  UNION ALL SELECT (SELECT count(*) FROM one) + row_number() OVER (ORDER BY turn, created_at, src, predicate), src, predicate, dst, 2, src || ' --in--> ' || dst || ' --in--> region:1' FROM two) WHERE ord <= 60"""
)
def graph_walk_back(spark, d):
    created = F.when(F.col("origin") == "supplier", "2026-01-01").otherwise("2026-01-02")
    edges = T.links(spark, d).select(F.col("source").alias("src"), F.col("relation").alias("predicate"), F.col("target").alias("dst"), created.alias("created_at"))
    return graph.walk_back(edges, "region:1", 60)


@query(
    f"""WITH {LINKS}, e AS (SELECT * FROM links WHERE source = 'supplier:3' OR target = 'supplier:3'),
one AS (SELECT target AS id, 'supplier:3 --' || relation || '--> ' || target AS via FROM links WHERE source = 'supplier:3'),
two AS (SELECT target AS id, one.via || ' --' || relation || '--> ' || target AS via FROM links JOIN one ON source = one.id)
SELECT source || ' ' || relation || ' ' || target AS text, origin AS source, 'graph_edge' AS match_type, 1.0::DOUBLE AS score FROM e
UNION ALL SELECT 'Depends on: ' || id || ' (via ' || via || ')', via, 'graph_traversal', 0.9::DOUBLE FROM (SELECT * FROM one UNION ALL SELECT * FROM two)"""
)
def graph_layer_hits(spark, d):
    return graph.layer_hits(T.links(spark, d), "supplier:3", 2)


@query(
    f"""WITH {NODES}, n AS (SELECT id, label, CASE WHEN kind = 'region' THEN 'document' WHEN kind = 'order' THEN NULL ELSE kind END AS t, CASE WHEN kind <> 'supplier' THEN kind || '.tbl' END AS f, CASE WHEN kind IN ('region', 'part') THEN 'L' || regexp_extract(id, '[0-9]+') END AS l FROM nodes),
s AS (SELECT *, CASE WHEN f IS NULL THEN 'unknown' WHEN l IS NULL THEN f ELSE f || ':' || l END AS source FROM n)
SELECT id, CASE WHEN t = 'document' THEN 'Doc: "' || label || '" -- ' || source ELSE label || ' (' || coalesce(t, 'unknown') || ') -- ' || source END AS content, source FROM s"""
)
def graph_node_hits(spark, d):
    kind = F.col("kind")
    n = T.nodes(spark, d).select("id", "label", F.when(kind == "region", "document").when(kind != "order", kind).alias("file_type"), F.when(kind != "supplier", F.concat(kind, F.lit(".tbl"))).alias("source_file"), F.when(kind.isin("region", "part"), F.concat(F.lit("L"), F.regexp_extract("id", "[0-9]+", 0))).alias("source_location"))
    return graph.node_hits(n)


@query(f"WITH {LINKS}, {NODES} SELECT source, target, coalesce(a.label, source) || ' --' || relation || '--> ' || coalesce(b.label, target) AS content, CASE WHEN origin = 'supplier' THEN 0.8::DOUBLE END AS score FROM links LEFT JOIN nodes a ON a.id = source LEFT JOIN nodes b ON b.id = target")
def graph_link_hits(spark, d):
    return graph.link_hits(T.links(spark, d), T.nodes(spark, d), F.when(F.col("origin") == "supplier", F.lit(0.8)))


@query(f"WITH {NODES} SELECT id, label FROM nodes WHERE kind = 'region'")
def graph_match_file(spark, d):
    """No node is named so; the files of some hold it."""
    nodes = T.nodes(spark, d).withColumn("norm_label", F.lower("label")).withColumn("source_file", F.concat("kind", F.lit(".tbl")))
    return graph.matching(nodes, "Region.TBL", ["id", "label", "norm_label"], ["label", "norm_label", "source_file"]).select("id", "label")


PATHS = "paths AS (SELECT c_custkey, ['src/tests/a.ts', 'src/a.test.ts', 'src/latest.ts', 'app/FooTests.swift', 'x/specs/y.py', 'src/contest.py', NULL][c_custkey % 7 + 1] AS path FROM customer)"


@query(f"WITH {PATHS} SELECT c_custkey, path, c_custkey % 7 IN (0, 1, 3, 4, 5) AS is_test FROM paths")
def test_files(spark, d):
    given = F.get(F.array(*map(F.lit, ("src/tests/a.ts", "src/a.test.ts", "src/latest.ts", "app/FooTests.swift", "x/specs/y.py", "src/contest.py", None))), F.pmod("c_custkey", F.lit(7)).cast("int"))
    return T.table(spark, d, "customer").select("c_custkey", given.alias("path")).withColumn("is_test", graph.is_test_file(F.col("path")))


@query(
    """WITH found AS (SELECT * FROM nation WHERE lower(n_name) = 'nation_1'),
d AS (SELECT 0 AS k, 'Definition: "' || n_name || '" (document-types) in ' || r_name AS content, 'schemas/' || n_nationkey || '.ts:2' AS source, 2 AS line FROM found JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT 1 AS k, CASE WHEN r_name <> c_mktsegment THEN 'Cross-repo usage: "' || n_name || '" used in ' || c_mktsegment || ' (defined in ' || r_name || ')' ELSE 'Same-repo usage: "' || n_name || '" used in ' || c_mktsegment END AS content, 'src/' || c_custkey || '.ts:' || l AS source, l AS line FROM customer JOIN found ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, unnest([2, 3, 5]) t(l))
SELECT content, source, line FROM d UNION ALL SELECT content, source, line FROM u"""
)
def crossref_hits(spark, d):
    defs, uses = linker.scanned(T.code(spark, d), [linker.SCHEMES["document-types"]])
    return linker.hits(defs, uses, "NATION_1", most=None)


@query("""SELECT 'Usage: "other" used in ' || c_mktsegment || ' (no definition found)' AS content, 'src/' || c_custkey || '.ts:4' AS source, 4 AS line FROM customer""")
def crossref_usage_hits(spark, d):
    defs, uses = linker.scanned(T.code(spark, d), [linker.SCHEMES["document-types"]])
    return linker.hits(defs, uses, "oth", most=None)


@query(
    """WITH RECURSIVE c AS (SELECT doc_id AS id, unnest([doc_id // 2, doc_id // 3]) AS p FROM documents WHERE doc_id > 0), up(id) AS (SELECT 700 UNION SELECT p FROM c JOIN up USING (id)),
asked AS (SELECT DISTINCT o_orderkey AS id FROM orders)
SELECT id::VARCHAR AS id, CASE WHEN id IN (SELECT id FROM up) THEN 'ancestor' WHEN id IN (SELECT id FROM c UNION SELECT p FROM c) THEN 'other' ELSE 'unknown' END AS state FROM asked"""
)
def commit_states(spark, d):
    docs = T.table(spark, d, "documents").filter("doc_id > 0")
    commits = docs.select(F.col("doc_id").cast("string").alias("source"), F.explode(F.array(F.floor(F.col("doc_id") / 2).cast("string"), F.floor(F.col("doc_id") / 3).cast("string"))).alias("target"), F.lit("parent").alias("relation"))
    asked = T.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id")).distinct()
    return graph.ancestry(commits, spark.createDataFrame([("700",)], "id string"), asked)


# ------------------------------------------------------------------ version events

_ZERO = "0" * 40


@query(
    f"""SELECT c_custkey AS ord, 'b-' || c_custkey AS branch, md5(c_custkey::VARCHAR) AS commit_sha FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 0"""
)
def deleted_branches(spark, d):
    key = F.col("c_custkey").cast("string")
    sha = F.md5(key.cast("binary"))
    kinds = F.array(
        F.concat(sha, F.lit(f" {_ZERO} refs/heads/b-"), key), F.concat(sha, F.lit(" "), sha, F.lit(" refs/heads/c-"), key), F.concat(sha, F.lit(f" {_ZERO} refs/tags/t-"), key), F.concat(sha, F.lit(f" {_ZERO}")), F.lit("  "),
    )
    text = F.concat(F.lit("x y\n"), F.get(kinds, F.pmod("c_custkey", F.lit(5)).cast("int")), F.lit("\n\n"))
    state = F.when(F.pmod("c_custkey", F.lit(2)) == 0, "committed").otherwise("prepared")
    return gitevents.deleted_branches(T.table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), state.alias("state"), text.alias("text")))


@query(
    """WITH m AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 3 AND o_orderkey % 3 <> 0)
SELECT 'branch' AS kind, CASE k % 4 WHEN 0 THEN 'feature-' || k ELSE 'topic/' || k END AS value, 'confirmed' AS "to" FROM m WHERE k % 4 IN (0, 1) UNION SELECT 'commit', md5(k::VARCHAR), 'confirmed' FROM m"""
)
def merge_promotions(spark, d):
    k = F.col("o_orderkey").cast("string")
    four = F.pmod("o_orderkey", F.lit(4)).cast("int")
    subject = F.get(F.array(F.concat(F.lit("Merge branch 'feature-"), k, F.lit("' into main")), F.concat(F.lit("Merge pull request #7 from owner/topic/"), k), F.lit("Fix it"), F.concat(F.lit("Merge branch 'z"), k, F.lit("'"))), four)
    commits = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.array().cast("array<string>")).otherwise(F.array(F.md5(k.cast("binary"))))
    merges = T.table(spark, d, "orders").select(F.when(four == 3, "side").otherwise("main").alias("branch"), subject.alias("subject"), commits.alias("commits"))
    return gitevents.promote_events(merges, "main")


@query(
    """WITH e AS (SELECT user_id % 50 AS branch, event_id AS ord, event_type = 'click' AS take, md5(event_id::VARCHAR) AS sha FROM events),
t AS (SELECT *, coalesce(sum(take::INT) OVER (PARTITION BY branch ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM e)
SELECT branch, max(ord) FILTER (take) AS ord, arg_max(sha, ord) FILTER (NOT take) AS sha FROM t GROUP BY branch, turn HAVING bool_or(take)"""
)
def pending_branch_shas(spark, d):
    e = T.table(spark, d, "events").select(F.pmod("user_id", F.lit(50)).alias("branch"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "click", "take").otherwise("stash").alias("op"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("sha"))
    return gitevents.taken(e)


# ------------------------------------------------------------------ notes and writes

TEXTS = f"{NOTES}, texts AS (SELECT note_id, status, '<!-- remembered @ 2026-01-01T00:00:00Z scope=top status=' || status || ' branch=' || branch || ' commit=' || commit_sha || ' -->' AS h, CASE WHEN note_id % 2 = 0 THEN 'status=confirmed stays' || chr(10) ELSE 'body' END AS b FROM notes)"


def _note_texts(spark, d):
    body = F.when(F.pmod("note_id", F.lit(2)) == 0, F.lit("status=confirmed stays\n")).otherwise("body")
    return T.notes(spark, d).select("note_id", F.concat("header", F.lit("\n"), body).alias("text"))


@query(f"WITH {TEXTS} SELECT note_id, replace(h, 'status=' || status, 'status=superseded') || chr(10) || b AS text FROM texts")
def status_rewrite(spark, d):
    return _note_texts(spark, d).select("note_id", writes.with_status(F.col("text"), F.lit("superseded")).alias("text"))


@query(f"WITH {TEXTS} SELECT note_id, h || chr(10) || b || CASE WHEN note_id % 2 = 0 THEN chr(10) ELSE chr(10) || chr(10) END || '## Lifecycle outcome' || chr(10) || 'merged as ' || note_id || chr(10) AS text FROM texts")
def outcome_block(spark, d):
    return _note_texts(spark, d).select("note_id", writes.with_outcome(F.col("text"), F.concat(F.lit("merged as "), F.col("note_id").cast("string"))).alias("text"))


@query(f"WITH {EDGES}, w AS (SELECT DISTINCT 'nation:' || n_nationkey AS src, 'in' AS predicate, 'region:' || u.r AS dst FROM nation, unnest([0, 1, 2]) u(r)) SELECT src, predicate, dst FROM w EXCEPT SELECT src, predicate, dst FROM edges")
def edges_inserted(spark, d):
    edges = T.links(spark, d).select(F.col("source").alias("src"), F.col("relation").alias("predicate"), F.col("target").alias("dst"))
    wanted = T.table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("src"), F.lit("in").alias("predicate"), F.explode(F.array(*(F.lit(f"region:{r}") for r in (0, 1, 2, 2)))).alias("dst"))
    return writes.new_edges(edges, wanted)


@query(f"WITH {FILES} SELECT path, CASE WHEN doc_id % 9 = 0 OR strlen(text) > 20000 OR trim(text) = '' THEN 0 ELSE 1 END::INT AS some_chunks, CASE WHEN doc_id % 9 = 0 THEN 'unreadable' WHEN strlen(text) > 20000 THEN 'too_large' WHEN trim(text) = '' THEN 'empty' END AS error FROM files")
def bulk_reindex(spark, d):
    files = T.files(spark, d).withColumn("text", F.when(F.pmod("doc_id", F.lit(9)) != 0, F.col("text")))
    return writes.bulk_indexed(files, 20_000).select("path", (F.col("n_chunks") > 0).cast("int").alias("some_chunks"), "error")


@query("SELECT s_suppkey, 'old ' || s_name || chr(10) || chr(10) || '<!-- managed:begin -->' || chr(10) || 'base' || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || chr(10) || s_name ELSE '' END || chr(10) || chr(10) || 'tier' || chr(10) || '<!-- managed:end -->' || chr(10) AS text FROM supplier")
def harness_compose(spark, d):
    s = T.table(spark, d, "supplier")
    return s.select("s_suppkey", writes.composed(F.concat(F.lit("old "), "s_name"), F.lit("base"), F.when(F.pmod("s_suppkey", F.lit(2)) == 0, F.col("s_name")), F.lit("tier")).alias("text"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate > o_orderdate + INTERVAL 60 DAY THEN true END AS stale FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def stale_hits(spark, d):
    both = T.table(spark, d, "lineitem").join(T.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", hooks.stale(F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"), F.col("l_shipdate")).alias("stale"))


@query(f"WITH {NOTES} SELECT CASE WHEN note_id % 4 = 0 THEN 'verified-merged' WHEN note_id % 4 = 1 OR branch IN ('src0', 'src1', 'src2') THEN 'still-open' WHEN branch IN ('src3', 'src4', 'src5') THEN 'ambiguous' ELSE 'out-of-scope' END AS classification, count(*) AS n FROM notes WHERE status = 'provisional' GROUP BY 1")
def audit_counts(spark, d):
    notes = T.notes(spark, d)
    quarter = F.pmod("note_id", F.lit(4))
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "branch string")
    found = lifecycle.audit(notes, notes.filter(quarter == 0), notes.filter(quarter <= 1), names("src0", "src1", "src2"), names("src3", "src4", "src5"))
    return found.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NOTES} SELECT count(*) AS n_notes, count(*) FILTER (l.doc_id IS NULL) AS drift_count FROM notes LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = note_id")
def reconcile_count(spark, d):
    """Notes against an index of the labelled documents: two tables of their own."""
    notes = T.notes(spark, d)
    indexed = T.table(spark, d, "labels").select(F.col("doc_id").alias("note_id"))
    lost = lifecycle.missing(notes, indexed).agg(F.count(F.lit(1)).alias("drift_count"))
    return notes.agg(F.count(F.lit(1)).alias("n_notes")).withColumn("k", F.lit(1)).join(lost.withColumn("k", F.lit(1)), "k").drop("k")


# ------------------------------------------------------------------ hooks, gates, administration


@query(
    """WITH a AS (SELECT c_custkey AS k, c_custkey % 6 AS m FROM customer)
SELECT k, CASE m WHEN 0 THEN 'asked' WHEN 1 THEN 'prompted' WHEN 2 THEN '' ELSE 'T-' || k || '00' END AS query,
CASE WHEN m = 4 THEN 'TK-1' WHEN m = 5 THEN 'TK-1,ST-2' WHEN m = 3 AND length('T-' || k || '00') >= 6 THEN 'T-' || k || '00' ELSE '' END AS identifiers,
CASE m WHEN 0 THEN 'reviewed' WHEN 1 THEN 'full-send' ELSE 'in-progress' END AS status,
CASE m WHEN 0 THEN 2.5 WHEN 1 THEN 7.0 WHEN 2 THEN 7.0 ELSE k END::DOUBLE AS number,
CASE m WHEN 0 THEN 'a' || chr(10) || chr(10) || 'c' ELSE 'a' || chr(10) || chr(10) || 'k ' || k || chr(10) || chr(10) || 'c' END AS topic,
'org/enterprise/x/' || k AS path, CASE WHEN m < 3 THEN '2026-08-01T00-33-15-581Z' ELSE 'note-' || k END AS note_id,
CASE WHEN m = 0 THEN 'confirmed' ELSE 'provisional' END AS initial FROM a"""
)
def hook_inputs(spark, d):
    m, k = F.pmod("c_custkey", F.lit(6)).cast("int"), F.col("c_custkey").cast("string")
    pick = lambda *xs: F.get(F.array(*(x if isinstance(x, type(k)) else F.lit(x).cast("string") for x in xs)), m)
    own = F.concat(F.lit("T-"), k, F.lit("00"))
    asked = hooks.picked_query(pick("asked", "", None, None, "", None), pick("no", "prompted", "", None, None, None), pick(None, "no", "", own, own, own))
    found = hooks.identifiers(pick(None, "", None, None, "TK-1", "TK-1"), pick("", None, None, None, "TK-1", "ST-2"), asked)
    return T.table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), asked.alias("query"), F.array_join(found, ",").alias("identifiers"), hooks.status(pick("Reviewed", "FULL-SEND", "gone", None, "", "in-progress")).alias("status"),
        hooks.positive(pick("2.5", "-1", "x", k, k, k), 7.0).alias("number"), hooks.topic(F.lit(" a "), pick("  ", *[F.concat(F.lit("k "), k)] * 5), F.lit(None).cast("string"), F.lit("c")).alias("topic"),
        hooks.path_for_scope(F.concat(F.lit("org/project/x/"), k), F.lit("enterprise")).alias("path"), hooks.note_id(F.when(m < 3, "2026-08-01T00-33-15-581Z-a.md").otherwise(F.concat(F.lit("note-"), k, F.lit(".md")))).alias("note_id"),
        gitevents.default_status(F.when(m == 0, "main").otherwise("side"), F.lit("main")).alias("initial"),
    )


@query("SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'content_type' WHEN page_id % 5 = 3 THEN 'content_type' WHEN strlen(html) > 3000 THEN 'too_large' ELSE 'ok' END AS outcome FROM pages")
def crawl_gates(spark, d):
    kind = F.get(F.array(*map(F.lit, ("text/html; charset=utf-8", "TEXT/plain", "application/xhtml+xml", "application/pdf", None))), F.pmod("page_id", F.lit(5)).cast("int"))
    return T.table(spark, d, "pages").select("page_id", hooks.fetched(kind, F.col("html"), 3000).alias("outcome"))


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS installed FROM supplier")
def hook_commands(spark, d):
    group = lambda *commands: F.struct(F.array(*(F.struct(c.cast("string").alias("command")) for c in commands)).alias("hooks"))
    groups = F.when(F.pmod("s_suppkey", F.lit(3)) == 0, F.array(group(F.lit("x")), group(F.lit(None), F.lit("node /a/pre.mjs --q")))).when(F.pmod("s_suppkey", F.lit(3)) == 1, F.array(group(F.lit("post.mjs"))))
    return T.table(spark, d, "supplier").select("s_suppkey", hooks.has_command(groups, "pre.mjs").alias("installed"))


@query("SELECT n_nationkey, (i - 1)::INT AS ord, ['First ' || n_name, 'Second'][i] AS heading, ['body of ' || n_name || chr(10) || chr(10) || 'more', 'x'][i] AS body FROM nation, unnest([1, 2]) t(i)")
def mandate_sections(spark, d):
    text = F.concat(F.lit("# T\n## Rules \n\n### First "), "n_name", F.lit("\n\nbody of "), "n_name", F.lit("\n\nmore\n### Second\n\nx\n\n## Other\n### No\n\ny"))
    return T.table(spark, d, "nation").select("n_nationkey", F.posexplode(hooks.subsections(text, "Rules")).alias("ord", "s")).select("n_nationkey", "ord", "s.*")


@query("SELECT source AS repo, CASE WHEN count(*) FILTER (doc_id % 5 = 1) > 0 THEN min(doc_id) FILTER (doc_id % 5 = 1) ELSE min(doc_id) END AS doc_id FROM documents GROUP BY source")
def context_first(spark, d):
    """Of each repo the first file by rank of its kind, then by id."""
    ranked = T.files(spark, d).withColumn("kind", F.when(F.pmod("doc_id", F.lit(5)) == 1, 0).otherwise(1))
    return graph.first_by(ranked, "repo", [F.col("kind"), F.col("doc_id")]).select("repo", "doc_id")


@query("SELECT source AS repo, CASE WHEN length(t) > 4000 THEN left(t, 4000) || chr(10) || '…[truncated]' ELSE t END AS summary FROM (SELECT source, string_agg('## ' || doc_id || chr(10) || left(text, 300), chr(10) || chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY source)")
def source_summaries(spark, d):
    """A section has six characters at least, so the first 700 of a source are all that a summary can show of."""
    first = search.top_of(T.table(spark, d, "documents").filter("text is not null"), "source", [F.col("doc_id")], hooks.SUMMARY_CHARS // 6 + 34)
    read = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.substring("text", 1, 300).alias("excerpt")))).alias("r"))
    named = F.transform("r", lambda s: F.struct(s["doc_id"].cast("string").alias("name"), s["excerpt"].alias("excerpt")))
    return read.select(F.col("source").alias("repo"), hooks.source_summary(named, F.array(F.lit("none"))).alias("summary"))


@query(
    """WITH r AS (SELECT c_nationkey AS chain, ['alpha', 'beta', 'gamma', 'delta'][c_custkey % 4 + 1] AS name, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 50 END AS priority, c_custkey AS ord FROM customer),
e AS (SELECT *, coalesce(priority, CASE name WHEN 'beta' THEN 5 END, CASE name WHEN 'alpha' THEN 10 WHEN 'beta' THEN 20 WHEN 'gamma' THEN 30 END, 2147483647)::INT AS effective FROM r)
SELECT chain, ord, effective, row_number() OVER (PARTITION BY chain ORDER BY effective, ord)::INT AS place FROM e"""
)
def runner_order(spark, d):
    name = F.get(F.array(*map(F.lit, ("alpha", "beta", "gamma", "delta"))), F.pmod("c_custkey", F.lit(4)).cast("int"))
    own = F.when(F.pmod("c_custkey", F.lit(7)) == 0, F.pmod("c_custkey", F.lit(50))).cast("int")
    runners = T.table(spark, d, "customer").select(F.col("c_nationkey").alias("chain"), name.alias("name"), own.alias("priority"), F.col("c_custkey").alias("ord"))
    return admin.runner_order(runners, {"beta": 5}, {"alpha": 10, "beta": 20, "gamma": 30}).select("chain", "ord", "effective", "place")


@query("SELECT label::VARCHAR AS name, row_number() OVER (ORDER BY label::VARCHAR)::INT AS rank FROM (SELECT DISTINCT label FROM embeddings)")
def collection_names(spark, d):
    names = T.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("name")).distinct()
    return merge.numbered(names, [F.col("name")])


@query("SELECT event_type AS config, count(*) AS hits, round(sum(value), 4) AS tokens, round(avg(value), 4) AS avg_latency FROM events GROUP BY event_type")
def config_report(spark, d):
    v = F.col("value")
    return admin.config_report(T.table(spark, d, "events").select(F.col("event_type").alias("config"), F.lit(1).alias("hits"), v.alias("tokens"), v.alias("latency")))


@query("SELECT s_suppkey AS scope_id, ['meta', 'enterprise', 'project'][s_suppkey % 3 + 1] AS tier FROM supplier WHERE s_suppkey % 4 <> 0")
def persona_listing(spark, d):
    tier = F.get(F.array(*map(F.lit, scopes.TIERS)), F.pmod("s_suppkey", F.lit(3)).cast("int"))
    drafts = T.table(spark, d, "supplier").select(tier.alias("tier"), F.col("s_suppkey").alias("scope_id"), F.when(F.pmod("s_suppkey", F.lit(4)) == 0, "draft").otherwise("approved").alias("state"))
    return scopes.listed(drafts)


@query("SELECT doc_id, left(regexp_replace(source || ' ' || lang || '!', '[^a-zA-Z0-9_-]', '-', 'g'), 40) AS tag, CASE WHEN doc_id % 2 = 0 THEN 'lines ' || doc_id || '–' || doc_id + 2 WHEN doc_id % 3 = 0 THEN 'chunk ' || doc_id ELSE '' END AS range, CASE WHEN length(text) > 1200 OR len(string_split(text, chr(10))) > 40 THEN left(array_to_string(string_split(text, chr(10))[1:40], chr(10)), 1200) || chr(10) || '…[truncated]' ELSE text END AS capped FROM documents")
def hit_fields(spark, d):
    i = F.col("doc_id")
    span = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.array(i, i + 2))
    chunk = F.when(F.pmod("doc_id", F.lit(3)) == 0, i)
    return T.table(spark, d, "documents").select("doc_id", X.tag(F.concat("source", F.lit(" "), "lang", F.lit("!"))).alias("tag"), X.line_range(span, chunk).alias("range"), X.capped(F.col("text")).alias("capped"))


# ------------------------------------------------------------------ SQL of queries registered elsewhere

#: Chunks of at most 4,000 bytes: the cut moves back over bytes that continue a character.
CHUNKED = """RECURSIVE hexed AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS size FROM documents),
walk(doc_id, k, lo, hi) AS (SELECT doc_id, -1, 0::BIGINT, 0::BIGINT FROM hexed WHERE size > 0
  UNION ALL SELECT w.doc_id, w.k + 1, w.hi, CASE WHEN w.hi + 4000 >= size THEN size
    WHEN substr(h, 2 * (w.hi + 4000) + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN w.hi + 4000 WHEN substr(h, 2 * (w.hi + 3999) + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN w.hi + 3999
    WHEN substr(h, 2 * (w.hi + 3998) + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN w.hi + 3998 ELSE w.hi + 3997 END
  FROM walk w JOIN hexed USING (doc_id) WHERE w.hi < size),
parts AS (SELECT doc_id, k AS chunk_index, hi - lo AS n_bytes, decode(unhex(substr(h, 2 * lo + 1, 2 * (hi - lo)))) AS piece FROM walk JOIN hexed USING (doc_id) WHERE k >= 0)"""
ORACLES["chunk_documents"] = f"WITH {CHUNKED} SELECT doc_id, chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS chunk_count, n_bytes::INT AS n_bytes, sha256(piece) AS sha256 FROM parts"


@query(f"WITH {CHUNKED} SELECT doc_id || '.md' AS filename, source AS tag, chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS chunk_count, md5(piece) AS digest FROM parts JOIN documents USING (doc_id)")
def chunk_specs(spark, d):
    docs = T.table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), X.tag(F.col("source")).alias("tag"), "text")
    return ingest.chunk_specs(docs, 4_000).select("filename", "tag", "chunk_index", "chunk_count", F.md5(F.encode("text", "UTF-8")).alias("digest"))


ORACLES["ingest_outcomes"] = f"WITH {CHUNKED} SELECT doc_id, count(piece) AS chunk_count, count(piece) FILTER (NOT regexp_matches(piece, '\\S')) AS failed, count(piece) FILTER (NOT regexp_matches(piece, '\\S')) = 0 AS ok FROM documents LEFT JOIN parts USING (doc_id) GROUP BY doc_id"
ORACLES["crawl_frontier"] = (
    "WITH seeds AS (SELECT page_id, url, html FROM pages QUALIFY row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) ORDER BY page_id) = 1), "
    + f"links AS ({ORACLES['same_host_links'].replace('FROM pages)', 'FROM seeds)')}), "
    + "every AS (SELECT page_id, link AS url, min(ord) AS ord FROM links JOIN seeds USING (page_id) WHERE link <> url GROUP BY page_id, link UNION ALL SELECT page_id, url, -1 FROM seeds) SELECT page_id, url, (row_number() OVER (PARTITION BY page_id ORDER BY ord))::INT AS rank FROM every QUALIFY rank <= 5"
)
ORACLES["pack_budget"] = f"""WITH RECURSIVE {PACKED.replace("CASE WHEN contains(text, 'thin') THEN NULL ELSE (doc_id % 100) / 100.0::DOUBLE END AS score", "(doc_id % 100) / 100.0::DOUBLE AS score")}, walk(scope, rank, n, used, skipped, bundle) AS (
  SELECT DISTINCT scope, 0::BIGINT, 0, 0::BIGINT, 0, '' FROM p
  UNION ALL SELECT w.scope, w.rank + 1, CASE WHEN stays THEN w.n ELSE w.n + 1 END, CASE WHEN stays THEN w.used ELSE w.used + c END, CASE WHEN w.n < 3 AND stays THEN w.skipped + 1 ELSE w.skipped END,
    CASE WHEN stays THEN w.bundle ELSE w.bundle || CASE WHEN w.n > 0 THEN chr(10) ELSE '' END || (w.n + 1) || t.tail END
  FROM walk w JOIN t ON t.scope = w.scope AND t.rank = w.rank + 1, LATERAL (SELECT ceil(length((w.n + 1) || t.tail) / 4.0)::BIGINT AS c), LATERAL (SELECT w.n >= 3 OR (w.used > 0 AND w.used + c > 260) AS stays) WHERE w.rank < 20)
SELECT scope, n AS n_shown, used AS tokens, skipped, bundle FROM walk QUALIFY row_number() OVER (PARTITION BY scope ORDER BY rank DESC) = 1"""
