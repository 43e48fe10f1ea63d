"""Registered queries over a data folder, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import net
from lodestack.functions import textops as X
from lodestack.operators import admin, graph, ingest, lifecycle, linker, merge, search
from lodestack.plans import cascade
from lodestack.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FILES = "files AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, source || '/' || lang AS area, source AS repo, doc_id, text FROM documents)"
LINES = FILES + ", cut AS (SELECT path, area, repo, doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM files), lines AS (SELECT path, area, repo, doc_id, i AS line_no, l[i] AS line FROM cut, unnest(generate_series(1, len(l))) t(i))"
NOTES = "notes AS (SELECT doc_id AS note_id, lang, source AS branch, CASE WHEN doc_id % 10 <= 5 THEN 'confirmed' WHEN doc_id % 10 <= 8 THEN 'provisional' ELSE 'superseded' END AS status, md5(doc_id::VARCHAR) AS commit_sha, text AS body FROM documents)"
LINKS = """links AS (
  SELECT DISTINCT 'customer:' || o_custkey AS source, 'order:' || o_orderkey AS target, 'placed' AS relation, 'orders' AS origin FROM orders
  UNION ALL SELECT DISTINCT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in', 'customer' FROM customer
  UNION ALL SELECT DISTINCT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in', 'supplier' FROM supplier
  UNION ALL SELECT DISTINCT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'in', 'nation' FROM nation
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', 'lineitem' FROM lineitem)"""
NODES = """nodes AS (
  SELECT 'customer:' || c_custkey AS id, c_name AS label, 'customer' AS kind FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, r_name, 'region' FROM region
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Order ' || o_orderkey, 'order' FROM orders)"""
DEGREES = "degrees AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM links UNION ALL SELECT target FROM links) GROUP BY id)"
QUERY = "tion"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ search


@query(f"WITH {LINES} SELECT doc_id, path, line_no, line, sha256(line) AS line_sha FROM lines WHERE contains(line, 'thonand') OR contains(line, '{QUERY} ')")
def literal_search(spark, d):
    found = search.any_literal(T.files(spark, d), [QUERY + " ", "thonand"])
    return found.select("doc_id", "path", "line_no", "line", F.sha2("line", 256).alias("line_sha"))


@query(f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE contains(lower(line), 'the th')")
def literal_search_ci(spark, d):
    return search.literal(T.files(spark, d), "The Th", ignore_case=True).select("doc_id", "line_no")


@query(f"WITH {LINES} SELECT doc_id, line_no, area FROM lines WHERE area = 'src1/en' AND contains(line, 'the')")
def area_search(spark, d):
    return search.literal(T.files(spark, d), "the", area="src1/en").select("doc_id", "line_no", "area")


@query(f"WITH {FILES} SELECT path, area, sha256(text) AS sha256, ceil(length(text) / 4.0)::BIGINT AS tokens FROM files")
def file_index(spark, d):
    f = T.files(spark, d)
    return search.file_index(f).select("path", "area", "sha256").join(f.select("path", X.tokens(F.col("text")).alias("tokens")), "path")


@query(
    f"WITH {FILES}, md AS (SELECT doc_id, regexp_split_to_array('# ' || text, '\\r?\\n') AS l FROM files) SELECT doc_id, i AS line, length(regexp_extract(l[i], '^(#{{1,2}})\\s+(.+?)\\s*$', 1)) AS level, regexp_extract(l[i], '^(#{{1,2}})\\s+(.+?)\\s*$', 2) AS heading FROM md, unnest(generate_series(1, len(l))) t(i) WHERE regexp_matches(l[i], '^(#{{1,2}})\\s+(.+?)\\s*$')"
)
def headings(spark, d):
    md = T.files(spark, d).withColumn("text", F.concat(F.lit("# "), "text"))
    return md.select("doc_id", F.explode(X.headings(F.col("text"))).alias("h")).select("doc_id", F.col("h.line").alias("line"), F.col("h.level").alias("level"), F.col("h.text").alias("heading"))


@query(f"WITH {FILES} SELECT area, count(*) AS n_files, min(path) AS first_path, max(path) AS last_path FROM files GROUP BY area")
def area_rollup(spark, d):
    return search.areas(T.files(spark, d))


@query(
    f"WITH {LINES}, w AS (SELECT count(*) AS n_files, coalesce(sum(ceil(length(text) / 4.0)), 0)::BIGINT AS find_tokens FROM files WHERE contains(text, 'reth')), s AS (SELECT count(*) AS n_hits, coalesce(sum(ceil(length(line) / 4.0)), 0)::BIGINT AS recall_tokens FROM lines WHERE contains(line, 'reth')) SELECT n_files, find_tokens, n_hits, recall_tokens, CASE WHEN find_tokens > 0 THEN round(recall_tokens / find_tokens, 6) ELSE 0.0 END AS ratio, recall_tokens < find_tokens AS beats_find FROM w, s"
)
def token_cost_ratio(spark, d):
    return search.find_cost(T.files(spark, d), "reth")


@query(f"WITH {LINES}, hits AS (SELECT repo, doc_id, line_no, row_number() OVER (PARTITION BY repo ORDER BY doc_id, line_no) AS rank FROM lines WHERE contains(line, 'the')) SELECT repo, doc_id, line_no, rank FROM hits WHERE rank <= 5")
def keyword_hits(spark, d):
    return search.keyword(T.files(spark, d), "the").select("repo", "doc_id", "line_no", "rank")


SCORES = "scores AS (SELECT e.vec_id, e.label::BIGINT AS scope, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(f"WITH {SCORES} SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM scores QUALIFY rank <= 10")
def vector_topk(spark, d):
    best = search.scored(T.table(spark, d, "embeddings"), 0).orderBy(F.desc("score"), "vec_id").limit(10)
    return best.select("vec_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("rank"))


@query(f"WITH {SCORES} SELECT scope, vec_id, score, row_number() OVER (PARTITION BY scope ORDER BY score DESC, vec_id) AS rank FROM scores QUALIFY rank <= 5")
def vector_topk_by_scope(spark, d):
    return search.top_of(search.scored(T.table(spark, d, "embeddings"), 0), "scope", [F.desc("score"), F.col("vec_id")], 5)


@query(f"WITH {SCORES} SELECT scope, count(*) FILTER (score >= 0.1) AS hits, count(*) FILTER (score < 0.1) AS below_floor FROM scores GROUP BY scope")
def vector_min_score(spark, d):
    return search.scored(T.table(spark, d, "embeddings"), 0).groupBy("scope").agg(F.count_if(F.col("score") >= 0.1).alias("hits"), F.count_if(F.col("score") < 0.1).alias("below_floor"))


@query(
    f"WITH {LINES}, hits AS (SELECT doc_id, line_no FROM lines WHERE contains(line, 'tionth')) SELECT DISTINCT l.doc_id, l.line_no FROM lines l JOIN hits h ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no - 1 AND h.line_no + 1"
)
def radius_context(spark, d):
    lines = T.lines(T.files(spark, d)).withColumnRenamed("line_no", "chunk_index")
    hits = lines.filter(F.contains("line", F.lit("tionth")))
    return search.neighbours(lines, hits, 1).select("doc_id", F.col("chunk_index").alias("line_no"))


# ------------------------------------------------------------------ merge

VECTOR = "v AS (SELECT d.source AS scope, d.doc_id AS source, 0 AS chunk, s.score, s.vec_id AS ord FROM scores s JOIN documents d ON d.doc_id = s.vec_id WHERE s.score >= 0.0)"
KEYED = "k AS (SELECT source AS scope, doc_id AS source, 0 AS chunk, doc_id AS ord FROM documents WHERE contains(text, 'thin'))"


def _vector_hits(spark, d):
    s = search.scored(T.table(spark, d, "embeddings"), 0).filter("score >= 0.0")
    docs = T.table(spark, d, "documents").select(F.col("source").alias("in"), "doc_id")
    return s.join(docs, s.vec_id == docs.doc_id).select(F.col("in").alias("scope"), F.col("doc_id").alias("source"), F.lit(0).alias("chunk"), "score", F.col("vec_id").alias("ord"))


def _keyword_hits(spark, d):
    return T.table(spark, d, "documents").filter(F.contains("text", F.lit("thin"))).select(F.col("source").alias("scope"), F.col("doc_id").alias("source"), F.lit(0).alias("chunk"), F.col("doc_id").alias("ord"))


@query(
    f"WITH {SCORES}, {VECTOR}, {KEYED}, m AS (SELECT coalesce(v.scope, k.scope) AS scope, coalesce(v.source, k.source) AS source, coalesce(v.chunk, k.chunk) AS chunk, v.score, CASE WHEN k.ord IS NULL THEN 'semantic' WHEN v.ord IS NULL THEN 'keyword' ELSE 'both' END AS match_type, v.ord IS NULL AS late, coalesce(v.ord, k.ord) AS o FROM v FULL OUTER JOIN k ON v.scope = k.scope AND v.source = k.source AND v.chunk = k.chunk) SELECT scope, source, chunk, score, match_type, row_number() OVER (PARTITION BY scope ORDER BY late, o) AS rank FROM m"
)
def hybrid_merge(spark, d):
    return merge.hybrid(_vector_hits(spark, d), _keyword_hits(spark, d))


HITS = f"{SCORES}, {VECTOR}, {KEYED}, hits AS (SELECT source, chunk, 'vector' AS layer, ord, score, 'semantic' AS match_type FROM v UNION ALL SELECT source, chunk, 'keyword', 1000000000 + ord, NULL, 'keyword' FROM k)"


def _hits(spark, d):
    v = _vector_hits(spark, d).select("source", "chunk", F.lit("vector").alias("layer"), "ord", "score", F.lit("semantic").alias("match_type"))
    return v.unionByName(_keyword_hits(spark, d).select("source", "chunk", F.lit("keyword").alias("layer"), (F.col("ord") + 1_000_000_000).alias("ord"), F.lit(None).cast("double").alias("score"), F.lit("keyword").alias("match_type")))


@query(f"WITH {HITS} SELECT source, chunk, arg_min(layer, ord) AS layer, min(ord) AS ord, CASE WHEN count(DISTINCT layer) > 1 THEN 'keyword' ELSE '' END AS also_matched FROM hits GROUP BY source, chunk")
def parallel_dedupe(spark, d):
    return merge.dedupe(_hits(spark, d))


@query(f"WITH {HITS}, f AS (SELECT *, min(ord) OVER (PARTITION BY source) AS first FROM hits) SELECT source, layer, ord, row_number() OVER (ORDER BY first, coalesce(chunk, 0), ord) AS rank FROM f")
def source_grouping(spark, d):
    return merge.by_source(_hits(spark, d)).select("source", "layer", "ord", "rank")


@query(f"WITH {HITS} SELECT source, layer, match_type, row_number() OVER (ORDER BY CASE layer WHEN 'vector' THEN 3 ELSE 4 END, match_type <> 'keyword', coalesce(score, 0) DESC, source::VARCHAR || chr(0) || chunk::VARCHAR) AS rank FROM hits")
def rank_hits(spark, d):
    hits = _hits(spark, d).withColumn("source", F.col("source").cast("string"))
    return merge.ranked(hits).select(F.col("source").cast("long").alias("source"), "layer", "match_type", "rank")


@query()
def pack_budget(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("source").alias("scope"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("source"), F.lit(None).cast("int").alias("chunk"), F.lit("vector").alias("layer"), F.when(F.contains("text", F.lit("thin")), "keyword").otherwise("semantic").alias("match_type"), (F.pmod("doc_id", F.lit(100)) / 100).alias("score"), "text")
    return merge.packed(merge.ranked(docs, "scope").filter("rank <= 20"), "scope", 260, 3)


# ------------------------------------------------------------------ lifecycle

FLIGHT = f"{NOTES}"


@query(f"WITH {NOTES} SELECT note_id, status, branch, commit_sha, regexp_matches(commit_sha, '^[0-9a-f]{{7,64}}$') AS strict FROM notes")
def status_header_parse(spark, d):
    n = T.notes(spark, d).select("note_id", X.flight(F.col("header")).alias("h"), X.flight(F.col("header"), strict=True).alias("s"))
    return n.select("note_id", "h.status", "h.branch", "h.commit_sha", F.col("s").isNotNull().alias("strict"))


@query(f"WITH {NOTES} SELECT note_id, status FROM notes WHERE status = 'confirmed'")
def visible_confirmed(spark, d):
    return lifecycle.visible_notes(T.notes(spark, d), None).select("note_id", "status")


@query(f"WITH {NOTES} SELECT note_id, status FROM notes WHERE status = 'confirmed' OR (status = 'provisional' AND branch = 'src3')")
def visible_own_branch(spark, d):
    return lifecycle.visible_notes(T.notes(spark, d), "src3").select("note_id", "status")


@query(f"WITH {NOTES} SELECT note_id, status FROM notes")
def visible_all(spark, d):
    return lifecycle.visible_notes(T.notes(spark, d), None, all_provisional=True).select("note_id", "status")


def _events(spark, to):
    return spark.createDataFrame([("branch", "src1", to), ("branch", "src2", to), ("commit", "8f14e45fceea167a5a36dedd4bea2543", to)], "kind string, value string, to string")


def _changed_sql(to):
    return f"WITH {NOTES} SELECT note_id, CASE WHEN hit THEN '{to}' ELSE status END AS status, hit AS changed FROM (SELECT *, status = 'provisional' AND (branch IN ('src1', 'src2') OR commit_sha = '8f14e45fceea167a5a36dedd4bea2543') AS hit FROM notes)"


@query(_changed_sql("confirmed"))
def promote_events(spark, d):
    return lifecycle.apply_events(T.notes(spark, d), _events(spark, "confirmed")).select("note_id", "status", "changed")


@query(_changed_sql("superseded"))
def supersede_events(spark, d):
    return lifecycle.apply_events(T.notes(spark, d), _events(spark, "superseded")).select("note_id", "status", "changed")


@query(f"WITH {NOTES} SELECT status AS old, t AS new, status = 'provisional' AND t IN ('confirmed', 'superseded') AS allowed, count(*) AS n FROM notes, unnest(['provisional', 'confirmed', 'superseded']) u(t) GROUP BY ALL")
def transition_guard(spark, d):
    pairs = T.notes(spark, d).select(F.col("status").alias("old"), F.explode(F.array(*map(F.lit, ("provisional", "confirmed", "superseded")))).alias("new"))
    return pairs.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n")).select("old", "new", lifecycle.may_change(F.col("old"), F.col("new")).alias("allowed"), "n")


@query(f"WITH {NOTES} SELECT note_id, branch FROM notes WHERE note_id % 13 = 0")
def reconcile_drift(spark, d):
    notes = T.notes(spark, d)
    return lifecycle.missing(notes, notes.filter(F.pmod("note_id", F.lit(13)) != 0)).select("note_id", "branch")


@query(f"WITH {FILES} SELECT path, doc_id % 7 = 0 AS stale FROM files")
def stale_index(spark, d):
    f = T.files(spark, d)
    index = f.select("path", F.sha2(F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))
    return f.join(index, "path").select("path", (F.sha2("text", 256) != F.col("sha256")).alias("stale"))


@query(
    f"WITH {NOTES} SELECT note_id, CASE WHEN note_id % 4 = 0 THEN 'verified-merged' WHEN note_id % 4 = 1 OR branch IN ('src0', 'src1', 'src2') THEN 'still-open' WHEN branch IN ('src3', 'src4', 'src5') THEN 'ambiguous' ELSE 'out-of-scope' END AS classification FROM notes WHERE status = 'provisional'"
)
def audit_ladder(spark, d):
    notes = T.notes(spark, d)
    quarter = F.pmod("note_id", F.lit(4))
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "branch string")
    return lifecycle.audit(notes, notes.filter(quarter == 0), notes.filter(quarter <= 1), names("src0", "src1", "src2"), names("src3", "src4", "src5")).select("note_id", "classification")


@query("WITH RECURSIVE up(id) AS (SELECT 700 UNION SELECT p FROM (SELECT doc_id AS id, unnest([doc_id // 2, doc_id // 3]) AS p FROM documents WHERE doc_id > 0) c JOIN up USING (id)) SELECT id::VARCHAR AS id FROM up")
def commit_ancestry(spark, d):
    docs = T.table(spark, d, "documents").filter("doc_id > 0")
    commits = docs.select(F.col("doc_id").cast("string").alias("source"), F.explode(F.array(F.floor(F.col("doc_id") / 2).cast("string"), F.floor(F.col("doc_id") / 3).cast("string"))).alias("target"), F.lit("parent").alias("relation"))
    return graph.ancestors(commits, spark.createDataFrame([("700",)], "id string"))


# ------------------------------------------------------------------ graph


@query(f"WITH {LINKS}, {NODES} SELECT 'links' AS what, origin AS name, count(*) AS n FROM links GROUP BY origin UNION ALL SELECT 'nodes', kind, count(*) FROM nodes GROUP BY kind")
def graph_stats(spark, d):
    return graph.stats(T.nodes(spark, d), T.links(spark, d))


@query(f"WITH {LINKS}, {DEGREES} SELECT id, degree FROM degrees")
def graph_degree(spark, d):
    return graph.degrees(T.links(spark, d))


@query(f"WITH {LINKS}, {NODES}, {DEGREES} SELECT id, label, degree FROM nodes JOIN degrees USING (id) WHERE kind NOT IN ('nation', 'region') ORDER BY degree DESC, id LIMIT 1")
def graph_focus(spark, d):
    return graph.focus(T.nodes(spark, d), T.links(spark, d), F.col("kind").isin("nation", "region"))


@query(f"WITH {LINKS}, {NODES} SELECT source, target, relation, coalesce(a.label, source) AS source_label, coalesce(b.label, target) AS target_label FROM links LEFT JOIN nodes a ON a.id = source LEFT JOIN nodes b ON b.id = target WHERE source IN ('nation:3', 'supplier:7', 'customer:5') OR target IN ('nation:3', 'supplier:7', 'customer:5')")
def graph_edges_touching(spark, d):
    ids = spark.createDataFrame([("nation:3",), ("supplier:7",), ("customer:5",)], "id string")
    return graph.labelled(graph.touching(T.links(spark, d), ids), T.nodes(spark, d)).select("source", "target", "relation", "source_label", "target_label")


def _levels_sql(here: str, there: str, start: str) -> str:
    return f"WITH {LINKS}, one AS (SELECT {there} AS id, {here} AS parent, relation, 1 AS depth FROM links WHERE {here} = '{start}'), two AS (SELECT {there} AS id, {here} AS parent, links.relation, 2 AS depth FROM links JOIN (SELECT DISTINCT id FROM one WHERE id <> '{start}') f ON f.id = {here}) SELECT * FROM one UNION ALL SELECT * FROM two"


@query(_levels_sql("target", "source", "region:1"))
def graph_impact_d2(spark, d):
    return graph.traverse(T.links(spark, d), spark.createDataFrame([("region:1",)], "id string"), 2, reverse=True)


@query(_levels_sql("source", "target", "supplier:3"))
def graph_deps_d2(spark, d):
    return graph.traverse(T.links(spark, d), spark.createDataFrame([("supplier:3",)], "id string"), 2)


@query(f"WITH {NODES} SELECT id, label FROM nodes WHERE lower(label) = 'nation_1' OR lower(id) = 'nation_1'")
def graph_match_exact(spark, d):
    return graph.matching(T.nodes(spark, d), "NATION_1", ["id", "label"]).select("id", "label")


@query(f"WITH {NODES} SELECT id, label FROM nodes WHERE contains(lower(label), 'ation_2') OR contains(lower(id), 'ation_2')")
def graph_match_partial(spark, d):
    return graph.matching(T.nodes(spark, d), "ation_2", ["id", "label"]).select("id", "label")


@query("SELECT 'customer-' || o_custkey AS subject, 'order-' || o_orderkey AS object, o_orderdate AS valid_from FROM orders WHERE o_orderstatus = 'O' AND (contains('customer-' || o_custkey, 'omer-12') OR contains('order-' || o_orderkey, 'omer-12'))")
def triple_lookup_live(spark, d):
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.contains(fold(F.col("subject")), F.lit("omer-12")) | F.contains(fold(F.col("object")), F.lit("omer-12"))
    return T.triples(spark, d).filter(F.col("valid_until").isNull() & hit).select("subject", "object", "valid_from")


# ------------------------------------------------------------------ linker


@query("SELECT n.n_name AS identifier, r_name AS def_repo, 'schemas/' || n.n_nationkey || '.ts' AS def_path, c_mktsegment AS use_repo, 'src/' || c_custkey || '.ts' AS use_path, l AS use_line, r_name <> c_mktsegment AS cross_repo FROM customer JOIN nation n ON c_nationkey = n.n_nationkey JOIN region ON n.n_regionkey = r_regionkey, unnest([2, 3, 5]) t(l)")
def crossref_link(spark, d):
    code = T.code(spark, d)
    return linker.linked(linker.definitions(code), linker.usages(code))


@query("SELECT c_mktsegment AS repo, 'src/' || c_custkey || '.ts' AS path, 'other' AS identifier, 4 AS line FROM customer")
def crossref_usage_only(spark, d):
    code = T.code(spark, d)
    return linker.orphans(linker.definitions(code), linker.usages(code)).select("repo", "path", "identifier", "line")


# ------------------------------------------------------------------ cascade


def _envelope(spark, answer):
    n = answer.hits.count() if answer.hits is not None else 0
    answer.release()
    row = (answer.ok, n, ",".join(answer.layers_queried), ",".join(answer.layers_skipped), answer.escalated, answer.degraded)
    return spark.createDataFrame([row], "ok boolean, n_hits long, layers_queried string, layers_skipped string, escalated boolean, degraded boolean")


def _layer(spark, d, name, text, pair=None, without=None):
    """A layer over the texts that hold ``text``. without: and that do not hold this; a part of ``text`` leaves none, in any table."""
    docs = T.table(spark, d, "documents")
    if without is not None:
        docs = docs.filter(~F.contains("text", F.lit(without)))
    return cascade.Layer(name, lambda: docs.filter(F.contains("text", F.lit(text))).select(F.col("doc_id").alias("source"), F.lit(0).alias("chunk"), F.lit(name).alias("layer"), F.col("doc_id").alias("ord")), pair)


@query("SELECT true AS ok, count(*) AS n_hits, 'graph,vector,file' AS layers_queried, '' AS layers_skipped, true AS escalated, false AS degraded FROM documents WHERE contains(text, 'thin')")
def cascade_default(spark, d):
    return _envelope(spark, cascade.recall("thin", [_layer(spark, d, "graph", "thin", without="hin"), _layer(spark, d, "vector", "thin", without="thi"), _layer(spark, d, "file", "thin"), _layer(spark, d, "meta", "the")]))


@query("SELECT true AS ok, count(*) AS n_hits, 'graph,vector,keyword' AS layers_queried, 'graph' AS layers_skipped, false AS escalated, true AS degraded FROM documents WHERE contains(text, 'thin') OR contains(text, 'thou')")
def cascade_pair(spark, d):
    broken = cascade.Layer("graph", lambda: T.table(spark, d, "no_such_table"))
    return _envelope(spark, cascade.recall("thin", [broken, _layer(spark, d, "vector", "thin", "p"), _layer(spark, d, "keyword", "thou", "p"), _layer(spark, d, "file", "the")]))


# ------------------------------------------------------------------ ingestion


def _named_docs(spark, d):
    ext = F.get(F.array(*map(F.lit, (".txt", ".md", ".pdf", ".html"))), F.pmod("doc_id", F.lit(4)).cast("int"))
    return T.table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), ext).alias("filename"), "text")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'unsupported_format' WHEN strlen(text) > 20000 THEN 'too_large' WHEN doc_id % 4 = 2 THEN 'unsupported_parser' ELSE 'ok' END AS outcome FROM documents")
def ingest_gates(spark, d):
    return ingest.gates(_named_docs(spark, d), 20_000, 20_000).select("doc_id", "outcome")


@query()
def chunk_documents(spark, d):
    return ingest.chunk_rows(T.table(spark, d, "documents"), 4_000).select("doc_id", "chunk_index", "chunk_count", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))


@query()
def ingest_outcomes(spark, d):
    docs = T.table(spark, d, "documents")
    return ingest.outcomes(docs, ingest.chunk_rows(docs, 4_000))


@query(f"WITH {LINES} SELECT doc_id, line_no AS chunk_index, sha256(line) AS sha256 FROM lines WHERE doc_id % 5 <> 0 OR line_no <= 2")
def reindex_prune(spark, d):
    old = T.lines(T.files(spark, d)).select("doc_id", F.col("line_no").alias("chunk_index"), F.sha2("line", 256).alias("sha256"))
    fresh = old.filter((F.pmod("doc_id", F.lit(5)) == 0) & (F.col("chunk_index") <= 2))
    return ingest.reindexed(old, fresh)


@query("SELECT doc_id, CASE WHEN length(x) > 320 THEN left(x, 320) || ' …' ELSE x END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents)")
def excerpts(spark, d):
    return T.table(spark, d, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


# ------------------------------------------------------------------ web


@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>[\s\S]*?</script>', ' ', 'gi'), '<style\b[^>]*>[\s\S]*?</style>', ' ', 'gi'), '<!--[\s\S]*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', '''') AS t FROM a)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\f\v]+', ' ', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM b"""
)
def html_text(spark, d):
    return T.table(spark, d, "pages").select("page_id", net.html_text(F.col("html")).alias("text"))


@query(
    r"""WITH h AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS origin, regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"'']+)["'']', 1) AS hs FROM pages),
r AS (SELECT page_id, url, i - 1 AS ord, regexp_replace(CASE WHEN regexp_matches(hs[i], '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN hs[i] WHEN starts_with(hs[i], '//') THEN regexp_extract(url, '^([a-zA-Z]+:)', 1) || hs[i] WHEN starts_with(hs[i], '/') THEN origin || hs[i] ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || hs[i] END, '#.*$', '') AS link FROM h, unnest(generate_series(1, len(hs))) t(i))
SELECT page_id, ord::INT AS ord, link FROM r WHERE regexp_matches(link, '^https?://') AND lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#:]*)', 1)) = lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"""
)
def same_host_links(spark, d):
    return net.same_host_links(T.table(spark, d, "pages"))


@query(r"SELECT page_id, CASE WHEN starts_with(p, '/de/') THEN '/de/' WHEN starts_with(p, '/fr/1') THEN '/fr/1' END AS rule FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def robots_blocked(spark, d):
    robots = spark.createDataFrame([("all", "User-agent: other\nDisallow: /\n\nUser-agent: *  # every agent\nDisallow: /de/\nDisallow:\nAllow: /x\ndisallow: /fr/1")], "site string, text string")
    rules = net.disallow_rules(robots).select("ord", "rule")
    pages = T.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("p"))
    return pages.select("page_id").join(net.first_rules(pages, rules), "page_id", "left")


@query(
    "WITH a AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '10' WHEN 1 THEN '172' WHEN 2 THEN '192' WHEN 3 THEN '169' WHEN 4 THEN '127' ELSE '8' END AS a, c_custkey * 7 % 256 AS b FROM customer) SELECT c_custkey, CASE WHEN a = '127' THEN '127.0.0.0/8' WHEN a = '10' THEN '10.0.0.0/8' WHEN a = '172' AND b BETWEEN 16 AND 31 THEN '172.16.0.0/12' WHEN a = '192' AND b = 168 THEN '192.168.0.0/16' WHEN a = '169' AND b = 254 THEN '169.254.0.0/16' END AS blocked FROM a"
)
def cidr_blocked(spark, d):
    first = F.get(F.array(*map(F.lit, ("10", "172", "192", "169", "127", "8"))), F.pmod("c_custkey", F.lit(6)).cast("int"))
    ip = F.concat_ws(".", first, F.pmod(F.col("c_custkey") * 7, F.lit(256)).cast("string"), F.lit("3.4"))
    return T.table(spark, d, "customer").select("c_custkey", net.blocked_range(ip).alias("blocked"))


@query()
def crawl_frontier(spark, d):
    """From each of a site's first page, at most 5 pages: itself, then its own links in order, each once."""
    pages = T.table(spark, d, "pages")
    seeds = pages.withColumn("site", net.host(F.col("url"))).withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("page_id"))).filter("n = 1")
    found = net.same_host_links(seeds).groupBy("page_id", "link").agg(F.min("ord").alias("ord")).join(seeds.select("page_id", "url"), "page_id").filter("link <> url")
    every = found.select("page_id", F.col("link").alias("url"), "ord").unionByName(seeds.select("page_id", "url", F.lit(-1).alias("ord")))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).filter("rank <= 5").drop("ord")


# ------------------------------------------------------------------ administration

NAMES = "names AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'project-' || c_custkey WHEN 1 THEN 'enterprise-' || lower(c_mktsegment) WHEN 2 THEN 'clients_' || c_custkey ELSE 'project-enterprise-' || c_custkey END AS name FROM customer)"
PLACED = f"{NAMES}, placed AS (SELECT name, CASE WHEN starts_with(name, 'project-') AND NOT contains(name, 'enterprise-') THEN 'project' ELSE 'enterprise' END AS scope, contains(name, 'project-') = contains(name, 'enterprise-') AS needs_override FROM names)"


def _placed(spark, d):
    key = F.col("c_custkey").cast("string")
    name = F.get(F.array(F.concat(F.lit("project-"), key), F.concat(F.lit("enterprise-"), F.lower("c_mktsegment")), F.concat(F.lit("clients_"), key), F.concat(F.lit("project-enterprise-"), key)), F.pmod("c_custkey", F.lit(4)).cast("int"))
    return T.table(spark, d, "customer").select(name.alias("name")).select("name", admin.placement(F.col("name")).alias("p")).select("name", "p.*")


@query(f"WITH {PLACED} SELECT name, scope, 'org/' || scope || '/' || CASE WHEN needs_override THEN name WHEN scope = 'project' THEN substr(name, 9) ELSE substr(name, 12) END AS org_tree_path, needs_override FROM placed")
def placement_classify(spark, d):
    return _placed(spark, d)


@query(f"WITH {PLACED} SELECT scope, count(*) AS n, count(*) FILTER (needs_override) AS override_needed FROM placed GROUP BY scope")
def placement_summary(spark, d):
    return _placed(spark, d).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_override").alias("override_needed"))


@query("SELECT label::BIGINT AS collection, count(*) AS points FROM embeddings GROUP BY label")
def inventory_counts(spark, d):
    return T.table(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("collection")).agg(F.count(F.lit(1)).alias("points"))


@query("SELECT coalesce(n.k, o.k) AS repo_path, coalesce(n.v, o.v) AS owner, coalesce(o.ord, n.ord) AS ord FROM (SELECT s_suppkey AS k, s_name AS v, s_suppkey AS ord FROM supplier WHERE s_suppkey % 3 <> 0) o FULL OUTER JOIN (SELECT s_suppkey AS k, 'new ' || s_name AS v, 1000000 + s_suppkey AS ord FROM supplier WHERE s_suppkey % 2 = 0) n ON o.k = n.k")
def org_tree_upsert(spark, d):
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("repo_path"), F.col("s_name").alias("owner"), F.col("s_suppkey").alias("ord"))
    new = s.filter(F.pmod("repo_path", F.lit(2)) == 0).select("repo_path", F.concat(F.lit("new "), "owner").alias("owner"), (F.col("ord") + 1_000_000).alias("ord"))
    return admin.upsert(s.filter(F.pmod("repo_path", F.lit(3)) != 0), new, "repo_path", ["owner"])


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'given' WHEN c_custkey % 5 = 1 THEN 'top' WHEN c_custkey % 5 = 4 AND c_custkey % 2 = 1 THEN 'top' ELSE 'repo-' || c_nationkey END AS scope, c_custkey % 5 = 1 OR c_custkey % 5 = 2 OR (c_custkey % 5 = 4 AND c_custkey % 2 = 1) AS escalate FROM customer"
)
def scope_resolution(spark, d):
    fifth = F.pmod("c_custkey", F.lit(5)).cast("int")
    role = F.get(F.array(*map(F.lit, ("Dev", "Orchestrator", "architect", "developer", ""))), fifth)
    repo = F.when((fifth == 4) & (F.pmod("c_custkey", F.lit(2)) == 1), "").otherwise(F.concat(F.lit("repo-"), F.col("c_nationkey").cast("string")))
    return T.table(spark, d, "customer").select("c_custkey", admin.scope_of(role, F.when(fifth == 0, "given"), repo).alias("s")).select("c_custkey", "s.*")


@query("SELECT n_name AS scope, i - 1 AS step, [n_name, r_name, 'top'][i] AS searched FROM nation JOIN region ON n_regionkey = r_regionkey, unnest([1, 2, 3]) t(i)")
def ladder_walk(spark, d):
    nation, region = T.table(spark, d, "nation"), T.table(spark, d, "region")
    both = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    return both.select(F.col("n_name").alias("scope"), F.posexplode(F.array("n_name", "r_name", F.lit("top"))).alias("step", "searched"))


EVENTS = "e AS (SELECT CASE event_type WHEN 'signup' THEN 'runner_attempt' WHEN 'view' THEN 'runner_attempt' WHEN 'click' THEN 'runner_success' WHEN 'purchase' THEN 'fallback_triggered' WHEN 'error' THEN 'runner_failure' END AS event, 'runner-' || (user_id % 4) AS runner FROM events)"


@query(f"WITH {EVENTS} SELECT count(*) FILTER (event = 'runner_attempt') AS attempts, count(*) FILTER (event = 'fallback_triggered') AS fallbacks, count(*) FILTER (event = 'runner_success') AS successes, count(*) FILTER (event = 'runner_failure') AS failures, round(count(*) FILTER (event = 'fallback_triggered') / count(*) FILTER (event = 'runner_attempt'), 6) AS fallback_rate FROM e")
def runner_metrics(spark, d):
    return admin.run_metrics(T.runner_events(spark, d))


@query(f"WITH {EVENTS} SELECT runner, count(*) AS attempts FROM e WHERE event = 'runner_attempt' GROUP BY runner")
def runner_distribution(spark, d):
    return T.runner_events(spark, d).filter("event = 'runner_attempt'").groupBy("runner").agg(F.count(F.lit(1)).alias("attempts"))


@query(f"WITH {LINES} SELECT q, count(*) AS hits, sum(ceil(length(line) / 4.0))::BIGINT AS tokens, count(DISTINCT repo) AS layers FROM lines, unnest(['thin', 'reth', 'onand']) t(q) WHERE contains(line, q) GROUP BY q")
def ab_report(spark, d):
    asked = T.lines(T.files(spark, d)).withColumn("q", F.explode(F.array(*map(F.lit, ("thin", "reth", "onand")))))
    return asked.filter(F.contains("line", "q")).groupBy("q").agg(F.count(F.lit(1)).alias("hits"), F.sum(X.tokens(F.col("line"))).alias("tokens"), F.count_distinct("repo").alias("layers"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL AND text <> '' GROUP BY conv_id")
def transcript_last_message(spark, d):
    said = T.table(spark, d, "conversations").filter((F.col("role") == "assistant") & (F.col("text") != ""))
    return said.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


@query("SELECT c_mktsegment AS tier, c_custkey AS scope_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'default ' || c_mktsegment END AS body, CASE WHEN c_custkey % 3 = 0 THEN 'stored' ELSE 'default' END AS origin FROM customer")
def persona_fallback(spark, d):
    c = T.table(spark, d, "customer").select(F.col("c_mktsegment").alias("tier"), F.col("c_custkey").alias("scope_id"), F.col("c_name").alias("body"))
    defaults = c.select("tier").distinct().withColumn("default_body", F.concat(F.lit("default "), "tier"))
    return admin.with_fallback(c.select("tier", "scope_id"), c.filter(F.pmod("scope_id", F.lit(3)) == 0), defaults)


_LAYER = {"view": "vector", "click": "graph", "purchase": "file", "signup": "keyword", "error": "none"}


@query(
    """WITH c AS (SELECT user_id AS scope, CASE event_type WHEN 'view' THEN 'vector' WHEN 'click' THEN 'graph' WHEN 'purchase' THEN 'file' WHEN 'signup' THEN 'keyword' ELSE 'none' END AS layer FROM events)
SELECT scope, level, label, bool_or(list_contains(served, layer)) AS active FROM c, (VALUES (2, 'Graph', ['graph', 'code-graph']), (3, 'Vector', ['vector', 'keyword']), (4, 'File doc store', ['file'])) t(level, label, served) GROUP BY ALL"""
)
def memory_levels(spark, d):
    """The layers that each user has touched, as those configured for a scope."""
    layer = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in _LAYER.items() for x in pair)), "event_type"), F.lit("none"))
    return admin.levels_of(T.table(spark, d, "events").select(F.col("user_id").alias("scope"), layer.alias("layer")))


@query("SELECT doc_id, 'a' || chr(10) || '<!-- managed:begin -->' || chr(10) || 'new' || chr(10) || '<!-- managed:end -->' || chr(10) || source AS text, 'new' AS body FROM documents")
def managed_block(spark, d):
    old = F.concat(F.lit(f"a\n{X.BLOCK_BEGIN}\nold\n{X.BLOCK_END}\n"), "source")
    return T.table(spark, d, "documents").select("doc_id", X.spliced(old, "new").alias("text")).withColumn("body", X.block_body(F.col("text")))
