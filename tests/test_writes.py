"""Guarded writes, readers of what they leave, hooks, version events, layers: cases that SQL does not state."""

import pytest
from pyspark.sql import functions as F

from lodestack.functions import hooks
from lodestack.operators import gitevents, graph, lifecycle, linker, merge, recall, scopes, search, writes
from lodestack.plans import cascade
from lodestack.sources import readers

NOTE = "note_id long, scope string, status string, branch string, commit_sha string, body string"
SCOPES = "scope string, collection string, ladder array<string>"


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([("project", "p_main", ["top"]), ("top", "t_main", None)], SCOPES)


def test_remember_writes_note_and_chunks_or_nothing(spark, known, tmp_path):
    path = str(tmp_path / "store")
    good = spark.createDataFrame([(1, "project", "confirmed", "main", "abc1234", "x" * 9_000), (2, "top", "provisional", "b", "abc1234", "short")], NOTE)
    out = writes.remember(good, known, path)
    assert (out.ok, out.notes, out.chunks) == (True, 2, 4)
    assert spark.read.parquet(f"{path}/chunks").count() == 4 and spark.read.parquet(f"{path}/notes").filter("header like '%status=provisional branch=b%'").count() == 1
    assert writes.remember(good, known, path, layer="file").chunks == 0
    assert spark.read.parquet(f"{path}/chunks").count() == 4
    blank = spark.createDataFrame([(3, "project", None, None, None, "  ")], NOTE)
    assert writes.remember(blank, known, path).code == "invalid_content"
    lost = spark.createDataFrame([(3, "nowhere", None, None, None, "text")], NOTE)
    answer = writes.remember(lost, known, path)
    assert answer.code == "unknown_scope" and answer.error == "known scopes: project, top"
    assert writes.remember(good.limit(0), known, path).code == "invalid_content"
    assert spark.read.parquet(f"{path}/notes").count() == 4


def test_write_cascade_tells_the_parts_that_failed():
    fails = ("vector", lambda: writes.Written(False, "vector", code="nothing_indexed"))
    breaks = ("graph", lambda: 1 / 0)
    works = ("file", lambda: writes.Written(True, "file", 1))
    out = writes.remember_cascade([fails, breaks, works])
    assert out.ok and out.layer == "file" and out.failed_parts == ["vector: nothing_indexed", "graph: write_failed"]
    assert writes.remember_cascade([fails, works], layer="vector").code == "nothing_indexed"
    assert writes.remember_cascade([works], layer="meta").code == "unknown_layer"
    assert writes.remember_cascade([fails]).code == "all_layers_failed"


def test_collections_and_scopes_are_made_in_two_steps(spark, known):
    held = spark.createDataFrame([("p_main", 768)], "collection string, dimension int")
    c, s, told = writes.create_collection_and_scope(held, known, "q_main", "q", 768)
    assert c.count() == 2 and s.count() == 3 and told.first().asDict() == {"collection_created": True, "scope_written": True, "error": None}
    c, s, told = writes.create_collection_and_scope(held, known, "q_main", "project", 768)
    assert c.count() == 2 and s.count() == 2 and told.first().error == "scope is mapped to p_main"
    assert writes.create_collection_and_scope(held, known, "p_main", "project", 768)[2].first().asDict() == {"collection_created": False, "scope_written": False, "error": None}
    assert writes.create_collection_and_scope(held, known, "-bad", "q", 768)[2].first().error == "malformed collection"
    assert writes.create_collection_and_scope(held, known, "q_main", "Bad Scope", 768)[2].first().error == "malformed scope"


def test_files_that_writers_leave_are_read_back(spark, tmp_path):
    at = str(tmp_path / "metrics")
    assert readers.metric_lines(spark, at).count() == 0
    writes.record_metric(spark, at, "runner_attempt", "a", "2026-01-01T00:00:00Z")
    writes.record_metric(spark, at, "runner_success", "a", "2026-01-01T00:00:01Z", "ok")
    assert {r.event for r in readers.metric_lines(spark, at).collect()} == {"runner_attempt", "runner_success"}
    inventory = str(tmp_path / "inventory")
    with pytest.raises(FileNotFoundError):
        readers.inventory(spark, inventory)
    assert writes.write_inventory(spark.createDataFrame([("b", 2), ("a", 1)], "collection string, points long"), inventory) == 2
    assert {(r.collection, r.points) for r in readers.inventory(spark, inventory).collect()} == {("a", 1), ("b", 2)}
    personas = str(tmp_path / "personas")
    assert readers.personas(spark, personas).count() == 0
    schema = readers.PERSONA
    writes.write_persona(spark.createDataFrame([("meta", "m", "M", [("h", "b")], [])], schema), personas)
    with pytest.raises(ValueError, match="x: unknown tier, no sections"):
        writes.write_persona(spark.createDataFrame([("team", "x", "X", [], [])], schema), personas)
    assert scopes.listed(readers.personas(spark, personas).withColumn("state", F.lit(None).cast("string"))).collect() == [("meta", "m")]
    assert readers.org_tree(spark, str(tmp_path / "none")).count() == 0


def test_trees_manifests_and_contexts(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in (("a/b/c/deep.md", "# One\ntext"), ("a/top.md", "x\n" * 60), ("node_modules/no.md", "no"), ("a/code.ts", "name: 'n1', type: 'document'"), ("a/pic.png", "p")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = readers.text_tree(spark, str(root), readers.REINDEXED)
    assert {r.path for r in files.collect()} == {"a/b/c/deep.md", "a/top.md", "a/code.ts"}
    assert readers.text_tree(spark, str(root / "gone")).count() == 0
    area = lambda a: {r.path for r in search.in_area(files, a).collect()}
    assert area("a/b") == {"a/b/c/deep.md"} and area("a") == {"a/top.md", "a/code.ts"} and area("no/where") == area(None)
    at = str(tmp_path / "manifest")
    assert readers.manifest(spark, at) is None
    readers.write_manifest(search.file_index(files), at)
    assert {r.path: [h.text for h in r.headings] for r in readers.manifest(spark, at).collect()}["a/b/c/deep.md"] == ["One"]
    got = {r.name: r for r in readers.context(files, [["a/none.md", "a/top.md"], ["gone.md"], ["a/code.ts"]]).collect()}
    assert set(got) == {"a/none.md", "a/code.ts"} and got["a/none.md"].path == "a/top.md" and got["a/none.md"].excerpt.endswith("…[truncated]")


def test_lines_of_matches(spark):
    text = "_type == 'a'\n_type in [\n  'b',\n  \"c\", 'd\"\n]\n_type == 'a'\nname: 'x',\n\ntype: 'document'\nname: `y`, type: 'other'"
    files = spark.createDataFrame([("r", "p", text)], "repo string, path string, text string")
    assert sorted((r.identifier, r.line) for r in linker.usages(files).collect()) == [("a", 1), ("a", 6), ("b", 3), ("c", 4)]
    assert [(r.identifier, r.line) for r in linker.definitions(files).collect()] == [("x", 7)]


def test_hits_search_the_texts_once(spark):
    """All hits of a name: read from what one search of the texts found, and not sorted."""
    files = spark.createDataFrame([("r", f"p{i}", "_type == 'other'") for i in range(3)] + [("r", "d", "name: 'x', type: 'document'"), ("r", "n", None)], "repo string, path string, text string")
    got = linker.hits(linker.definitions(files), linker.usages(files), "OTH", most=None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "rangepartitioning" not in plan
    assert sorted(r.source for r in got.collect()) == ["p0:1", "p1:1", "p2:1"]
    assert [r.source for r in linker.hits(linker.definitions(files), linker.usages(files), "OTH", most=2).collect()] == ["p0:1", "p1:1"]


def test_other_schemes_join_in(spark):
    found = lambda kind: lambda files: files.select("repo", "path", F.lit(kind).alias("kind"), F.col("text").alias("identifier"), F.lit(1).alias("line"))
    files = spark.createDataFrame([("r", "p", "name: 'x', type: 'document'")], "repo string, path string, text string")
    defs, uses = linker.scanned(files, [linker.SCHEMES["document-types"], linker.Scheme("whole", found("definition"), found("usage"))])
    assert {(r.scheme, r.identifier) for r in defs.collect()} == {("document-types", "x"), ("whole", "name: 'x', type: 'document'")}
    assert uses.count() == 1


def test_matching_takes_quotes_as_they_are(spark):
    nodes = spark.createDataFrame([("n1", "it's", None), ("n2", "other", "IT'S here")], "id string, label string, norm_label string")
    assert [r.id for r in graph.matching(nodes, "IT'S", ["id", "label", "norm_label"]).collect()] == ["n1"]
    assert [r.id for r in graph.matching(nodes, "t's h", ["id", "label", "norm_label"]).collect()] == ["n2"]


def test_reverse_walk_is_ordered_and_limited(spark):
    edges = spark.createDataFrame([("src/consumer.ts", "depends_on", "src/core.ts", "2"), ("src/feature.ts", "implements", "src/consumer.ts", "1"), ("src/core.ts", "depends_on", "src/feature.ts", "3"), ("src/b.ts", "uses", "src/core.ts", "1")], "src string, predicate string, dst string, created_at string")
    got = graph.walk_back(edges, "src/core.ts").collect()
    assert [(r.src, r.depth) for r in got] == [("src/b.ts", 1), ("src/consumer.ts", 1), ("src/feature.ts", 2), ("src/core.ts", 3)]
    assert got[2].via == "src/feature.ts --implements--> src/consumer.ts --depends_on--> src/core.ts"
    assert graph.walk_back(edges, "src/core.ts", 2).count() == 2 and graph.walk_back(edges, "nothing").count() == 0


def test_document_nodes_want_a_line(spark):
    schema = "id string, label string, file_type string, source_file string, source_location string"
    with pytest.raises(Exception, match="document node without a line: d1"):
        graph.node_hits(spark.createDataFrame([("d1", "D", "document", "a.md", "12")], schema)).collect()
    assert graph.node_hits(spark.createDataFrame([("d1", "D", "document", "a.md", "L12")], schema)).first().content == 'Doc: "D" -- a.md:L12'


def test_headers_that_are_none_are_not_rewritten(spark):
    with pytest.raises(Exception, match="no note header"):
        spark.createDataFrame([("plain\ntext",)], "t string").select(writes.with_status(F.col("t"), F.lit("confirmed"))).collect()


def test_sections_that_are_missing_fail(spark):
    with pytest.raises(Exception, match="no sections below: Rules"):
        spark.createDataFrame([("# T\n## Other\n### x\n\ny",)], "t string").select(hooks.subsections(F.col("t"), "Rules")).collect()


def test_events_end_where_they_should(spark):
    rows = [(1, "committed", f"abc {'0' * 64} refs/heads/x/y\nbad line\n"), (2, "prepared", f"abc {'0' * 40} refs/heads/z")]
    deleted = gitevents.deleted_branches(spark.createDataFrame(rows, "ord int, state string, text string"))
    assert [(r.branch, r.commit_sha) for r in deleted.collect()] == [("x/y", "abc")]
    notes = spark.createDataFrame([(1, "provisional", "x/y", "s1"), (2, "confirmed", "x/y", "s2"), (3, "provisional", "q", "s3")], "note_id long, status string, branch string, commit_sha string")
    out = lifecycle.apply_events(notes, gitevents.supersede_events(deleted))
    assert {r.note_id: r.status for r in out.collect()} == {1: "superseded", 2: "confirmed", 3: "provisional"}
    merges = spark.createDataFrame([("main", "Merge branch 'q'", []), ("main", "Merge branch 'q'", ["s3", "s9"])], "branch string, subject string, commits array<string>")
    assert {(r.kind, r.value) for r in gitevents.promote_events(merges, "main").collect()} == {("branch", "q"), ("commit", "s3"), ("commit", "s9")}
    assert gitevents.promote_events(merges, "other").count() == 0


def test_graph_hits_without_scopes_make_their_own(spark):
    none = spark.createDataFrame([], "scope string, scope_ord int, source string, score double, ord long")
    hits = spark.createDataFrame([("g1", 0.9, 1), ("g2", 1.0, 2)], "source string, score double, ord long")
    assert [(r.scope, r.source, r["rank"]) for r in recall.with_graph(none, hits).orderBy("rank").collect()] == [("code-graph", "g2", 1), ("code-graph", "g1", 2)]
    some = spark.createDataFrame([("a", 0, "v1", 0.1, 1), ("a", 0, "v2", 0.5, 2)], none.schema)
    assert [r.source for r in recall.with_graph(some, hits.limit(0)).orderBy("rank").collect()] == ["v1", "v2"]
    assert [r.source for r in recall.with_graph(some, hits).orderBy("rank").collect()] == ["g2", "g1", "v2", "v1"]


def test_ranks_over_many_ranges_are_those_of_one_sort(spark):
    rows = [(k * 7919 % 1009, k) for k in range(1009)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    assert [(r.a, r["rank"]) for r in merge.numbered(df, [F.col("a")]).orderBy("rank").collect()] == [(k, k + 1) for k in range(1009)]


def test_layers_by_name(spark):
    files = spark.createDataFrame([("s/en/1.md", "s/en", "s", 1, "one\ntwo thin")], "path string, area string, repo string, doc_id long, text string")
    nodes = spark.createDataFrame([("n", "label")], "id string, label string")
    tables = {"files": files, "nodes": nodes}
    answer = cascade.recall("thin", cascade.layers_of(["graph", "file"], tables, "thin"))
    assert answer.ok and not answer.escalated and answer.layers_queried == ["graph", "file"] and [(r.source, r.chunk, r.layer) for r in answer.hits.collect()] == [(1, 2, "file")]
    answer.release()
    with pytest.raises(ValueError, match="unknown layers"):
        cascade.layers_of(["nothing"], tables, "x")
    with pytest.raises(ValueError, match="registered already"):
        cascade.register_layer("file", lambda t, q: files)
    assert set(cascade.LAYERS) >= {"file", "keyword", "vector", "graph", "triples", "crossref"}
    out = cascade.with_fallback(lambda: spark.read.parquet("/nowhere"), lambda: files.select("doc_id"))
    assert out.first().degraded and not cascade.with_fallback(lambda: files.select("doc_id"), lambda: files).first().degraded


def test_links_are_resolved_as_a_browser_does(spark):
    base = "http://h.org/a/b/c.html?q=1#top"
    links = {"#x": "http://h.org/a/b/c.html?q=1", "?p=2": "http://h.org/a/b/c.html?p=2", "d.html#y": "http://h.org/a/b/d.html", "../e": "http://h.org/a/e", "./f/./g/../h": "http://h.org/a/b/f/h", "../../../..": "http://h.org/", "/i?j=k/../l": "http://h.org/i?j=k/../l", "//other.org/x": "http://other.org/x", "https://h.org/z": "https://h.org/z", "mailto:a@b.c": "mailto:a@b.c"}
    from lodestack.functions import net

    rows = spark.createDataFrame([(base, h) for h in links], "b string, h string").select("h", net.resolved(F.col("b"), F.col("h")).alias("r")).collect()
    assert {r.h: r.r for r in rows} == links


def test_graph_hits_in_a_scope_of_most_rows(spark):
    """Ranks of one large first scope are numbered over several ranges, without gaps, and the other scope keeps its order."""
    hits = spark.range(6000).selectExpr("if(id % 10 = 0, 'b', 'a') AS scope", "if(id % 10 = 0, 1, 0) AS scope_ord", "'v' || id AS source", "if(id % 7 = 0, null, (id % 50) / 50D) AS score", "id AS ord")
    graph_hits = spark.range(2000).selectExpr("'g' || id AS source", "(id % 25) / 25D AS score", "id AS ord")
    rows = recall.with_graph(hits, graph_hits).collect()
    least = float("-inf")
    first = sorted((r for r in rows if r.scope == "a"), key=lambda r: (-(least if r.score is None else r.score), r.source[0] == "g", r.ord))
    assert [r["rank"] for r in first] == list(range(1, 7401))
    assert [r["rank"] for r in sorted((r for r in rows if r.scope == "b"), key=lambda r: r.ord)] == list(range(1, 601))
