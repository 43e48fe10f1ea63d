"""Readers over real folders, and guarded scope and persona writes."""

import json

import pytest
from pyspark.sql import functions as F

from lodestack.operators import scopes
from lodestack.sources import readers, tables


def test_text_tree(spark, tmp_path):
    for name, data in {"a/b/x.md": b"# hi\r\nthere", "top.ts": b"code", "node_modules/y.md": b"no", "a/bin.md": b"\xff\xfe"}.items():
        at = tmp_path / "root" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    root = str(tmp_path / "root")
    got = {r.path: (r.area, r.text) for r in readers.text_tree(spark, root).collect()}
    assert got == {"a/b/x.md": ("a/b", "# hi\r\nthere"), "top.ts": ("", "code"), "a/bin.md": ("a", None)}
    assert {r.path for r in readers.text_tree(spark, root, ("ts",)).collect()} == {"top.ts"}
    names = spark.createDataFrame([("top.ts",), ("gone.md",)], "path string")
    read, missing = readers.requested(readers.text_tree(spark, root), names)
    assert read.count() == 1 and [r.path for r in missing.collect()] == ["gone.md"]
    assert readers.first_of(readers.text_tree(spark, root), ["no.md", "top.ts", "a/b/x.md"]).first().path == "top.ts"


def test_graph_document(spark, tmp_path):
    at = tmp_path / "graph.json"
    doc = {"nodes": [{"id": "a", "label": "A", "file_type": "code"}, {"id": "d", "file_type": "document", "source_location": "L3"}], "links": [{"source": "a", "target": "d", "relation": "cites", "confidence_score": 0.5}]}
    at.write_text(json.dumps(doc))
    nodes, links = readers.graph_document(spark, str(at))
    assert nodes.count() == 2 and links.first().relation == "cites"
    doc["nodes"][1]["source_location"] = "line 3"
    at.write_text(json.dumps(doc))
    with pytest.raises(Exception, match="document node without a line"):
        readers.graph_document(spark, str(at))[0].collect()


def test_metric_lines_and_manifest(spark, tmp_path):
    assert readers.metric_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "m.jsonl").write_text('{"event":"runner_attempt","runner":"r","timestamp":"2026-01-01T00:00:00Z"}\n')
    assert readers.metric_lines(spark, str(tmp_path / "m.jsonl")).first().runner == "r"
    assert readers.manifest(spark, str(tmp_path / "index")) is None


def test_scopes(spark):
    table = spark.createDataFrame([("top", "all", [])], "scope string, collection string, ladder array<string>")
    more = scopes.add_scope(table, "repo", "repo_memory", ["top"])
    assert [(r.step, r.searched) for r in scopes.ladder_of(more).filter("scope = 'repo'").orderBy("step").collect()] == [(0, "repo"), (1, "top")]
    assert scopes.add_scope(more, "repo", "repo_memory", []).count() == 2
    for name, collection, ladder, code in (("repo", "other", [], "409"), ("Bad name", "x", [], "400"), ("new", "x", ["nowhere"], "422")):
        with pytest.raises(ValueError, match=code):
            scopes.add_scope(more, name, collection, ladder)
    wanted = spark.createDataFrame([("top",), ("x",)], "scope string")
    assert {(r.collection, r.fallback_used) for r in scopes.collections_of(wanted, more, "spare").collect()} == {("all", False), ("spare", True)}


def test_personas(spark):
    schema = "tier string, scope_id string, display_name string, sections array<struct<heading:string,body:string>>, parents array<struct<tier:string,scope_id:string>>"
    rows = [("meta", "m", "Main", [("Voice", "plain\n\n\n\nend")], []), ("project", "p", " ", [], [("project", "m")])]
    df = spark.createDataFrame(rows, schema)
    got = df.select("scope_id", scopes.violations(*(F.col(c) for c in df.columns)).alias("v"), scopes.rendered(F.col("sections")).alias("md")).collect()
    assert got[0].v == [] and got[0].md == "## Voice\n\nplain\n\nend"
    assert got[1].v == ["display name is blank", "no sections", "a parent of a tier that is not global"]
    assert scopes.parent_sections(df).first().display_name is None
    drafts = df.select("tier", "scope_id").withColumn("state", F.lit("draft")).withColumn("disposed_at", F.lit(None).cast("string"))
    assert {r.scope_id: r.state for r in scopes.disposed(drafts, "meta", "m", "approved", "2026").collect()} == {"m": "approved", "p": "draft"}


def test_keys_of_links_are_told_apart_in_tasks_of_a_set_size(spark, monkeypatch):
    """No more tasks' worth of rows in one task, whatever the session's partitions, and numbers, not texts, are compared."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    pairs = spark.range(3_000).selectExpr("id % 500 a", "if(id % 500 = 7, null, id % 3) b")
    got = tables.distinct(pairs)
    assert got.rdd.getNumPartitions() == 30 and got.count() == len({tuple(r) for r in pairs.collect()})
    assert tables.distinct(pairs.limit(0)).count() == 0
    plan = tables.links(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_suppkey" in plan and "Aggregate [source" not in plan
