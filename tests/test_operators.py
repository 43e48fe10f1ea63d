"""Small cases of operators whose results SQL does not state, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import net
from lodestack.functions import textops as X
from lodestack.operators import admin, graph, ingest, lifecycle, linker, merge, search
from lodestack.plans import cascade, registry
from lodestack.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def chunked(text, most):
    data, out, at = text.encode(), [], 0
    while at < len(data):
        to = min(at + most, len(data))
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to -= 1
        out.append(data[at:to].decode())
        at = to
    return out


@pytest.mark.parametrize("text", ["", "a", "ab" * 20, "äöü€" * 13, "🙂" * 9, "a🙂é€" * 7, None])
def test_chunks_match_a_byte_model(spark, text):
    assert one(spark, X.chunks(F.col("t"), 8), t=text) == chunked(text or "", 8)


def test_headers(spark):
    assert one(spark, X.flight(F.col("t")), t="<!-- x status=confirmed branch=b/1 commit=zz -->")["commit_sha"] == "zz"
    assert one(spark, X.flight(F.col("t"), strict=True), t="<!-- x status=confirmed branch=b/1 commit=zz -->") is None
    assert one(spark, X.flight(F.col("t")), t="status=unknown branch=b commit=c") is None


@pytest.mark.parametrize(("header", "branch", "all_", "want"), [(None, None, False, True), ("confirmed", None, False, True), ("provisional", "b", False, True), ("provisional", "c", False, False), ("provisional", None, False, False), ("provisional", None, True, True), ("superseded", "b", False, False), ("superseded", "b", True, True)])
def test_visibility(spark, header, branch, all_, want):
    text = f"<!-- x status={header} branch=b commit=abcdef0 -->" if header else "no header"
    assert one(spark, lifecycle.visible(X.flight(F.col("t")), branch, all_), t=text) is want


def test_events_apply_once(spark):
    notes = spark.createDataFrame([(1, "provisional", "b", "c1"), (2, "provisional", "x", "c2"), (3, "confirmed", "b", "c3"), (4, "provisional", "y", "c4")], "note_id long, status string, branch string, commit_sha string")
    events = spark.createDataFrame([("branch", "b", "superseded"), ("commit", "c2", "confirmed")], "kind string, value string, to string")
    once = lifecycle.apply_events(notes, events).select(*notes.columns)
    assert {r.note_id: r.status for r in once.collect()} == {1: "superseded", 2: "confirmed", 3: "confirmed", 4: "provisional"}
    again = lifecycle.apply_events(once, events)
    assert not again.filter("changed").count()


def test_address_ranges(spark):
    want = {"127.9.9.9": "127.0.0.0/8", "172.15.0.1": None, "172.31.255.1": "172.16.0.0/12", "8.8.8.8": None, "::1": "::1/128", "fd00::12": "fc00::/7", "fe90::1": "fe80::/10", "2001:db8::1": None}
    df = spark.createDataFrame([(k,) for k in want], "ip string").select("ip", net.blocked_range(F.col("ip")).alias("r"))
    assert {r.ip: r.r for r in df.collect()} == want


def test_every_robots_rule_is_applied(spark):
    rules = spark.createDataFrame([(i, f"/{i}/") for i in range(1_500)] + [(2_000, "/7")], "ord int, rule string")
    pages = spark.createDataFrame([(i, f"/{i}/x") for i in range(1_600)] + [(-1, ""), (-2, None), (-3, "/7")], "page_id int, p string")
    got = {r.page_id: r.rule for r in net.first_rules(pages, rules).collect()}
    assert got == {i: f"/{i}/" for i in range(1_500)} | {-3: "/7"}
    assert net.first_rules(pages, rules.limit(0)).count() == 0


def test_packing(spark):
    hits = spark.createDataFrame(
        [("q", "meta", "semantic", 0.5, "a", 1, "x" * 60), ("q", "vector", "semantic", 0.9, "b", 1, "y" * 2000), ("q", "vector", "keyword", None, "c", 1, "z"), ("q", "other", "semantic", 0.99, "d", None, "w")],
        "g string, layer string, match_type string, score double, source string, chunk int, text string",
    )
    ranked = merge.ranked(hits, "g")
    assert [r.source for r in ranked.orderBy("rank").collect()] == ["a", "c", "b", "d"]
    row = merge.packed(ranked, "g", 60, 3).first()
    assert (row.n_shown, row.skipped) == (3, 1) and row.bundle.startswith("1. [meta · score 0.50] a chunk 1")


def test_dedupe_and_hybrid(spark):
    hits = spark.createDataFrame([("s", 1, "vector", 1), ("s", 1, "keyword", 2), ("s", 1, "vector", 3), ("t", None, "file", 4)], "source string, chunk int, layer string, ord int")
    assert {(r.source, r.layer, r.also_matched) for r in merge.dedupe(hits).collect()} == {("s", "vector", "keyword"), ("t", "file", "")}
    v = spark.createDataFrame([("p", "a", 0, 0.5, 1), ("p", "b", None, 0.4, 2)], "scope string, source string, chunk int, score double, ord int")
    k = spark.createDataFrame([("p", "b", None, 1), ("p", "c", 0, 2)], "scope string, source string, chunk int, ord int")
    assert [(r.source, r.match_type) for r in merge.hybrid(v, k).orderBy("rank").collect()] == [("a", "semantic"), ("b", "both"), ("c", "keyword")]


def walked(edges, start, depth):
    seen, frontier, out = {start}, [start], []
    for d in range(1, depth + 1):
        new = []
        for n in frontier:
            for s, t in edges:
                if s == n:
                    out.append((t, n, d))
                    if t not in seen:
                        seen.add(t)
                        new.append(t)
        frontier = new
    return sorted(out)


def test_traversal_matches_a_walk(spark):
    rng = random.Random(3)
    edges = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(30)})
    links = spark.createDataFrame([(a, b, "r") for a, b in edges], "source string, target string, relation string")
    got = graph.traverse(links, spark.createDataFrame([("n1",)], "id string"), 3)
    assert sorted((r.id, r.parent, r.depth) for r in got.collect()) == walked(edges, "n1", 3)
    assert graph.traverse(links, spark.createDataFrame([("none",)], "id string"), 3).count() == 0


def test_ancestors_have_no_bound_unless_given(spark):
    commits = spark.createDataFrame([(f"c{i}", f"c{i - 1}", "parent") for i in range(1, 7)], "source string, target string, relation string")
    tips = spark.createDataFrame([("c6",)], "id string")
    assert graph.ancestors.__defaults__ == (None,)
    assert {r.id for r in graph.ancestors(commits, tips).collect()} == {f"c{i}" for i in range(7)}
    assert {r.id for r in graph.ancestors(commits, tips, 2).collect()} == {"c6", "c5", "c4"}


def test_linker(spark):
    files = spark.createDataFrame([("a", "d.ts", "x\nname: 'tool',\n title: 't',\n type: \"document\""), ("a", "n.ts", "name: 'w', type: 'string'"), ("b", "u.ts", '\n\n*[_type == "tool"]\n*[_type in ["tool", `gadget`]]')], "repo string, path string, text string")
    defs, uses = linker.definitions(files), linker.usages(files)
    assert [(r.identifier, r.line) for r in defs.collect()] == [("tool", 2)]
    assert sorted((r.identifier, r.line) for r in uses.collect()) == [("gadget", 4), ("tool", 3), ("tool", 4)]
    assert linker.linked(defs, uses).filter("cross_repo").count() == 2
    assert [r.identifier for r in linker.orphans(defs, uses).collect()] == ["gadget"]


def layer(spark, name, n, pair=None, fail=False):
    def hits():
        if fail:
            raise RuntimeError("down")
        return spark.createDataFrame([(f"s{i}", i, name, i) for i in range(n)], "source string, chunk int, layer string, ord int")

    return cascade.Layer(name, hits, pair)


def test_cascade(spark):
    a = cascade.recall("q", [layer(spark, "a", 0), layer(spark, "b", 2), layer(spark, "c", 9, fail=True)])
    assert (a.ok, a.layers_queried, a.escalated, a.degraded, a.hits.count()) == (True, ["a", "b"], False, False, 2)
    b = cascade.recall("q", [layer(spark, "a", 0), layer(spark, "b", 0)])
    assert (b.ok, b.escalated, b.hits.count()) == (True, True, 0)
    c = cascade.recall("q", [layer(spark, "a", 0), layer(spark, "b", 0, fail=True)])
    assert (c.ok, c.error, c.degraded) == (False, "down", True)
    d = cascade.recall("q", [layer(spark, "v", 2, "p"), layer(spark, "k", 2, "p")])
    assert d.hits.count() == 2 and {r.also_matched for r in d.hits.collect()} == {"k"}
    assert cascade.recall(" ", []).error == "invalid_query" and cascade.recall("q", []).error == "no_layers_configured"


def test_default_cascade_passes_its_empty_layers_in_any_table(spark, tmp_path):
    """Texts with words that were once held to be in no table."""
    rows = [(1, "no such text"), (2, "nor this one"), (3, "the thin one, nor this one"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.cascade_default(spark, str(tmp_path)).first()
    assert got[:] == (True, 1, "graph,vector,file", "", True, False)


def test_search(spark):
    files = spark.createDataFrame([("a/b/1.md", "a/b", "r", 1, "x.*y\r\nXy"), ("top.md", "", "r", 2, None)], "path string, area string, repo string, doc_id long, text string")
    assert [r.line_no for r in search.literal(files, ".*").collect()] == [1]
    assert search.literal(files, "xY", ignore_case=True).count() == 1
    assert search.literal(files, "x", area="no/such").count() == 1
    with pytest.raises(ValueError):
        search.literal(files, "  ")
    assert [one(spark, X.area_of(F.col("p")), p=p) for p in ("top.md", "a/x", "a/b/c/x")] == ["", "a", "a/b"]


def test_placement_and_scopes(spark):
    names = {"project-atlas": ("project", "org/project/atlas", False), "clients_project-atlas_memory": ("project", "org/project/atlas_memory", False), "enterprise-shared": ("enterprise", "org/enterprise/shared", False), "clients_memory": ("enterprise", "org/enterprise/clients_memory", True), "project-enterprise-shared": ("enterprise", "org/enterprise/project-enterprise-shared", True)}
    df = spark.createDataFrame([(k,) for k in [*names, " "]], "n string").select("n", admin.placement(F.col("n")).alias("p"))
    assert {r.n: r.p and tuple(r.p) for r in df.collect()} == {**names, " ": None}
    assert one(spark, admin.repo_name(F.col("t")), t="git@host.org:team/Repo.git") == "repo"


def test_blocks(spark):
    first = one(spark, X.spliced(F.col("t"), "new"), t="human\n")
    again = one(spark, X.spliced(F.col("t"), "new"), t=first)
    assert first == again and one(spark, X.block_body(F.col("t")), t=again) == "new"
    assert "old" not in one(spark, X.spliced(F.col("t"), "newer"), t=first.replace("new", "old"))


def test_ingest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a.txt", "x" * 30), (2, "b.exe", "x"), (3, "c.md", ""), (4, "d.txt", " " * 8), (5, "e.pdf", "x")], "doc_id long, filename string, text string")
    assert {r.doc_id: r.outcome for r in ingest.gates(docs, 20).collect()} == {1: "too_large", 2: "unsupported_format", 3: "ok", 4: "ok", 5: "unsupported_parser"}
    out = {r.doc_id: (r.chunk_count, r.failed, r.ok) for r in ingest.outcomes(docs, ingest.chunk_rows(docs, 8)).collect()}
    assert out[3] == (0, 0, True) and out[4] == (1, 1, False) and out[1] == (4, 0, True)
    note = spark.createDataFrame([("top", "provisional", "b", "abcdef0", "text")], "scope string, status string, branch string, commit_sha string, body string")
    assert ingest.append_note(str(tmp_path / "notes"), note) == 1
    with pytest.raises(ValueError):
        ingest.append_note(str(tmp_path / "notes"), note.withColumn("body", F.lit(" ")))


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "promote", "2026-01-01 00:00:00"), (1, "supersede", "2026-01-02 00:00:00"), (2, "supersede", "2026-01-01 00:00:00")], "note_id long, kind string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(source)
    stream = spark.readStream.schema(jobs.EVENT).parquet(source)
    q = jobs.lifecycle(stream).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.note_id, r.status) for r in spark.table("states").collect()} == {(1, "confirmed"), (2, "superseded")}
    files = str(tmp_path / "files")
    spark.createDataFrame([("a/1.md", "a", "# T")], "path string, area string, text string").write.parquet(files)
    for _ in range(2):
        jobs.continuous_index(spark, files, "path string, area string, text string", str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).count() == 1
