"""Indexes, continuous indexing, keyed state over micro-batches and reachability, against scans and batch answers."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.functions.textops import tokens
from lodestack.operators import admin, graph, merge, reach, search, text_index, vector_index, writes
from lodestack.plans import index_queries
from lodestack.sources import tables as T
from lodestack.sources.shared import cut, drop_cuts
from lodestack.streaming import index, state

FOLDER = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- vectors


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((12, 16))
    m = centers[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 16)) * 0.6
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(m)] + [(9001, 0, None), (9002, 0, []), (9003, 0, [0.0] * 16), (9004, 0, [float("nan")] * 16), (9005, 1, [None] + [1.0] * 15)]
    path = str(tmp_path_factory.mktemp("vectors") / "index")
    vector_index.build(spark.createDataFrame(rows, "vec_id long, scope int, embedding array<double>"), path)
    return m, path


def exact(m, x, hits):
    s = np.round(m @ x / np.linalg.norm(m, axis=1) / np.linalg.norm(x), 6)
    return [(int(i), float(s[i])) for i in np.lexsort((np.arange(len(m)), -s))[:hits]]


def test_few_lists_hold_nearly_all_neighbours(spark, vectors):
    m, path = vectors
    queries = spark.createDataFrame([(i, m[i].tolist()) for i in range(0, 1500, 15)] + [(7777, None)], "query_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in vector_index.search(spark, path, queries, 10).collect()}
    true = {(q, i) for q in range(0, 1500, 15) for i, _ in exact(m, m[q], 10)}
    assert len(got & true) >= 0.9 * len(true)
    lists, _ = vector_index.centroids(spark, path)
    assert vector_index.probes(spark, path) < len(lists)


def test_all_lists_are_exact(spark, vectors):
    m, path = vectors
    queries = spark.createDataFrame([(i, m[i].tolist()) for i in (3, 700)], "query_id long, embedding array<double>")
    got = vector_index.search(spark, path, queries, 7, probe=10_000).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, pytest.approx(r.score, abs=2e-6)) for r in got] == exact(m, m[3], 7) + exact(m, m[700], 7)
    one = vector_index.near(spark, path, m[3].tolist(), 7, probe=10_000).orderBy("rank").collect()
    assert [r.vec_id for r in one] == [i for i, _ in exact(m, m[3], 7)] and one[0].score == 1.0


def test_one_search_reads_its_lists_alone(spark, vectors):
    m, path = vectors
    found = vector_index.near(spark, path, m[3].tolist(), 5, probe=2, scope=0, min_score=0.2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and " IN (" in plan
    assert {r.scope for r in found.collect()} == {0} and all(r.score >= 0.2 for r in found.collect())
    wanted = vector_index.nearest_lists(m[3:4], *vector_index.centroids(spark, path), 2)[0]
    assert " IN ({})".format(",".join(map(str, sorted(wanted)))) in plan or " IN ({})".format(",".join(map(str, wanted))) in plan


def test_vectors_in_blocks(spark, vectors, monkeypatch):
    """Lists and queries of many blocks give what one block gives."""
    m, path = vectors
    monkeypatch.setattr(vector_index, "ROWS_A_TASK", 20)
    monkeypatch.setattr(vector_index, "QUERIES_A_TASK", 5)
    queries = spark.createDataFrame([(i, m[i].tolist()) for i in range(0, 300, 10)], "query_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in vector_index.search(spark, path, queries, 4, probe=10_000).collect()}
    assert got == {(q, k + 1): i for q in range(0, 300, 10) for k, (i, _) in enumerate(exact(m, m[q], 4))}


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, 0, None)], "vec_id long, scope int, embedding array<float>")
    vector_index.build(none, str(tmp_path / "v"))
    assert vector_index.near(spark, str(tmp_path / "v"), [1.0], 5).count() == 0
    assert vector_index.search(spark, str(tmp_path / "v"), none.select(F.col("vec_id").alias("query_id"), "embedding")).count() == 0


def test_registered_search_has_recall(spark):
    key = lambda rows: {(r.query_id, r.vec_id) for r in rows.collect()}
    some, every = key(index_queries.vector_index_search(spark, FOLDER)), key(index_queries.vector_index_all_lists(spark, FOLDER))
    assert len(every) == 50 and len(some & every) >= 0.9 * len(every)


# ---------------------------------------------------------------- literals


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    draw = random.Random(4)
    rows = [(i, f"r/{i}.md", "\n".join("".join(draw.choice("abcé ß🙂X") for _ in range(draw.randint(0, 40))) for _ in range(5))) for i in range(200)]
    rows += [(500, "r/a.md", None), (501, "r/b.md", ""), (502, "r/c.md", "ab"), (503, "r/long.md", "x" * 300_000 + " needle\n" + "y" * 300_000)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    base = tmp_path_factory.mktemp("texts")
    text_index.build(files, str(base / "plain"))
    text_index.build(files, str(base / "low"), ignore_case=True)
    return files, str(base)


@pytest.mark.parametrize("literals", [["abc"], ["é ß"], ["🙂"], ["ab"], ["b", "needle"], ["needle"], ["no such"], ["cé", "X🙂a", "no such"], ["\\u00e9X "], ["xxxxxx needle"]])
def test_index_finds_what_a_scan_finds(spark, texts, literals):
    files, base = texts
    key = lambda rows: sorted((r.doc_id, r.line_no, r.line) for r in rows.collect())
    assert key(text_index.search(spark, f"{base}/plain", literals)) == key(search.any_literal(files, literals))
    assert key(text_index.search(spark, f"{base}/low", [x.upper() for x in literals], ignore_case=True)) == key(search.any_literal(files, [x.upper() for x in literals], ignore_case=True))


def test_many_candidates_are_joined(spark, texts, monkeypatch):
    files, base = texts
    monkeypatch.setattr(text_index, "PUSHED", 3)
    assert text_index.search(spark, f"{base}/plain", ["abc"]).count() == search.literal(files, "abc").count() > 3


def test_scans_of_the_index_are_filtered(spark, texts):
    _, base = texts
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    held = plan(text_index.candidates(spark, f"{base}/plain", text_index.rarest(spark, f"{base}/plain", "needle")))
    assert "In(gram, [" in held and "struct<gram:int,doc_id:bigint>" in held and "/plain/texts" not in held
    assert "EqualTo(doc_id,503)" in plan(text_index.search(spark, f"{base}/plain", ["needle"])).replace("In(doc_id, [503])", "EqualTo(doc_id,503)")


def test_postings_are_runs_and_texts_are_not_shuffled_for_a_search(spark, texts, tmp_path, monkeypatch):
    """Several runs of a task hold each posting once, none is sorted over all, and many candidates shuffle no text."""
    files, base = texts
    monkeypatch.setattr(text_index, "PUSHED", 3)
    for most in (1_000_000, 5):
        monkeypatch.setattr(text_index, "SENT", most)
        found = text_index.search(spark, f"{base}/plain", ["abc"])
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == search.literal(files, "abc").count() > 3
    monkeypatch.setattr(text_index, "RUN", 500)
    batch = pa.RecordBatch.from_arrays([pa.array([9, 3, 5]), pa.array([b"abcd" * 900, bytes(range(255)) * 2, b"bcda"])], ["doc_id", "text"])
    runs = [list(zip(*(c.to_pylist() for c in r.columns), strict=True)) for r in text_index._posted(iter([batch, batch.slice(0, 1)]))]
    assert all(r == sorted(r) for r in runs) and runs[0][0] == (258, 3)
    assert sum(len(r) for r in runs) == 4 + 255 + 2 + 4


def test_blank_literals_are_refused(spark, texts):
    with pytest.raises(ValueError, match="invalid_query"):
        text_index.search(spark, f"{texts[1]}/plain", [" "])


# ---------------------------------------------------------------- streams


def feed(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_lifecycle_over_restarts(spark, tmp_path):
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = [
        [(1, 1, "confirmed", "a", None), (2, 1, "provisional", "b", None), (3, 1, "gone", "c", None), (None, 1, "confirmed", "d", None)],
        [(1, 2, "superseded", "e", None), (1, 1, "confirmed", "a", None), (2, 3, "superseded", "g", None), (2, 2, "confirmed", "f", None)],
    ]
    for rows in batches:
        feed(spark, rows, state.EVENT, source)
        state.run(state.lifecycle(spark.readStream.schema(state.EVENT).parquet(source)), out, at)
    rows = spark.read.schema(state.TRANSITION).parquet(out)
    got = sorted((r.note_id, r.seq, r.before, r.after, r.reason or "") for r in rows.collect())
    assert got == [
        (1, 1, "confirmed", "confirmed", "replayed"), (1, 1, "provisional", "confirmed", ""), (1, 2, "confirmed", "confirmed", "settled"),
        (2, 1, "provisional", "provisional", "unchanged"), (2, 2, "provisional", "confirmed", ""), (2, 3, "confirmed", "confirmed", "settled"),
        (3, 1, "provisional", "provisional", "not allowed"),
    ]
    assert {(r.note_id, r.status, r.summary) for r in state.settled(rows).collect()} == {(1, "confirmed", "a"), (2, "confirmed", "f"), (3, "provisional", None)}


def test_open_notes_are_superseded_by_a_timer(spark, tmp_path):
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([(1, 1, "provisional", "a", None), (2, 1, "confirmed", "b", None)], [(3, 1, "confirmed", "c", None)]):
        feed(spark, rows, state.EVENT, source)
        state.run(state.lifecycle(spark.readStream.schema(state.EVENT).parquet(source), open_ms=1), out, at, timed=True)
    got = {(r.note_id, r.status) for r in state.settled(spark.read.schema(state.TRANSITION).parquet(out)).collect()}
    assert got == {(1, "superseded"), (2, "confirmed"), (3, "confirmed")}


def test_stash_and_take_over_batches(spark, tmp_path):
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = [
        [("a", 1, "stash", "x"), ("b", 1, "take", None), (None, 1, "take", None)],
        [("a", 3, "stash", "y"), ("a", 2, "take", None), ("b", 1, "take", None)],
        [("a", 5, "take", None), ("a", 4, "take", None)],
    ]
    for rows in batches:
        feed(spark, rows, state.STEP, source)
        state.run(state.taken(spark.readStream.schema(state.STEP).parquet(source)), out, at)
    got = sorted((r.branch, r.ord, r.sha) for r in spark.read.schema(state.TAKEN).parquet(out).collect())
    assert got == [("a", 2, "x"), ("a", 4, "y"), ("a", 5, None), ("b", 1, None)]


def test_stash_expires(spark, tmp_path):
    import time

    source, out, at = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([("a", 1, "stash", "x")], [("a", 2, "take", None)]):
        feed(spark, rows, state.STEP, source)
        state.run(state.taken(spark.readStream.schema(state.STEP).parquet(source), expiry_ms=1), out, at, timed=True)
        time.sleep(0.1)
    assert [(r.ord, r.sha) for r in spark.read.schema(state.TAKEN).parquet(out).collect()] == [(2, None)]


def test_continuous_index_is_an_upsert(spark, tmp_path):
    source, target, at = (str(tmp_path / x) for x in ("in", "index", "state"))

    def come(*rows):
        feed(spark, [(p, t, None) for p, t in rows], "path string, text string, modified timestamp", source)
        index.follow(spark, source, target, at, most=8)

    def held():
        return {(r.path, r.chunk_index, r.chunk_count, r.text) for r in index.current(spark, target).collect()}

    come(("a", "one two three four"), ("b", "stays"), ("c", "goes"), ("e", ""))
    come(("a", "short"), ("b", "stays"), ("c", None), ("d", None))
    want = {("a", 0, 1, "short"), ("b", 0, 1, "stays")}
    assert held() == want
    versions = {(r.path, r.epoch) for r in index.latest(spark, target).collect()}
    assert versions == {("a", 1), ("b", 0), ("c", 1), ("e", 0)}  # b and d changed nothing
    index.write_epoch(spark.createDataFrame([("a", "short", None), ("c", None, None)], index.VERSION), 1, target, most=8)  # replayed
    assert held() == want and {(r.path, r.epoch) for r in index.latest(spark, target).collect()} == versions
    index.compacted(spark, target, str(tmp_path / "fresh"))
    assert {(r.path, r.text) for r in index.current(spark, str(tmp_path / "fresh")).collect()} == {("a", "short"), ("b", "stays")}
    assert {r.path for r in index.files(spark, str(tmp_path / "fresh")).collect()} == {"a", "b", "e"}


def test_edges_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "edges")
    edges = lambda *rows: spark.createDataFrame(rows, "src string, predicate string, dst string, origin string")
    assert writes.append_edges(path, edges(("a", "in", "b", "x"), ("a", "in", "b", "x"), ("a", "of", "b", "x"))) == 2
    assert writes.append_edges(path, edges(("a", "in", "b", "y"), ("c", "in", "b", "y"))) == 1
    assert writes.append_edges(path, edges(("c", "in", "b", "y"))) == 0
    assert sorted((r.src, r.predicate, r.origin) for r in spark.read.parquet(path).collect()) == [("a", "in", "x"), ("a", "of", "x"), ("c", "in", "y")]


def test_bulk_index_writes_what_is_good(spark, tmp_path):
    target = str(tmp_path / "index")
    files = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    first = writes.bulk_index(files(("a", "one"), ("b", "two"), ("c", "x" * 50), ("d", None), ("e", " ")), target, 0, most_bytes=20)
    assert {(r.path, r.n_chunks, r.error) for r in first.collect()} == {("a", 1, None), ("b", 1, None), ("c", 0, "too_large"), ("d", 0, "unreadable"), ("e", 0, "empty")}
    writes.bulk_index(files(("a", "new"), ("b", None)), target, 1, most_bytes=20)
    assert {(r.path, r.text) for r in index.current(spark, target).collect()} == {("a", "new"), ("b", "two")}


def test_levels_and_reports_of_tables(spark):
    configured = spark.createDataFrame([("s", "vector"), ("s", "file"), ("s", "vector"), ("t", "no layer"), ("t", None)], "scope string, layer string")
    got = {(r.scope, r.level): r.active for r in admin.levels_of(configured).collect()}
    assert got == {("s", 2): False, ("s", 3): True, ("s", 4): True, ("t", 2): False, ("t", 3): False, ("t", 4): False}
    answers = spark.createDataFrame([("a", 2, 10, 1.0), ("a", 3, 5, None), ("b", 0, 0, 4.0)], "config string, hits int, tokens int, latency double")
    assert {tuple(r) for r in admin.config_report(answers).collect()} == {("a", 5, 15, 1.0), ("b", 0, 0, 4.0)}


# ---------------------------------------------------------------- graphs, order, tokens


def test_long_chains_take_few_rounds(spark):
    n = 10_000
    edges = spark.range(n).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    jumps = reach.Jumps(edges)
    got = reach.reachable(edges, spark.createDataFrame([(5,), (None,)], "id long"), jumps)
    assert got.agg(F.count("id"), F.min("id"), F.max("id")).first()[:] == (n - 4, 5, n)
    assert jumps.rounds < 20


def test_reach_of_merges(spark):
    """Branches and merges, against a walk."""
    draw = random.Random(8)
    edges = [(i, draw.randint(max(0, i - 4), i - 1)) for i in range(1, 120) for _ in range(draw.choice((1, 1, 2)))] + [(7, 7), (None, 3), (300, 301)]
    tips = [90, 40, 1000]
    seen, todo = set(tips), list(tips)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    got = reach.reachable(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(t,) for t in tips], "id long"))
    assert sorted(r.id for r in got.collect()) == sorted(seen)
    assert reach.reachable(spark.createDataFrame([], "source long, target long"), spark.createDataFrame([(1,)], "id long")).collect()[0].id == 1


def test_reach_past_nodes_left_out(spark, monkeypatch):
    """A line and merges with most nodes left out on the way: less is moved than by doubling the whole, and all is found."""
    monkeypatch.setattr(reach, "FEW", 50)
    n = 2_000
    line = spark.range(n).select(F.col("id").cast("int").alias("source"), (F.col("id") + 1).alias("target"))
    jumps = reach.Jumps(line)
    assert jumps.tables[0].count() <= 50 and 5 < len(jumps.out) < 40
    got = reach.reachable(line, spark.createDataFrame([(5,), (None,)], "id long"), jumps)
    assert got.agg(F.count("id"), F.min("id"), F.max("id")).first()[:] == (n - 4, 5, n)
    with pytest.raises(ValueError, match="cycle"):
        reach.Jumps(line.selectExpr("source", f"(source + 1) % {n} as target")).table(12)
    monkeypatch.setattr(reach, "FEW", 10)
    test_reach_of_merges(spark)


def test_cycles_are_told(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "source long, target long")
    with pytest.raises(ValueError, match="cycle"):
        graph.ancestors(edges, spark.createDataFrame([(1,)], "id long"))


def test_ranks_of_a_frequent_scope(spark):
    """Numbers within each scope, null among them, though a scope lies in many ranges."""
    scope = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 7).cast("string"))
    df = spark.range(3_000).select(scope.alias("scope"), (F.col("id") * 7919 % 3001).alias("o"))
    got = sorted((r.scope or "", r.rank, r.o) for r in merge.numbered(df, [F.col("o")], "scope").collect())
    by = {}
    for r in df.collect():
        by.setdefault(r.scope or "", []).append(r.o)
    assert got == sorted((k, i + 1, o) for k, v in by.items() for i, o in enumerate(sorted(v)))


@pytest.mark.parametrize("within", [None, "scope"])
def test_ranks_in_a_locale(spark, within):
    names = ["Zebra", "apple", "Éclair", "eclair", "Apple", "zebra", "banana"]
    hits = spark.createDataFrame([("s", n, None, "file", None, None) for n in names], "scope string, source string, chunk int, layer string, score double, match_type string")
    order = lambda **k: [r.source for r in merge.ranked(hits, within, **k).orderBy("rank").collect()]
    assert order() == sorted(names)
    assert order(collation="UNICODE") == ["apple", "Apple", "banana", "eclair", "Éclair", "zebra", "Zebra"]


def test_tokens_count_utf16_units(spark):
    row = spark.createDataFrame([("🙂🙂", "abcd", "abcde", None, "")], "a string, b string, c string, d string, e string")
    assert row.select(*(tokens(F.col(c)) for c in "abcde")).first()[:] == (1, 1, 2, 0, 0)
    assert row.select(tokens(F.concat("a", "b"))).first()[0] == 2


def test_cut_reads_columns_and_goes(spark):
    import os

    df = cut(T.files(spark, FOLDER), "files")
    assert "ReadSchema: struct<doc_id:bigint>" in df.select("doc_id")._jdf.queryExecution().executedPlan().toString()
    at = df.inputFiles()[0].removeprefix("file:")
    drop_cuts(spark)
    assert not os.path.exists(at)
