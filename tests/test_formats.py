"""Graph documents and metric lines as formats, against the readers of the same files."""

import json

import pytest
from pyspark.sql import functions as F

from lodestack.sources import formats, readers
from lodestack.streaming import jobs


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


def document(name, n):
    nodes = [{"id": f"{name}{i}", "label": f"N{i}", "file_type": "code" if i % 2 else "document", "source_file": "a.md", "source_location": f"L{i}", "_origin": "x" if i % 3 else None, "more": 1} for i in range(n)]
    links = [{"source": f"{name}{i}", "target": f"{name}{i + 1}", "relation": "calls" if i % 2 else "owns", "confidence_score": i if i % 3 else None} for i in range(n)]
    return {"nodes": nodes, "links": links}


def test_graph_format_equals_the_reader(known, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(document(name, 5)))
    (tmp_path / "_skip.json").write_text("no json")
    (tmp_path / "empty.json").write_text("{}")
    read = lambda table: known.read.format("lodestack_graph").option("table", table).load(str(tmp_path))
    for table, k in (("nodes", 0), ("links", 1)):
        got = read(table)
        want = [r for name in ("a", "b") for r in readers.graph_document(known, str(tmp_path / f"{name}.json"))[k].collect()]
        columns = [c for c in got.columns if c not in ("file",)]
        assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, (r for r in (type(w)(**{c: w[c] for c in columns}) for w in want))))
        assert got.rdd.getNumPartitions() == 3
    assert known.read.format("lodestack_graph").load(str(tmp_path / "none")).count() == 0


def test_graph_filters_are_pushed(known, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(document("a", 8)))
    links = known.read.format("lodestack_graph").option("table", "links").load(str(tmp_path))
    some = links.filter((F.col("relation") == "calls") & F.col("source").isin("a1", "a2", "a3") & (F.col("confidence_score") > 1))
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Filter ")[1].split("\n")[0]  # what is done above the source: not what it took over
    assert "confidence_score#" in left and "calls" not in left and "a1" not in left
    assert [(r.source, r.confidence_score) for r in some.collect()] == []
    assert {r.source for r in links.filter("relation = 'calls' and source in ('a1', 'a2', 'a3')").collect()} == {"a1", "a3"}


def test_document_nodes_without_a_line_fail(known, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"nodes": [{"id": "z", "file_type": "document", "source_location": "12"}]}))
    with pytest.raises(Exception, match="document node without a line: z"):
        known.read.format("lodestack_graph").load(str(tmp_path / "a.json")).collect()
    with pytest.raises(Exception, match="nodes or links"):
        known.read.format("lodestack_graph").option("table", "x").load(str(tmp_path)).collect()


def event(kind, runner="r1", **more):
    return json.dumps({"event": kind, "runner": runner, "timestamp": "2026-01-01T10:00:00Z", **more}) + "\n"


def test_metric_lines_equal_the_reader(known, tmp_path):
    at = tmp_path / "m.jsonl"
    at.write_text(event("runner_attempt") + "\n" + event("runner_failure", detail="é 🙂") + event("runner_success")[:-1])
    got = known.read.format("lodestack_metrics").load(str(at))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, readers.metric_lines(known, str(at)).collect()))
    assert known.read.format("lodestack_metrics").load(str(tmp_path / "none")).count() == 0
    at.write_text("no json\n[1]\n")
    assert [tuple(r) for r in got.collect()] == [(None,) * 4] * 2


def test_metric_stream_follows_growing_files(known, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def work():
        stream = known.readStream.format("lodestack_metrics").load(str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.event for r in known.read.schema(formats.METRIC).parquet(out).collect())

    (folder / "a.jsonl").write_text(event("a1") + event("a2") + event("a3")[:20])  # the third is being written
    assert work() == ["a1", "a2"]
    with (folder / "a.jsonl").open("a") as f:
        f.write(event("a3")[20:] + event("a4"))
    (folder / "b.jsonl").write_text(event("b1"))
    assert work() == ["a1", "a2", "a3", "a4", "b1"]
    assert work() == ["a1", "a2", "a3", "a4", "b1"]
    batch = jobs.metrics(known.read.schema(formats.METRIC).parquet(out))
    assert batch.count() == 5
