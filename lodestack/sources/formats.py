"""Formats for ``spark.read.format`` and ``spark.readStream.format``: graph documents and metric lines.

Both read folders that the driver and all executors can open as files (a mounted share); for other stores there are the
readers of ``readers``. ``register(spark)`` makes them known.

``lodestack_graph`` (option ``table``: nodes or links): a partition for each document of a folder, or the one document.
Filters of equality with a text, and of membership in texts, are pushed down to the documents, so that only what is wanted
leaves a Python worker.

``lodestack_metrics``: JSON lines of run events, as a table or as a stream. A stream follows files that grow: its offset is
the place behind the last whole line of each file, so a line is read once, and a line that is being written is not.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

NODES = "file string, ord int, id string, label string, norm_label string, file_type string, source_file string, source_location string, origin string"
LINKS = "file string, ord int, source string, target string, relation string, source_file string, source_location string, confidence_score double, origin string"
METRIC = "event string, runner string, timestamp timestamp, detail string"


def _files(options: dict[str, str], ending: str) -> list[str]:
    """The files at a path, in order; none where there is none."""
    path = options["path"].removeprefix("file:")
    path = "/" + path.lstrip("/") if options["path"].startswith("file:") else path
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(ending) and not f.startswith((".", "_")))
    return [path] if os.path.exists(path) else []


class FilePart(InputPartition):
    def __init__(self, path: str, start: int = 0, end: int = 0) -> None:
        self.path, self.start, self.end = path, start, end


class GraphReader(DataSourceReader):
    def __init__(self, options: dict[str, str], table: str, columns: list[str]) -> None:
        self.options, self.table, self.columns = options, table, columns
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            texts = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else ()
            if texts and all(isinstance(t, str) for t in texts) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                held = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = set(texts) if held is None else held & set(texts)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [FilePart(p) for p in _files(self.options, ".json")] or [FilePart("")]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, encoding="utf-8") as f:
            document = json.load(f)
        name = os.path.basename(partition.path)
        for ord_, item in enumerate(document.get(self.table) or []):
            item = {**item, "origin": item.get("_origin"), "file": name, "ord": ord_}
            if self.table == "nodes" and item.get("file_type") == "document":
                at = item.get("source_location") or ""
                if not (at[:1] == "L" and at[1:].isdecimal() and at.isascii()):
                    raise ValueError(f"document node without a line: {item.get('id') or '?'}")
            if all(item.get(c) in texts for c, texts in self.wanted.items()):
                yield tuple(float(item[c]) if c == "confidence_score" and item.get(c) is not None else item.get(c) for c in self.columns)


class GraphSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestack_graph"

    def schema(self) -> str:
        table = self.options.get("table", "nodes")
        if table not in ("nodes", "links"):
            raise ValueError(f"table is nodes or links, not {table}")
        return NODES if table == "nodes" else LINKS

    def reader(self, schema: Any) -> DataSourceReader:
        return GraphReader(self.options, self.options.get("table", "nodes"), [f.name for f in schema.fields])


def _moment(value: Any) -> datetime | None:
    try:
        at = datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def _events(partition: FilePart) -> Iterator[tuple]:
    """The whole lines between two places of a file; a line that is no JSON object is an event of nulls, as elsewhere."""
    with open(partition.path, "rb") as f:
        f.seek(partition.start)
        while f.tell() < partition.end and (line := f.readline()):
            if line.strip():
                try:
                    item = json.loads(line)
                except ValueError:
                    item = None
                item = item if isinstance(item, dict) else {}
                text = {k: None if item.get(k) is None else v if isinstance(v := item[k], str) else json.dumps(v) for k in ("event", "runner", "detail")}
                yield text["event"], text["runner"], _moment(item.get("timestamp")), text["detail"]


def _whole(path: str) -> int:
    """The place behind a file's last line end."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            step = min(at, 1 << 16)
            f.seek(at - step)
            k = f.read(step).rfind(b"\n")
            if k >= 0:
                return at - step + k + 1
            at -= step
    return 0


class MetricReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [FilePart(p, 0, os.path.getsize(p)) for p in _files(self.options, ".jsonl")] or [FilePart("", 0, 0)]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        return _events(partition) if partition.path else iter(())


class MetricStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: _whole(p) for p in _files(self.options, ".jsonl")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [FilePart(p, start.get(p, 0), upto) for p, upto in end.items() if upto > start.get(p, 0)]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        return _events(partition)

    def commit(self, end: dict) -> None:
        pass


class MetricSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestack_metrics"

    def schema(self) -> str:
        return METRIC

    def reader(self, schema: Any) -> DataSourceReader:
        return MetricReader(self.options)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return MetricStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GraphSource, MetricSource):
        spark.dataSource.register(source)
