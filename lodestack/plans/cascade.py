"""The escalating cascade: ordered layers, the first non-empty one answers; the rest are never read."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators import graph, linker, search
from lodestack.operators.merge import by_source, dedupe


@dataclass
class Layer:
    """A named source of hits(source, chunk, layer, ord). Two in a row that share a pair name are asked together."""

    name: str
    hits: Callable[[], DataFrame]
    pair: str | None = None


@dataclass
class Answer:
    ok: bool
    hits: DataFrame | None = None
    layers_queried: list[str] = field(default_factory=list)
    layers_skipped: list[str] = field(default_factory=list)
    escalated: bool = False
    degraded: bool = False
    error: str | None = None
    probed: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.probed:
            df.unpersist()


#: Layers by name: each factory takes the tables of a configuration and the query, and gives the layer's hits.
LAYERS: dict[str, Callable[[dict[str, DataFrame], str], DataFrame]] = {}


def register_layer(name: str, factory: Callable[[dict[str, DataFrame], str], DataFrame]) -> None:
    """Add a layer; a name is registered once."""
    if name in LAYERS:
        raise ValueError(f"layer {name} is registered already")
    LAYERS[name] = factory


def layers_of(names: Sequence[str], tables: dict[str, DataFrame], query: str, pairs: dict[str, str] | None = None) -> list[Layer]:
    """The named layers, in order, over tables; an unknown name is an error that lists the known ones."""
    unknown = [n for n in names if n not in LAYERS]
    if unknown:
        raise ValueError(f"unknown layers {unknown}; known: {sorted(LAYERS)}")
    return [Layer(n, lambda n=n: LAYERS[n](tables, query).withColumn("layer", F.lit(n)), (pairs or {}).get(n)) for n in names]


def with_fallback(first: Callable[[], DataFrame], second: Callable[[], DataFrame]) -> DataFrame:
    """The hits of the first source, or of the second if the first cannot be read; ``degraded`` tells which."""
    try:
        hits = first()
        hits.isEmpty()
        return hits.withColumn("degraded", F.lit(False))
    except Exception:  # any failure of the primary source turns to the secondary one, and the hits say so
        return second().withColumn("degraded", F.lit(True))


def _file_hits(tables: dict[str, DataFrame], query: str) -> DataFrame:
    return search.literal(tables["files"], query).select(F.col("doc_id").alias("source"), F.col("line_no").alias("chunk"), F.xxhash64("doc_id", "line_no").alias("ord"))


def _keyword_hits(tables: dict[str, DataFrame], query: str) -> DataFrame:
    return search.keyword(tables["files"], query).select(F.col("doc_id").alias("source"), F.col("line_no").alias("chunk"), F.xxhash64("doc_id", "line_no").alias("ord"))


def _vector_hits(tables: dict[str, DataFrame], query: str) -> DataFrame:
    """The query names a stored vector."""
    near = search.scored(tables["vectors"], int(query)).orderBy(F.desc("score"), "vec_id").limit(10)
    return near.select(F.col("vec_id").alias("source"), F.lit(0).alias("chunk"), (-F.col("score") * 1_000_000).cast("long").alias("ord"))


def _graph_hits(tables: dict[str, DataFrame], query: str) -> DataFrame:
    return graph.matching(tables["nodes"], query, ["id", "label"]).orderBy("id").limit(20).select(F.col("id").alias("source"), F.lit(0).alias("chunk"), F.xxhash64("id").alias("ord"))


def _triple_hits(tables: dict[str, DataFrame], query: str) -> DataFrame:
    low = F.lit(query.lower())
    live = tables["triples"].filter(F.col("valid_until").isNull() & (F.contains(F.lower("subject"), low) | F.contains(F.lower("object"), low)))
    return live.orderBy("subject", "object").limit(10).select(F.col("subject").alias("source"), F.lit(0).alias("chunk"), F.xxhash64("subject", "object").alias("ord"))


def _crossref_hits(tables: dict[str, DataFrame], query: str) -> DataFrame:
    defs, uses = linker.scanned(tables["code"], list(linker.SCHEMES.values()))
    return linker.hits(defs, uses, query).select("source", F.col("line").alias("chunk"), F.xxhash64("content", "source").alias("ord"))


for _name, _factory in (("file", _file_hits), ("keyword", _keyword_hits), ("vector", _vector_hits), ("graph", _graph_hits), ("triples", _triple_hits), ("crossref", _crossref_hits)):
    register_layer(_name, _factory)


def _nodes(layers: Sequence[Layer]) -> list[list[Layer]]:
    out: list[list[Layer]] = []
    for layer in layers:
        mate = next((n for n in out if layer.pair and n[0].pair == layer.pair), None)
        if mate:
            mate.append(layer)
        else:
            out.append([layer])
    return out


def recall(query: str, layers: Sequence[Layer]) -> Answer:
    """First node empty: go on. A later node empty: escalated. A node that fails: degraded, go on; if the last one asked
    failed, its error is the answer. The probe is cached, so a layer's hits are computed once; the caller of a job that asks
    many times gives the memory back by ``answer.release()`` once the hits are stored."""
    if not query.strip():
        return Answer(False, error="invalid_query")
    if not layers:
        return Answer(False, error="no_layers_configured")
    out, last = Answer(True), None
    for k, node in enumerate(_nodes(layers)):
        found, errors = [], []
        for layer in node:
            out.layers_queried.append(layer.name)
            try:
                hits = layer.hits().cache()
                out.probed.append(hits)
                found.append((hits, hits.isEmpty()))
            except Exception as e:  # a layer that cannot answer is reported, the next one is asked
                errors.append(str(e).splitlines()[0])
                out.layers_skipped.append(layer.name)
        out.degraded |= bool(errors)
        last = errors[0] if not found else None
        full = [h for h, empty in found if not empty]
        if full:
            every = full[0]
            for h in full[1:]:
                every = every.unionByName(h)
            out.hits = by_source(dedupe(every) if len(node) > 1 else every)
            return out
        out.escalated |= bool(found) and k > 0
        if found:
            out.hits = found[0][0]
    if last is not None:
        return Answer(False, layers_queried=out.layers_queried, layers_skipped=out.layers_skipped, degraded=True, error=last)
    return out
