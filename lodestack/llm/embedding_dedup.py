"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one representative a group.

Equal vectors are one representative from the begin. A cell of more than ``SPLIT`` vectors is split by spherical k-means,
fitted on about ``SAMPLE`` of its vectors for each centroid (at most ``FAN`` centroids, chosen by hash: the bound is on the
fit alone), and every vector is assigned; so cells stay small at any size of the table, at a cost in proportion to it and
to the number of levels. A vector goes to its nearest centroid and to the next ones within ``MARGIN``, ``NEAR`` in all, so
that neighbours across a border meet: links are found with the recall that the README states, none below the bound is
made. A pair that meets in several cells counts in the least one. A cell whose children would hold too much of it each,
by its sample, is not split.

Dense groups cost their size, not its square. Centroids closer than ``MERGED`` become one. Vectors within half the angle of
the bound of their centroid are its core: any two of them are linked without a product, and all that can be linked with
them, within three halves of the angle, are taken to that cell as well, so no link of a core vector is missed. What is
loose and cannot be split is compared block by block, each pair of blocks in a task of its own.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do rows without an id,
which are their own representatives (component_id null, kept). Vectors of different lengths never link. Every row has its
row in the result; rows that repeat an id link like others, and share an id as component. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.components import components
from lodestack.llm.shared import keep

BOUND = 0.9
ANGLE = math.acos(BOUND)
CORE = math.cos(ANGLE / 2) + 1e-6
GUEST = math.cos(1.5 * ANGLE) - 1e-6
MERGED = 0.9
SPLIT, A_CELL, FAN, SAMPLE, ROUNDS = 8192, 1024, 1024, 32, 8
NEAR, MARGIN = 5, 0.25
LEVELS = 8
#: Rows that are assigned together, and rows of a block of a cell that cannot be split.
A_GROUP, A_BLOCK = 8192, 4096
#: Cells up to which a table of cells is broadcast (some 100 bytes a cell); a longer one is joined by salted shuffles.
BROADCAST_CELLS = 100_000
SALTS = 64
#: Equal vectors of at least this share of all rows are joined by a broadcast of at most 1 / HEAVY rows.
HEAVY = 0.001

STATE = "id long, h long, weight long, cell string, core boolean, before string, marks array<array<int>>, vec binary"
_STATE = [("id", pa.int64()), ("h", pa.int64()), ("weight", pa.int64()), ("cell", pa.string()), ("core", pa.bool_()), ("before", pa.string()), ("marks", pa.list_(pa.list_(pa.int32()))), ("vec", pa.binary())]


# ---------------------------------------------------------------- numpy side


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, key: a digest of the vector, null where it links with nothing; dim; vec: its bytes."""
    for batch in batches:
        rows = batch.column(1)
        kind = np.dtype("f4") if pa.types.is_float32(rows.type.value_type) else np.dtype("f8")
        keys: list[bytes | None] = []
        vecs: list[bytes | None] = []
        dims = []
        for i in range(len(rows)):
            x = None
            if rows[i].is_valid and rows[i].values is not None and len(rows[i].values) and not rows[i].values.null_count:
                x = rows[i].values.to_numpy(zero_copy_only=False).astype(kind)
                x = x + kind.type(0) if np.isfinite(x).all() and x.any() else None
            raw = None if x is None else x.tobytes()
            vecs.append(raw)
            keys.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
            dims.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["vec_id", "key", "dim", "vec"])


def _units(vecs: pa.ChunkedArray, kind: str) -> np.ndarray:
    """float64 rows of length 1."""
    rows = vecs.to_pylist()
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[k : k + 4096] @ c.T).argmax(axis=1) for k in range(0, len(x), 4096)])


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """At most k unit centroids, none closer to another than MERGED."""
    c = x[: min(k, len(x))].copy()
    for step in range(ROUNDS + 2):
        at = _nearest(x, c)
        sizes = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norms = np.sqrt((sums * sums).sum(axis=1))
        moved = norms > 1e-9
        c[moved] = sums[moved] / norms[moved, None]
        if step >= ROUNDS - 1:  # join centroids of one dense group, the largest first
            order, left = np.argsort(-sizes, kind="stable"), np.ones(len(c), bool)
            close = c @ c.T > MERGED
            for i in order:
                if left[i]:
                    close_to = close[i] & left
                    close_to[i] = False
                    left &= ~close_to
            c = c[left]
    return c


def _fitted(table: pa.Table) -> pa.Table:
    rows = table.sort_by([("h", "ascending"), ("id", "ascending")])
    x = _units(rows["vec"], rows["kind"][0].as_py())
    c = spherical_kmeans(x, rows["want"][0].as_py())
    goes = np.bincount([j for cells, _ in assigned(x, c) for j in cells], minlength=len(c))
    if (goes.astype(float) ** 2).sum() > 0.6 * float(len(x)) ** 2:  # more would be compared in the children than is saved
        c = c[:1]
    return pa.table({"cell": pa.array([rows["cell"][0].as_py()]), "k": pa.array([len(c)], pa.int32()), "centroids": pa.array([c.tobytes()], pa.binary())})


def assigned(x: np.ndarray, c: np.ndarray) -> list[tuple[list[int], int]]:
    """Of each vector: the centroids whose cells it goes to, and the centroid whose core it is in, or -1."""
    out = []
    for lo in range(0, len(x), 2048):
        s = x[lo : lo + 2048] @ c.T
        order = np.argpartition(-s, min(NEAR, s.shape[1]) - 1, axis=1)[:, :NEAR]
        best = s.max(axis=1)
        home = s.argmax(axis=1)
        guest = s >= GUEST
        for r in range(len(s)):
            core = best[r] >= CORE
            cells = {int(home[r])}
            if not core:
                cells.update(int(j) for j in order[r] if s[r, j] >= best[r] - MARGIN)
            if guest[r].any():
                cells.update(np.flatnonzero(guest[r]).tolist())
            out.append((sorted(cells), int(home[r]) if core else -1))
    return out


def _assign(rows: pa.Table, centroids: pa.Table) -> pa.Table:
    out = {name: [] for name, _ in _STATE}
    if rows.num_rows and centroids.num_rows:
        x = _units(rows["vec"], rows["kind"][0].as_py())
        c = np.frombuffer(centroids["centroids"][0].as_py(), np.float64).reshape(-1, x.shape[1])
        cell = rows["cell"][0].as_py()
        each = zip(*(rows[n].to_pylist() for n in ("id", "h", "weight", "marks", "vec")), assigned(x, c), strict=True)
        for i, h, weight, marks, vec, (cells, core) in each:
            before = str([m[1:] for m in marks])
            for j in cells:
                for name, value in zip(out, (i, h, weight, f"{cell}/{j}", core == j, before, [*marks, [j, core, *cells]], vec), strict=True):
                    out[name].append(value)
    return pa.table({name: pa.array(out[name], kind) for name, kind in _STATE})


class _Marks:
    """What tells, level by level, in which cell a pair of rows of one cell counts."""

    def __init__(self, marks: list[list[list[int]]]) -> None:
        self.levels = []
        for level in zip(*marks, strict=True):
            wide = max(map(len, level)) - 2
            cells = np.full((len(level), wide), -1, np.int32)
            for r, m in enumerate(level):
                cells[r, : len(m) - 2] = m[2:]
            self.levels.append((level[0][0], np.array([m[1] for m in level], np.int32), cells))

    def here(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for path, core, cells in self.levels:
            both = (core[a] == core[b]) & (core[a] >= 0)
            least = np.full(len(a), 1 << 30, np.int32)
            for k in range(cells.shape[1]):
                x = cells[a, k]
                common = (x >= 0) & (cells[b] == x[:, None]).any(axis=1)
                least = np.where(common, np.minimum(least, x), least)
            ok &= np.where(both, core[a], least) == path
        return ok


def _compared(table: pa.Table) -> pa.Table:
    """Links of the rows of a block with themselves, or of block 0 with block 1: of each row their number and a node
    that it is connected to. Pairs of core rows are counted elsewhere."""
    n = table.num_rows
    x = _units(table["vec"], table["kind"][0].as_py())
    ids, hs = table["id"].to_numpy(), table["h"].to_numpy()
    weight, core = table["weight"].to_numpy(), np.array(table["core"].to_pylist(), bool)
    side, marks = table["side"].to_numpy(), _Marks(table["marks"].to_pylist())
    across = bool(side.any())
    links, label = np.zeros(n, np.int64), np.arange(n)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        s = x[lo:hi] @ x.T >= BOUND
        s &= ~(core[lo:hi, None] & core[None, :])
        s[np.arange(hi - lo), np.arange(lo, hi)] = False
        if across:
            s &= side[lo:hi, None] != side[None, :]
        a, b = np.nonzero(s)
        for k in range(0, len(a), 1 << 18):
            p, q = a[k : k + (1 << 18)] + lo, b[k : k + (1 << 18)]
            here = marks.here(p, q)
            np.add.at(links, p[here], weight[q[here]])
        for r in np.flatnonzero(s.any(axis=1)):
            of = np.unique(np.append(label[s[r]], label[lo + r]))
            if len(of) > 1:
                label[np.isin(label, of[1:])] = of[0]
    some = np.flatnonzero((links > 0) | (label != np.arange(n)))
    to = label[some]
    return pa.table({"id": pa.array(ids[some]), "h": pa.array(hs[some]), "to_id": pa.array(ids[to]), "to_h": pa.array(hs[to]), "links": pa.array(links[some])})


LINKED = "id long, h long, to_id long, to_h long, links long"


# ---------------------------------------------------------------- plans


def _with_cells(state: DataFrame, cells: DataFrame, n_cells: int) -> DataFrame:
    """state joined with a table that has a row for some of its cells, however many rows a cell has."""
    if n_cells <= BROADCAST_CELLS:
        return state.join(F.broadcast(cells), "cell")
    salted = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return state.withColumn("_salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["cell", "_salt"]).drop("_salt")


def _split(state: DataFrame, big: DataFrame, n_big: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """The children of the rows of the big cells, and the big cells that k-means could not split."""
    rows = _with_cells(state, big, n_big).withColumn("kind", F.lit(kind))
    rows = rows.withColumn("want", F.least(F.lit(FAN), F.ceil(F.col("n") / A_CELL)).cast("int"))
    share = F.lit(float(1 << 40)) * SAMPLE * F.col("want") / F.col("n")
    fitted = rows.filter(F.pmod("h", F.lit(1 << 40)) < share).select("cell", "want", "kind", "id", "h", "vec").groupBy("cell").applyInArrow(_fitted, "cell string, k int, centroids binary")
    fitted = keep(fitted, "cells-fitted")
    groups = keep(big.join(fitted.select("cell", "k"), "cell", "left").withColumn("whole", F.coalesce(F.col("k"), F.lit(0)) < 2).withColumn("groups", F.ceil(F.col("n") / A_GROUP).cast("long")), "cells-groups")
    dealt = _with_cells(state, groups.filter("not whole").select("cell", "groups"), n_big).withColumn("g", F.pmod("h", "groups")).withColumn("kind", F.lit(kind)).drop("groups")
    matrices = fitted.join(groups.filter("not whole").select("cell", "groups"), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"), "centroids")
    children = dealt.groupBy("cell", "g").cogroup(matrices.groupBy("cell", "g")).applyInArrow(_assign, STATE)
    return children, groups.filter("whole").select("cell", "n", "loose", "usual")


def _cells_of(state: DataFrame) -> DataFrame:
    """cell, n, usual: what most of its core rows have gone through before; loose: rows that are not of that core."""
    parts = state.groupBy("cell", F.when(F.col("core"), F.col("before")).alias("before")).count()
    usual = F.max(F.when(F.col("before").isNotNull(), F.struct(F.col("count").alias("c"), F.col("before").alias("b")))).alias("u")
    return parts.groupBy("cell").agg(F.sum("count").alias("n"), usual).select("cell", "n", (F.col("n") - F.coalesce("u.c", F.lit(0))).alias("loose"), F.col("u.b").alias("usual"))


def cells(reps: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Rows by cell, and the cells (cell, n, loose, usual)."""
    state = reps.select("id", "h", "weight", F.col("dim").cast("string").alias("cell"), F.lit(False).alias("core"), F.lit("").alias("before"), F.array().cast("array<array<int>>").alias("marks"), "vec")
    done_rows, done_cells = [], []
    for _ in range(LEVELS):
        of = keep(_cells_of(state), "cells")
        big = of.filter((F.col("n") > SPLIT) & (F.col("loose") * F.col("n") > SPLIT * SPLIT))
        counts = of.agg(F.count(F.lit(1)).alias("all"), F.count_if((F.col("n") > SPLIT) & (F.col("loose") * F.col("n") > SPLIT * SPLIT)).alias("big")).first()
        if not counts.big:
            break
        children, stuck = _split(state, big, counts.big, kind)
        leaves = of.join(big.select("cell"), "cell", "left_anti").unionByName(stuck)
        done_rows.append(_with_cells(state, leaves.select("cell"), counts.all))
        done_cells.append(leaves)
        state = keep(children, "cells-rows")
    else:
        of = keep(_cells_of(state), "cells")
    done_rows.append(state)
    done_cells.append(of)
    return reduce(DataFrame.unionByName, done_rows), reduce(DataFrame.unionByName, done_cells)


def _tasks() -> Column:
    """The tasks, and the side in each, that a row of a cell goes to: one for a small cell, else one for each pair of
    loose blocks and for each loose and core block."""
    loose, cores = F.ceil(F.col("loose") / A_BLOCK).cast("int"), F.ceil((F.col("n") - F.col("loose")) / A_BLOCK).cast("int")
    block = F.pmod(F.shiftright("h", 7), F.when(F.col("core"), cores).otherwise(loose)).cast("int")
    task = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    none, zero, one = F.lit(-1), F.lit(0), F.lit(1)
    upto = lambda n: F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<int>"))
    with_loose = F.transform(upto(loose), lambda j: task(F.least(block, j), F.greatest(block, j), F.when(j < block, one).otherwise(zero)))
    with_cores = F.transform(upto(cores), lambda j: task(block, none - one - j, zero))
    of_core = F.transform(upto(loose), lambda i: task(i, none - one - block, one))
    return F.when(F.col("n") <= SPLIT, F.array(task(none, none, zero))).when(F.col("core"), of_core).otherwise(F.concat(with_loose, with_cores))


def links(reps: DataFrame, kind: str) -> DataFrame:
    """id, h, to_id, to_h, links: numbers of links that some task found of a vector, each pair counted once for either
    end, and a vector that it is connected with."""
    rows, of = cells(reps, kind)
    of = keep(of, "cells-all")
    rows = _with_cells(rows, of, of.count()).withColumn("core", F.col("core") & F.col("before").eqNullSafe(F.col("usual")))
    rows = keep(rows.withColumn("kind", F.lit(kind)), "cells-dealt")
    tasks = rows.filter("loose > 0").withColumn("task", F.explode(_tasks())).select("id", "h", "weight", "cell", "core", "marks", "vec", "kind", "task.i", "task.j", "task.side")
    found = tasks.groupBy("cell", "i", "j").applyInArrow(_compared, LINKED)
    core = rows.filter("core")
    # every two core rows of a cell have gone the same way, so their pairs count here or, all of them, in another cell
    counts = F.forall(F.slice("marks", 1, F.greatest(F.size("marks") - 1, F.lit(0))), lambda m: F.when(m[1] >= 0, m[1]).otherwise(m[2]) == m[0])
    totals = keep(core.groupBy("cell").agg(F.sum("weight").alias("all"), F.min(F.struct("id", "h")).alias("least"), F.first(counts).alias("counts")), "cells-cores")
    of_core = _with_cells(core.select("id", "h", "weight", "cell"), totals, totals.count())
    of_core = of_core.select("id", "h", F.col("least.id").alias("to_id"), F.col("least.h").alias("to_h"), F.when(F.col("counts"), F.col("all") - F.col("weight")).otherwise(0).alias("links"))
    return found.unionByName(of_core)


def near_duplicates(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of the table."""
    kind = "f4" if dict(vectors.dtypes)[column] == "array<float>" else "f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<float>" if kind == "f4" else "array<double>").alias("vector"))
    rows = keep(rows.mapInArrow(_described, "vec_id long, key binary, dim int, vec binary"), "vectors")
    can = (F.col("key").isNotNull() & F.col("vec_id").isNotNull()).alias("can")
    reps = rows.filter(can).groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    reps = keep(reps.withColumn("h", F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("long")), "vectors-distinct")
    found = keep(links(reps, kind), "links")
    node = F.struct("id", "h")
    edges = found.select(node.alias("a"), F.struct(F.col("to_id").alias("id"), F.col("to_h").alias("h")).alias("b")).filter("a <> b")
    least = components(edges).select("node.id", "node.h", F.col("component.id").alias("component_id"))
    summed = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    of = reps.select("key", "id", "h", "weight").join(summed, ["id", "h"], "left").join(least, ["id", "h"], "left")
    of = keep(of.select("key", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "vectors-found")
    # the rows of equal vectors may be a third of the table: keys with that many rows are few
    n = rows.count()
    heavy = of.filter(F.col("weight") >= max(2.0, HEAVY * n)).drop("weight")
    rest = of.filter(F.col("weight") < max(2.0, HEAVY * n)).drop("weight")
    linked = rows.filter(can).select("vec_id", "key")
    hot = linked.join(F.broadcast(heavy), "key")
    others = linked.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(rest, "key")
    alone = rows.filter(~can).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = reduce(DataFrame.unionByName, [x.select("vec_id", "n_links", "component_id") for x in (hot, others, alone)])
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
