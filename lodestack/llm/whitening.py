"""Embedding whitening: covariance by upper-triangle column aggregates, decomposed with LAPACK.

Vectors are put on a grid (floor(``GRID`` * component), a long each), so sums over them are exact and equal vectors count
once in the fit. For d dimensions one aggregation sums the d * (d + 1) / 2 centred products of all pairs of dimensions, as
Spark SQL expressions; beyond ``MOST_SUMS`` sums, as of 128 dimensions, the triangle is cut into several aggregations.
Only these sums reach the driver: their number hangs on the dimension alone.

Null vectors and those with null, NaN or infinite components are left out; so are vectors of another length than most
have (ties: the longer one), as no covariance joins them, and empty ones. Repeated rows and ids are answered each, and
count once in the fit. Components whose variance is nothing but rounding are left out: a table of one distinct vector, or
of none, gives no rows, and fewer dimensions than components asked for give fewer. A deviation beyond a long is null.
Extra columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.shared import keep

GRID = 256
COMPONENTS = 4
#: Sums of one aggregation; each is a column of its buffer.
MOST_SUMS = 8_320


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # of the covariance, falling
    vectors: np.ndarray  # a row for each value
    trace: float


def on_grid(vector: Column) -> Column:
    """floor(GRID * c) of each component; null where the vector is null, empty or has a component that is no finite number."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(whole & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * GRID).cast("long")))


def gridded(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that can be whitened, all of one length."""
    x = vectors.select("vec_id", on_grid(F.col(column)).alias("x")).filter("x is not null")
    lengths = x.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()
    return x.filter(F.size("x") == (lengths.m.d if lengths.m else 0))


def _centred(i: int, mean: float) -> Column:
    return F.get("x", F.lit(i)).cast("double") - F.lit(mean)


def covariance(fit: DataFrame, means: list[float], n: int) -> np.ndarray:
    """Of the vectors x: sums of centred products of every pair of dimensions, over n."""
    d = len(means)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    centred = fit.select(*(_centred(i, m).alias(f"c{i}") for i, m in enumerate(means)))
    out = np.zeros((d, d))
    for lo in range(0, len(pairs), MOST_SUMS):
        part = pairs[lo : lo + MOST_SUMS]
        row = centred.selectExpr(*(f"sum(c{i} * c{j})" for i, j in part)).first()
        for (i, j), v in zip(part, row, strict=True):
            out[i, j] = out[j, i] = v / n
    return out


def fit_whitening(fit: DataFrame) -> Whitening:
    """Of the distinct vectors x, all of one length. Values that are no more than rounding of the largest are left out."""
    least = fit.first()
    if least is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    d = len(least.x)
    row = fit.select(*(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(d))).selectExpr("count(1)", *(f"sum(cast(x{i} as decimal(20, 0)))" for i in range(d))).first()
    n, sums = row[0], [int(s) for s in row[1:]]
    v = covariance(fit, [s / n for s in sums], n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors.T[::-1]
    real = values > max(values[0], 0.0) * d * 1e-13
    return Whitening(n, sums, values[real], vectors[real], float(np.trace(v)))


def _projected(w: Whitening, k: int) -> Column:
    """Component k, from 0, of the whitened vector."""
    means, axis = [s / w.n for s in w.sums], w.vectors[k] / np.sqrt(w.values[k])
    terms = F.zip_with(F.zip_with("x", F.lit(means), lambda a, b: a.cast("double") - b), F.lit(axis.tolist()), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def identity_error(fit: DataFrame, w: Whitening, components: int) -> float:
    """The largest entry, by size, of the whitened covariance less the identity, measured over the vectors."""
    k = min(components, len(w.values))
    if not k:
        return 0.0
    y = fit.select(*(_projected(w, i).alias(f"y{i}") for i in range(k)))
    means = list(y.agg(*(F.avg(f"y{i}") for i in range(k))).first())
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    centred = y.select(*((F.col(f"y{i}") - F.lit(m)).alias(f"c{i}") for i, m in enumerate(means)))
    row = centred.selectExpr(*(f"sum(c{i} * c{j}) / {w.n}D" for i, j in pairs)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, row, strict=True))


def _deviation(w: Whitening) -> Column:
    """The sum over dimensions of (n * x - sum) ** 2, exact in longs; null beyond them."""
    square = F.transform(F.zip_with("x", F.lit(w.sums), lambda a, b: F.try_subtract(F.try_multiply(a, F.lit(w.n).cast("long")), b.cast("long"))), lambda a: F.try_multiply(a, a))
    return F.aggregate(square, F.lit(0).cast("long"), lambda a, b: F.try_add(a, b))


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector(vec_id, column) and leading component: the whitened vector's part, the share of the variance
    that the component explains, the exact deviation from the mean, and the fit's measured error."""
    x = keep(gridded(vectors, column), "whiten-grid")
    fit = keep(x.select("x").distinct(), "whiten-fit")
    w = fit_whitening(fit)
    k = min(components, len(w.values))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, w, components)
    parts = F.array(*(F.struct(F.lit(i + 1).alias("component"), _projected(w, i).alias("whitened"), F.lit(float(w.values[i] / w.trace)).alias("explained")) for i in range(k)))
    out = x.select("vec_id", _deviation(w).alias("deviation"), F.inline(parts).alias("component", "whitened", "explained"))
    return out.select("vec_id", "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
