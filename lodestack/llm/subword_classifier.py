"""Quality classifier of supervised subword embeddings.

Words and character n-grams are hashed into BUCKETS rows of a table of learned vectors; a document is the average of
its vectors, and a softmax of that average gives its classes. Trained by stochastic gradient descent in numpy on at most
``FIT_ROWS`` labelled documents of ``FIT_BYTES`` together, the ones of least hash; scored on every whole text. As the softmax is linear in the
average, a bucket's part of the score is one number, and executors need a table of BUCKETS of them, whatever the corpus.

Null and empty texts have no features and get the bias alone. A document labelled more than once, and each row of a
repeated id, counts each time, within the bounds; null labels are not learned from; with no labelled rows, or one class only, the score is that class's share (0.5 for none).
Rows that repeat an id are scored each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.lattice_lm import held_out
from lodestack.llm.text import BASE, BASE_INV, byte_texts, in_chunks, mix, powers

BUCKETS = 1 << 17
GRAMS = (3, 4)
DIMENSIONS = 8
FIT_ROWS, FIT_BYTES = 4_000, 16 << 20
EPOCHS = 6
RATE = 0.5
#: Characters whose features are made together.
PLACES = 1 << 19
_POWERS, _INVERSES = (powers(b, PLACES + max(GRAMS) + 1) for b in (BASE, BASE_INV))


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text index) of each word and of each character n-gram within a word and the spaces around it, by windows
    of PLACES characters; a word that goes on past its window is hashed by a carried sum."""
    points = [np.frombuffer((b" " + t + b" ").decode().encode("utf-32-le"), "<u4") for t in texts]
    begins = np.cumsum([0, *map(len, points)])
    p = points[0] if len(points) == 1 else np.concatenate([np.zeros(0, "<u4"), *points])
    del points
    n, beyond = len(p), max(GRAMS) - 1
    total, open_at = np.zeros(1, np.uint64), None  # sum before the window; (sum, inverse, text) at the begin of an open word
    for lo in range(0, n, PLACES):
        size = min(n - lo, PLACES)
        q = p[lo : lo + size + beyond]
        white = (q == 32) | ((q >= 9) & (q <= 13))
        q = np.where(white, 32, q).astype(np.uint64)
        owner = np.repeat(np.arange(len(texts)), np.diff(np.clip(begins, lo, lo + size)))
        sums, spaces = np.zeros(len(q) + 1, np.uint64), np.zeros(len(q) + 1, np.int64)
        np.cumsum(white, out=spaces[1:])
        step = np.diff(np.concatenate([[open_at is not None], ~white[:size]]).astype(np.int8))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        with np.errstate(over="ignore"):
            np.cumsum(mix(q + np.uint64(77)) * _POWERS[: len(q)] * np.uint64(pow(BASE, lo, 1 << 64)), out=sums[1:])
            sums += total
            inverse = _INVERSES[: len(q) + 1] * np.uint64(pow(BASE_INV, lo, 1 << 64))
            at, by, of = sums[starts], inverse[starts], owner[starts]
            if open_at is not None:
                at, by, of = (np.append(x, y) for x, y in zip(open_at, (at, by, of), strict=True))
            open_at = (at[-1:], by[-1:], of[-1:]) if len(at) > len(ends) else None
            whole = slice(0, len(ends))
            found, owners = [mix((sums[ends] - at[whole]) * by[whole] + np.uint64(1))], [of[whole]]
            for k in GRAMS:
                last = min(size, len(q) - k + 1)
                if last > 0:
                    begin = np.flatnonzero(spaces[k - 1 : k - 1 + last] - spaces[1 : 1 + last] == 0)  # no white space but at the ends
                    found.append(mix((sums[begin + k] - sums[begin]) * inverse[begin] + np.uint64(k)))
                    owners.append(owner[begin])
        total = sums[size : size + 1].copy()
        yield (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owners)


def _for_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text, times) to (label, distinct buckets, their share of the document, times)."""
    for batch in batches:
        texts = byte_texts(batch.column(1))
        for i, t in enumerate(texts):
            every = sum((np.bincount(bucket, minlength=BUCKETS) for bucket, _ in features([t])), np.zeros(BUCKETS, np.int64))
            values = np.flatnonzero(every)
            counts = every[values]
            share = (counts / max(1, counts.sum())).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([values.astype(np.int32).tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary()), batch.column(2).slice(i, 1)], ["label", "buckets", "share", "times"])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's part of the log odds of label 1, and the bias."""
    rng = np.random.default_rng(seed)
    ones = sum(y for y, _, _ in rows)
    if not rows or ones in (0, len(rows)):
        share = (ones + 1) / (len(rows) + 2)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    # both classes weigh the same
    weight = [len(rows) / (2 * (len(rows) - ones)), len(rows) / (2 * ones)]
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            y, buckets, share = rows[k]
            rate = RATE * (1 - done / steps)
            done += 1
            own = vectors[buckets]
            mean = share @ own
            z = out @ mean + bias
            p = np.exp(z - z.max())
            gap = p / p.sum()
            gap[y] -= 1
            gap *= min(weight[y], 4.0) * rate
            vectors[buckets] = own - (share * 50)[:, None] * (gap @ out)[None, :] / max(1.0, 50 * float(share.max()))
            out -= np.outer(gap, mean)
            bias -= gap * 0.1
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def _apply(parts: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(2))
            for lo, hi in in_chunks(texts):
                n, z = np.zeros(hi - lo), np.zeros(hi - lo)
                for bucket, owner in features(texts[lo:hi]):
                    n += np.bincount(owner, minlength=hi - lo)
                    z += np.bincount(owner, parts[bucket], hi - lo)
                z = z / np.maximum(n, 1) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, parts: int = 4, part: int = 2) -> DataFrame:
    """One row a document: doc_id, held_out, score (of label 1), predicted. Rows held out are never learned from."""
    ids = F.col("doc_id").cast("long").alias("doc_id")
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), parts, part)).select(ids, F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_rows)
    sample = docs.select(ids, "text").join(F.broadcast(chosen), "doc_id")  # at most fit_rows rows of two numbers
    # an id may repeat in documents: the bounds hold for the joined rows, by numbers alone
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"), F.col("key")
    sample = sample.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    sizes = sample.select("doc_id", "label", "key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).orderBy(*order).limit(fit_rows)
    upto = sizes.withColumn("upto", F.sum("size").over(Window.orderBy(*order))).filter(F.col("upto") <= fit_bytes)
    listed = upto.groupBy("doc_id", "label", "key").agg(F.count(F.lit(1)).alias("times"))
    one = sample.join(F.broadcast(listed), ["doc_id", "label", "key"]).dropDuplicates(["doc_id", "label", "key"])
    got = one.select("label", "text", "times").mapInArrow(_for_fit, "label int, buckets binary, share binary, times long").collect()
    got = [r for r in got for _ in range(r["times"])]
    rows = sorted(((r["label"], bytes(r["buckets"]), bytes(r["share"])) for r in got), key=lambda x: (x[1], x[2], x[0]))
    weights, bias = fit([(y, np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for y, b, s in rows])
    out = docs.select(ids, held_out(F.col("doc_id"), parts, part).alias("held_out"), "text").mapInArrow(_apply(weights.astype(np.float64), bias), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
