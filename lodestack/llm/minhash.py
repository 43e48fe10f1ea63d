"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set holds its distinct five-word shingles (the whole sequence, if it has fewer words). Documents of equal
sets are one representative. A signature has ``COORDINATES`` least hashes; a representative is posted under the
coordinate-value pairs of its prefix: in one order of all pairs, frequent ones last, two signatures that agree in at
least ``MATCHES`` coordinates share ``COLLISIONS`` pairs among the first COORDINATES - MATCHES + COLLISIONS of each; pairs
of documents with fewer collisions go by count. Frequent pairs, as of passages that many documents share, so fall out of
the prefixes.

Merging skips what is already known. Each posting list first meets its least member only; after those pairs are counted
over whole signatures, and confirmed on whole sets, only members of different components still meet. So a large group
of near copies costs its size, not its square, and no link between two components goes unseen. Sizes that rule the
similarity out are skipped too. Of a list of more than ``CROWD`` members not all pairs are made: there only pairs whose
whole sets, rare shingles first, share one early enough for the similarity still to be reached.

MATCHES leaves 5 standard deviations below the 192 that sets of similarity 0.75 agree in on average. More coordinates
make the prefix a smaller share of them: sets that share a passage, and are not similar enough, then part by their own
words before they reach the passage's pairs, and are never paired.

Null, empty and blank texts have an empty set and are linked with nothing; so are rows without an id. Rows that repeat
an id count as one document. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.components import components
from lodestack.llm.shared import drop_kept, drop_kept_since, keep, kept_so_far, sized
from lodestack.llm.text import BYTE_LOWER, Words, _splitmix, byte_texts, in_chunks, mix

SHINGLE = 5
SIMILARITY_PERCENT = 75
COORDINATES = 256
MATCHES = 157
COLLISIONS = 8
PREFIX = COORDINATES - MATCHES + COLLISIONS
#: Pairs whose frequency orders the prefixes: those of at least HEAVY_LEAST postings, the HEAVY_MOST most frequent. It is
#: only an order: any bound gives the same links, a lower one longer posting lists.
HEAVY_LEAST, HEAVY_MOST = 24, 100_000
#: Ids up to which a list of documents is broadcast (some 16 bytes an id); a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of an open list that still meet each other: at most half as many pairs as this for each posting.
CROWD = 64
#: Pairs, each with two signatures or texts, that are worth a task.
PAIRS_A_TASK = 5_000

_A = _splitmix(COORDINATES, 1001) | np.uint64(1)
_B = _splitmix(COORDINATES, 2002)
_C = _splitmix(SHINGLE, 3003) | np.uint64(1)
_COORDINATE = _splitmix(COORDINATES, 4004)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, BYTE_LOWER)
    with np.errstate(over="ignore"):
        n = len(w.hashes)
        rolled = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            rolled[: n - k] += w.hashes[k:] * _C[k]
        rolled = mix(rolled)
        out = []
        for a, b in zip(w.first, w.last, strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(rolled[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(mix(np.array([(w.hashes[a:b] * _C[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32[len(sets), COORDINATES]; no set may be empty."""
    h = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(COORDINATES):
            out[:, i] = np.minimum.reduceat(h * _A[i] + _B[i], starts) >> np.uint64(32)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), byte_texts(batch.column(1))
        for lo, hi in in_chunks(texts):
            sets = shingle_sets(texts[lo:hi])
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            signed: list[bytes | None] = [None] * len(sets)
            one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(full):
                some = [sets[i] for i in full]
                for i, row in zip(full, signatures(some), strict=True):
                    signed[i] = row.tobytes()
                h, starts = np.concatenate(some), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                with np.errstate(over="ignore"):
                    one[full] = np.add.reduceat(mix(h), starts)
                    two[full] = np.add.reduceat(mix(h ^ np.uint64(0x5555)), starts)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(signed, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])


def _tokens(sigs: pa.Array) -> np.ndarray:
    """uint64[rows, COORDINATES]: each coordinate-value pair as one number."""
    rows = np.frombuffer(b"".join(sigs.to_pylist()), np.uint32).reshape(-1, COORDINATES)
    return mix(rows.astype(np.uint64) ^ _COORDINATE[None, :])


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, counts = np.unique(_tokens(batch.column(0)), return_counts=True)
        held = counts >= 2
        yield pa.RecordBatch.from_arrays([pa.array(values[held].view(np.int64)), pa.array(counts[held])], ["token", "n"])


def _post(heavy: np.ndarray, counts: np.ndarray):
    """heavy: sorted tokens; counts: how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                tokens = _tokens(part.column(2))
                order = tokens >> np.uint64(20)  # frequency first, then the number itself
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
                    order |= np.where(heavy[at] == tokens, np.minimum(counts[at], (1 << 19) - 1), 0).astype(np.uint64) << np.uint64(44)
                first = np.argpartition(order, PREFIX - 1, axis=1)[:, :PREFIX]
                chosen = np.take_along_axis(tokens, first, axis=1).ravel().view(np.int64)
                rep, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(chosen), pa.array(np.repeat(rep, PREFIX)), pa.array(np.repeat(n, PREFIX))], ["token", "rep", "n"])

    return run


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sig_a, sig_b) that agree in enough coordinates."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, COORDINATES) for k in (2, 3))
        yield batch.filter(pa.array((x == y).sum(axis=1) >= MATCHES)).select(["a", "b"])


def _confirm(percent: int):
    """Pairs (a, b, text_a, text_b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = byte_texts(batch.column(2)), byte_texts(batch.column(3))
            good = []
            for lo, hi in in_chunks([x + y for x, y in zip(left, right, strict=True)]):
                for s, t in zip(shingle_sets(left[lo:hi]), shingle_sets(right[lo:hi]), strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return run


def _small(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _representatives(described: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, sig) of one document of each set. Where no row repeats an id and few are left out, signatures
    stay where they are; else they are dealt by id."""
    rows = described.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "sig")
    others = described.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "h1", "h2").join(sets, ["h1", "h2"]).filter("doc_id <> rep").select("doc_id")
    others = keep(sized(others, n), "mh-others")
    repeated = not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()
    if not repeated and others.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(others), "doc_id", "left_anti")
    return keep(rows.join(sets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "mh-sigs")


def _colliding(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= COLLISIONS).select("a", "b")


def _links(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """Of pairs(a, b) of n documents at most, those that agree by signature and then by whole sets."""
    mark, most = kept_so_far(), pairs.count()

    def both(df: DataFrame, side: DataFrame, what: str) -> DataFrame:
        for x in ("a", "b"):
            df = df.join(side.select(F.col("doc_id").alias(x), F.col(what).alias(f"{what}_{x}")), x)
        return df.select("a", "b", f"{what}_a", f"{what}_b")

    def named(df: DataFrame) -> DataFrame:
        return _small(keep(sized(df.select(F.col("a").alias("doc_id")).union(df.select("b")).distinct(), min(n, 2 * most)), "mh-named"))

    # only signatures and texts that a pair names are shuffled
    close = keep(sized(both(pairs, sigs.join(named(pairs), "doc_id", "left_semi"), "sig"), most, PAIRS_A_TASK).mapInArrow(_agree, "a long, b long"), "mh-close")
    most = close.count()
    wanted = keep(texts.join(named(close), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "mh-texts")
    links = keep(sized(both(close, wanted, "text"), most, PAIRS_A_TASK).mapInArrow(_confirm(percent), "a long, b long"), "mh-links")
    drop_kept_since(pairs.sparkSession, mark, links)
    return links


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = byte_texts(batch.column(1))
        for lo, hi in in_chunks(texts):
            values, counts = np.unique(np.concatenate(shingle_sets(texts[lo:hi])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["shingle", "n"])


def _first_shingles(often: np.ndarray, counts: np.ndarray, percent: int):
    """The first shingles of each set, rare ones first, as far as a similar set could have its first shared one. often:
    sorted shingles; counts: how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), byte_texts(batch.column(1))
            for lo, hi in in_chunks(texts):
                first = []
                for s in (sets := shingle_sets(texts[lo:hi])):
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        s = s[np.lexsort((s, np.where(often[at] == s, counts[at], 0)))]
                    first.append(s[: len(s) - -(-percent * len(s) // 100) + 1])
                k = np.array([len(s) for s in first])
                place = np.concatenate([np.arange(n) for n in k])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(ids[lo:hi], k)), pa.array(np.repeat([len(s) for s in sets], k)), pa.array(place)], ["shingle", "rep", "n", "p"])

    return run


def _crowded_pairs(crowd: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of crowd(rep, component) in different components, among them all that are similar enough.

    Sets of x and y shingles, x <= y, need percent (x + y) / (100 + percent) shingles in common. Then their first common
    one, in any order of all shingles, stands early in both: the smaller set posts only what a set of its own size or more
    could need, and what follows the shared shingle must still hold the rest.
    """
    members = keep(texts.join(_small(crowd.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "mh-crowd")
    often = members.mapInArrow(_shingles, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_LEAST)
    listed = np.array([(r[0], r[1]) for r in often.orderBy(F.desc("n"), "shingle").limit(HEAVY_MOST).collect()], np.int64).reshape(-1, 2)
    values = listed[:, 0].copy().view(np.uint64)
    by = np.argsort(values)
    posted = members.mapInArrow(_first_shingles(values[by], listed[by, 1], percent), "shingle long, rep long, n long, p long").join(crowd, "rep")
    posted = keep(posted, "mh-first-shingles")
    a, b = posted.alias("a"), posted.alias("b")
    x, y, both = F.col("a.n"), F.col("b.n"), F.lit(100 + percent)
    return (
        a.filter(both * (x - F.col("a.p")) >= 2 * percent * x)
        .join(
            b,
            (F.col("a.shingle") == F.col("b.shingle"))
            & ((x < y) | ((x == y) & (F.col("a.rep") < F.col("b.rep"))))
            & (F.col("a.component") != F.col("b.component"))
            & (F.lit(100) * x >= F.lit(percent) * y)
            & (both * F.least(x - F.col("a.p"), y - F.col("b.p")) >= F.lit(percent) * (x + y)),
        )
        .select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least id it reaches by links), kept."""
    spark, mark = docs.sparkSession, kept_so_far()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = keep(texts.mapInArrow(_describe, "doc_id long, n_shingles long, h1 long, h2 long, sig binary"), "mh-sets")
    rows = described.drop("sig")
    is_real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    real = rows.filter(is_real)
    n = real.count()
    sets = keep(sized(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.max("n_shingles").alias("n")), n), "mh-reps")
    reps = _representatives(described, sets, n)

    often = reps.select("sig").mapInArrow(_often, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_LEAST)
    listed = np.array([(r[0], r[1]) for r in often.orderBy(F.desc("n"), "token").limit(HEAVY_MOST).collect()], np.int64).reshape(-1, 2)
    heavy, counts = listed[:, 0].astype(np.int64).view(np.uint64), listed[:, 1]
    by = np.argsort(heavy)
    postings = reps.select("doc_id", "n_shingles", "sig").mapInArrow(_post(heavy[by], counts[by]), "token long, rep long, n long")
    posted = n * PREFIX
    lists = keep(sized(postings.groupBy("token").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("token", "hub"), posted // 2), "mh-lists")
    shared = keep(sized(postings.join(lists, "token"), posted), "mh-postings")  # postings of lists of two or more

    fits = lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)
    stars = _colliding(shared.filter(F.col("rep") != F.col("hub")).select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    stars = keep(sized(stars, posted // COLLISIONS), "mh-stars")
    first = _links(stars, reps, texts, percent, n)
    joined = keep(sized(components(first), n), "mh-first")

    # members of a list that are in different components yet
    placed = shared.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("token", "rep", "n", F.coalesce("component", "rep").alias("component"))
    placed = keep(sized(placed, posted), "mh-placed")
    open_lists = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("c")).filter("x <> y").select("token", "c")
    left = keep(sized(placed.join(open_lists, "token"), posted), "mh-open")
    a, b = left.filter(F.col("c") <= CROWD).alias("a"), left.filter(F.col("c") <= CROWD).alias("b")
    rest = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.component") != F.col("b.component")) & fits(F.col("a.n"), F.col("b.n"))).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    # two of a crowded list are both in the crowd; of others every collision counts here
    rest = _colliding(rest)
    crowd = keep(sized(left.filter(F.col("c") > CROWD).select("rep", "component").distinct(), n), "mh-crowd-ids")
    rest = rest.unionByName(_crowded_pairs(crowd, texts, percent)).distinct()
    rest = rest.join(stars, ["a", "b"], "left_anti")
    second = _links(keep(rest, "mh-rest"), reps, texts, percent, n)
    found = keep(sized(components(first.unionByName(second)), n), "mh-components")
    # documents of a set of their own that nothing links are their own class: only the others are joined
    by_set = sets.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").filter("component is not null or rep < last")
    by_set = keep(sized(by_set.select("h1", "h2", F.coalesce("component", "rep").alias("component")), n), "mh-classes")
    drop_kept_since(spark, mark, described, by_set)
    classed = real.join(by_set, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    alone = rows.filter(~F.coalesce(is_real, F.lit(False))).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return classed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
