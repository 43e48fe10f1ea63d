"""Embedding near-duplicates, whitening and periodic runs against brute force, and their edge cases; sizes of others."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import bloom_cascade, embedding_dedup, periodic_runs, pii_votes, queries, shared, whitening
from lodestack.llm.text import mix

FOLDER = "/root/testdata/sf0.001"
BAD = [(901, None), (902, []), (903, [0.0] * 64), (904, [math.nan] + [1.0] * 63), (905, [math.inf] + [1.0] * 63), (906, [None] + [1.0] * 63), (907, [1.0, 2.0]), (908, [2.0, 4.0]), (None, [1.0] * 64)]


def vectors(spark, rows, schema="vec_id long, embedding array<float>, label int, id long, h long, cell string, x string, key string"):
    return spark.createDataFrame([(i, v, 1, 2, 3, "4", "5", "6") for i, v in rows], schema)


# ---------------------------------------------------------------- near-duplicates


def linked(ids, m):
    """Links and component of each vector, by all products."""
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    comp = np.array(ids)
    while True:
        new = np.minimum(comp, np.where(s, comp[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == comp).all():
            return s.sum(axis=1), comp
        comp = new


def planted(n, seed=3):
    """Vectors, each with a neighbour at a cosine just over the bound, two dense groups and two groups of equal ones."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x, noise = unit(rng.standard_normal((n, 64))), rng.standard_normal((n, 64))
    noise = unit(noise - (noise * x).sum(1, keepdims=True) * x)
    c = rng.uniform(0.9001, 0.95, n)[:, None]
    g, h = unit(rng.standard_normal(64)), unit(rng.standard_normal(64))
    parts = [x, c * x + np.sqrt(1 - c * c) * noise, g + rng.standard_normal((n // 4, 64)) * 0.02, h + rng.standard_normal((n // 4, 64)) * 0.04, np.repeat(x[:2], n // 10, axis=0)]
    m = np.concatenate(parts).astype("f4")
    return rng.permutation(len(m)).tolist(), m


def both(spark, ids, m):
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors(spark, [(i, v.tolist()) for i, v in zip(ids, m, strict=True)])).collect()}
    assert len(got) == len(ids) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    links, comp = linked(ids, m.astype(float))
    return np.array([got[i].n_links for i in ids]), np.array([got[i].component_id for i in ids]), links, comp


def test_one_cell_is_exact(spark):
    shared.ship(spark)
    got, comp, links, components = both(spark, *planted(600))
    assert (got == links).all() and (comp == components).all()


def test_cells_find_nearly_all_links_and_make_none(spark, monkeypatch):
    """Several levels of cells: no vector gets a link too many; dense groups and equal vectors are whole."""
    shared.ship(spark)
    monkeypatch.setattr(embedding_dedup, "SPLIT", 512)
    monkeypatch.setattr(embedding_dedup, "A_CELL", 64)
    ids, m = planted(4000)
    got, comp, links, components = both(spark, ids, m)
    assert (got <= links).all()
    pairs = slice(0, 8000)
    assert got[pairs].sum() >= 0.97 * links[pairs].sum()
    assert (got[8000:] == links[8000:]).all()
    assert (comp[8000:] == components[8000:]).all()


def test_blocks_count_as_one_cell(spark, monkeypatch):
    """A loose group that k-means cannot part: every pair of blocks is a task."""
    shared.ship(spark)
    monkeypatch.setattr(embedding_dedup, "SPLIT", 100)
    monkeypatch.setattr(embedding_dedup, "A_BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "LEVELS", 2)
    rng = np.random.default_rng(5)
    h = rng.standard_normal(64)
    m = (h / np.linalg.norm(h) + rng.standard_normal((700, 64)) * 0.038).astype("f4")
    got, comp, links, components = both(spark, list(range(700)), m)
    assert (got == links).all() and (comp == components).all()


def test_vectors_that_cannot_link(spark):
    shared.ship(spark)
    good = [(1, [1.0] * 64), (1, [1.0] * 64), (2, [1.0] * 63 + [1.5]), (3, [-1.0] * 64)]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(vectors(spark, good + BAD)).collect()}
    alone = {(i, 0, i, True) for i in (3, 901, 902, 903, 904, 905, 906, None)}
    assert got == {(1, 2, 1, True), (2, 2, 1, False), (907, 1, 907, True), (908, 1, 907, False)} | alone
    assert embedding_dedup.near_duplicates(vectors(spark, [])).collect() == []
    assert {r.kept for r in embedding_dedup.near_duplicates(vectors(spark, BAD[:3])).collect()} == {True}


# ---------------------------------------------------------------- whitening


def plain_whitening(m):
    x = np.floor(256 * m.astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes[:, ::-1] / np.sqrt(values[::-1]), values[::-1] / values.sum()


@pytest.mark.parametrize("most", [5, 8_320])
def test_whitening_is_that_of_numpy(spark, monkeypatch, most):
    shared.ship(spark)
    monkeypatch.setattr(whitening, "MOST_SUMS", most)
    rng = np.random.default_rng(1)
    m = (rng.standard_normal((300, 7)) * np.arange(1, 8)).astype("f4")
    m = np.concatenate([m, m[:100]])  # repeats count once
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    got = whitening.whiten(vectors(spark, rows + BAD)).collect()
    n, deviation, white, share = plain_whitening(m)
    assert len(got) == 4 * len(m)
    for k in range(4):
        part = {r.vec_id: r for r in got if r.component == k + 1}
        w = np.array([part[i].whitened for i in range(len(m))])
        assert min(abs(w - white[:, k]).max(), abs(w + white[:, k]).max()) < 1e-9
        assert [part[i].deviation for i in range(len(m))] == deviation.tolist()
        assert {r.n for r in part.values()} == {n} and all(abs(r.explained - share[k]) < 1e-12 for r in part.values())
    assert all(0 <= r.identity_error < 1e-9 for r in got)


def test_whitening_of_little(spark):
    shared.ship(spark)
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, BAD[:2])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (2, [2.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(round(r.whitened, 6)), r.explained) for r in got) == [(1, 1, 2, 256**2, 1.0, 1.0)] + [(2, 1, 2, 256**2, 1.0, 1.0)] * 2


def test_whitening_of_the_table(spark):
    got = queries.op13_whitening(spark, FOLDER).toPandas()
    assert len(got) == 2000 and got.identity_error.max() < 1e-9 and got.explained.is_monotonic_decreasing is not None


# ---------------------------------------------------------------- periodic runs


def plain_runs(words):
    """(start, length, period) of every run, from the words that equal the q-th next one."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, size, q) for (s, size), q in best.items())


def plain_answer(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        words = words[:a] + [words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(a, n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    top = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *top, digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_sequences(seed):
    rng = np.random.default_rng(seed)
    for t in range(300):
        x = rng.integers(0, rng.integers(1, 5), rng.integers(0, 130))
        if t % 3 == 0 and len(x) > 20:
            a = rng.integers(0, len(x) - 1)
            x[a:] = x[a + np.arange(len(x) - a) % rng.integers(1, (len(x) - a) // 2 + 2)]
        got = [(s, e - s, q) for s, e, q in periodic_runs.runs_of(mix(x.astype(np.uint64))).tolist()]
        assert got == sorted(plain_runs(x.tolist()), key=lambda r: (r[0], r[2]))


def test_runs_of_long_sequences():
    """Half a million words of a Fibonacci word and of one word alone: linear, not by pairs."""
    a, b = "0", "01"
    while len(b) < 300_000:
        a, b = b, b + a
    fib = np.frombuffer(b.encode(), np.uint8).astype(np.uint64)
    got = periodic_runs.runs_of(mix(fib))
    # a Fibonacci word of length F(n) has 2 F(n - 2) - 3 maximal runs; those of under 12 words are left out
    assert 0 < len(got) < 2 * len(fib)
    assert periodic_runs.runs_of(mix(np.zeros(500_000, np.uint64))).tolist() == [[0, 500_000, 1]]


def test_equal_hashes_are_found_out(monkeypatch):
    """Runs that prefix hashes make up are seen, and the segment is done with other bases."""
    x = np.random.default_rng(2).integers(0, 2, 400)
    honest = periodic_runs._Agreement.equal
    monkeypatch.setattr(periodic_runs._Agreement, "equal", lambda self, i, j, size: honest(self, i, j, size) | (self.seed_is_first & (size == 3)))
    init = periodic_runs._Agreement.__init__

    def start(self, ids, seed):
        init(self, ids, seed)
        self.seed_is_first = seed == 0

    monkeypatch.setattr(periodic_runs._Agreement, "__init__", start)
    got = [(s, e - s, q) for s, e, q in periodic_runs.segment_runs(x).tolist()]
    assert sorted(got) == plain_runs(x.tolist())


def test_op12_is_the_plain_answer(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, FOLDER, "documents").collect()}
    got = {r.doc_id: tuple(r)[2:] for r in queries.op12_periodic_runs(spark, FOLDER).collect()}
    short = {i: t for i, t in docs.items() if len(t or "") < 12_000}
    assert got.keys() == docs.keys() and len(short) > 100
    for i, t in short.items():
        assert got[i] == plain_answer(i, t), i


def test_op12_edges(spark):
    shared.ship(spark)
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 11), (5, "a " * 12), (6, "a b " * 6), (6, "a b " * 6), (None, "x y z " * 9), (33, "la " * 40 + "end é ü 🙂 " * 8), (20, "é ü " * 30)]
    looped = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    texts += [(i, " ".join(f"w{k}" for k in range(40 + i))) for i in looped]
    df = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in texts], "doc_id long, text string, n_runs int, start string, period int")
    got = sorted((repr(r.doc_id), tuple(r)[2:]) for r in periodic_runs.periodic_runs(df, loops=True).collect())
    assert got == sorted((repr(i), plain_answer("no id" if i is None else i, t)) for i, t in texts)
    assert periodic_runs.periodic_runs(df.limit(0), loops=True).collect() == []


def test_collapse_keeps_first_periods(spark):
    shared.ship(spark)
    df = spark.createDataFrame([(1, "start " + "do re mi " * 5 + "end"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in periodic_runs.collapse(df).collect()}
    assert got == {1: ("start do re mi end", [(1, 15, 3)]), 2: ("", [])}


# ---------------------------------------------------------------- bounds of earlier operators


def test_a_few_rules_take_few_bits(spark):
    """Four listed keys among a million: the cascade is sized by the list, and exact."""
    shared.ship(spark)
    keys = spark.range(1_000_000).select(F.xxhash64("id").alias("h"), F.col("id").isin(5, 77, 4_000, 999_999).alias("listed"))
    levels = bloom_cascade.cascade(keys)
    assert sum(x.bits for x in levels) < 8 * 10_000
    rows = keys.toPandas()
    assert (bloom_cascade.listed(levels, rows.h.to_numpy().view(np.uint64)) == rows.listed.to_numpy()).all()
    assert bloom_cascade.first_bits(4, 4 * 10**12) < 8 * 1_000 and bloom_cascade.first_bits(10**6, 10**13) < bloom_cascade.MOST_BITS


def test_long_runs_of_address_characters(spark):
    """Two megabytes without a break, before an address that is spelled out: linear, and the address is found."""
    import time

    shared.ship(spark)
    text = "x" * 2_000_000 + " dot mail mary (at) site dot com or jo at home dot org"
    found = pii_votes._matches(F.col("text"), pii_votes.LOOSE["email"], pii_votes.LOOSE_HINT["email"])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").select(found.alias("m"))
    began = time.time()
    got = df.first().m
    assert time.time() - began < 20
    assert [text[s.start : s.end] for s in got] == ["mary (at) site dot com", "jo at home dot org"]


def test_pipeline_is_its_stages(spark, tmp_path):
    """``run`` gives what the stages give when each is written and read by hand."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.select(*got.columns).collect()))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0 and sizes[4] == sizes[5]
