"""Words and texts without bound: the same results in windows as at once."""

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.llm import lattice_lm, shared, subword_classifier
from test_llm_more import PIECES, frame

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789+/"


def long_text(kind, n):
    rng = random.Random(3)
    if kind == "ideographs":
        return "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n // 3))
    return "x" * n if kind == "one letter" else "".join(rng.choices(LETTERS, k=n))


@pytest.mark.parametrize("places", [1 << 16, 100])
@pytest.mark.parametrize("kind", ["ideographs", "letters", "one letter"])
def test_a_long_word_scores_as_by_the_plain_recursion(kind, places, monkeypatch):
    monkeypatch.setattr(lattice_lm, "PLACES", places)
    pieces = lattice_lm.Pieces.from_file(PIECES)
    row = np.frombuffer(b" " + long_text(kind, 2_000).encode(), np.uint8)
    total, counts = lattice_lm.lattice(row[None], pieces, np.ones(1))
    for way in (lattice_lm.long_word, lattice_lm.place_by_place):
        counted = np.zeros(len(pieces.keys))
        assert np.isclose(way(row, pieces, counted), total[0], rtol=1e-10)
        assert np.isclose(way(row, pieces), total[0], rtol=1e-10)
        assert np.allclose(counted, counts, atol=1e-9)


def test_documents_without_white_space(spark):
    rows = [(k, long_text(kind, 60_000)) for k, kind in enumerate(("ideographs", "letters", "one letter"))] + [(5, "a short text"), (6, long_text("letters", 700))]
    got = {r.doc_id: r for r in lattice_lm.score(frame(spark, rows), PIECES).collect()}
    assert all(np.isfinite(r.score) and r.score < 0 for r in got.values())
    assert {k: (r.n_tokens, r.held_out) for k, r in got.items()} == {k: (4 if k == 5 else 2, k in (1, 6)) for k in got}
    assert got[6].score < -700  # no whole word of the training texts: spelled by its pieces


def test_words_of_any_length_score_alike_parted_or_not(monkeypatch):
    pieces = lattice_lm.Pieces.from_file(PIECES)
    words = pa.array([w.encode() for w in ["a", "short", "text", "漢字", long_text("letters", 700)]], pa.binary())
    monkeypatch.setattr(lattice_lm, "LONG_WORD", 1)
    parted = lattice_lm.marginals(words, pieces)
    monkeypatch.setattr(lattice_lm, "LONG_WORD", 1 << 20)
    assert np.allclose(parted, lattice_lm.marginals(words, pieces))


@pytest.mark.parametrize("places", [7, 1_000])
def test_features_of_windows_are_those_of_the_whole(places, monkeypatch):
    texts = [x.encode() for x in ("", "  ", "two words", "é 漢字 " * 40, "a" * 3_000, "b\tc\n\nd " * 30)]

    def counts():
        out = np.zeros((len(texts), subword_classifier.BUCKETS), np.int64)
        for bucket, owner in subword_classifier.features(texts):
            np.add.at(out, (owner, bucket), 1)
        return out

    whole = counts()
    assert whole[2].sum() == 2 + len(" two ") - 2 + len(" words ") - 2 + len(" two ") - 3 + len(" words ") - 3
    monkeypatch.setattr(subword_classifier, "PLACES", places)
    assert (counts() == whole).all()


def test_a_text_of_many_megabytes_is_classified(spark):
    rows = [(k, f"good words number {k}" if k % 2 else f"bad things {k}") for k in range(40)] + [(100, "good words " * 1_900_000), (101, "z" * 5_000_000)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in subword_classifier.classify(frame(spark, rows), labels).collect()}
    assert got[100] > 0.5 and 0 <= got[101] <= 1


def test_operators_in_two_threads_drop_their_own_tables(spark):
    def work(k):
        mark = shared.kept_so_far()
        mine = [shared.keep(spark.range(k, k + 3).toDF("x"), f"thread-{k}") for _ in range(3)]
        shared.drop_kept_since(spark, mark, mine[-1])
        return mine[-1].agg(F.sum("x")).first()[0]

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, [0, 10, 20, 30])) == [3, 33, 63, 93]


def test_bit_arrays_hold_all_of_their_hashes_and_few_others(spark, monkeypatch):
    from lodestack.llm import winnowing

    listed, others = (spark.range(lo, lo + 500).select(F.xxhash64("id").alias("h")) for lo in (0, 10_000))

    def passed(df, bits):
        return df.filter(winnowing.maybe(bits, F.col("h"))).count()

    bits = winnowing.bit_array(listed)
    assert passed(listed, bits) == 500 and passed(others, bits) < 80
    assert passed(others, winnowing.bit_array(listed.limit(0))) == 0
    monkeypatch.setattr(winnowing, "MOST_BITS", 64)
    assert passed(listed, winnowing.bit_array(listed)) == 500


def test_a_passage_of_many_items(spark):
    """Four hundred items share a passage that one document holds thrice: all are told, and the words count once."""
    from lodestack.llm import winnowing

    passage = " ".join(f"p{i}" for i in range(60))
    items = spark.createDataFrame([(f"i{k}", f"own{k} {passage}") for k in range(400)] + [("short", "p0 p1 p2")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"{passage} x {passage} y {passage}"), (2, "p0 p1"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in winnowing.contamination(docs, items).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].n_items) == (182, 180, 401)
    assert sorted(rows[1]["items"]) == sorted([f"i{k}" for k in range(400)] + ["short"])
    assert [(rows[k].n_hit, rows[k].n_items, rows[k].contaminated) for k in (2, 3)] == [(0, 0, False)] * 2
    assert [r.doc_id for r in winnowing.contaminated(docs, items).collect()] == [1]
