"""The operators on repeated ids, long texts and their bounds, and against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestack.llm import bloom_cascade, lattice_lm, line_cleaning, minhash, mixing, pii_votes, queries, sentence_spans, shared, subword_classifier, token_ids, winnowing
from lodestack.llm.text import IS_WHITE, Words

FOLDER = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    shared.ship(spark)
    return queries.table(spark, FOLDER, "documents")


def frame(spark, rows):
    shared.ship(spark)
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---------------------------------------------------------------- words


def test_long_words_are_hashed_alike_wherever_they_stand():
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    one, other = Words([long, b"a " + long + b" b"]), Words([b"x", long])
    assert one.hashes[0] == one.hashes[2] == other.hashes[1] and len(set(one.hashes.tolist())) == 3


# ---------------------------------------------------------------- op1


def test_document_score_is_the_sum_over_all_segmentations(spark):
    rows = [(i, t) for i, t in enumerate(["the thin thing", "a thing thinks", "the the a", "thin ice thaws", "things", None, "then a thicket"] * 2)]
    got = {r.doc_id: r for r in lattice_lm.score(frame(spark, rows), PIECES).collect()}
    held = {r.doc_id for r in got.values() if r.held_out}
    count = Counter(w for i, t in rows if i not in held for w in words(t))
    ends = len(rows) - len(held)
    start = lattice_lm.Pieces.from_file(PIECES)
    logp, names = start.logp, {}
    for w in {w for _, t in rows for w in words(t)}:
        text = b" " + w.encode()
        for a in range(len(text)):
            for b in range(a + 1, len(text) + 1):
                k = np.flatnonzero(start.keys == lattice_lm._whole_key(text[a:b])[0])
                if len(k):
                    names[text[a:b]] = int(k[0])

    def spelled(text, p, at=0):
        """(probability, expected counts) by every segmentation."""
        if at == len(text):
            return 1.0, Counter()
        total, expected = 0.0, Counter()
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in names:
                k = names[text[at:end]]
                rest, own = spelled(text, p, end)
                mass = math.exp(p[k]) * rest
                total += mass
                expected[k] += mass
                for key, m in own.items():
                    expected[key] += math.exp(p[k]) * m
        return total, expected

    n, distinct = sum(count.values()), len(count)
    one, two = sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values())
    discount = min(0.9, max(0.1, one / (one + 2 * two))) if one + two else 0.5
    by_file = np.exp(start.logp)
    for _ in range(lattice_lm.ROUNDS):
        counts = np.zeros(len(logp))
        for w in count:
            total, expected = spelled(b" " + w.encode(), logp)
            for k, m in expected.items():
                counts[k] += discount * m / total
        counts = (1 - lattice_lm.FILE_SHARE) * counts + lattice_lm.FILE_SHARE * counts.sum() * by_file
        mass = n - discount * distinct + counts.sum() + ends
        logp = np.log(counts / mass)
    end = math.log10(ends / mass)
    for i, t in rows:
        want = end + sum(math.log10(max(count[w] - discount, 0) / mass + spelled(b" " + w.encode(), logp)[0]) for w in words(t))
        assert math.isclose(got[i].score, want, rel_tol=1e-6), (t, got[i].score, want)


# ---------------------------------------------------------------- op2


def test_every_prefix_of_the_schedule_holds_the_shares(docs):
    plan = mixing.Plan(docs, block=16)
    share = {r.sid: r.hi - r.lo for r in plan.sources.collect()}
    slots = plan.slots.orderBy("id").collect()
    assert len(slots) > 1000 and len({r.sid for r in slots}) > 2
    seen = Counter()
    for k, r in enumerate(slots, 1):
        seen[r.sid] += 1
        assert all(abs(seen[s] - share[s] * k) <= 6 for s in share), k
    # points that follow no low-discrepancy sequence break the balance
    flat = mixing.Plan(docs, block=16, points=lambda slot: (slot + F.lit(0.5)) / F.lit(float(len(slots))))
    seen, worst = Counter(), 0.0
    for k, r in enumerate(flat.slots.orderBy("id").collect(), 1):
        seen[r.sid] += 1
        worst = max(worst, *(abs(seen[s] - share[s] * k) for s in share))
    assert worst > 50


def test_the_result_hangs_on_the_points(spark, docs):
    one = {r.doc_id: (r.first_slot, r.last_slot) for r in mixing.taken(docs).collect()}
    flat = {r.doc_id: (r.first_slot, r.last_slot) for r in mixing.taken(docs, points=lambda slot: slot * F.lit(0.0)).collect()}
    assert one != flat
    rows = mixing.mix(docs, position="slot", block=16).collect()
    assert [r.slot for r in rows] == sorted(r.slot for r in rows)
    total = sum(len(words(r.text)) for r in rows)
    by_source = Counter()
    for r in rows:
        by_source[r.source] += len(words(r.text))
    seen, done = Counter(), 0
    longest = max(len(words(r.text)) for r in rows)
    for r in rows:
        seen[r.source] += len(words(r.text))
        done += len(words(r.text))
        assert all(abs(seen[s] - by_source[s] * done / total) <= 3 * longest for s in by_source)


def test_sources_beyond_the_broadcast_bound_mix_the_same(docs, monkeypatch):
    want = {r.doc_id: (r.taken, r.first_slot) for r in mixing.taken(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert {r.doc_id: (r.taken, r.first_slot) for r in mixing.taken(docs).collect()} == want


def test_golden_points(spark):
    slots = [0, 1, 2, 12345, 123456789, (1 << 32) - 1, (1 << 33) + 7]
    got = spark.createDataFrame([(s,) for s in slots], "s long").select("s", mixing.golden(F.col("s")).alias("p")).collect()
    assert all(math.isclose(r.p, ((r.s * 2654435769) % (1 << 32) + 0.5) / (1 << 32)) for r in got)


# ---------------------------------------------------------------- op3


def test_added_spans_of_every_kind(spark):
    rows = [(i, f"please contact mary{i}@site{i}.com or call +1 (415) 555-01{i % 90 + 10} now, card 4111 1111 1111 1111, host 10.0.0.{i}") for i in range(60)]
    rows += [(100, "my card 4111.1111.1111.1111 ok"), (101, "my card 4111.1111.1111.1112 no"), (102, "ratio 1::2 no")]
    got = {r.doc_id: r.s for r in pii_votes.find(frame(spark, rows)).select("doc_id", pii_votes.written(F.col("spans")).alias("s")).collect()}
    assert (got[100], got[101], got[102]) == ("card:8:27", "", "")


def test_candidates_of_addresses_and_their_surroundings(spark):
    text = "host fe80::1ff:fe23:4567:890a,1:2:3:4:5:6:7:8 x::1 a:b"
    found = pii_votes._matches(F.col("text"), pii_votes.LOOSE["ip"], pii_votes.LOOSE_HINT["ip"])
    got = frame(spark, [(1, text)]).select(found.alias("m")).first().m
    assert [(text[s.start : s.end], s.before, s.left, s.right) for s in got] == [("fe80::1ff:fe23:4567:890a", "host ", " ", ","), ("1:2:3:4:5:6:7:8", ",", ",", " ")]


def test_reliabilities_match_a_plain_version(spark):
    rng = np.random.default_rng(11)
    combos = sorted({tuple(int(x) for x in rng.integers(-1, 2, pii_votes.N_VOTES)) for _ in range(12)})
    rows = [(list(c), [f"s{i}"], float(3 * i + 1)) for i, c in enumerate(combos)]
    df = spark.createDataFrame([(rows,)], "combos array<struct<votes:array<int>,shape:array<string>,n:double>>")
    got = df.select(pii_votes._em(F.col("combos")).alias("s")).first().s
    prior, right = 0.5, np.array([0.95, 0.7, 0.8, 0.7, 0.8])
    votes, n = np.array(combos), np.array([r[2] for r in rows])
    for _ in range(pii_votes.ROUNDS):
        q = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + votes @ np.log(right / (1 - right)))))
        good = (n[:, None] * np.where(votes == 1, q[:, None], np.where(votes == -1, 1 - q[:, None], 0))).sum(0)
        right = np.clip((good + 1) / ((n[:, None] * abs(votes)).sum(0) + 2), 0.02, 0.98)
        prior = float(np.clip(((n * q).sum() + 1) / (n.sum() + 2), 0.02, 0.98))
    assert math.isclose(got.prior, prior, rel_tol=1e-9) and np.allclose(got.right, right)


def test_a_text_of_many_numbers(spark):
    text = " x ".join(str(k % 1000) for k in range(200_000)) + " y 4111 1111 1111 1111 z " + " ".join(f"10.0.{k % 256}.1;" for k in range(20_000))
    row = pii_votes.find(frame(spark, [(1, text)])).first()
    kinds = Counter(s.kind for s in row.base)
    assert kinds == {"card": 1, "ip": 20_000}
    assert all(text[s.start : s.end].startswith("10.0.") for s in row.base[1:2000])


# ---------------------------------------------------------------- op4


def test_fit_matches_a_plain_version():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        b = np.unique(rng.integers(0, 50, 8)).astype(np.int32)
        rows.append((i % 2, b, np.full(len(b), 1 / len(b), np.float32)))
    weights, bias = subword_classifier.fit(rows, seed=3)
    r = np.random.default_rng(3)
    table = r.uniform(-1 / 8, 1 / 8, (subword_classifier.BUCKETS, 8)).astype(np.float64)
    out, b, done = np.zeros((2, 8)), np.zeros(2), 0
    for _ in range(subword_classifier.EPOCHS):
        for k in r.permutation(len(rows)):
            y, buckets, share = rows[k]
            rate = subword_classifier.RATE * (1 - done / (subword_classifier.EPOCHS * len(rows)))
            done += 1
            mean = sum(s * table[x] for x, s in zip(buckets, share, strict=True))
            p = np.exp(out @ mean + b)
            gap = (p / p.sum() - np.eye(2)[y]) * rate
            step = gap @ out
            for x, s in zip(buckets, share, strict=True):
                table[x] = table[x] - 50 * s * step / max(1.0, 50 * float(share.max()))
            out -= np.outer(gap, mean)
            b -= 0.1 * gap
    assert np.allclose(weights, table @ (out[1] - out[0]), atol=1e-3) and math.isclose(bias, b[1] - b[0], abs_tol=1e-3)


def test_fit_bounds_hold_for_repeated_ids(spark, monkeypatch):
    docs = frame(spark, [(i % 3, f"text number {i} of some words") for i in range(30)])
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(subword_classifier, "fit", lambda rows, seed=7: (seen.append(len(rows)), (np.zeros(subword_classifier.BUCKETS, np.float32), 0.0))[1])
    subword_classifier.classify(docs, labels, fit_rows=5)
    subword_classifier.classify(docs, labels, fit_bytes=100)
    assert seen[0] == 5 and seen[1] <= 4


# ---------------------------------------------------------------- op5

PROSE = ["Next, we measured how the tide rises and falls over one long day.", "Search parties left at dawn and came back late in the evening.", "She baked a cookie for all of the children in the class.", "Home is where the heart is, as they have always said here.", "Weiter oben am Hang stand damals noch eine kleine alte Hütte.", "Retour à la maison, elle trouva la porte ouverte et la lampe allumée.", "Anterior a la guerra, la plaza tenía una fuente de piedra clara.", "The copyright law of that year changed little for most of us."]
JUNK = ["Home.", "Menü.", "Lire la suite.", "Iniciar sesión.", "We use cookies, see the privacy policy.", "Todos los derechos reservados.", "Tous droits réservés.", "Alle Rechte vorbehalten.", "Home > Products > All of them.", "no sentence end here"]


def test_prose_in_four_languages_stays_and_junk_goes(spark):
    rows = [(1, "\n".join(PROSE)), (2, "\n".join(PROSE + JUNK)), (3, "\n".join(PROSE[:1] + JUNK * 4))]
    got = {r.doc_id: r for r in line_cleaning.clean_lines(frame(spark, rows)).collect()}
    assert got[1].kept and got[1].n_failed_lines == 0
    assert got[2].cleaned == "\n".join(PROSE) and got[2].n_failed_lines == len(JUNK)
    assert not got[3].kept


# ---------------------------------------------------------------- op6


@pytest.mark.parametrize("most", [1 << 28, 1])
def test_repeated_rows_of_pages_are_judged_each(spark, most):
    rows = [(1, "http://a.net/"), (1, "http://a.net/"), (1, "http://b.org/fr/x"), (None, "http://a.net/"), (None, "http://c.de/"), (2, None)]
    got = bloom_cascade.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES, most_bits=most).collect()
    assert Counter((r.page_id, r.rule, r.verdict) for r in got) == Counter([(1, "net/", "block"), (1, "net/", "block"), (1, "org/fr/", "allow"), (None, "net/", "block"), (None, None, "allow"), (2, None, "allow")])


# ---------------------------------------------------------------- op7


def brute_sentences(text):
    """Word ranges of sentences and pieces, by their definitions."""
    w = Words([text.encode()])
    n = len(w.starts)
    if not n:
        return []
    data = text.encode()
    begins = {0}
    for i in range(n - 1):
        word = data[w.starts[i] : w.ends[i]].decode()
        while len(word) > 1 and word[-1] in "\"')]}’”“»›":
            word = word[:-1]
        if word[-1] in ".!?" or b"\n" in data[w.ends[i] : w.starts[i + 1]]:
            begins.add(i + 1)
    rank = [0 if i in begins else int(h) | 1 for i, h in enumerate(w.hashes)]
    width = sentence_spans.LONGEST
    for k in range(n - width + 1):
        least = min(rank[k : k + width])
        begins |= {k + j for j in range(width) if rank[k + j] == least}
    edges = [*sorted(begins), n]
    return list(zip(edges, edges[1:], strict=False))


def brute_left(rows):
    """What is left of each (id, text) row, by the definition of runs and of what comes first."""
    held, first = {}, {}
    for i, t in rows:
        sents, ws, out = brute_sentences(t or ""), words(t), []
        for k in range(len(sents)):
            j = k + sentence_spans.RUN - 1
            while j < len(sents) and sents[j][1] - sents[k][0] < sentence_spans.RUN_WORDS:
                j += 1
            if j < len(sents):
                out.append((tuple(ws[sents[k][0] : sents[j][1]]), k, j + 1))
        held[i, t] = (sents, ws, out)
    for i, t in sorted(held, key=lambda x: (x[0], 0)):
        for run, k, _ in held[i, t][2]:
            first.setdefault(run, (i, t, k))
    left = {}
    for (i, t), (sents, ws, out) in held.items():
        gone = {s for run, k, stop in out if first[run] != (i, t, k) for s in range(k, stop)}
        left[i, t] = [w for s, (a, b) in enumerate(sents) if s not in gone for w in ws[a:b]]
    return left


def test_sentence_spans_match_brute_force(spark, docs):
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{x}{'.' * (k % 11 == 10)}" for k, x in enumerate(rng.integers(0, 9, 70)))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(10_000 + k, " ".join(f"q{x}" for x in rng.integers(0, 1 << 30, k)) + " " + passage + " end.") for k in range(0, 40, 3)]
    rows += [(20_000, passage + "\n" + passage), (20_001, None), (20_002, ""), (20_003, "One. Two.")]
    want = brute_left(rows)
    got = {r.doc_id: words(r.text) for r in sentence_spans.remove_repeats(frame(spark, rows)).collect()}
    for (i, t), left in want.items():
        assert got[i] == left, i
    changed = {r.doc_id for r in sentence_spans.changed_documents(frame(spark, rows)).collect()}
    assert changed == {i for (i, t), left in want.items() if left != words(t)}


def test_spans_of_ids_with_several_texts(spark):
    passage = " ".join(f"w{k}." if k % 9 == 8 else f"w{k}" for k in range(70))
    rows = [(1, "Short."), (1, "Alpha opens here. " + passage), (1, passage + " Omega."), (1, passage + " Omega."), (2, "Beta. " + passage), (None, passage), (None, passage)]
    left = Counter((r.doc_id, len(words(r.text)) > 60) for r in sentence_spans.remove_repeats(frame(spark, rows)).collect())
    assert left[2, True] == 0 and left[None, True] == 2
    assert left[1, True] in (1, 2) and left[1, False] + left[1, True] == 4  # one of the two texts of id 1 keeps the passage


# ---------------------------------------------------------------- op8, and long texts


def test_a_hot_id_fills_several_files_in_order(spark):
    rows = [(7, f"text {k} here.") for k in range(400)] + [(None, "none"), (9, "last")]
    segments, ranks = token_ids.write_dataset(frame(spark, rows), queries.word_tokenizer(), n_tasks=4)
    assert segments.select("file").distinct().count() > 1
    got = token_ids.read_dataset(segments, ranks).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *[7] * 400, 9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def test_one_very_long_text(spark):
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"w{k}" for k in range(5_000)] + ["end."])
    long = " ".join(vocabulary[rng.integers(0, len(vocabulary), 3_800_000)])
    assert len(long) > 20_000_000
    docs = frame(spark, [(1, long), (2, "a short text. It ends."), (3, long)]).repartition(3)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).select("doc_id", "component_id").collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id for r in sentence_spans.changed_documents(docs).select("doc_id", "n_removed").collect()} == {3}
    n = {r.doc_id: r.n_tokens for r in lattice_lm.score(docs, PIECES).collect()}
    assert n == {1: 3_800_001, 2: 6, 3: 3_800_001}
    got = {r.doc_id: r.n_tokens for r in token_ids.read_dataset(*token_ids.write_dataset(docs, queries.word_tokenizer())).collect()}
    assert got[1] == got[3] > 3_800_000


# ---------------------------------------------------------------- op9


def planted(rng):
    """Pairs of texts with similarities from 0.6 to 0.95, and a passage that all of them share."""
    texts, k = {}, 0
    common = [f"c{x}" for x in range(30)]
    for common_words in np.linspace(150, 195, 120).astype(int):
        base = [f"x{v}" for v in rng.integers(0, 1 << 40, 200)]
        other = base[:common_words] + [f"y{v}" for v in rng.integers(0, 1 << 40, 200 - common_words)]
        texts[k], texts[k + 1] = " ".join(base + common), " ".join(other + common)
        k += 2
    return texts


def links(texts):
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    return {i: 100 * len(sets[i] & sets[i + 1]) >= 75 * len(sets[i] | sets[i + 1]) for i in texts if i % 2 == 0}


@pytest.mark.parametrize("bounds", [{}, {"CROWD": 1, "HEAVY_LEAST": 2, "HEAVY_MOST": 10, "BROADCAST_IDS": 0}])
def test_no_link_is_lost_at_any_bound(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(minhash, name, value)
    texts = planted(np.random.default_rng(8))
    want = links(texts)
    assert 20 < sum(want.values()) < 100
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, list(texts.items()))).collect()}
    assert {i: got[i + 1] == i for i in want} == want


# ---------------------------------------------------------------- op10


def test_contamination_of_rows_that_repeat_an_id(spark):
    item = " ".join(f"b{k}" for k in range(30))
    items = spark.createDataFrame([(1, item), (2, item), (3, "tiny item here")], "item_id long, text string")
    rows = [(5, item), (5, "before " + item + " " + item), (5, "a b c"), (None, "x " + item), (None, "y"), (6, "some tiny item here.")]
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in winnowing.contamination(frame(spark, rows), items).collect())
    assert got == Counter([(5, 30, 30, "1,2"), (5, 61, 60, "1,2"), (5, 3, 0, ""), (None, 31, 30, "1,2"), (None, 1, 0, ""), (6, 4, 3, "3")])


# ---------------------------------------------------------------- shared


def test_kept_tables_go(spark):
    mark = shared.kept_so_far()
    one, two = shared.keep(spark.range(3), "one"), shared.keep(spark.range(4), "two")
    shared.drop_kept_since(spark, mark, two)
    assert two.count() == 4
    with pytest.raises(Exception, match="(?i)not.exist|does not exist|FILE_NOT_EXIST"):
        one.count()
    assert shared.kept_so_far() == mark + 1


def test_white_space_is_what_the_contract_says():
    assert sorted(np.flatnonzero(IS_WHITE)) == [9, 10, 11, 12, 13, 32]


def test_overlaps_are_found_in_any_block(spark):
    strict = [(7 * k, 7 * k + 3) for k in range(700)]
    loose = [(k, k + 2) for k in range(0, 4_950, 3)]
    df = spark.createDataFrame([(loose, strict, [])], "a array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>, c array<struct<start:int,end:int>>")
    got = df.select(pii_votes._apart(F.col("a"), [F.col("b"), F.col("c"), F.col("b")]).alias("x")).first().x
    assert [tuple(s) for s in got] == [(a, b) for a, b in loose if not any(x < b and a < y for x, y in strict)]
