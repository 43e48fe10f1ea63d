"""The training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestack.llm import bloom_cascade, components, lattice_lm, line_cleaning, minhash, mixing, pii_votes, queries, sentence_spans, shared, subword_classifier, token_ids, winnowing
from lodestack.llm.text import Words

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, h1 string, row int, kind string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def make(spark, texts):
    """documents of texts, with null sources, extra columns and clashing names."""
    return spark.createDataFrame([(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", len(t or ""), "x", "y", 1, "z") for i, t in texts], SCHEMA)


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "One."), (5, "a b c d e f g h i j k l"), (6, "a b c d e f g h i j k l"), (6, "a b c d e f g h i j k l"), (7, "x" * 5000), (8, "Ä ö\u00a0ü 🙂 é. The end, indeed.\nNext | line | here |"), (9, "word " * 3000)]


@pytest.fixture(scope="module")
def edge(spark):
    shared.ship(spark)
    return make(spark, EDGE)


@pytest.fixture(scope="module")
def docs(spark):
    shared.ship(spark)
    return queries.table(spark, FOLDER, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_numpy_words_are_the_words():
    sample = [b"", b" a  bc\x0bd\n", "é\u00a0x\ty".encode()]
    w = Words(sample)
    assert [[w.word(i) for i in range(a, b)] for a, b in zip(w.first, w.last, strict=True)] == [[], [b"a", b"bc", b"d"], ["é\u00a0x".encode(), b"y"]]


def test_every_operator_takes_edge_cases_and_empty_tables(spark, edge):
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "B c d"), (2, None), (3, ""), (None, "a b"), (4, "a b c d e f g h i j k")], "item_id long, text string")
    runs = {
        "lm": lambda d: lattice_lm.score(d, vocabulary),
        "mix": lambda d: mixing.taken(d),
        "mixed": lambda d: mixing.mix(d),
        "pii": lambda d: pii_votes.find(d),
        "quality": lambda d: subword_classifier.classify(d, labels),
        "lines": lambda d: line_cleaning.clean_lines(d),
        "spans": lambda d: sentence_spans.remove_repeats(d),
        "ids": lambda d: token_ids.read_dataset(*token_ids.write_dataset(d, queries.word_tokenizer())),
        "near": lambda d: minhash.near_duplicates(d),
        "leaks": lambda d: winnowing.contamination(d, items),
    }
    for name, run in runs.items():
        n = run(edge).count()
        assert n == len(EDGE) or name == "mixed", name
        assert run(edge.limit(0)).count() == 0, name


def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.Pieces.from_file(public_tokenizers.path("piece_bpe_32k.model"))
    word = b"thin"
    text = b" " + word
    keys = {int(k): p for k, p in zip(pieces.keys, pieces.logp, strict=True)}
    logp = lambda s: keys.get(int(lattice_lm._whole_key(s)[0]), -math.inf)

    def total(at):
        return 1.0 if at == len(text) else sum(math.exp(logp(text[at:j])) * total(j) for j in range(at + 1, len(text) + 1))

    rows = np.frombuffer(text, np.uint8)[None, :]
    assert math.isclose(lattice_lm.lattice(rows, pieces)[0][0], math.log(total(0)), rel_tol=1e-9)


def test_lm_base_and_score(docs, texts):
    rows = lattice_lm.score(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    own = {i: [*words(lower(t)), None] for i, t in texts.items()}
    c = Counter(w for i, ws in own.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = own[r.doc_id]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and -math.inf < r.score < 0
    mean = lambda f, side: sum(f(r) for r in rows if r.held_out == side) / sum(r.n_tokens for r in rows if r.held_out == side)
    assert mean(lambda r: r.score, True) > -7  # far above the spelling of bytes


def test_lm_words_beyond_the_heavy_list_score_the_same(docs, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = {r.doc_id: r for r in lattice_lm.score(docs, path).collect()}
    monkeypatch.setattr(lattice_lm, "HEAVY_WORDS", 500)
    for r in lattice_lm.score(docs, path).collect():
        assert math.isclose(r.score, whole[r.doc_id].score, rel_tol=1e-9) and r.n_known == whole[r.doc_id].n_known


def test_mixing_targets_and_texts(spark, docs, texts):
    rows = mixing.taken(docs).collect()
    size = Counter()
    for r in rows:
        assert r.size == len(words(texts[r.doc_id])) and r.taken <= 2 * r.size
    source = {r.doc_id: r.source for r in docs.collect()}
    for i, t in texts.items():
        size[source[i]] += len(words(t))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size))}
    target, open_, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    got = Counter()
    for r in rows:
        assert math.isclose(r.target, target[source[r.doc_id]], rel_tol=1e-9)
        got[source[r.doc_id]] += r.taken
    assert all(abs(got[s] - target[s]) <= 0.5 + 1e-6 for s in size)
    again = {r.doc_id: r.taken for r in mixing.taken(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    mixed = Counter()
    for r in mixing.mix(docs).collect():
        mixed[r.doc_id] += len(words(r.text))
    assert mixed == Counter({i: n for i, n in again.items() if n})


def luhn(x):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(x))) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


HARD = ["1.2.3.4.5.6.7.8 a@b.co_x@y.com", "4111 1111 1111 1111-4111", "+1 (654) 555-9716 +0099 256.1.1.1 001.002.003.004", "🙂 é a.b@c-d.e.f@g.h x@y", "+12 345 67", "9" * 60, "7992739871300 4111-1111-1111-1111", "a@b@c.d.e..f @x.y"]


def test_pii_base_spans(spark, docs, texts):
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    want = {**texts, **{10_000 + i: t for i, t in enumerate(HARD)}}
    for r in pii_votes.find(both).select("doc_id", pii_votes.written(F.col("base")).alias("b")).collect():
        assert r.b == base_spans(want[r.doc_id]), want[r.doc_id][:80]


def test_pii_method_adds_spans(spark):
    rows = [(i, f"please contact mary{i}@site{i}.com or call +1 (415) 555-01{i % 90 + 10} now") for i in range(60)]
    rows += [(100, "write to joe.p [at] example [dot] com today"), (101, "order 123 4567 8901x 55"), (102, "call (415) 555-0199 ok")]
    got = {r.doc_id: r.s for r in pii_votes.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii_votes.written(F.col("spans")).alias("s")).collect()}
    assert (got[100], got[101], got[102]) == ("email:9:37", "", "phone:5:19")


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    out = subword_classifier.classify(queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels"))
    held = out.filter("held_out").join(queries.table(spark, folder, "labels"), "doc_id").collect()
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_line_rules(spark):
    good = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) + " and ends." for i in range(8))
    rows = {r.doc_id: r for r in line_cleaning.clean_lines(spark.createDataFrame([(1, good + "\nHome | About | Contact |\nAll rights reserved."), (2, "Home | About | News | Contact\n" * 20 + good[:60]), (3, "few words.")], "doc_id long, text string")).collect()}
    assert rows[1].kept and rows[1].cleaned == good and rows[1].n_failed_lines == 2
    assert not rows[2].kept and rows[3].base_failed


def test_pipeline_keeps_prose_that_mentions_what_the_line_rules_look_for(spark):
    import corpus_pipeline

    prose = " ".join(f"w{i}" for i in range(60)) + " and ends."
    good = [f"Il répondit « oui » puis elle dit « non » et {prose}", f"Er sagte »ja« und sie »nein«, {prose}", f"Previous work has shown that {prose}", f"He ate cookies while {prose}", f"It was released under duress, said › who ‹ and {prose}", f"Where a > b holds and {prose}"]
    bad = ["Home > Products > All of them.", "One. | Two | Three. | Four", "All rights reserved.", "Home page.", "We use cookies, see the privacy policy."]
    rows = [*enumerate(good), (100, "\n".join([prose, *bad])), (101, " | ".join(f"w{i}." for i in range(200)))]
    docs = spark.createDataFrame([(i, t, "fr", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, FOLDER).collect()}
    assert got == {**dict(enumerate(good)), 100: prose}


def test_bloom_cascade_is_exact(spark):
    shared.ship(spark)
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"), (F.col("id") % 7 == 0).alias("listed"))
    levels = bloom_cascade.cascade(keys)
    rows = keys.collect()
    got = bloom_cascade.listed(levels, np.array([r.h for r in rows], np.int64).view(np.uint64))
    assert len(levels) > 2 and got.tolist() == [r.listed for r in rows]


def test_urls_by_cascade_and_by_join(spark):
    urls = [None, "", "net/x", "http://net/", "http://a.NET", "https://a.example.net/en/1?q", "http://example.net/de/#x", "http://www.example.com/de/", "http://xexample.com/de/", "x://org/fr/?://b.net/", "http://u\nv.org/fr/1"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, rule int")
    want = [None, None, None, "net/", None, "example.net/en/", "net/", "example.com/de/", None, "org/fr/", "org/fr/"]
    for limit in (1 << 28, 1):
        got = {r.page_id: r for r in bloom_cascade.judge(pages, queries.URL_RULES, most_bits=limit).collect()}
        assert [got[i].rule for i in range(len(urls))] == want
        assert got[3].verdict == "block" and got[4].verdict == "allow" and got[1].host == ""
    assert bloom_cascade.judge(pages, []).filter("verdict = 'allow'").count() == len(urls)
    assert bloom_cascade.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_repeated_passages_go_and_first_copies_stay(spark):
    shared.ship(spark)
    passage = "The first sentence of a passage has words. A second one follows it with more of them! Does a third belong here as well? It does, and the fourth of them closes the passage after fifty words, which is why it is a long one that goes on and on until the end is near."
    rows = [(1, "Alpha opens. " + passage + " Omega closes."), (2, "Nothing is shared here, at all, by anyone."), (3, "Another text.\n" + passage + "\nIt ends."), (4, passage)]
    out = {r.doc_id: r for r in sentence_spans.changed_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out) == {3, 4} and out[3].first_ids == [1]
    assert out[3].text == "Another text.\nIt ends." and out[4].text == ""
    inside = {r.doc_id: r for r in sentence_spans.changed_documents(spark.createDataFrame([(9, passage + "\n" + passage)], "doc_id long, text string")).collect()}
    assert inside[9].text.strip() == passage


def test_repeated_passages_are_found_wherever_they_begin(spark):
    shared.ship(spark)
    rng = np.random.default_rng(5)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    rows, copies = [], set()
    for i in range(200):
        passage = some(51 + i % 20)
        if i % 3:
            passage[rng.integers(0, 12)] += (".", '."', "?”)")[i % 3]
        if i % 4 == 3:
            passage[-1 - rng.integers(0, 12)] += "."
        for k in range(2):
            rows.append((2 * i + k, " ".join(["Opens.", *some(rng.integers(0, 40)), *passage, *some(rng.integers(0, 40)), "ends."])))
        copies.add(2 * i + 1)
    rows += [(1000, " ".join(["same"] * 500)), (1001, " ".join(some(900)))]
    got = {r.doc_id: r for r in sentence_spans.changed_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    windows = Counter(tuple(w[k : k + 30]) for _, t in rows for w in [words(t)] for k in range(len(w) - 29))
    assert {i for i, t in rows if any(windows[tuple(w[k : k + 30])] > 1 for w in [words(t)] for k in range(len(w) - 29))} == copies | {i - 1 for i in copies} | {1000}
    assert set(got) == copies | {1000}
    texts = dict(rows)
    for i in copies:
        left, both = words(got[i].text), set(words(texts[i])) & set(words(texts[i - 1]))
        assert len(words(texts[i])) - len(left) >= 30 and set(words(texts[i])) - set(left) <= both


def test_sentences_are_cut_alike_alone_and_together():
    sample = [" ".join(f"w{i * i % 97}{'.' * (i % 23 == 5)}" for i in range(k, 3 * k)).encode() for k in (0, 1, 4, 9, 10, 11, 40, 200)] + [b"", b'He said "so." (Or "no!") Then he went.']
    s = sentence_spans.Sentences(sample)
    for i, t in enumerate(sample):
        own = sentence_spans.Sentences([t])
        assert (s.begin[s.first[i] : s.last[i]] - s.words.first[i]).tolist() == own.begin.tolist()
        assert not len(own.begin) or (own.end - own.begin).max() <= sentence_spans.LONGEST
    assert own.begin.tolist() == [0, 3, 5]


def test_variable_length_code_round_trips():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32), rng.integers(0, 2**32, 1001, dtype=np.uint32) >> rng.integers(0, 32, 1001, dtype=np.uint32)):
        control, data = token_ids.encode(values)
        assert len(control) == -(-len(values) // 4) and token_ids.decode(control, data, len(values)).tolist() == values.tolist()


def test_token_ids_are_the_tokenizers(spark, docs, texts):
    from tokenizers import Tokenizer

    odd = ["It's <|endoftext|> x<|ENDOFTEXT|>y, A.B, end.,", "naïve Σας ΟΔΟΣ. 3.14, 10%", "don't WON'T 'LL", "a\u00a0b\u3000c .", "e\u0301 E\u0301.", None, "x.\x0by,"]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    every = {**texts, **{10_000 + i: t for i, t in enumerate(odd)}}
    path = queries.word_tokenizer()
    tokenizer, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in token_ids.read_dataset(*token_ids.write_dataset(both, path, n_tasks=3)).collect()}
    for i in sorted(every):
        ids = [*tokenizer.encode(every[i] or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), every[i]
        start += len(ids)


def classes(sets):
    inverse, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        common = Counter(j for x in sets[i] for j in inverse[x])
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in sets[i]:
            inverse[x].append(i)
    return {i: root(i) for i in sets}


def shingles(t):
    w = words(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates_match_brute_force(spark, docs, texts):
    chain = {10_000 + k: " ".join(f"w{j}" for j in range(k * 3, k * 3 + 80)) for k in range(12)}  # each linked to the next only
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(chain.items()), "doc_id long, text string"))
    sets = {i: shingles(t) for i, t in {**texts, **chain}.items()}
    want = classes(sets)
    for r in minhash.near_duplicates(both).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (102, 101), (100, 100), (None, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 100, 101: 100, 102: 100}


def hits_of(t, windows):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    hit, items = set(), set()
    for n in {len(k) for k in windows}:
        for k in range(len(w) - n + 1):
            if own := windows.get(tuple(w[k : k + n])):
                items |= own
                hit |= set(range(k, k + n))
    return len(w), len(hit), items


@pytest.mark.parametrize("most", [200_000, 0])
def test_winnowing_matches_brute_force(spark, docs, texts, most):
    some = [" ".join(words(texts[i])[5 : 5 + n]) for i, n in ((3, 12), (8, 25), (11, 10), (15, 3), (20, 1))]
    items = spark.createDataFrame([*enumerate(some), (77, "A a A a a a a a a a a a a"), (78, None)], "item_id long, text string")
    windows = defaultdict(set)
    for i, t in [*enumerate(some), (77, "a " * 13)]:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000, "b " + "a " * 40 + "c"), (10_001, None)], "doc_id long, text string"))
    every = {**texts, 10_000: "b " + "a " * 40 + "c", 10_001: None}
    for r in winnowing.contamination(both, items, broadcast_rows=most).collect():
        n, hit, found = hits_of(every[r.doc_id], windows)
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (n, hit, sorted(map(str, found)), hit > 0)


def test_pipeline_keeps_clean_documents_whole(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = shared.keep(stage(spark, docs, FOLDER), "test-stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append({r.doc_id: r.text for r in docs.collect()})
    kept, unique, clean = seen
    want = classes({i: shingles(t) for i, t in kept.items()})
    assert set(unique) == {i for i, c in want.items() if c == i}
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(r.text))
        for k in range(len(w) - 9):
            windows[tuple(w[k : k + 10])].add(r.item_id)
    assert set(clean) == {i for i, t in unique.items() if not hits_of(t, windows)[1]}
    mixed = shared.keep(corpus_pipeline.mix_sources(spark, docs, FOLDER), "test-mixed")
    rows = corpus_pipeline.write_token_ids(spark, mixed, FOLDER).orderBy("start").collect()
    assert len(rows) == mixed.count() and [r.doc_id for r in rows] == sorted(r.doc_id for r in mixed.collect())
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_pipeline_decontaminates_documents_without_an_id(spark):
    import corpus_pipeline

    item = max((r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()), key=len)
    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"Before it {item}"), (None, clean), (None, None), (1, item), (2, clean), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, docs, FOLDER).collect()]
    assert sorted(got, key=str) == sorted([(None, clean), (None, None), (2, clean), (3, None)], key=str)


def test_digests_of_queries(spark):
    rows = queries.op10_winnowing(spark, FOLDER).collect()
    assert {r.items_sha256 for r in rows if not r.contaminated} == {hashlib.sha256(b"").hexdigest()}
