"""PII by weak supervision, built-in functions only.

Candidate spans come from strict patterns (the base, always reported) and from looser ones. Labelers vote on each: the
strict patterns, gazetteers (domains, issuers, calling codes, address ranges), cue words before the span, its borders,
and counter-cues. Expectation-maximisation over the vote patterns estimates each labeler's reliability for each kind;
its posteriors are soft labels on which a final classifier of the span's form and surroundings is trained (log odds of
each feature value). Looser candidates that the classifier accepts join the base spans.

Votes and features take few values, so both models are fitted on counts of their combinations: the counts of a kind fit
in one row, however many spans there are.

Null and empty texts have no spans. Rows that repeat are judged each. Offsets are code points, ends exclusive. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.shared import keep
from lodestack.llm.text import let

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
ROUNDS = 25

#: Strict patterns. A run is entered at its begin, or where the last match ended, and never given back: the same matches
#: as of the plain patterns, in linear time.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits, with single spaces or hyphens between them, that has 12 to 19
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has none of the pattern.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Looser ones; a run of an address is entered as above, so a long run is linear as well.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[\[({]at[\])}] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({]dot[\])}] ?| dot )[A-Za-z0-9-]++)++|(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}(?<sep>[./_]|\x20{2,3}|\x20-\x20)[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{1,7}(?![0-9./_])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
}
LOOSE_HINT = {"email": r"[\[({]at[\])}]| dot ", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f:]", "card": r"[0-9]{4}[./_\x20]", "phone": "[0-9][ .-][0-9]"}

#: Gazetteers and cue words; these are looked for since the match before, in so many characters.
AROUND = 32
DOMAINS = "com|org|net|edu|gov|info|io|co|de|fr|es|it|nl|uk|eu|us|ch|at|example"
CUES = {
    "email": "mail|contact|write to|reach|schreib|contacter|correo|courriel",
    "ip": r"\bip\b|address|host|server|gateway|adresse|servidor",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|cell|telefon|llama|appel",
}
COUNTER_CUES = r"version|isbn|order|invoice|serial|figure|table|page|password|\bid\b|\bno\b|\bv$"


#: Matches whose offsets one fold appends: folds copy what they append to, so long lists go by blocks of so many.
BLOCK = 128
SPANS = "array<struct<start:int,end:int,value:string,before:string,left:string,right:string>>"


def _in_blocks(values: Column) -> Column:
    """An array that is not empty, as arrays of BLOCK values."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def _apart(spans: Column, others: list[Column]) -> Column:
    """Of spans those that overlap none of ``others``, arrays in order; these are searched by blocks."""
    over = lambda s, first, last: (first["start"] < s["end"]) & (s["start"] < last["end"])

    def free_of(spans: Column, other: Column) -> Column:
        hit = lambda s, blocks: F.exists(blocks, lambda b: over(s, F.get(b, F.lit(0)), F.element_at(b, -1)) & F.exists(b, lambda o: over(s, o, o)))
        free = let(_in_blocks(other), lambda blocks: F.filter(spans, lambda s: ~hit(s, blocks)))
        return F.when((F.size(spans) > 0) & (F.size(other) > 0), free).otherwise(spans)

    def of(spans: Column, rest: list[Column]) -> Column:
        return let(free_of(spans, rest[0]), lambda left: of(left, rest[1:])) if rest else spans

    return of(spans, others)


def _upto(sizes: Column) -> Column:
    """Running sums of an array of integers."""
    return F.aggregate(sizes, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<start, end, value, before, left, right>> of a pattern's matches, from the gaps between them: offsets
    from their lengths, ``before`` (AROUND characters at most, lower-cased) and the characters at the borders from their
    ends, so that a text of many matches is not searched from its begin for each."""

    def of_steps(steps: Column) -> Column:
        # steps: (gap, value) of every match; each block's total is summed first, and then the offsets within the block
        size = lambda s: s["gap"] + F.length(s["value"])

        def of_blocks(blocks: Column) -> Column:
            totals = _upto(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + size(s))))

            def of_totals(totals: Column) -> Column:
                def of_block(block: Column, k: Column) -> Column:
                    before = F.when(k > 0, F.get(totals, k - 1)).otherwise(0)
                    return let(
                        _upto(F.transform(block, size)),
                        lambda ends: F.transform(block, lambda s, i: F.struct((before + F.get(ends, i) - F.length(s["value"])).alias("start"), (before + F.get(ends, i)).alias("end"), *(s[x].alias(x) for x in ("value", "before", "left", "right")))),
                    )

                return F.flatten(F.transform(blocks, of_block))

            return let(totals, of_totals)

        return F.when(F.size(steps) > 0, let(_in_blocks(steps), of_blocks)).otherwise(F.array().cast(SPANS))

    def of_gaps(gaps: Column) -> Column:
        def of_values(values: Column) -> Column:
            def step(m: Column, i: Column) -> Column:
                gap, after = F.get(gaps, i), F.get(gaps, i + 1)
                left = F.when(gap != "", F.right(gap, F.lit(1))).otherwise(F.coalesce(F.right(F.get(values, i - 1), F.lit(1)), F.lit("")))
                right = F.when(after != "", F.left(after, F.lit(1))).otherwise(F.coalesce(F.left(F.get(values, i + 1), F.lit(1)), F.lit("")))
                return F.struct(F.length(gap).alias("gap"), m.alias("value"), F.lower(F.right(gap, F.lit(AROUND))).alias("before"), left.alias("left"), right.alias("right"))

            return let(F.transform(values, step), of_steps)

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_values)

    found = let(F.split(text, pattern, -1), of_gaps)
    return F.when(text.rlike(hint), found).otherwise(F.array().cast(SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, each(i)).otherwise(each(i) * 2 - F.when(each(i) > 4, 9).otherwise(0)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _gazetteer(kind: str, value: Column) -> Column:
    low = F.lower(value)
    if kind == "email":
        return F.when(low.rlike(rf"(\.|dot[\])}}]? ?)({DOMAINS})$"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(low.contains(":"), 0).when(low.rlike(r"^0*([1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."), 1).otherwise(-1)
    if kind == "card":
        return F.when(value.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(-1)
    return F.when(value.rlike(r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 1).when(value.startswith("+"), -1).otherwise(0)


def _border(c: Column) -> Column:
    return F.when(c == "", "edge").when(c.rlike(r"^[\x20\x09-\x0D]"), "space").when(c.rlike(r"^[\p{L}\p{N}]"), "letter").otherwise("mark")


def _described(span: Column, kind: str, strict: Column) -> Column:
    """A span with its votes (1, 0 or -1 each) and its classifier features, as a struct."""
    before, left, right = span["before"], span["left"], span["right"]
    cue, counter = before.rlike(CUES[kind]), before.rlike(COUNTER_CUES)
    good = ~left.rlike(r"^[\p{L}\p{N}]") & ~right.rlike(r"^[\p{L}\p{N}@]")
    votes = F.array(F.when(strict, 1).otherwise(0), _gazetteer(kind, span["value"]), F.when(cue, 1).otherwise(0), F.when(good, 1).otherwise(-1), F.when(counter, -1).otherwise(0))
    shape = F.array(
        F.concat(F.lit("left="), _border(left)),
        F.concat(F.lit("right="), _border(right)),
        F.concat(F.lit("cue="), cue.cast("string"), counter.cast("string")),
        F.concat(F.lit("digits="), F.least(F.floor(F.length(_digits(span["value"])) / 4), F.lit(5)).cast("string")),
        F.concat(F.lit("known="), _gazetteer(kind, span["value"]).cast("string")),
    )
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), strict.alias("strict"), votes.alias("votes"), shape.alias("shape"))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


N_VOTES = 5


def _posterior(state: Column, votes: Column) -> Column:
    """Of a pattern of votes, under state(prior, right: reliability of each labeler)."""
    told = F.zip_with(votes, state["right"], lambda v, r: v * F.log(r / (F.lit(1.0) - r)))
    return _sigmoid(F.log(state["prior"] / (F.lit(1.0) - state["prior"])) + F.aggregate(told, F.lit(0.0), lambda a, x: a + x))


def _em(combos: Column) -> Column:
    """state after ROUNDS rounds over combos: array<struct<votes, shape, n>>."""
    within = lambda x: F.greatest(F.lit(0.02), F.least(F.lit(0.98), x))
    share = lambda part, whole: (part + F.lit(1.0)) / (whole + F.lit(2.0))

    def again(state: Column, _: Column) -> Column:
        judged = F.transform(combos, lambda c: F.struct(c["votes"].alias("votes"), c["n"].alias("n"), _posterior(state, c["votes"]).alias("q")))

        def better(rows: Column) -> Column:
            def of(k: Column) -> Column:
                right = F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["n"] * F.when(F.get(r["votes"], k) == 1, r["q"]).when(F.get(r["votes"], k) == -1, F.lit(1.0) - r["q"]).otherwise(F.lit(0.0)))
                cast = F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["n"] * F.abs(F.get(r["votes"], k)))
                return within(share(right, cast))

            prior = share(F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["n"] * r["q"]), F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["n"]))
            return F.struct(within(prior).alias("prior"), F.transform(F.sequence(F.lit(0), F.lit(N_VOTES - 1)), of).alias("right"))

        return let(judged, better)

    start = F.struct(F.lit(0.5).alias("prior"), F.array(*(F.lit(x) for x in (0.95, 0.7, 0.8, 0.7, 0.8))).alias("right"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, again)


def decisions(spans: DataFrame) -> DataFrame:
    """(kind, votes, shape, score): the final classifier's probability for each combination that spans have."""
    combos = spans.groupBy("kind", "votes", "shape").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_kind = combos.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "shape", "n"))).alias("combos"))
    taught = by_kind.withColumn("state", _em(F.col("combos"))).withColumn(
        "taught", F.transform("combos", lambda c: F.struct(c["votes"].alias("votes"), c["shape"].alias("shape"), c["n"].alias("n"), _posterior(F.col("state"), c["votes"]).alias("q")))
    )
    # the classifier: smoothed log odds of every feature value, against the soft labels
    values = taught.select("kind", F.col("state.prior").alias("prior"), "taught", F.explode("taught").alias("t")).select("kind", F.col("t.n").alias("n"), F.col("t.q").alias("q"), F.posexplode("t.shape").alias("slot", "value"))
    pos, neg = F.sum(F.col("n") * F.col("q")), F.sum(F.col("n") * (1 - F.col("q")))
    odds = values.groupBy("kind", "slot", "value").agg(pos.alias("pos"), neg.alias("neg"))
    whole = values.filter("slot = 0").groupBy("kind").agg(pos.alias("all_pos"), neg.alias("all_neg"))
    weights = odds.join(whole, "kind").select("kind", "value", F.log(((F.col("pos") + 0.5) / (F.col("all_pos") + 2)) / ((F.col("neg") + 0.5) / (F.col("all_neg") + 2))).alias("w"))
    rows = taught.select("kind", F.explode("taught").alias("t")).select("kind", F.col("t.votes").alias("votes"), F.col("t.shape").alias("shape"), F.col("t.q").alias("q"))
    scored = rows.select("*", F.explode("shape").alias("value")).join(weights, ["kind", "value"]).groupBy("kind", "votes", "shape").agg(F.sum("w").alias("w"), F.max("q").alias("q"))
    return scored.join(whole, "kind").select("kind", "votes", "shape", _sigmoid(F.log((F.col("all_pos") + 1) / (F.col("all_neg") + 1)) + F.col("w")).alias("score"))


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row a document: doc_id, base and spans (array<struct<start, kind_at, end, kind>>, in order)."""
    body = F.coalesce("text", F.lit(""))

    def strict(kind: str) -> Column:
        return F.filter(_matches(F.col("body"), STRICT[kind], HINT[kind]), lambda s: _valid(kind, s["value"]))

    hits = docs.select("doc_id", body.alias("body")).select("doc_id", "body", *(strict(k).alias(k) for k in KINDS), *(_matches(F.col("body"), LOOSE[k], LOOSE_HINT[k]).alias(f"loose_{k}") for k in LOOSE))

    def described_all(spans: Column, kind: str, is_strict: bool) -> Column:
        return F.transform(spans, lambda s: _described(s, kind, F.lit(is_strict)))

    described = [described_all(F.col(k), k, True) for k in KINDS]
    fits = lambda k, s: _valid(k, s["value"]) if k == "card" else F.lit(True)
    described += [described_all(_apart(F.filter(f"loose_{k}", lambda s: fits(k, s)), [F.col(x) for x in KINDS]), k, False) for k in LOOSE]
    rows = keep(hits.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*described).alias("spans")), "pii-spans")
    order = F.array(*map(F.lit, KINDS))
    placed = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("kind_at"), s["end"].alias("end"), s["kind"].alias("kind"))
    spans = rows.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    judged = spans.filter("not strict").join(decisions(spans), ["kind", "votes", "shape"]).filter(F.col("score") >= accept)
    more = judged.groupBy("row").agg(F.collect_list(placed({k: F.col(k) for k in ("start", "end", "kind")})).alias("more"))
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["strict"]), placed))
    out = rows.select("row", "doc_id", base.alias("base")).join(more, "row", "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.slice("base", 1, 0)))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
