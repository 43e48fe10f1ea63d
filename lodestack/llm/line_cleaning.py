"""Line-first cleaning (quality rules), built-in functions only.

Each line with a word is tested by punctuation, navigation and boilerplate rules; failing lines are removed and
a document that loses too large a share of its words is rejected, as is one that fails the whole-text rules.

A line fails if it has no sentence end; if it shouts (three runs of signs); if it is a chain of links (two separators or
more that do not quote, one for every NAVIGATION_WORDS words at least) or a short line that begins with a link word; or
if it holds a stock phrase for every BOILERPLATE_WORDS of its words. So one mention in a line of prose removes nothing.
Words and phrases are English, German, French and Spanish.

Null or empty text: no words, ``base_failed`` true, not kept. Repeated rows are judged each. Extra columns pass
through unchanged; columns of the same names as the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.text import WHITE, let, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
SYMBOLS = "#*$%&|<>"

#: Rules of a line. Of the navigation rules, a chain holds a separator for every so many words, and a line that begins
#: with a link word has at most so many; a line of boilerplate holds a phrase for every so many words.
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*([\x20\x09-\x0D]|$)"
SHOUTING = r"([!?#*$%&]{2,}[^!?#*$%&]*){3}"
SEPARATORS = "»›•·>|"
NAVIGATION_WORDS = 8
LINK_LINE_WORDS = 3
BOILERPLATE_WORDS = 16
#: Pairs of signs that quote what is between them.
QUOTES = "«»", "»«", "‹›", "›‹"
LINK_WORDS = (
    "home", "menu", "login", "log in", "sign up", "sign in", "search", "next", "previous", "back to top", "read more", "skip to content",
    "startseite", "menü", "anmelden", "registrieren", "suche", "weiter", "zurück", "mehr lesen", "weiterlesen", "zum inhalt",
    "accueil", "connexion", "s'inscrire", "rechercher", "suivant", "précédent", "retour", "lire la suite", "aller au contenu",
    "inicio", "menú", "iniciar sesión", "registrarse", "buscar", "siguiente", "anterior", "volver", "leer más", "ir al contenido",
)
PHRASES = (
    "we use cookies", "use of cookies", "accept cookies", "accept all cookies", "cookie policy", "enable javascript", "javascript is disabled", "javascript is required", "requires javascript",
    "terms of use", "terms of service", "privacy policy", "all rights reserved", "licensed under the", "released under the", "copyright notice",
    "subscribe to our", "click here", "lorem ipsum", "©", "copyright (c)", "copyright 1", "copyright 2",
    "wir verwenden cookies", "cookie-richtlinie", "javascript aktivieren", "nutzungsbedingungen", "datenschutzerklärung", "alle rechte vorbehalten", "newsletter abonnieren", "hier klicken",
    "nous utilisons des cookies", "utilisation de cookies", "activer javascript", "conditions d'utilisation", "politique de confidentialité", "tous droits réservés", "abonnez-vous à", "cliquez ici",
    "utilizamos cookies", "uso de cookies", "activar javascript", "términos de uso", "condiciones de uso", "política de privacidad", "todos los derechos reservados", "suscríbete a", "haga clic aquí",
)


def any_of(values: tuple[str, ...]) -> str:
    """Alternatives of a pattern. The values hold no signs that patterns use but round brackets."""
    return "|".join(v.replace("(", r"\(").replace(")", r"\)") for v in values)


BEGINS_WITH_LINK = rf"^[\x20\x09-\x0D]*({any_of(LINK_WORDS)})([^\p{{L}}\p{{N}}]|$)"
PHRASE = rf"(^|[^\p{{L}}\p{{N}}])({any_of(PHRASES)})"


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the same text."""

    def of_sorted(runs: Column) -> Column:
        twice = F.filter(F.transform(runs, lambda s, j: F.when((s["h"] == F.get(runs, j - 1)["h"]) | (s["h"] == F.get(runs, j + 1)["h"]), s["i"])), lambda p: p.isNotNull())
        return F.aggregate(
            F.array_sort(twice),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["at"])).alias("n"), p.alias("at")),
            lambda acc: acc["n"],
        )

    def of_windows(h: Column) -> Column:
        # most texts repeat no window: a hash set settles them without a sort
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    windows = let(words, lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))
    return let(windows, of_windows).cast("long")


def _n_words(line: Column) -> Column:
    return F.size(words_of(line))


def _n_separators(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, SEPARATORS, ""))


def _is_chain(line: Column) -> Column:
    plain = line
    for left, right in QUOTES:
        plain = F.regexp_replace(plain, f"{left}([^{left}{right}]*){right}", "$1")
    return let(_n_separators(plain), lambda n: (n >= 2) & (NAVIGATION_WORDS * n >= _n_words(line)))


def line_fails(line: Column, low: Column) -> Column:
    """Whether a line, also given lower-cased, fails a rule."""
    chain = F.when(_n_separators(line) >= 2, _is_chain(line)).otherwise(False)
    link = F.when(low.rlike(BEGINS_WITH_LINK), _n_words(line) <= LINK_LINE_WORDS).otherwise(False)
    stock = F.when(low.rlike(PHRASE), BOILERPLATE_WORDS * F.regexp_count(low, F.lit(PHRASE)) >= _n_words(line)).otherwise(False)
    return ~line.rlike(SENTENCE_END) | line.rlike(SHOUTING) | chain | link | stock


def clean_lines(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each text, ``cleaned`` (the text without its failing lines) and ``kept``.

    kept: false if base_failed, or if the removed lines hold more than ``max_lost_percent`` of the words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    judged = F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x, F.lower(x)).alias("fails")))
    measured = docs.withColumn("_m", let(words_of(body), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))).withColumn(
        "_l",
        let(
            judged,
            lambda ls: F.struct(
                (F.size(ls) - F.size(F.array_distinct(F.transform(ls, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(ls, lambda x: x["fails"])).cast("long").alias("n_failed_lines"),
                F.aggregate(ls, F.lit(0), lambda a, x: a + F.when(x["fails"], _n_words(x["line"])).otherwise(0)).cast("long").alias("lost_words"),
                F.array_join(F.transform(F.filter(ls, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned"),
            ),
        ),
    )
    n, lost = F.col("_m.n_words"), F.col("_l.lost_words")
    failed = (n < MIN_WORDS) | (100 * F.col("_m.n_repeat_words") > MAX_REPEAT_PERCENT * n)
    added = {
        "n_words": n,
        "word_chars": F.length(F.translate(body, WHITE, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.col("_l.n_dup_lines"),
        "n_repeat_words": F.col("_m.n_repeat_words"),
        "n_failed_lines": F.col("_l.n_failed_lines"),
        "kept_words": n - lost,
        "cleaned": F.col("_l.cleaned"),
        "base_failed": failed,
        "kept": ~failed & (100 * lost <= max_lost_percent * n),
    }
    return measured.withColumns(added).drop("_m", "_l")
