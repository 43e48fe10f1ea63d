"""Scalar expressions over text: tokens, excerpts, areas, headings, note headers, chunk boundaries, managed blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits and patterns of the formats read and written.
EXCERPT_CHARS = 320
CHUNK_BYTES = 4_000
FLIGHT = r"status=(provisional|confirmed|superseded)\s+branch=(\S+)\s+commit=(\S+)"
STRICT_FLIGHT = r"^<!--.*\bstatus=(provisional|confirmed|superseded)\s+branch=(\S+)\s+commit=([0-9a-fA-F]{7,64})\b.*-->"
HEADING = r"^(#{1,2})\s+(.+?)\s*$"
BLOCK_BEGIN, BLOCK_END = "<!-- managed:begin -->", "<!-- managed:end -->"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """A quarter token a UTF-16 unit, rounded up; missing text has none. Characters beyond U+FFFF have two units."""
    return F.ceil(F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")) / 8).cast("long")


def either(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def excerpt(text: Column, most: int = EXCERPT_CHARS) -> Column:
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit(" …"))).otherwise(one)


def capped(text: Column, lines: int = 40, chars: int = 1_200, mark: str = "…[truncated]") -> Column:
    """At most so many lines, then characters; a mark tells that something was cut."""
    some = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    cut = F.substring(some, 1, chars)
    return F.when(F.length(cut) < F.length(text), F.concat(cut, F.lit("\n" + mark))).otherwise(text)


def line_range(span: Column, chunk_index: Column) -> Column:
    return F.when(F.size(span) == 2, F.concat(F.lit("lines "), span[0].cast("string"), F.lit("–"), span[1].cast("string"))).when(chunk_index.isNotNull(), F.concat(F.lit("chunk "), chunk_index.cast("string"))).otherwise("")


def area_of(path: Column) -> Column:
    """The folder of a path, at most two segments deep; a file at the root has an empty area."""
    return once(F.split(path, "/"), lambda p: F.array_join(F.slice(p, F.lit(1), F.least(F.size(p) - 1, F.lit(2))), "/"))


def headings(text: Column) -> Column:
    """array<struct<level, text, line>> of first and second level Markdown headings."""
    found = F.transform(F.split(text, r"\r?\n"), lambda x, i: F.struct(F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.regexp_extract(x, HEADING, 2).alias("text"), (i + 1).alias("line")))
    return F.filter(found, lambda h: h["level"] > 0)


def note_header(scope: Column, status: Column, branch: Column, commit: Column) -> Column:
    return F.concat(F.lit("<!-- remembered @ 2026-01-01T00:00:00Z scope="), scope, F.lit(" status="), status, F.lit(" branch="), branch, F.lit(" commit="), commit, F.lit(" -->"))


def flight(line: Column, strict: bool = False) -> Column:
    """struct<status, branch, commit_sha> of a header line; null without one. The strict form wants a hex commit."""
    pattern = STRICT_FLIGHT if strict else FLIGHT
    got = F.struct(*(F.regexp_extract(line, pattern, i + 1).alias(n) for i, n in enumerate(("status", "branch", "commit_sha"))))
    return F.when(line.rlike(pattern), got)


def tag(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "[^a-zA-Z0-9_-]", "-"), 1, 40)


def _continues(data: Column, at: Column) -> Column:
    """Whether the byte at a 0-based place continues a character of UTF-8."""
    return F.hex(F.substr(data, at + 1, F.lit(1))).rlike("^[89AB]")


def chunks(text: Column, most: int = CHUNK_BYTES) -> Column:
    """array<string>: the text in pieces of at most ``most`` bytes, cut between characters; empty text has none."""

    def cut(data: Column) -> Column:
        size = F.octet_length(data)

        def step(a: Column, _: Column) -> Column:
            to = F.least(a["at"] + most, size)
            back = F.when(to >= size, to).when(~_continues(data, to), to).when(~_continues(data, to - 1), to - 1).when(~_continues(data, to - 2), to - 2).otherwise(to - 3)
            return F.when(a["at"] >= size, a).otherwise(F.struct(back.alias("at"), F.concat(a["out"], F.array(F.decode(F.substr(data, a["at"] + 1, back - a["at"]), "UTF-8"))).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.ceil(size / F.lit(most - 3)).cast("int") + 1), start, step, lambda a: a["out"])

    return once(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), cut)


def spliced(existing: Column, body: Column | str) -> Column:
    """A text with its managed block (the one of the last markers) replaced, or one appended."""
    block = F.concat(F.lit(f"{BLOCK_BEGIN}\n"), F.lit(body), F.lit(f"\n{BLOCK_END}"))
    last = lambda mark: F.length(existing) - F.locate(mark[::-1], F.reverse(existing)) - len(mark) + 2
    begin, end = last(BLOCK_BEGIN), last(BLOCK_END)
    held = existing.contains(BLOCK_BEGIN) & existing.contains(BLOCK_END) & (begin < end)
    inside = F.concat(F.substr(existing, F.lit(1), begin - 1), block, F.substr(existing, end + len(BLOCK_END)))
    return F.when(held, inside).when(existing == "", F.concat(block, F.lit("\n"))).otherwise(F.concat(existing, F.when(existing.endswith("\n"), "\n").otherwise("\n\n"), block, F.lit("\n")))


def block_body(existing: Column) -> Column:
    return F.nullif(F.regexp_extract(existing, rf"(?s)^.*{BLOCK_BEGIN}\n(.*)\n{BLOCK_END}", 1), F.lit(""))
