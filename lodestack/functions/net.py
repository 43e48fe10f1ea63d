"""Web expressions: address ranges, HTML text, links, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Address ranges that are never fetched, as network and bits; in the order they are tried.
BLOCKED = (
    ("127.0.0.0", 8),
    ("10.0.0.0", 8),
    ("172.16.0.0", 12),
    ("192.168.0.0", 16),
    ("169.254.0.0", 16),
    ("::1", 128),
    ("fc00::", 7),
    ("fe80::", 10),
)
#: Entities decoded, in this order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))

#: Parts of a page that are no text, the space that is left, and links.
DROPPED = (r"(?i)<script\b[^>]*>[\s\S]*?</script>", r"(?i)<style\b[^>]*>[\s\S]*?</style>", r"<!--[\s\S]*?-->", "<[^>]+>")
SPACES = ((r"[ \t\f\x0B]+", " "), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))
HREF = r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"']"


def ipv4_number(ip: Column) -> Column:
    part = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).cast("long")
    return part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * (1 << 8) + part(4)


def ipv6_hex(ip: Column) -> Column:
    """32 hex digits of an IPv6 address, ``::`` filled with zeros."""
    halves = F.split(F.lower(ip), "::", 2)
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), "")


def blocked_range(ip: Column) -> Column:
    """``network/bits`` of the first blocked range that holds an address; null if none does."""
    first = F.lit(None).cast("string")
    six = ip.contains(":")
    for network, bits in reversed(BLOCKED):
        if ":" in network:
            inside = six & (F.substring(F.conv(F.substring(ipv6_hex(ip), 1, 4), 16, 10), 1, 10).cast("int").bitwiseAND(((1 << bits) - 1) << (16 - bits)) == (0xFC00 if bits == 7 else 0xFE80)) if bits <= 16 else six & (ipv6_hex(ip) == "0" * 31 + "1")
        else:
            a, b, c, d = map(int, network.split("."))
            want, mask = (a << 24) + (b << 16) + (c << 8) + d, ((1 << bits) - 1) << (32 - bits)
            inside = ~six & (ipv4_number(ip).bitwiseAND(mask) == want)
        first = F.when(inside, f"{network}/{bits}").otherwise(first)
    return first


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags dropped, entities decoded, space normalised."""
    out = html
    for pattern in DROPPED:
        out = F.regexp_replace(out, pattern, " ")
    for name, plain in ENTITIES:
        out = F.regexp_replace(out, f"(?i){name}", plain)
    for pattern, plain in SPACES:
        out = F.regexp_replace(out, pattern, plain)
    return out


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1))


def _plain_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; one that ends in them ends in a slash."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/"))), F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.lit("/"), joined, F.when(path.rlike(r"/\.{1,2}$") & (joined != ""), "/").otherwise(""))).otherwise(path)


def resolved(base: Column, href: Column) -> Column:
    """A link of a page as an absolute url without its fragment: another scheme or host, a rooted or relative path, a
    query alone, or a fragment alone (the page itself)."""
    link = F.regexp_replace(href, "#.*$", "")
    origin, page = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1), F.regexp_replace(base, "#.*$", "")
    bare = F.regexp_replace(page, r"\?.*$", "")
    folder = F.when(bare == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(bare, "/[^/]*$", "/"))
    full = (
        F.when(link == "", page)
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(bare, link))
        .otherwise(F.concat(folder, link))
    )
    head, path, rest = F.regexp_extract(full, r"^([a-zA-Z]+://[^/?#]*)", 1), F.regexp_extract(full, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(full, r"^[^?]*(\?.*)?$", 1)
    return F.when(head == "", full).otherwise(F.concat(head, _plain_path(path), rest))


def same_host_links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, link): http links of a page to its own host, resolved, without fragments."""
    raw = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("ord", "href"))
    out = raw.select("page_id", "url", "ord", resolved(F.col("url"), F.col("href")).alias("link"))
    return out.filter(F.col("link").rlike("^https?://") & (host(F.col("link")) == host(F.col("url")))).select("page_id", "ord", "link")


def disallow_rules(robots: DataFrame) -> DataFrame:
    """From (site, text): (site, ord, rule) of the groups for every agent."""
    row = robots.select("site", F.posexplode(F.split("text", r"\r?\n")).alias("ord", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", "")))
    pair = row.filter(F.instr("raw", ":") > 0).select("site", "ord", F.lower(F.trim(F.substring_index("raw", ":", 1))).alias("key"), F.trim(F.expr("substring(raw, instr(raw, ':') + 1)")).alias("value"))
    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("site").orderBy("ord"))
    return pair.withColumn("agent", agent).filter((F.col("key") == "disallow") & (F.col("agent") == "*") & (F.col("value") != "")).select("site", "ord", F.col("value").alias("rule"))


def first_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, rule): of (page_id, p) with (ord, rule) the first rule that begins the path p; an equi-join on the
    prefixes of the lengths that rules use, so any number of rules is applied."""
    lengths = [r.n for r in rules.select(F.length("rule").alias("n")).distinct().collect()]
    used = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("p"))
    prefixes = pages.select("page_id", F.explode(F.transform(used, lambda n: F.substring("p", F.lit(1), n))).alias("rule"))
    return prefixes.join(rules, "rule").groupBy("page_id").agg(F.min_by("rule", "ord").alias("rule"))
