"""SQL of the queries that SQL can state."""

from __future__ import annotations

from lodestack.llm import line_cleaning as lc

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = "[^\\x20\\x09-\\x0D]+"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


LINE_CLEANING = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
grams AS (SELECT doc_id, k, w[k:k + 2] AS g FROM d, unnest(generate_series(1, len(w) - 2)) u(k)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
  SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
worded AS (SELECT doc_id, l, lower(l) AS low, len(regexp_extract_all(l, '{WORD}')) AS n,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '«([^«»]*)»', '\\1', 'g'), '»([^«»]*)«', '\\1', 'g'), '‹([^‹›]*)›', '\\1', 'g'), '›([^‹›]*)‹', '\\1', 'g') AS bare
  FROM lines WHERE regexp_matches(l, '{WORD}')),
judged AS (SELECT doc_id, l, n, regexp_matches(l, {quoted(lc.SENTENCE_END)}) AND NOT regexp_matches(l, {quoted(lc.SHOUTING)})
  AND NOT (len(regexp_extract_all(bare, '[{lc.SEPARATORS}]')) >= 2 AND {lc.NAVIGATION_WORDS} * len(regexp_extract_all(bare, '[{lc.SEPARATORS}]')) >= n)
  AND NOT (n <= {lc.LINK_LINE_WORDS} AND list_any_value(list_filter([{", ".join(quoted(w) for w in lc.LINK_WORDS)}], lambda w: starts_with(ltrim(low, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), w)
    AND NOT regexp_matches(substr(ltrim(low, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), length(w) + 1, 1), '[\\p{{L}}\\p{{N}}]'))) IS NOT NULL)
  AND NOT {lc.BOILERPLATE_WORDS} * len(regexp_extract_all(low, {quoted(lc.PHRASE)})) >= n AS good FROM worded),
by_doc AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (NOT good) AS n_failed_lines, coalesce(sum(n) FILTER (good), 0)::BIGINT AS kept_words FROM judged GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '{lc.SYMBOLS}', '')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(kept_words, 0)::BIGINT AS kept_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN by_doc USING (doc_id))
SELECT *, n_words < {lc.MIN_WORDS} OR 100 * n_repeat_words > {lc.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {lc.MIN_WORDS} OR 100 * n_repeat_words > {lc.MAX_REPEAT_PERCENT} * n_words) AND 100 * (n_words - kept_words) <= {lc.MAX_LOST_PERCENT} * n_words AS kept FROM m"""

URLS = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(host_of, path_of, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, arg_max(host_of || path_of, length(host_of || path_of)) AS rule, arg_max(verdict, length(host_of || path_of)) AS verdict FROM u JOIN r ON (host = host_of OR ends_with(host, '.' || host_of)) AND starts_with(path, path_of) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[k:k + 4] AS g FROM d, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) u(k)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
least_of AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)"""

CONTAMINATION = f"""
WITH i AS (SELECT item_id, regexp_extract_all({LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[k:k + least(10, len(w)) - 1] AS g FROM i, unnest(generate_series(1, CASE WHEN len(w) = 0 THEN 0 ELSE len(w) - least(10, len(w)) + 1 END)) u(k)),
d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
dw AS (SELECT doc_id, n, k, w[k:k + n - 1] AS g FROM d, (SELECT DISTINCT n FROM win), unnest(generate_series(1, len(w) - n + 1)) u(k)),
h AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM h) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)"""

EMBEDDING_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
least_of AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN least_of USING (vec_id)"""

ORACLES = {"op5_line_cleaning": LINE_CLEANING, "op6_bloom_cascade": URLS, "op9_minhash_join": NEAR_DUPLICATES, "op10_winnowing": CONTAMINATION, "op11_kmeans_dedup": EMBEDDING_LINKS}
