"""SQL twins of the queries over documents that SQL can express."""

from __future__ import annotations

from . import quality

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents
), sets AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a
), least AS (SELECT a AS doc_id, min(b) AS m FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

REPEATS = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (SELECT doc_id, i, hash(substring(h, 2 * i + 1, 800)) AS k, hash(substring(h, 2 * i + 1, 800) || 'x') AS k2 FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM raw WHERE n >= 400)
), twice AS (SELECT k, k2 FROM windows GROUP BY k, k2 HAVING count(*) > 1
), hits AS (SELECT doc_id, i FROM windows SEMI JOIN twice USING (k, k2)
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM hits)) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT r.doc_id, coalesce(max(b), 0), any_value(n) FROM raw r LEFT JOIN runs USING (doc_id) GROUP BY r.doc_id
), kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN raw USING (doc_id) GROUP BY doc_id
), gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256, coalesce(n_removed, 0) > 0 AS repeats
FROM raw LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _quality() -> str:
    quoted = lambda xs: ", ".join("'" + x + "'" for x in xs)
    r = quality.Rules()
    return f"""
WITH base AS (
  SELECT doc_id, CASE WHEN lang IN ({quoted(quality.COMMON)}) THEN lang ELSE '' END AS lang, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), grams AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM base WHERE len(w) >= 3)
), repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), counts AS (
  SELECT doc_id, lang, len(w) AS n_words, length(t) - length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, t, w FROM base
), classes AS (SELECT doc_id, lang, n_words, unnest(range(0, 8)) AS bin, unnest([
    length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^A-Z]', '', 'g')), length(regexp_replace(t, '[^0-9]', '', 'g')), length(t) - word_chars,
    length(regexp_replace(t, '[^.,;:!?''"()-]', '', 'g')), length(regexp_replace(t, '[^#-&*+/<->@\\[-`{{-~]', '', 'g')), length(regexp_replace(t, '[^\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g')), length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))]) AS c FROM counts
), common AS (SELECT word, bin, f || e AS form FROM (SELECT word, bin, unnest(list_distinct([word, upper(left(word, 1)) || substring(word, 2)])) AS f FROM (SELECT unnest([{quoted(quality.WORDS)}]) AS word, unnest(range(8, {8 + len(quality.WORDS)})) AS bin)), (SELECT unnest(['', '.', ',', ';', ':', '!', '?']) AS e)
), wordbins AS (SELECT doc_id, lang, n_words, coalesce(bin, {8 + len(quality.WORDS)}) AS bin, count(*) AS c FROM (SELECT doc_id, lang, n_words, unnest(w) AS form FROM counts) LEFT JOIN common USING (form) GROUP BY ALL
), bins AS (SELECT doc_id, lang, n_words, bin, bin >= 8 AS kind, c FROM (SELECT * FROM classes WHERE c > 0 UNION ALL SELECT * FROM wordbins)
), refs AS (SELECT l AS lang, bin, kind, sum(c) AS q FROM (SELECT unnest(list_distinct([lang, ''])) AS l, bin, kind, c FROM bins LEFT JOIN repeats USING (doc_id)
    WHERE n_words >= {r.least_words} AND n_words >= 50 AND 100 * coalesce(n_repeat_words, 0) <= 50 * n_words) GROUP BY ALL
), shares AS (SELECT lang, bin, kind, q / sum(q) OVER (PARTITION BY lang, kind) AS q FROM refs
), own AS (SELECT doc_id, lang, bin, kind, c / sum(c) OVER (PARTITION BY doc_id, kind) AS p FROM bins
), parts AS (
  SELECT o.doc_id, o.kind, p, coalesce(q, 0) AS q FROM own o LEFT JOIN shares s ON s.lang = o.lang AND s.bin = o.bin AND s.kind = o.kind
), rest AS (SELECT o.doc_id, o.kind, 1 - sum(coalesce(q, 0)) AS q, count(q) > 0 OR EXISTS (SELECT 1 FROM shares z WHERE z.lang = any_value(o.lang) AND z.kind = o.kind) AS has FROM own o LEFT JOIN shares s ON s.lang = o.lang AND s.bin = o.bin AND s.kind = o.kind GROUP BY o.doc_id, o.kind
), js AS (SELECT doc_id, kind, CASE WHEN any_value(has) THEN sqrt(greatest(0, (sum(p * log2(p / ((p + parts.q) / 2))) + sum(CASE WHEN parts.q > 0 THEN parts.q * log2(parts.q / ((p + parts.q) / 2)) ELSE 0 END) + any_value(rest.q)) / 2)) ELSE 0 END AS d FROM parts JOIN rest USING (doc_id, kind) GROUP BY doc_id, kind
), judged AS (SELECT c.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(a.d, 0) AS cj, coalesce(b.d, 0) AS wj,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM counts c LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN js a ON a.doc_id = c.doc_id AND NOT a.kind LEFT JOIN js b ON b.doc_id = c.doc_id AND b.kind)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars >= {r.least_chars} AND cj > {r.char_limit}) AND NOT (n_words >= {r.least_words} AND wj > {r.word_limit}) AS kept, round(cj, 6) AS char_js, round(wj, 6) AS word_js FROM judged
"""


QUALITY = _quality()

#: The truth for pages whose article is marked and has no boilerplate inside, as all pages of the tables; the operator gets
#: there by weighing words and links, and tests hold it against pages without such marks.
PAGES = """
WITH article AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages
), plain AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(?:p|br|h1|ul|li)\\b[^>]*>', ' ', 'g'), '<[^>]+>', '', 'g') AS t FROM article
), decoded AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '&amp', '&'), '\\s+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM decoded
"""
