"""SQL that states the results of operators that SQL can express."""

# Counts of each text, the sketch buckets of the passing ones, quartiles per language and source
# with their fallbacks, and the verdict.
_QUALITY = r"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM split),
keyed AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM grams),
marked AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM keyed),
spots AS (
  SELECT DISTINCT doc_id, i + k.k AS at FROM marked, (SELECT unnest([0, 1, 2]) AS k) k WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n FROM spots GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeats r ON s.doc_id = r.doc_id),
stats AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length,
    CASE WHEN n_words > 0 THEN n_symbols * 10000 // n_words ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END AS repeats
  FROM counted),
long AS (
  SELECT lang, source, 'word_length' AS m, 500 AS least, word_length AS v, base_failed FROM stats
  UNION ALL SELECT lang, source, 'symbols', 300, symbols, base_failed FROM stats
  UNION ALL SELECT lang, source, 'dup_lines', 1000, dup_lines, base_failed FROM stats
  UNION ALL SELECT lang, source, 'repeats', 1000, repeats, base_failed FROM stats),
low AS (
  SELECT lang, source, m, least, CASE WHEN v < 64 THEN v
    ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS v
  FROM long WHERE NOT base_failed),
pools AS (
  SELECT DISTINCT a.lang, a.source, a.m, a.least, p.level FROM low a, (SELECT unnest([0, 1, 2]) AS level) p),
ranked AS (
  SELECT p.lang, p.source, p.m, p.least, p.level, b.v,
    row_number() OVER (PARTITION BY p.lang, p.source, p.m, p.level ORDER BY b.v) AS r,
    count(*) OVER (PARTITION BY p.lang, p.source, p.m, p.level) AS n
  FROM pools p JOIN low b ON p.m = b.m
    AND (p.level = 2 OR b.lang IS NOT DISTINCT FROM p.lang)
    AND (p.level > 0 OR b.source IS NOT DISTINCT FROM p.source)),
quartiles AS (
  SELECT lang, source, m, least, level, max(n) AS n,
    min(v) FILTER (WHERE 4 * r >= n) AS q1, min(v) FILTER (WHERE 4 * r >= 3 * n) AS q3
  FROM ranked GROUP BY ALL),
chosen AS (
  SELECT * FROM quartiles WHERE n >= 30
  QUALIFY row_number() OVER (PARTITION BY lang, source, m ORDER BY level) = 1),
fences AS (
  SELECT lang, source, m, q1 - 3 * greatest(q3 - q1, least) AS low,
    q3 + 3 * greatest(q3 - q1, least) AS high FROM chosen),
outside AS (
  SELECT DISTINCT s.doc_id FROM stats s JOIN fences f
    ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source
  WHERE (f.m = 'word_length' AND (word_length < low OR word_length > high))
     OR (f.m = 'symbols' AND (symbols < low OR symbols > high))
     OR (f.m = 'dup_lines' AND (dup_lines < low OR dup_lines > high))
     OR (f.m = 'repeats' AND (repeats < low OR repeats > high)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
FROM stats
"""

_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (
  SELECT doc_id, place, line, translate(regexp_replace(regexp_replace(line, '^[ \t\n\x0B\f\r]+', ''),
      '[ \t\n\x0B\f\r]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE c.key IS NOT NULL AND k.doc_id <> c.last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place)
    FILTER (WHERE c.key IS NULL OR k.doc_id = c.last), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id
"""

_URLS = r"""
WITH rules(host, path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0
    THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM cut),
fits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
best AS (
  SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id
"""

# Term counts of all documents, weights, and the sums of each item's terms in each document.
_SEARCH = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
facts AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_all FROM doc_terms WHERE len(t) > 0),
tfs AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (
    SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM doc_terms) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, facts GROUP BY term),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) //
    (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_all))))::BIGINT AS score
  FROM item_terms JOIN tfs USING (term) JOIN weights USING (term), facts GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0) WHERE rank <= 50
"""

SQL: dict[str, str] = {
    "op1_quality_rules": _QUALITY,
    "op5_line_dedup": _LINES,
    "op7_url_filters": _URLS,
    "op12_lexical_search": _SEARCH,
}
