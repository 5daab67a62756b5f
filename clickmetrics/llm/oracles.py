"""DuckDB statements for the operators that SQL can express: plain forms, independent of the Spark methods."""

_SPACE = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') AS a FROM documents
),
g AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(a) = 0 THEN []
                               WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
                               ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS s
    FROM w)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
),
e AS (
  SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
)
SELECT r.node AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.seen) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node
"""

SUBSTRINGS = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS a FROM documents
),
s AS (
  SELECT doc_id, i, md5(array_to_string(a[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, a, unnest(range(1, len(a) - 48)) AS i FROM w WHERE len(a) >= 50)
),
f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
cut AS (SELECT s.doc_id, s.i FROM s JOIN f USING (h) WHERE s.doc_id > f.first),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM cut, range(0, 50) t(k)),
words AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM w),
kept AS (
  SELECT words.doc_id, count(gone.pos) AS n_removed,
         string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE gone.pos IS NULL) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos GROUP BY words.doc_id
)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

# The adaptive thresholds: quartiles of a log-linear histogram per (language, source), else language, else all.
_BUCKET = "CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 1) * 16 + (v >> (length(bin(v)) - 5)) % 16 END"
_START = "CASE WHEN b < 16 THEN b ELSE (16 + b % 16) << (b // 16 - 4) END"

QUALITY = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS a FROM documents
),
g AS (
  SELECT doc_id, i, array_to_string(a[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, a, unnest(range(1, len(a) - 6)) AS i FROM w WHERE len(a) >= 8)
),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
ln AS (
  SELECT doc_id, count(*) AS n_lines,
         count(*) FILTER (WHERE regexp_matches(line, '{_SPACE}'))
         - count(DISTINCT line) FILTER (WHERE regexp_matches(line, '{_SPACE}')) AS n_dup
  FROM lines GROUP BY doc_id
),
st AS (
  SELECT w.doc_id, lang, source, CAST(len(a) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(ln.n_dup AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, ln.n_lines,
         CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM st),
m AS (
  SELECT doc_id, lang, source, u.k AS measure, u.v AS v FROM (
    SELECT doc_id, lang, source, unnest([
      {{'k': 'symbols', 'v': 1000 * n_symbols // n_words}}, {{'k': 'dup_lines', 'v': 1000 * n_dup_lines // n_lines}},
      {{'k': 'upper', 'v': 1000 * n_upper // word_chars}}, {{'k': 'long_words', 'v': 100 * word_chars // n_words}},
      {{'k': 'short_words', 'v': 100 * word_chars // n_words}}]) AS u
    FROM b WHERE NOT base_failed)
),
x AS (SELECT *, {_BUCKET} AS b FROM m),
lvl AS (
  SELECT coalesce(lang, '\0') AS l, coalesce(source, '\0') AS s, measure, b FROM x
  UNION ALL SELECT coalesce(lang, '\0'), '*', measure, b FROM x
  UNION ALL SELECT '*', '*', measure, b FROM x
),
h AS (SELECT l, s, measure, b, count(*) AS n FROM lvl GROUP BY ALL),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY l, s, measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY l, s, measure) AS docs FROM h
),
q AS (
  SELECT l, s, measure, max(docs) AS docs, min({_START}) FILTER (WHERE 4 * upto >= docs) AS q1,
         min({_START}) FILTER (WHERE 4 * upto >= 2 * docs) AS q2, min({_START}) FILTER (WHERE 4 * upto >= 3 * docs) AS q3
  FROM c GROUP BY ALL
),
pick AS (
  SELECT f.l, f.s, f.measure, unnest(CASE WHEN f.docs >= 100 THEN [{{'q1': f.q1, 'q2': f.q2, 'q3': f.q3}}]
      WHEN g.docs >= 100 THEN [{{'q1': g.q1, 'q2': g.q2, 'q3': g.q3}}] ELSE [{{'q1': z.q1, 'q2': z.q2, 'q3': z.q3}}] END) AS q
  FROM q f JOIN q g ON g.l = f.l AND g.s = '*' AND g.measure = f.measure JOIN q z ON z.l = '*' AND z.measure = f.measure
  WHERE f.s <> '*'
),
lim AS (
  SELECT l, s, measure, CASE measure
      WHEN 'symbols' THEN q.q2 + greatest(6 * (q.q3 - q.q2), 100) WHEN 'dup_lines' THEN q.q2 + greatest(6 * (q.q3 - q.q2), 400)
      WHEN 'upper' THEN q.q2 + greatest(6 * (q.q3 - q.q2), 300) WHEN 'long_words' THEN q.q2 + greatest(6 * (q.q3 - q.q2), 400)
      ELSE q.q2 - greatest(6 * (q.q2 - q.q1), 250) END AS t
  FROM pick
),
bad AS (
  SELECT DISTINCT m.doc_id FROM m JOIN lim ON lim.l = coalesce(m.lang, '\0') AND lim.s = coalesce(m.source, '\0')
    AND lim.measure = m.measure
  WHERE CASE WHEN m.measure = 'short_words' THEN m.v < lim.t ELSE m.v > lim.t END
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.doc_id IS NULL AS kept
FROM b LEFT JOIN bad ON bad.doc_id = b.doc_id
"""
