"""The SQL that the quotation query must equal."""

QUOTES_SQL = r"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
n AS (SELECT *, row_number() OVER () AS id FROM m),
l AS (
  SELECT id, conv_id, turn, unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS line,
         generate_subscripts(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), 1) AS pos
  FROM n),
p AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', '') AS words
  FROM l),
b AS (
  SELECT *, CASE WHEN trim(words) = '' OR level IS DISTINCT FROM lag(level) OVER w OR trim(lag(words) OVER w) = '' THEN 1 ELSE 0 END AS breaks
  FROM p WINDOW w AS (PARTITION BY id ORDER BY pos)),
r AS (SELECT *, sum(breaks) OVER (PARTITION BY id ORDER BY pos) AS part FROM b),
g AS (
  SELECT id, conv_id, turn, level, trim(lower(regexp_replace(string_agg(words, ' ' ORDER BY pos), '\s+', ' ', 'g'))) AS passage
  FROM r GROUP BY id, conv_id, turn, level, part),
q AS (SELECT * FROM g WHERE passage <> ''),
s AS (SELECT DISTINCT id, conv_id, turn, passage FROM q WHERE level = 0),
h AS (SELECT conv_id, passage, min(turn) AS first_turn FROM s WHERE conv_id IS NOT NULL GROUP BY ALL),
a AS (SELECT passage, conv_id AS c, turn AS t FROM s WHERE conv_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY passage ORDER BY conv_id, turn NULLS FIRST) = 1),
o AS (
  SELECT q.id, q.conv_id, q.level,
         CASE WHEN h.first_turn < q.turn THEN q.conv_id WHEN a.c < q.conv_id OR (q.conv_id IS NULL AND a.c IS NOT NULL) THEN a.c END AS oc,
         CASE WHEN h.first_turn < q.turn THEN h.first_turn WHEN a.c < q.conv_id OR (q.conv_id IS NULL AND a.c IS NOT NULL) THEN a.t END AS ot
  FROM q LEFT JOIN h ON h.conv_id = q.conv_id AND h.passage = q.passage LEFT JOIN a ON a.passage = q.passage WHERE q.level > 0),
k AS (
  SELECT id, conv_id, count(*) AS n_quoted, count(oc) AS n_linked,
         arg_max(oc, (-level, oc, ot)) FILTER (oc IS NOT NULL) AS oc, arg_max(ot, (-level, oc, ot)) FILTER (oc IS NOT NULL) AS ot
  FROM o GROUP BY id, conv_id),
e AS (SELECT conv_id AS x, oc AS y FROM k WHERE oc <> conv_id UNION SELECT oc, conv_id FROM k WHERE oc <> conv_id),
t AS (SELECT x AS c, x AS reach FROM e UNION SELECT t.c, e.y FROM t JOIN e ON e.x = t.reach),
u AS (SELECT c, min(reach) AS thread FROM t GROUP BY c),
body AS (SELECT id, trim(string_agg(words, chr(10) ORDER BY pos) FILTER (level = 0), chr(10)) AS text FROM p GROUP BY id)
SELECT n.conv_id, n.turn, n.role, coalesce(u.thread, n.conv_id) AS thread_id,
       CASE WHEN n.conv_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY n.conv_id ORDER BY coalesce(n.turn, 0)) END AS position,
       k.oc AS reply_conv_id, k.ot AS reply_turn, coalesce(k.n_quoted, 0) AS n_quoted, coalesce(k.n_linked, 0) AS n_linked,
       coalesce(body.text, '') AS text
FROM n JOIN body ON body.id = n.id LEFT JOIN k ON k.id = n.id LEFT JOIN u ON u.c = n.conv_id
"""
