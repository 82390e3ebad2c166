"""DuckDB SQL that computes the same rows as the queries that SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> doc_id AS lost FROM keyed k LEFT JOIN shared s USING (key)),
islands AS (
  SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM marked WHERE NOT lost),
runs AS (SELECT doc_id, min(pos) AS start, count(*) AS n FROM islands GROUP BY doc_id, island),
bitmaps AS (SELECT doc_id, string_agg(start || '+' || n, ',' ORDER BY start) AS keep_runs FROM runs GROUP BY 1)
SELECT m.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256,
       coalesce(any_value(b.keep_runs), '') AS keep_runs
FROM marked m LEFT JOIN bitmaps b ON b.doc_id = m.doc_id GROUP BY m.doc_id"""

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT size, item_id, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT size FROM windows))),
found AS (SELECT doc_id, size, i, item_id FROM places JOIN windows USING (size, win)),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS word FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN named m USING (doc_id)"""

JACCARD_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
  SELECT a.doc_id AS one, b.doc_id AS other, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT one, other FROM common JOIN sizes x ON x.doc_id = one JOIN sizes y ON y.doc_id = other WHERE c + 1e-9 >= 0.8 * (x.n + y.n - c)),
reach(one, other) AS (SELECT one, other FROM links UNION SELECT r.one, l.other FROM reach r JOIN links l ON l.one = r.other)
SELECT d.doc_id, least(d.doc_id, coalesce(r.smallest, d.doc_id)) AS class_id, coalesce(l.n, 0) AS n_links
FROM docs d LEFT JOIN (SELECT one, min(other) AS smallest FROM reach GROUP BY 1) r ON r.one = d.doc_id
LEFT JOIN (SELECT one, count(*) AS n FROM links GROUP BY 1) l ON l.one = d.doc_id"""

HARD_NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
found AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3"""

WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
firsts AS (SELECT body, min(page_id) AS first_id FROM payloads GROUP BY body),
digests AS (
  SELECT page_id, body, list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha1(body), CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS fives
  FROM payloads)
SELECT d.page_id, CAST(strlen(d.body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0],
         lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> b) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
       CASE WHEN d.page_id IS NOT DISTINCT FROM f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM digests d JOIN firsts f ON f.body = d.body"""

_LETTERS = "[A-Za-z\\x{C0}-\\x{FF}]+"

SPELLING = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
              ORDER BY i) AS t FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '{_LETTERS}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
hexed AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM runs),
bytes AS (
  SELECT *, list_transform(range(0, strlen(s)), lambda i: CAST('0x' || substr(hex(encode(s)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM hexed),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc_table),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest),
ranked AS (
  SELECT a, b, wb.n AS n_b, wa.n AS n_a, count(*) OVER (PARTITION BY a) AS n_near,
         row_number() OVER (PARTITION BY a ORDER BY wb.n DESC, encode(b)) AS place
  FROM near JOIN words wa ON wa.word = a JOIN words wb ON wb.word = b),
forms AS (
  SELECT a AS word, n_near, CASE WHEN n_b >= 5 * n_a THEN b END AS form, CASE WHEN n_b >= 5 * n_a THEN n_b END AS form_n
  FROM ranked WHERE place = 1),
chain(word, reached, hops) AS (
  SELECT word, word, 0 FROM words
  UNION ALL SELECT c.word, f.form, c.hops + 1 FROM chain c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, hops) AS root FROM chain GROUP BY word)
SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, f.form, f.form_n, r.root
FROM words w LEFT JOIN forms f ON f.word = w.word JOIN roots r ON r.word = w.word"""
