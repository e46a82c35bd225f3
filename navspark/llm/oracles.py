"""The operators that SQL can express, for a second engine."""

from __future__ import annotations

#: Words are runs of other characters than space and 0x09-0x0D.
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH doc AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM doc WHERE len(words) >= 35),
windows AS (SELECT doc_id, s, array_to_string(words[s : s + 34], ' ') AS content FROM starts),
twice AS (SELECT content FROM windows GROUP BY content HAVING count(*) > 1),
hits AS (SELECT doc_id, s FROM windows SEMI JOIN twice USING (content)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM hits),
word AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM doc),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS content FROM word ANTI JOIN gone USING (doc_id, p)
         GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(content, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)"""

SUFFIX_DEDUP = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h,
                    strlen(coalesce(text, '')) AS n FROM documents),
windows AS (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, 400)) AS content
  FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS s FROM doc WHERE n >= 200)),
twice AS (SELECT content FROM windows GROUP BY content HAVING count(*) > 1),
hits AS (SELECT doc_id, s FROM windows SEMI JOIN twice USING (content)),
marked AS (SELECT *, s - coalesce(lag(s) OVER w, -1000) > 200 AS opens FROM hits
           WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
grouped AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
runs AS (SELECT doc_id, run, min(s) AS a, max(s) + 200 AS b FROM grouped GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a AS ends, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS begins FROM runs
  UNION ALL SELECT doc_id, n, coalesce(max(b), 0) FROM doc LEFT JOIN runs USING (doc_id) GROUP BY doc_id, n),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * begins + 1, 2 * (ends - begins)), '' ORDER BY begins) AS content
         FROM gaps JOIN doc USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(content, ''))) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {WORDS.format(text=_LOWER)} AS words FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(words[s : s + 3], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS s FROM doc WHERE len(words) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
  WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (
  SELECT a, b FROM link
  UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM doc d LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)"""

#: Maximal runs of letters, digits and all characters outside ASCII.
TERMS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""
WITH term AS MATERIALIZED (SELECT doc_id, unnest({TERMS.format(text=_LOWER)}) AS t FROM documents),
size AS (SELECT doc_id, count(*) AS n FROM term GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
asked AS MATERIALIZED (
  SELECT item_id, t, count(*) AS times
  FROM (SELECT item_id, unnest({TERMS.format(text=_LOWER)}) AS t FROM benchmark) GROUP BY 1, 2),
posting AS MATERIALIZED (
  SELECT doc_id, t, count(*) AS tf FROM term WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2),
held AS (SELECT t, count(*) AS df FROM posting GROUP BY t),
gain AS MATERIALIZED (
  SELECT doc_id, t, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT
         * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))) AS g
  FROM posting JOIN held USING (t) JOIN size USING (doc_id), total),
scored AS (
  SELECT item_id, doc_id, sum(times * g)::BIGINT AS score FROM asked JOIN gain USING (t) GROUP BY 1, 2)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""
