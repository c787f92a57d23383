"""SQL over the same tables for the queries that SQL can express on whole tables."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ITEM_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"


def lines_sql(docs: str = "documents", min_docs: int = 10) -> str:
    return f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs})),
k AS (SELECT *, translate(trim(line, {_BLANK}), {_AZ}) AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs})
SELECT k.doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY 1"""


def contamination_sql(docs: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ITEM_WORD}) AS w FROM {docs}),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ITEM_WORD}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM
  (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, s, dw.n AS n FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""


SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM
  (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM dup)),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT t.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY t.p) AS text FROM t
  LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.p = gone.p WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

_PIECE = r"'[.,;:!?\x0A-\x0D]'"

COLLOCATIONS = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_AZ}) AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, {_PIECE})) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1 HAVING sum(len(w)) > 0),
occ AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM
  (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM occ GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.k, a, h, x.f AS l, y.f AS r,
    (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS h FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:h], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[h + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1),
inner_ AS (SELECT lang, array_to_string(w[s:s + j - 1], ' ') AS phrase, max(a) AS most FROM
  (SELECT *, unnest(range(1, k - j + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS j FROM c WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ i ON i.lang = best.lang AND i.phrase = best.phrase
  WHERE i.most IS NULL OR 100 * i.most::HUGEINT < 80 * best.a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000"""

_PLAIN = "translate(coalesce(text, ''), chr(1), chr(2))"
_KEYWORD = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
            "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")
SECRETS = f"""
WITH rules AS (SELECT * FROM (VALUES (0, 'assign', 8), (1, 'access', 16), (2, 'hex', 32)) AS v(o, kind, least)),
d AS (SELECT row_number() OVER () AS row, doc_id, {_PLAIN} AS t FROM documents),
cut AS (
  SELECT row, 0 AS o, string_split(regexp_replace(t, '{_KEYWORD}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS s FROM d
  UNION ALL SELECT row, 1, string_split(regexp_replace(t, 'AKIA[A-Z0-9]+', chr(1) || '\\0' || chr(1), 'g'), chr(1)) FROM d
  UNION ALL SELECT row, 2, string_split(regexp_replace(t, '[0-9a-f]{{32,}}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) FROM d),
parts AS (SELECT row, o, unnest(s) AS part, unnest(range(1, len(s) + 1)) AS i FROM cut WHERE len(s) > 1),
ends AS (SELECT *, sum(length(part)) OVER (PARTITION BY row, o ORDER BY i) AS e FROM parts),
found AS (SELECT row, ends.o, kind, CAST(e - length(part) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ends JOIN rules ON rules.o = ends.o
  WHERE i % 2 = 0 AND CASE WHEN ends.o = 0 THEN length(regexp_extract(part, '{_KEYWORD}', 2)) ELSE length(part) END >= least),
said AS (SELECT row, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access,
  count(*) FILTER (WHERE o = 2) AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM found GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN said ON said.row = d.row"""

SQL = {"op3_line_dedup": lines_sql(), "op4_decontamination": contamination_sql(), "op8_substring_dedup": SUBSTRINGS,
       "op12_collocations": COLLOCATIONS, "op13_secret_scans": SECRETS}
