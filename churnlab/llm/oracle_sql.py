"""DuckDB SQL of the pair and window operators, written as plain joins over all tokens."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _five(rows: str, key: str) -> str:
    """Distinct 5-word shingles (or the whole short sequence) of ``rows`` (key, ws)."""
    lead = " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER p" for i in range(1, 5))])
    return f"""
words AS (SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM {rows}),
shingle AS (
  SELECT DISTINCT {key}, g FROM (SELECT {key}, {lead} AS g FROM words WINDOW p AS (PARTITION BY {key} ORDER BY i)) WHERE g IS NOT NULL
  UNION ALL SELECT {key}, array_to_string(ws, ' ') FROM {rows} WHERE len(ws) BETWEEN 1 AND 4)"""


def ngram_components(percent: int = 75) -> str:
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS ws FROM documents),
{_five("d", "doc_id")},
n AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b, c = x.n AND c = y.n AS equal FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= {percent} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
far AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a),
same AS (SELECT b AS doc_id, min(a) AS a FROM links WHERE equal GROUP BY b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(far.b, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(same.a, d.doc_id)) AS class_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN far USING (doc_id) LEFT JOIN same USING (doc_id)"""


def substring_dedup(length: int = 50) -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
windows AS (
  SELECT doc_id, i, n, string_agg(w, ' ') OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING) AS g FROM words),
found AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM windows WHERE i + {length - 1} <= n),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM found, range({length}) r(j) WHERE first < doc_id),
kept AS (
  SELECT words.doc_id, string_agg(w, ' ' ORDER BY words.i) AS body, count(*) AS n
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def line_report(percent: int = 75) -> str:
    return f"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS l FROM raw),
d AS (
  SELECT row_number() OVER (ORDER BY doc_id, pos) AS id, doc_id, pos, regexp_extract_all(lower(l), '{WORD}') AS ws
  FROM line WHERE regexp_matches(l, '{WORD}')),
{_five("d", "id")},
n AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
pairs AS (SELECT b.id AS a, a.id AS b, count(*) AS c FROM shingle a JOIN shingle b USING (g) WHERE b.id < a.id GROUP BY ALL),
gone AS (
  SELECT DISTINCT b AS id FROM pairs JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
per AS (SELECT doc_id, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed FROM d JOIN gone USING (id) GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id)
SELECT documents.doc_id, coalesce(total.n, 0)::BIGINT AS n_lines, coalesce(per.n, 0)::BIGINT AS n_removed,
       coalesce(per.removed, '') AS removed
FROM documents LEFT JOIN total USING (doc_id) LEFT JOIN per USING (doc_id)"""
