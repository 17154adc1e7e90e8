"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses

OP3 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept,
       h AS text_sha256
FROM d
WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""

OP4 = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0
),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) + 0.0 AS score
  FROM e q, e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id
)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
"""

# Bytes as hexadecimal digits, cut into stretches of 1000 bytes so that a window is found without counting through a long text.
OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, n, k * 1000 AS base, substr(h, k * 2000 + 1, 2098) AS part FROM d, range(0, n // 1000 + 1) r(k)),
w AS (SELECT doc_id, base + j AS i, substr(part, 2 * j + 1, 100) AS s FROM c, range(0, least(1000, greatest(n - 49 - base, 0))) q(j)),
m AS (SELECT s, min(doc_id) AS least_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
t AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM w JOIN m USING (s) WHERE least_id < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t),
r AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM g GROUP BY doc_id, run),
o AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM r),
k AS (SELECT o.doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(d.h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS kept FROM o JOIN d USING (doc_id) GROUP BY o.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN d.h ELSE k.kept || substr(d.h, 2 * k.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    """The canonical form of a text, as SQL."""
    out = rf"regexp_replace(translate({text}, '{licenses.UPPER}', '{licenses.LOWER}'), '(^|\n)[ \t]*(copyright|\(c\)|all rights reserved)[^\n]*', chr(10), 'g')"
    out = f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"
    for other, one in licenses.SPELLINGS:
        out = f"replace({out}, {_quoted(other)}, {_quoted(one)})"
    return out


def licenses_sql() -> str:
    known = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licenses.KNOWN)
    return f"""
WITH k AS (SELECT min(i) AS license_id, sha256({_canonical("t")}) AS digest FROM (VALUES {known}) v(i, t) GROUP BY digest),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, sha256({_canonical("text")}) AS text_digest FROM d),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
h AS (SELECT l.doc_id, k.license_id FROM l JOIN k ON sha256({_canonical("l.line")}) = k.digest),
a AS (SELECT doc_id, license_id FROM h UNION SELECT w.doc_id, k.license_id FROM w JOIN k ON w.text_digest = k.digest)
SELECT w.doc_id, w.text_digest, coalesce(k.license_id, '') AS whole_license,
       coalesce((SELECT count(*) FROM h WHERE h.doc_id = w.doc_id), 0) AS n_notices,
       coalesce((SELECT string_agg(license_id, ',' ORDER BY license_id) FROM a WHERE a.doc_id = w.doc_id), '') AS licenses
FROM w LEFT JOIN k ON w.text_digest = k.digest
"""


ORACLES = {"op3_exact_dedup": OP3, "op4_nearest_neighbours": OP4, "op7_licenses": licenses_sql(), "op9_suffix_dedup": OP9}
