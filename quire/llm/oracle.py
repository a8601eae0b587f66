"""DuckDB SQL for the operators that SQL can express, as brute force over whole tables.

Left out: op1 (a model), op2, op6 and op10 (a tokenizer), op3 (splitters), op7 (sketches).
"""

from __future__ import annotations

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE32 = UPPER + "234567"

#: Each row's least reachable id over links (a, b) in both directions.
REACH = "reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.93),
{REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(least(a, b)) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

SIMILAR_SETS = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: hash(array_to_string(w[i:i+3], ' ')))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
both_ AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS n FROM t p JOIN t q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
one AS (SELECT a, b FROM both_ WHERE 100 * n >= 85 * (na + nb - n)), links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
{REACH}, c AS (SELECT a, min(least(a, b)) AS c FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, coalesce(c, doc_id) AS component_id FROM s LEFT JOIN c ON c.a = doc_id"""

REPEATED_WINDOWS = f"""WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i+19], ' ')))) AS k, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20),
r AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM w),
g AS (SELECT x.doc_id, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY x.j) FILTER (WHERE c.j IS NULL) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j GROUP BY x.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)"""

EQUAL_PAYLOADS = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(h) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', (((('0x' || substr(d, (5 * (i // 4) + 1)::INT, 5))::INTEGER >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p"""

ORACLE_SQL: dict[str, str] = {
    "op4_pstable_neardup": NEAR_VECTORS,
    "op5_ngram_jaccard": SIMILAR_SETS,
    "op8_substring_dedup": REPEATED_WINDOWS,
    "op9_warc_segments": EQUAL_PAYLOADS,
}
