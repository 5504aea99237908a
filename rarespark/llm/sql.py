"""SQL, for DuckDB, of the operators whose results it can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(pattern: str) -> str:
    return f"regexp_extract_all({LOWER}, '{pattern}')"


#: All windows of 200 bytes, each known by its digest; bytes covered by a window that occurs twice
#: go, and what is left is put together in order.
OP5 = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, p, md5(hex(b[p : p + 199])) AS k FROM (SELECT rid, b, unnest(range(1, octet_length(b) - 198)) AS p FROM d WHERE octet_length(b) >= 200)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM w SEMI JOIN twice USING (k)),
marked AS (SELECT rid, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY p ROWS UNBOUNDED PRECEDING) AS span FROM r),
cut AS (SELECT rid, span, min(p) AS a, max(p) + 200 AS e FROM marked GROUP BY rid, span),
gaps AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 1) AS a, a AS e FROM cut UNION ALL SELECT rid, max(e), NULL FROM cut GROUP BY rid),
kept AS (SELECT rid, string_agg(hex(b[gaps.a : coalesce(gaps.e - 1, octet_length(b))]), '' ORDER BY gaps.a) AS h FROM gaps JOIN d USING (rid) WHERE gaps.a <= coalesce(gaps.e - 1, octet_length(b)) GROUP BY rid),
total AS (SELECT rid, sum(e - a) AS n_removed, count(*) AS n_spans FROM cut GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(h, ''))) END AS kept_sha256 FROM d LEFT JOIN total USING (rid) LEFT JOIN kept USING (rid)"""

_ITEM = _words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
OP6 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ITEM} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ITEM} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, size, array_to_string(w[p : p + size - 1], ' ') AS k FROM (SELECT item, w, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT rid, size, p, array_to_string(w[p : p + size - 1], ' ') AS k FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d JOIN sizes ON len(w) >= size)),
hit AS (SELECT rid, p, size, item FROM dw JOIN iw USING (size, k)),
covered AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + size)) AS q FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""

_SPACED = _words(r"[^\x20\x09-\x0D]+")
OP8 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_SPACED} AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(w[p : p + 4], ' ') AS k FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
keyed AS (SELECT rid, md5(string_agg(k, chr(10) ORDER BY k)) AS s, count(*) AS n FROM sh GROUP BY rid),
sets AS (SELECT s, max(n) AS n, min(rid) AS rid FROM keyed GROUP BY s),
member AS (SELECT sets.s, sets.n, sh.k FROM sets JOIN sh USING (rid)),
shared AS (SELECT a.s AS a, b.s AS b, max(a.n) AS n, max(b.n) AS m, count(*) AS c FROM member a JOIN member b ON a.k = b.k AND a.s < b.s AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY a.s, b.s),
near AS (SELECT a, b FROM shared WHERE c * 10 >= 8 * (n + m - c)),
link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(s, other) AS (SELECT DISTINCT a, a FROM link UNION SELECT reach.s, link.b FROM reach JOIN link ON link.a = reach.other),
copies AS (SELECT s, min(doc_id) AS copy_of, count(*) AS n_copies FROM keyed JOIN d USING (rid) GROUP BY s),
least_of AS (SELECT reach.s, min(copies.copy_of) AS class_id FROM reach JOIN copies ON copies.s = reach.other GROUP BY reach.s),
links AS (SELECT a AS s, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, coalesce(class_id, copy_of, doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies, coalesce(copy_of, doc_id) AS copy_of FROM d LEFT JOIN keyed USING (rid) LEFT JOIN copies USING (s) LEFT JOIN least_of USING (s) LEFT JOIN links USING (s)"""


def oracle_sql() -> dict[str, str]:
    return {"op5_suffix_radix_dedup": OP5, "op6_fm_index_decontamination": OP6, "op8_bayesian_jaccard_join": OP8}
