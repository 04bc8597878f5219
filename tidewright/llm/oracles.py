"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from tidewright.llm import secret_scan

_WORDS = r"list_filter(regexp_split_to_array(lower_az, '[ \t\n\v\f\r]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(list_reduce(list_transform(string_split(substring(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(text), 'null')), 1, 13), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, b: a * 16 + b) AS DOUBLE) + 0.5e0) / 4503599627370496e0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM d GROUP BY source),
c AS (SELECT *, 2e0 * source_size AS cap, 2e0 * source_size / weight AS ratio FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS cap_before, coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS weight_before,
    sum(weight) OVER () AS weight_all, 1.5e0 * sum(source_size) OVER () AS budget FROM c),
l AS (SELECT *, (budget - cap_before) / (weight_all - weight_before) AS level FROM f),
w AS (SELECT (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, weight_before LIMIT 1) AS water),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, weight * water) END AS target FROM l, w),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, target - epochs * source_size AS rest FROM e),
k AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.epochs, r.rest, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / coalesce(q.weight, 1e0), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
  LEFT JOIN (SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) > 0 THEN 0.25e0 WHEN coalesce(quality, 0) > 0 THEN 2e0 ELSE 0.5e0 END) AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) q ON d.doc_id = q.doc_id)
SELECT doc_id, size, source_size, target, CAST(least(epochs * size + greatest(0, least(size, CAST(floor(rest) AS BIGINT) - before)), 2 * size) AS BIGINT) AS taken FROM k"""

_TOP = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256e0 * x)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_LM = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS lower_az FROM documents), l AS (SELECT r, doc_id, {_WORDS} AS w FROM d),
x AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM l), y AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM x),
u AS (SELECT w, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY w), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM x),
p AS (SELECT v, w, r, CAST(count(*) AS DOUBLE) AS own FROM y WHERE v IS NOT NULL GROUP BY ALL), b AS (SELECT v, w, sum(own) AS c FROM p GROUP BY ALL), h AS (SELECT v, sum(own) AS c FROM p GROUP BY v),
pairs AS (SELECT r, sum(CASE WHEN b.c > own THEN own ELSE 0 END) AS seen, sum(own * CASE WHEN b.c > own THEN ln((b.c - own) / h.c) ELSE ln(0.4e0 * u.c / n.n) END) AS s FROM p JOIN b USING (v, w) JOIN h USING (v) JOIN u USING (w), n GROUP BY r),
heads AS (SELECT r, ln(u.c / n.n) AS s FROM y JOIN u USING (w), n WHERE i = 1),
t AS (SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(seen, 0) AS BIGINT) AS n_seen, coalesce(heads.s, 0e0) + coalesce(pairs.s, 0e0) AS s FROM l LEFT JOIN pairs USING (r) LEFT JOIN heads USING (r))
SELECT doc_id, n_words, n_seen, round(s, 6) AS log_score, round(CASE WHEN n_words > 0 THEN s / n_words ELSE 0e0 END, 6) AS mean_log_score FROM t"""

_CUT = r"list_filter(regexp_split_to_array(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_CLEAN = f"""
WITH i AS (SELECT item_id, {_CUT} AS w FROM (SELECT item_id, {_LOWER} AS lower_az FROM benchmark)),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_CUT} AS w FROM (SELECT doc_id, {_LOWER} AS lower_az FROM documents)),
dw AS (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, s, dw.n, item_id FROM dw JOIN iw ON dw.x = iw.x AND dw.n = iw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM m)) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)"""


def _matches(kind: int, pattern: str) -> str:
    """Places of a pattern's matches: the text is fenced and cut at the fences, as in the operator."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, {kind} AS kind, piece, CAST(sum(length(piece)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS stop, i
      FROM (SELECT r, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT r, string_split(regexp_replace(t, '{quoted}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM d))"""


_KINDS = ((0, secret_scan.ASSIGN), (1, secret_scan.ACCESS), (2, secret_scan.HEX), (3, secret_scan.RUN), (4, secret_scan.ENDPOINT))
_NAMES = "CASE kind " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(secret_scan.KINDS)) + " END"
_ASSIGN = secret_scan.ASSIGN.replace("'", "''")
_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
a AS ({" UNION ALL ".join(_matches(k, p) for k, p in _KINDS)}),
m AS (SELECT r, kind, stop - length(piece) AS start, stop, piece FROM a WHERE i % 2 = 0),
b AS (SELECT r, kind, start, stop FROM m WHERE (kind <> 0 OR length(regexp_extract(piece, '{_ASSIGN}', 2)) >= {secret_scan.LEAST_ASSIGNED}) AND (kind <> 3 OR length(piece) = 40 AND NOT contains(piece, '='))),
c AS (SELECT * FROM b WHERE kind <= 2 OR r IN (SELECT r FROM b WHERE kind = 1)),
t AS (SELECT * FROM c x WHERE x.kind <> 3 OR NOT EXISTS (SELECT 1 FROM c y WHERE y.r = x.r AND y.kind <= 2 AND y.start < x.stop AND x.start < y.stop)
    AND EXISTS (SELECT 1 FROM c y WHERE y.r = x.r AND y.kind = 1 AND x.start - y.stop <= {secret_scan.SCOPE} AND y.start - x.stop <= {secret_scan.SCOPE})),
k AS (SELECT * FROM t x WHERE x.kind <= 3 OR EXISTS (SELECT 1 FROM t y WHERE y.r = x.r AND y.kind = 1 AND x.start - y.stop <= {secret_scan.SCOPE} AND y.start - x.stop <= {secret_scan.SCOPE})
    AND EXISTS (SELECT 1 FROM t y WHERE y.r = x.r AND y.kind IN (0, 3) AND x.start - y.stop <= {secret_scan.SCOPE} AND y.start - x.stop <= {secret_scan.SCOPE})),
s AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg({_NAMES} || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind <= 2) AS base, string_agg({_NAMES} || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (r)"""

ORACLES: dict[str, str] = {
    "op3_mixture": _MIX,
    "op4_top_k": _TOP,
    "op6_lm_score": _LM,
    "op7_decontaminate": _CLEAN,
    "op10_secret_scan": _SECRETS,
}
