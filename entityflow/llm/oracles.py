"""DuckDB SQL of the queries that SQL can express."""

from entityflow.llm.licences import COPYRIGHT, KNOWN, LOWER, SPELLINGS, UPPER

ORACLES: dict[str, str] = {}

# Fixed values of the operator's defaults, as in quality.QualityParams.
_RULES = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "dup_line_share": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "repeat_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "upper_share": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15),
}
_GRID = ", ".join(
    f"('{rule}', {i}, {c}::DOUBLE)" for rule, cuts in _RULES.items() for i, c in enumerate(cuts)
)
ORACLES["op7_quality"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
ln AS (
  SELECT rid, count(*) AS n, count(DISTINCT l) AS u
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (
  SELECT rid, doc_id, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE 'other' END AS stratum,
         len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         coalesce(ln.n, 0) AS n_lines, coalesce(ln.n - ln.u, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
s AS (
  SELECT *, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
         coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share,
         coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_share,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM f),
grid AS (SELECT * FROM (VALUES {_GRID}) AS t(rule, step, cutoff)),
m AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
held AS (
  UNPIVOT (SELECT rid, stratum, good, symbol_share, dup_line_share, repeat_share, upper_share
           FROM s JOIN m USING (doc_id) WHERE NOT base_failed)
  ON symbol_share, dup_line_share, repeat_share, upper_share INTO NAME rule VALUE x),
t AS (
  SELECT stratum, rule, step, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND x > cutoff) AS k,
         count(*) FILTER (NOT good AND x > cutoff) AS bad
  FROM held JOIN grid USING (rule) GROUP BY ALL),
tails AS (
  SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.0125) + (n - j) * ln(0.9875)))
             FROM unnest(range(0, k + 1)) AS r(j)) AS tail FROM t),
stand AS (
  SELECT *, max(tail) OVER (PARTITION BY stratum, rule ORDER BY step) <= 0.05 / 20 AS ok, bad - 10.0 * k AS worth FROM tails),
best AS (
  SELECT stratum, rule, cutoff FROM stand WHERE ok AND worth > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY worth DESC, step) = 1),
failed AS (
  SELECT a.rid, string_agg(a.rule, ',' ORDER BY CASE a.rule WHEN 'symbol_share' THEN 0 WHEN 'dup_line_share' THEN 1
                                              WHEN 'repeat_share' THEN 2 ELSE 3 END) AS rules
  FROM (UNPIVOT (SELECT rid, stratum, symbol_share, dup_line_share, repeat_share, upper_share FROM s)
        ON symbol_share, dup_line_share, repeat_share, upper_share INTO NAME rule VALUE x) a
  JOIN best b ON a.stratum = b.stratum AND a.rule = b.rule AND a.x > b.cutoff GROUP BY a.rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS failed_rules
FROM s LEFT JOIN failed USING (rid)
"""

ORACLES["op9_mixing"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
src AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source)),
lev AS (
  SELECT *, (sum(s) OVER () - 3 * coalesce(sum(s) OVER c, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER c, 0)) AS level
  FROM src WINDOW c AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT source, s, greatest(0, least(3.0 * s, max(level) OVER () * w)) AS target FROM lev),
p AS (
  SELECT doc_id, size, s, target, round(target)::BIGINT AS goal,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN tgt ON d.source IS NOT DISTINCT FROM tgt.source)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
       (CASE WHEN s > 0 THEN goal // s ELSE 0 END * size
        + least(size, greatest(0, goal - CASE WHEN s > 0 THEN goal // s ELSE 0 END * s - before)))::BIGINT AS taken
FROM p
"""

ORACLES["op3_revisits"] = r"""
WITH p AS (
  SELECT page_id AS p, url, '"' || left(sha256(coalesce(html, '')), 16) || '"' AS tag, 'day ' || (page_id % 28) AS dated FROM pages),
r AS (
  SELECT 3 * p AS id, true AS whole, url, p * 60 AS ts, tag, dated, tag AS own_tag, dated AS own_dated FROM p
  UNION ALL
  SELECT 3 * p + k, false, CASE k WHEN 1 THEN url || '#again' ELSE regexp_replace(url, '[?#].*$', '') || '?utm_source=x' END,
         CASE k WHEN 1 THEN p * 60 + 60 + 86400 * (p % 4) ELSE p * 60 + 86400 * (1 - 2 * (p % 2)) END, tag, dated,
         CASE p % 7 WHEN 0 THEN '"stale"' WHEN 1 THEN NULL WHEN 2 THEN 'W/' || tag WHEN 3 THEN NULL ELSE tag END,
         CASE WHEN p % 7 IN (1, 2) THEN dated END
  FROM p, (SELECT unnest([1, 2]) AS k)),
bare AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS b FROM r),
parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(b, '^[A-Za-z]+://([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g') AS host,
         regexp_replace(regexp_extract(b, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|ref)(=|$)'))) AS q
  FROM bare),
k AS (
  SELECT *, CASE WHEN regexp_matches(b, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?]')
            THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url_key
  FROM parts),
j AS (
  SELECT *, last_value(CASE WHEN whole THEN {'i': id, 't': own_tag, 'd': own_dated} END IGNORE NULLS) OVER (
           PARTITION BY url_key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l
  FROM k),
v AS (
  SELECT *, CASE WHEN l IS NULL OR url_key IS NULL THEN 'no_response'
    WHEN CASE WHEN own_tag LIKE 'W/%' THEN substr(own_tag, 3) = regexp_replace(l.t, '^W/', '')
              WHEN own_tag IS NOT NULL THEN own_tag = l.t
              WHEN own_dated IS NOT NULL THEN own_dated = l.d
              ELSE l.t IS NULL AND l.d IS NULL END THEN 'resolved' ELSE 'mismatch' END AS verdict
  FROM j WHERE NOT whole)
SELECT id AS record_id, url_key, CASE WHEN verdict = 'resolved' THEN l.i END AS response_id, verdict,
       CASE WHEN verdict = 'resolved' THEN
         'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10)
         || 'etag: ' || coalesce(own_tag, l.t) || chr(10) || 'last-modified: ' || coalesce(own_dated, l.d) END AS headers
FROM v
"""

ORACLES["op6_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS t,
         replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS r,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c),
f AS (SELECT *, CASE WHEN before = role THEN 3 + length(t) ELSE 7 + length(r) + length(t) + 8 END AS chars FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

ORACLES["op10_topk"] = r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def _canonical(text: str) -> str:
    form = f"""' ' || regexp_replace(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '(?m){COPYRIGHT}', '', 'g'),
        '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g') || ' '"""
    for variant, usual in SPELLINGS:
        form = f"replace({form}, ' {variant} ', ' {usual} ')"
    return f"trim({form})"


def _known() -> str:
    return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)


ORACLES["op4_licences"] = rf"""
WITH known AS (
  SELECT sha256({_canonical("text")}) AS k, min(licence) AS licence FROM (VALUES {_known()}) AS t(licence, text) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
w AS (SELECT rid, doc_id, nullif({_canonical("text")}, '') AS c FROM d),
l AS (
  SELECT rid, list_sort(list(DISTINCT licence)) AS notices
  FROM (SELECT rid, {_canonical("line")} AS c FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)) x
  JOIN known ON c <> '' AND sha256(c) = k GROUP BY rid)
SELECT doc_id, CASE WHEN c IS NOT NULL THEN sha256(c) END AS digest, licence, coalesce(array_to_string(notices, ','), '') AS notices
FROM w LEFT JOIN known ON sha256(c) = k LEFT JOIN l USING (rid)
"""


ORACLES["op11_fill_in_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (
  SELECT doc_id, text, t, len(t) AS n, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN range(4)] AS h FROM d),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (
  SELECT *, array_to_string(t[1 : a], '') AS pre, array_to_string(t[a + 1 : b], '') AS mid, array_to_string(t[b + 1 :], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round as two steps: assignment, and the floor of the means (of an empty cluster, the centroid before)."""
    near = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT rid, vec_id, x, cluster, distance FROM (
    SELECT v.rid, v.vec_id, v.x, c.cluster, CAST({near} AS BIGINT) AS distance FROM v CROSS JOIN c{i} c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n) ORDER BY pos) AS x FROM (
    SELECT cluster, pos, CAST(sum(y) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT cluster, unnest(x) AS y, unnest(range(64)) AS pos FROM a{i}) GROUP BY cluster, pos) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, rid) - 1 AS cluster, x FROM (
    SELECT *, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v) ORDER BY h, rid LIMIT {k}),
{",".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.x, lambda y: CAST(y AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)"""


ORACLES["op12_bit_planes"] = _clusters_sql()
