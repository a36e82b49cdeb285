"""Scalar function queries over the bound tables."""

import uuid

from pyspark.sql import functions as F

from entityflow.functions import fingerprint as fp
from entityflow.functions import money, text, vectors
from entityflow.plans.bindings import Tables
from entityflow.plans.registry import query

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "entityflow/refs")

# printed-line texts made from the catalog: zero-padded numbers, promo codes, spaces, hit points, neither
_TEXTS_SQL = """(SELECT id, CASE id % 5
      WHEN 0 THEN 'No. ' || lpad(number, 3, '0') || '/' || printed_total || ' SWSH' || (id % 300)
      WHEN 1 THEN 'promo SM' || (id % 1000) || ' of ' || name
      WHEN 2 THEN number || '  / ' || printed_total || '/7'
      WHEN 3 THEN name
      ELSE '  HP ' || (id % 300) || '  ' || name || '2  170 hp ' END AS line FROM v_refs)"""


def _texts(t: Tables):
    k = F.col("id")
    line = (
        F.when(k % 5 == 0, F.concat(F.lit("No. "), F.lpad("number", 3, "0"), F.lit("/"), "printed_total", F.lit(" SWSH"), (k % 300).cast("string")))
        .when(k % 5 == 1, F.concat(F.lit("promo SM"), (k % 1000).cast("string"), F.lit(" of "), "name"))
        .when(k % 5 == 2, F.concat("number", F.lit("  / "), "printed_total", F.lit("/7")))
        .when(k % 5 == 3, F.col("name"))
        .otherwise(F.concat(F.lit("  HP "), (k % 300).cast("string"), F.lit("  "), "name", F.lit("2  170 hp ")))
    )
    return t.refs.select("id", line.alias("line"))


@query("fn_parse_number", "v_refs", rf"""
    SELECT id, CASE WHEN regexp_matches(line, '\d{{1,3}}\s*/\s*\d{{1,3}}')
                    THEN regexp_extract(line, '(\d{{1,3}})\s*/\s*(\d{{1,3}})', 1) || '/' || regexp_extract(line, '(\d{{1,3}})\s*/\s*(\d{{1,3}})', 2)
                    WHEN regexp_matches(line, '[A-Z]{{2,4}}\d{{1,3}}') THEN regexp_extract(line, '[A-Z]{{2,4}}\d{{1,3}}') END AS number
    FROM {_TEXTS_SQL}""")
def _(t):
    return _texts(t).select("id", text.parse_number(F.col("line")).alias("number"))


@query("fn_clean_name", "v_refs", rf"""
    SELECT id, trim(regexp_replace(regexp_replace(line, '(?i)(\b\d+\s*HP\b|\bHP\s*\d+\b|\bHP\b)', ' ', 'g'), '\s+', ' ', 'g')) AS name
    FROM {_TEXTS_SQL}""")
def _(t):
    return _texts(t).select("id", text.clean_name(F.col("line")).alias("name"))


_PRINTED_SQL = """(SELECT id, CASE id % 4 WHEN 0 THEN lpad(number, 3, '0') || '/' || printed_total WHEN 1 THEN '000 / 0' || printed_total
    WHEN 2 THEN 'SM0' || number ELSE number || '/' || printed_total END AS number FROM v_refs)"""


@query("fn_norm_number", "v_refs", rf"""
    SELECT id, CASE WHEN regexp_matches(number, '^\d{{1,3}}\s*/\s*\d{{1,3}}$') THEN
        coalesce(nullif(ltrim(trim(split_part(number, '/', 1)), '0'), ''), '0') || '/' ||
        coalesce(nullif(ltrim(trim(split_part(number, '/', 2)), '0'), ''), '0') ELSE number END AS number FROM {_PRINTED_SQL}""")
def _(t):
    k = F.col("id")
    printed = (
        F.when(k % 4 == 0, F.concat(F.lpad("number", 3, "0"), F.lit("/"), "printed_total"))
        .when(k % 4 == 1, F.concat(F.lit("000 / 0"), "printed_total"))
        .when(k % 4 == 2, F.concat(F.lit("SM0"), "number"))
        .otherwise(F.concat("number", F.lit("/"), "printed_total"))
    )
    return t.refs.select("id", text.norm_number(printed).alias("number"))


_ANSWERS_SQL = """(SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Sure:' || chr(10) || props || chr(10) || 'done' WHEN 1 THEN props
    WHEN 2 THEN '{' || props WHEN 3 THEN 'none' ELSE '[1] {"k": [' || chr(10) || '2, {"x": 1}]}' END AS answer FROM events)"""


@query("fn_json_block", "", rf"""
    SELECT event_id, CASE WHEN block <> '' AND json_valid(block) THEN block END AS block,
           CASE WHEN block <> '' AND json_valid(block) AND event_id % 5 <> 4 THEN json_extract_string(block, '$.k') END AS k
    FROM (SELECT event_id, regexp_extract(answer, '(?s)\{{.*\}}') AS block FROM {_ANSWERS_SQL})""")
def _(t):
    k, props = F.col("request_id"), F.col("props")
    answer = (
        F.when(k % 5 == 0, F.concat(F.lit("Sure:\n"), props, F.lit("\ndone")))
        .when(k % 5 == 1, props).when(k % 5 == 2, F.concat(F.lit("{"), props)).when(k % 5 == 3, F.lit("none"))
        .otherwise(F.lit('[1] {"k": [\n2, {"x": 1}]}'))
    )
    block = t.requests.select(k.alias("event_id"), text.json_block(answer).alias("block"))
    return block.withColumn("k", F.when(F.col("event_id") % 5 != 4, F.get_json_object("block", "$.k")))


@query("fn_json_price", "v_refs", """
    SELECT id, CASE WHEN id % 4 = 0 OR id % 4 = 1 THEN CAST(round_even(CAST(retail AS DECIMAL(12, 2))::DOUBLE * 100, 0) AS INTEGER) END AS cents
    FROM v_refs""")
def _(t):
    from entityflow.sources.catalog import market_cents

    k = F.col("id")
    market = F.col("retail").cast("decimal(12,2)").cast("string")
    doc = (
        F.when(k % 4 <= 1, F.concat(F.lit('{"data":{"tcgplayer":{"prices":{"normal":{"market":'), market, F.lit('},"holofoil":{}}}}}')))
        .when(k % 4 == 2, F.lit('{"data":{"tcgplayer":{"prices":{"normal":{"market":null}}}}}'))
        .otherwise(F.when(k % 8 == 3, '{"data":{}}').otherwise('{"data":{"tcgplayer":{"prices":{"holofoil":{"market":1.0}}}}}'))
    )
    return t.refs.select("id", market_cents(doc, F.lit("normal")).alias("cents"))


@query("fn_json_links", "", """
    SELECT page_id, pos - 1 AS pos, link, CASE WHEN starts_with(link, 'https://i.') THEN 'ok' ELSE 'refused' END AS gate FROM (
      SELECT page_id, unnest([1, 2]) AS pos,
             unnest(['https://i.' || CASE page_id % 2 WHEN 0 THEN 'redd.it' ELSE 'imgur.com' END || '/p' || page_id || '.jpg', url]) AS link
      FROM pages WHERE page_id % 5 <> 4)""")
def _(t):
    from entityflow.operators.gates import gate_urls
    from entityflow.sources.catalog import listing_links

    k = F.col("page_id")
    direct = F.concat(F.lit("https://i."), F.when(k % 2 == 0, "redd.it").otherwise("imgur.com"), F.lit("/p"), k.cast("string"), F.lit(".jpg"))
    thread = F.to_json(F.array(F.struct(F.struct(F.array(
        F.struct(F.struct(direct.alias("url")).alias("data")), F.struct(F.struct(F.col("url").alias("url")).alias("data")),
        F.struct(F.struct(F.lit(None).cast("string").alias("url")).alias("data")),
    ).alias("children")).alias("data"))))
    album = F.to_json(F.struct(F.struct(F.array(F.struct(direct.alias("link")), F.struct(F.col("url").alias("link"))).alias("images")).alias("data")))
    doc = F.when(k % 5 == 4, F.lit('{"data": [')).when(k % 2 == 0, thread).otherwise(album)
    links = listing_links(t.raw("pages").select("page_id", doc.alias("doc")), "page_id", "doc")
    gated = gate_urls(links.withColumnRenamed("link", "url"))
    return gated.select(
        "page_id", "pos", F.col("url").alias("link"), F.when(F.col("reason").isNull(), "ok").otherwise("refused").alias("gate")
    )


@query("fn_sanitize", "", r"""
    SELECT doc_id, substring(regexp_replace('  ' || text || chr(10), '^\s+|\s+$', '', 'g'), 1, 1000) AS value FROM documents""")
def _(t):
    return t.raw("documents").select("doc_id", text.sanitize(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("value"))


@query("fn_content_key", "", "SELECT doc_id, sha256(text) AS content_key FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", text.content_key(F.col("text")).alias("content_key"))


@query("fn_stable_seed", "", """
    SELECT p_partkey AS id, CAST(CAST('0x' || substring(sha256(CAST(p_partkey AS VARCHAR)), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM part""")
def _(t):
    return t.refs.select("id", text.stable_seed(F.col("id").cast("string")).cast("string").alias("seed"))


@query("fn_stable_id", "", f"""
    SELECT id, substring(d, 1, 8) || '-' || substring(d, 9, 4) || '-5' || substring(d, 14, 3) || '-' ||
           substring('89ab', CAST(CAST('0x' || substring(d, 17, 1) AS INTEGER) % 4 + 1 AS INTEGER), 1) || substring(d, 18, 3) || '-' || substring(d, 21, 12) AS stable_id
    FROM (SELECT p_partkey AS id, sha1(from_hex('{NAMESPACE.hex}') || encode(CAST(p_partkey AS VARCHAR))) AS d FROM part)""")
def _(t):
    return t.refs.select("id", text.stable_id(F.col("id").cast("string"), NAMESPACE).alias("stable_id"))


@query("fn_signed64", "", """
    SELECT id, CAST(CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616 ELSE CAST(u AS HUGEINT) END AS BIGINT) AS signed,
           CAST(u AS VARCHAR) AS back
    FROM (SELECT p_partkey AS id, CAST('0x' || substring(sha256(CAST(p_partkey AS VARCHAR)), 1, 16) AS UBIGINT) AS u FROM part)""")
def _(t):
    signed = fp.signed64(text.stable_seed(F.col("id").cast("string")))
    return t.refs.select("id", signed.alias("signed")).withColumn("back", fp.unsigned64(F.col("signed")).cast("string"))


@query("fn_hamming", "v_index v_probe", """
    SELECT item_id, hash_type, CAST(bit_count(xor(p.hash_bits, i.hash_bits)) AS INTEGER) AS distance
    FROM v_probe p JOIN v_index i USING (hash_type) WHERE p.item_id = i.ref_id""")
def _(t):
    own = t.index.select(F.col("ref_id").alias("item_id"), "hash_type", F.col("hash_bits").alias("own_bits"))
    return t.probe.join(own, ["item_id", "hash_type"]).select(
        "item_id", "hash_type", fp.hamming(F.col("hash_bits"), F.col("own_bits")).alias("distance")
    )


@query("fn_fingerprint64", "v_bits", "SELECT vec_id, bits FROM v_bits WHERE t = 0")
def _(t):
    return t.coefficients.select("vec_id", fp.bits_from_coefficients(F.col("coef")).alias("bits"))


@query("fn_fingerprint_tiers", "v_bits", """
    SELECT vec_id AS ref_id, (['full', 'edge', 'region_art', 'region_name', 'region_text'])[t + 1] AS hash_type, bits AS hash_bits FROM v_bits""")
def _(t):
    from entityflow.operators.index import fingerprint_rows

    return fingerprint_rows(t.coefficients.select(F.col("vec_id").alias("ref_id"), "coef"))


@query("fn_variant_expand", "v_coef", """
    WITH shaken AS (SELECT vec_id, n, CASE WHEN n = 0 THEN coef ELSE list_transform(range(64), lambda i: coef[i + 1]
                 + (CAST('0x' || substring(md5(vec_id || '-' || n || '-' || i), 1, 8) AS BIGINT) / 4294967296::DOUBLE - 0.5::DOUBLE) * 0.02::DOUBLE) END AS c
            FROM v_coef, (SELECT unnest(range(7)) AS n)),
    tiered AS (SELECT vec_id, n, u.t AS t, CASE u.t WHEN 0 THEN c
            WHEN 1 THEN list_transform(range(64), lambda i: c[(i + 1) % 64 + 1] - c[i + 1])
            ELSE list_concat(c[16 * u.t - 31:16 * u.t], list_transform(range(32), lambda i: c[16 * u.t - 31 + (i + 1) % 32] - c[16 * u.t - 31 + i])) END AS c
            FROM shaken, (SELECT unnest(range(5)) AS t) u)
    SELECT vec_id AS ref_id, (['full', 'edge', 'region_art', 'region_name', 'region_text'])[t + 1] AS hash_type, n AS variant,
           CASE WHEN n = 0 THEN 'reference' ELSE 'augmented' END AS source, CAST(list_sum(list_transform(range(1, 64), lambda i:
        CASE WHEN c[i + 1] > med THEN (1::BIGINT << (63 - i)::INTEGER) ELSE 0 END)) AS BIGINT) AS hash_bits
    FROM (SELECT *, list_sort(c[2:64])[32] AS med FROM tiered)""", types={"variant": "INTEGER"})
def _(t):
    from entityflow.operators.index import variant_rows
    from entityflow.params import HashParams

    return variant_rows(t.coefficients.select(F.col("vec_id").alias("ref_id"), "coef"), HashParams().augmentations)


@query("fn_l2_normalise", "v_coef", """
    SELECT vec_id, pos - 1 AS pos, round(v / sqrt(sq), 6) AS value FROM (
      SELECT vec_id, unnest(range(1, 65)) AS pos, unnest(coef) AS v, list_sum(list_transform(coef, lambda x: x * x)) AS sq FROM v_coef)""", types={"pos": "INTEGER"})
def _(t):
    unit = t.coefficients.select("vec_id", vectors.l2_normalise(F.col("coef")).alias("u"))
    return unit.select("vec_id", F.posexplode("u").alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("value"))


@query("fn_mean_pool", "v_coef", """
    SELECT vec_id, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY vec_id)), 6) AS value FROM (
      SELECT vec_id, i AS pos, (coef[i + 1] + coef[i + 17] + coef[i + 33] + coef[i + 49]) / 4 AS m
      FROM v_coef, (SELECT unnest(range(16)) AS i))""", types={"pos": "INTEGER"})
def _(t):
    tokens = F.array(*[F.slice("coef", 1 + 16 * i, 16) for i in range(4)])
    pooled = t.coefficients.select("vec_id", vectors.l2_normalise(vectors.mean_pool(tokens)).alias("u"))
    return pooled.select("vec_id", F.posexplode("u").alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("value"))


_EMAIL_SQL = """(SELECT user_id, CASE user_id % 6 WHEN 0 THEN '  ' || upper(email) || ' ' WHEN 1 THEN '.' || email WHEN 2 THEN replace(email, '@', '..x@')
    WHEN 3 THEN replace(email, '@', '') WHEN 4 THEN repeat('x', 250) || email ELSE email END AS raw FROM v_users)"""


@query("fn_email_norm", "v_users", rf"""
    SELECT user_id, email, length(email) <= 254 AND NOT starts_with(email, '.') AND NOT contains(email, '..')
       AND regexp_matches(email, '^[a-z0-9_''+.-]*[a-z0-9_+-]@([a-z0-9][a-z0-9-]*\.)+[a-z]{{2,}}$') AS valid
    FROM (SELECT user_id, lower(trim(raw)) AS email FROM {_EMAIL_SQL})""")
def _(t):
    k, e = F.col("user_id"), F.col("email")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("  "), F.upper(e), F.lit(" "))).when(k % 6 == 1, F.concat(F.lit("."), e))
        .when(k % 6 == 2, F.replace(e, F.lit("@"), F.lit("..x@"))).when(k % 6 == 3, F.replace(e, F.lit("@"), F.lit("")))
        .when(k % 6 == 4, F.concat(F.repeat(F.lit("x"), 250), e)).otherwise(e)
    )
    email, valid = text.norm_email(raw)
    return t.users.select("user_id", email.alias("email"), valid.alias("valid"))
