"""Text resolution, cache, index maintenance and catalog queries over the bound tables."""

from pyspark.sql import functions as F

from entityflow.functions.text import content_key
from entityflow.operators import index as ix
from entityflow.operators import resolve as op
from entityflow.plans.bindings import Tables, lit_ts
from entityflow.plans.registry import query
from entityflow.sources.storage import scratch
from entityflow.plans.scalars import NAMESPACE
from entityflow.sources import catalog


# every fiftieth entity gets a name of its own, so that the name-only tier is reached
def named_refs(t: Tables):
    own = F.concat("name", F.lit(" "), F.col("id").cast("string"))
    return t.refs.withColumn("name", F.when(F.col("id") % 50 == 0, own).otherwise(F.col("name")))


_NAMED = "(SELECT id, CASE WHEN id % 50 = 0 THEN name || ' ' || id ELSE name END AS name, number, printed_total FROM v_refs)"
OBSERVED_SQL = f"""(SELECT c.card_id AS item_id, CASE c.ordinal WHEN 1 THEN upper(r.name) WHEN 2 THEN NULL WHEN 3 THEN '??' WHEN 4 THEN '' ELSE r.name END AS name,
      CASE WHEN c.suppkey % 4 = 0 THEN NULL WHEN c.suppkey % 4 = 1 THEN 'SWSH' || r.number WHEN c.suppkey % 4 = 2 THEN '0' || r.number || ' / ' || r.printed_total
           ELSE r.number || '/' || r.printed_total END AS number
    FROM v_cards c JOIN {_NAMED} r ON r.id = c.card_ref_id)"""


def observed(t: Tables):
    n, s = F.col("ordinal"), F.col("suppkey") % 4
    ref = named_refs(t).select(F.col("id").alias("card_ref_id"), "name", "number", "printed_total")
    name = F.when(n == 1, F.upper("name")).when(n == 2, F.lit(None)).when(n == 3, "??").when(n == 4, "").otherwise(F.col("name"))
    number = (
        F.when(s == 0, F.lit(None)).when(s == 1, F.concat(F.lit("SWSH"), "number"))
        .when(s == 2, F.concat(F.lit("0"), "number", F.lit(" / "), "printed_total")).otherwise(F.concat("number", F.lit("/"), "printed_total"))
    )
    return t.cards.join(ref, "card_ref_id").select(F.col("card_id").alias("item_id"), name.alias("name"), number.alias("number"))


@query("join_fuzzy_resolve", "v_cards v_refs", rf"""
    WITH named AS (SELECT * FROM {_NAMED}),
    obs AS (SELECT item_id, nullif(lower(name), '') AS name, ltrim(trim(split_part(number, '/', 1)), '0') AS num, trim(split_part(number, '/', 2)) AS total
            FROM {OBSERVED_SQL}),
    g AS (SELECT number, printed_total, count(*) AS n, min(id) AS only_id FROM named GROUP BY 1, 2),
    gn AS (SELECT number, printed_total, lower(name) AS name, min(id) AS id FROM named GROUP BY 1, 2, 3),
    nm AS (SELECT lower(name) AS name, count(*) AS n, min(id) AS id FROM named GROUP BY 1)
    SELECT item_id, CASE WHEN g.n = 1 THEN g.only_id WHEN gn.id IS NOT NULL THEN gn.id WHEN nm.n = 1 THEN nm.id END AS ref_id,
           CASE WHEN g.n = 1 THEN 1.0::DOUBLE WHEN gn.id IS NOT NULL THEN 0.9::DOUBLE WHEN nm.n = 1 THEN 0.6::DOUBLE ELSE 0::DOUBLE END AS exactness
    FROM obs LEFT JOIN g ON g.number = obs.num AND g.printed_total = obs.total
    LEFT JOIN gn ON gn.number = obs.num AND gn.printed_total = obs.total AND gn.name = obs.name
    LEFT JOIN nm ON nm.name = obs.name""")
def _(t):
    return op.resolve(observed(t), named_refs(t))


@query("agg_ocr_regions", "v_lines", r"""
    WITH body AS (SELECT item_id, string_agg(text, ' ' ORDER BY pos) FILTER (band = 'text') AS joined, sum(conf) AS conf, count(*) AS n,
                         max(text) FILTER (band = 'name') AS head FROM v_lines GROUP BY item_id)
    SELECT item_id, round(conf / n, 9) AS mean_conf,
           nullif(trim(regexp_replace(regexp_replace(head, '(?i)(\b\d+\s*HP\b|\bHP\s*\d+\b|\bHP\b)', ' ', 'g'), '\s+', ' ', 'g')), '') AS name,
           CASE WHEN regexp_matches(joined, '\d{1,3}\s*/\s*\d{1,3}') THEN
                  regexp_extract(joined, '(\d{1,3})\s*/\s*(\d{1,3})', 1) || '/' || regexp_extract(joined, '(\d{1,3})\s*/\s*(\d{1,3})', 2)
                ELSE nullif(regexp_extract(joined, '[A-Z]{2,4}\d{1,3}'), '') END AS number
    FROM body""")
def _(t):
    return op.read_regions(t.lines).withColumn("mean_conf", F.round("mean_conf", 9))


_CACHE_SQL = """(SELECT sha256(text) AS content_key, arg_min('answer ' || doc_id, doc_id) AS response FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)"""


@query("join_cache_split", "", f"""
    WITH cache AS {_CACHE_SQL}, keyed AS (SELECT doc_id, sha256(text) AS content_key FROM documents)
    SELECT 'hit' AS part, CAST(doc_id AS VARCHAR) AS id, response FROM keyed JOIN cache USING (content_key)
    UNION ALL SELECT 'miss', CAST(doc_id AS VARCHAR), NULL FROM keyed ANTI JOIN cache USING (content_key)
    UNION ALL SELECT 'stored', content_key, response FROM cache
    UNION ALL SELECT 'stored', content_key, arg_min('new ' || doc_id, doc_id) FROM keyed ANTI JOIN cache USING (content_key)
       WHERE doc_id % 4 <> 0 GROUP BY content_key""")
def _(t):
    docs = t.raw("documents")
    k = F.col("doc_id").cast("string")
    cache = docs.where(F.col("doc_id") % 3 == 0).groupBy(content_key(F.col("text")).alias("content_key")).agg(
        F.min_by(F.concat(F.lit("answer "), k), "doc_id").alias("response")
    )
    hits, misses = op.cache_split(docs.select("doc_id", F.col("text").alias("content")), cache)
    answers = misses.select("content_key", "doc_id", F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("new "), k)).alias("response"))
    stored = op.cache_insert(cache, answers, "doc_id")
    return (
        hits.select(F.lit("hit").alias("part"), k.alias("id"), "response")
        .unionByName(misses.select(F.lit("miss").alias("part"), k.alias("id"), F.lit(None).cast("string").alias("response")))
        .unionByName(stored.select(F.lit("stored").alias("part"), F.col("content_key").alias("id"), "response"))
    )


@query("set_insert_ignore", "v_cards v_photos", """
    SELECT photo_id, min(card_id) AS card_id FROM v_cards
    WHERE photo_id NOT IN (SELECT photo_id FROM v_photos WHERE status = 'failed') GROUP BY photo_id""")
def _(t):
    taken = t.photos.where(F.col("status") == "failed").select("photo_id")
    rows = t.cards.select("photo_id", "card_id")
    return op.insert_ignore(taken, rows.withColumn("o", F.col("card_id")), ["photo_id"], "o").select("photo_id", "card_id")


# --- catalog ---------------------------------------------------------------------------------

@query("src_catalog_set_filter", "v_refs", """
    SELECT id, name, set_id, number FROM v_refs WHERE set_id IN ('Brand#3', 'Brand#17')""")
def _(t):
    return catalog.select_refs(t.refs, ["Brand#3", "Brand#17"]).select("id", "name", "set_id", "number")


@query("src_catalog_upsert", "v_refs", """
    SELECT id, CASE WHEN id % 10 < 3 THEN 'new ' || name ELSE name END AS name, CASE WHEN id % 10 < 3 OR id >= 1000000 THEN TIMESTAMP '2024-05-01 00:00:00'
           ELSE TIMESTAMP '2024-01-01 00:00:00' END AS synced_at
    FROM (SELECT id, name FROM v_refs UNION ALL SELECT id + 1000000, 'new ' || name FROM v_refs WHERE id % 10 = 7)""")
def _(t):
    old = t.refs.select("id", "name", lit_ts("2024-01-01 00:00:00").alias("synced_at"))
    fresh = F.when(F.col("id") % 10 == 7, F.col("id") + 1000000).otherwise(F.col("id")).alias("id")
    rows = t.refs.where((F.col("id") % 10 < 3) | (F.col("id") % 10 == 7)).select(fresh, F.concat(F.lit("new "), "name").alias("name"))
    return catalog.upsert_catalog(old, rows, lit_ts("2024-05-01 00:00:00"))


@query("src_missing_asset", "v_refs", """
    SELECT id, CASE WHEN id % 6 = 5 OR id % 7 = 0 THEN 'skipped' ELSE 'kept' END AS outcome FROM v_refs""")
def _(t):
    listing = t.refs.where(F.col("id") % 6 != 5).select("id", F.when(F.col("id") % 7 == 0, 0).otherwise(900).alias("length"))
    kept, skipped = catalog.with_assets(t.refs, listing)
    return kept.select("id", F.lit("kept").alias("outcome")).unionByName(skipped.select("id", F.lit("skipped").alias("outcome")))


@query("src_catalog_flatten", "v_refs", """
    SELECT CAST(id AS VARCHAR) AS id, name, set_id, number, CASE WHEN id % 3 <> 0 THEN printed_total END AS printed_total,
           CASE WHEN id % 4 <> 0 THEN 'Rare' END AS rarity, 'https://img.example/' || id AS image_url,
           CASE WHEN id % 5 <> 0 THEN array_to_string(list_sort(finishes), ',') ELSE '' END AS finishes FROM v_refs""")
def _(t):
    # catalog pages of up to 250 entities, written as documents and read back
    from entityflow.sources.storage import scratch

    k = F.col("id")
    price = F.when(k % 5 != 0, F.struct(F.map_from_arrays("finishes", F.transform("finishes", lambda f: F.struct(F.col("retail").alias("market")))).alias("prices")))
    entity = F.struct(
        k.cast("string").alias("id"), "name", "number", F.when(k % 4 != 0, F.lit("Rare")).alias("rarity"),
        F.struct(F.concat(F.lit("https://img.example/"), k.cast("string")).alias("large")).alias("images"),
        F.struct(F.col("set_id").alias("id"), F.col("set_name").alias("name"), F.when(k % 3 != 0, F.col("printed_total").cast("int")).alias("printedTotal")).alias("set"),
        price.alias("tcgplayer"),
    )
    path = scratch(t.spark, "pages")
    pages = t.refs.groupBy(F.floor(k / 250)).agg(F.collect_list(entity).alias("data")).select("data")
    pages.write.json(path)
    flat = catalog.flatten_catalog(catalog.read_pages(t.spark, path, one_per_file=False))
    return flat.select("id", "name", "set_id", "number", "printed_total", "rarity", "image_url", F.array_join("finishes", ",").alias("finishes"))


# --- index -----------------------------------------------------------------------------------

_SOURCED = """(SELECT ref_id, hash_type, hash_bits, ['reference', 'augmented', 'user_validated'][ref_id % 3 + 1] AS source FROM v_index)"""


def _sourced(t: Tables):
    names = F.array(*[F.lit(s) for s in ("reference", "augmented", "user_validated")])
    return t.index.select("ref_id", F.element_at(names, (F.col("ref_id") % 3 + 1).cast("int")).alias("source"), "hash_type", "hash_bits")


@query("sink_index_refresh", "v_index", f"""
    SELECT ref_id, source, hash_type, hash_bits FROM {_SOURCED} WHERE source = 'user_validated' OR ref_id % 2 = 1
    UNION ALL SELECT ref_id, 'reference', hash_type, hash_bits + 1 FROM v_index WHERE ref_id % 2 = 0""")
def _(t):
    new = t.index.where(F.col("ref_id") % 2 == 0).select("ref_id", F.lit("reference").alias("source"), "hash_type", (F.col("hash_bits") + 1).alias("hash_bits"))
    path, schema = scratch(t.spark, "hash-index"), new.schema
    ix.create_index(_sourced(t), path, 16)
    ix.write_refresh(path, new.withColumn("hash_bits", F.col("hash_bits") + 5), 16)  # replaced again by the next
    ix.write_refresh(path, new, 16)
    return ix.read_index(t.spark, path, schema)


# a long log of validated fingerprints: one row per card and tier of its entity modulo 40
_LOG_SQL = """(SELECT card_ref_id % 40 AS ref_id, CASE WHEN ordinal % 2 = 0 THEN 'full' ELSE 'edge' END AS hash_type,
    CASE WHEN suppkey % 3 = 0 THEN 'reference' ELSE 'user_validated' END AS source, created_at, card_id AS row_id FROM v_cards)"""


def _log(t: Tables):
    return t.cards.select(
        (F.col("card_ref_id") % 40).alias("ref_id"), F.when(F.col("ordinal") % 2 == 0, "full").otherwise("edge").alias("hash_type"),
        F.when(F.col("suppkey") % 3 == 0, "reference").otherwise("user_validated").alias("source"), "created_at", F.col("card_id").alias("row_id"),
        "suppkey", "ordinal",
    )


@query("win_cap_newest", "v_cards", f"""
    SELECT * FROM {_LOG_SQL} WHERE source = 'reference' UNION ALL
    SELECT * FROM (SELECT * FROM {_LOG_SQL} WHERE source = 'user_validated'
      QUALIFY row_number() OVER (PARTITION BY ref_id, hash_type ORDER BY created_at DESC, row_id DESC) <= 20)""")
def _(t):
    return ix.cap_newest(_log(t).drop("suppkey", "ordinal"), 20)


@query("spec_lru_cap", "v_cards", f"""
    SELECT ref_id, hash_type, source, row_id FROM {_LOG_SQL} WHERE source = 'reference' UNION ALL
    SELECT ref_id, hash_type, source, row_id FROM (SELECT card_ref_id % 40 AS ref_id, CASE WHEN ordinal % 2 = 0 THEN 'full' ELSE 'edge' END AS hash_type,
        'user_validated' AS source, card_id AS row_id, CASE WHEN suppkey % 4 <> 0 THEN created_at END AS last_matched_at, ordinal AS usage_count
      FROM v_cards WHERE suppkey % 3 <> 0
      QUALIFY row_number() OVER (PARTITION BY ref_id, hash_type ORDER BY last_matched_at DESC NULLS LAST, usage_count DESC, row_id DESC) <= 20)""")
def _(t):
    log = _log(t).withColumn("last_matched_at", F.when(F.col("suppkey") % 4 != 0, F.col("created_at"))).withColumn("usage_count", F.col("ordinal"))
    return ix.cap_least_used(log, 20).select("ref_id", "hash_type", "source", "row_id")


@query("index_build", "v_bits v_index", """
    SELECT ref_id, source, hash_type, count(*) AS n, CAST(max(CASE WHEN source <> 'augmented' THEN hash_bits END) AS BIGINT) AS bits FROM (
      SELECT ref_id, 'user_validated' AS source, hash_type, hash_bits FROM v_index WHERE ref_id % 3 = 2
      UNION ALL SELECT ref_id, 'reference', hash_type, hash_bits FROM v_index WHERE ref_id % 3 = 0 AND ref_id % 4 = 0
      UNION ALL SELECT ref_id, 'augmented', hash_type, hash_bits FROM v_index WHERE ref_id % 3 = 1 AND ref_id % 4 = 0
      UNION ALL SELECT vec_id, 'reference', (['full', 'edge', 'region_art', 'region_name', 'region_text'])[t + 1], bits FROM v_bits WHERE vec_id % 4 <> 0
      UNION ALL SELECT vec_id, 'augmented', (['full', 'edge', 'region_art', 'region_name', 'region_text'])[t + 1], bits
        FROM v_bits, (SELECT unnest(range(6))) WHERE vec_id % 4 <> 0)
    GROUP BY 1, 2, 3""")
def _(t):
    refs = t.coefficients.where(F.col("vec_id") % 4 != 0).select(F.col("vec_id").alias("ref_id"), "coef")
    built = ix.build_index(_sourced(t), refs)
    return built.groupBy("ref_id", "source", "hash_type").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("source") != "augmented", F.col("hash_bits"))).alias("bits")
    )


@query("vector_index_build", "v_coef", f"""
    SELECT substring(d, 1, 8) || '-' || substring(d, 9, 4) || '-5' || substring(d, 14, 3) || '-' ||
           substring('89ab', CAST(CAST('0x' || substring(d, 17, 1) AS INTEGER) % 4 + 1 AS INTEGER), 1) || substring(d, 18, 3) || '-' || substring(d, 21, 12) AS point_id,
           vec_id AS ref_id, round(coef[1] / sqrt(list_sum(list_transform(coef, lambda x: x * x))), 6) AS first
    FROM (SELECT vec_id, coef, sha1(from_hex('{NAMESPACE.hex}') || encode(CAST(vec_id AS VARCHAR))) AS d FROM v_coef WHERE vec_id % 2 = 0 OR vec_id % 3 = 0)""")
def _(t):
    vec = t.vectors
    old = ix.build_vectors(None, vec.where(F.col("point_id") % 2 == 0).select(F.col("point_id").alias("ref_id"), "vector"), NAMESPACE)
    points = ix.build_vectors(old, vec.where(F.col("point_id") % 3 == 0).select(F.col("point_id").alias("ref_id"), "vector"), NAMESPACE)
    return points.select("point_id", "ref_id", F.round(F.col("vector")[0], 6).alias("first"))
