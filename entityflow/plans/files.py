"""Source, sink, layout, pipeline and upkeep queries over the bound tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from entityflow.functions import text
from entityflow.functions.ranking import first_n
from entityflow.operators import cascade, evaluate, knn, layout, resolve, upkeep
from entityflow.plans.bindings import Tables, lit_ts, turned_bits
from entityflow.plans.collection import star
from entityflow.plans.governance import _METRICS_SQL, _scored
from entityflow.plans.matching import CANDIDATES_SQL, decide_sql, joined_candidates, orientations
from entityflow.plans.registry import query
from entityflow.plans.resolving import named_refs
from entityflow.sources import blocklist, reports, storage

_MONEY = "'$' || (price_cents // 100) || '.' || lpad(CAST(price_cents % 100 AS VARCHAR), 2, '0')"


@query("sink_collection_csv", "v_star", f"""
    SELECT name, set_name AS set, number, finish, CAST(quantity AS VARCHAR) AS quantity, CASE WHEN price_cents IS NOT NULL THEN {_MONEY} END AS price,
           price_source, strftime(price_fetched_at, '%Y-%m-%dT%H:%M:%S.000Z') AS price_date, CAST(confidence AS VARCHAR) AS confidence,
           CAST(batch_id AS VARCHAR) AS batch, card_id || '.webp' AS image_filename FROM v_star""")
def _(t):
    path = storage.scratch(t.spark, "collection-csv")
    reports.write_collection_csv(star(t), path)
    return reports.read_collection_csv(t.spark, path)


@query("sink_scan_json", "v_cards v_wide v_methods v_refs", f"""
    WITH decided AS MATERIALIZED (SELECT * FROM {decide_sql()}), cand AS {CANDIDATES_SQL.replace('METHODS', 'v_methods').replace('DECIDED', 'decided')}
    SELECT c.photo_id AS file, row_number() OVER (PARTITION BY c.photo_id ORDER BY c.card_id) - 1 AS crop_index, d.ref_id AS card_ref_id, r.name, d.confidence,
           d.stage AS accepted_stage, CAST((row_number() OVER (PARTITION BY c.photo_id ORDER BY c.card_id) - 1) % 4 * 90 AS INTEGER) AS rotation, array_to_string(d.ran, '') AS methods, coalesce(cand.candidates, '') AS candidates
    FROM v_cards c JOIN decided d ON d.item_id = c.card_id LEFT JOIN v_refs r ON r.id = d.ref_id LEFT JOIN cand ON cand.item_id = c.card_id""", types={"crop_index": "INTEGER"})
def _(t):
    # cards are decided where their votes are, and dealt by photo once, for the places and the report; a card without votes has
    # its place, but is not reported
    at = Window.partitionBy("photo_id").orderBy("card_id")
    votes = t.cards.select("card_id", "photo_id").join(cascade.wide_methods(t.methods), F.col("card_id") == F.col("item_id"), "left")
    decided = cascade.decide_wide(votes).withColumn("voted", F.col("item_id").isNotNull()).drop("item_id", "margin", "agreement")
    decisions = decided.withColumn("crop_index", F.row_number().over(at) - 1).where("voted").withColumnRenamed("photo_id", "file")
    report = reports.scan_report(decisions.withColumn("rotation", (F.col("crop_index") % 4 * 90).cast("int")), t.refs)
    path = storage.scratch(t.spark, "scan-report")
    report.write.option("compression", "gzip").json(path)
    cards = t.spark.read.schema(reports.REPORT_SCHEMA).json(path).select("file", F.explode("cards").alias("c")).select("file", "c.*")
    return cards.select(
        "file", "crop_index", "card_ref_id", "name", "confidence", "accepted_stage", "rotation",
        F.array_join(F.transform("methods", lambda m: m["method"]), "").alias("methods"),
        F.array_join(F.transform("candidates", lambda r: r.cast("string")), ",").alias("candidates"),
    )


@query("sink_eval_run", "v_cards v_wide", f"SELECT split, value, total, wrong, auto_accept_rate, false AS baseline_written FROM {_METRICS_SQL}")
def _(t):
    rows, summary, _ = evaluate.evaluate(*_scored(t), 0.9)
    path = storage.scratch(t.spark, "eval-run")
    written = reports.write_run(rows, summary, path, f"{path}/baseline")
    back = t.spark.read.schema(summary.schema).json(f"{path}/metrics")
    return back.select("split", "value", "total", "wrong", "auto_accept_rate", F.lit(written).alias("baseline_written"))


@query("src_eval_manifest", "v_cards", """
    SELECT photo_id AS file, max(scenario) OVER (PARTITION BY photo_id) AS scenario, row_number() OVER (PARTITION BY photo_id ORDER BY card_id) - 1 AS pos,
           CAST(card_ref_id AS VARCHAR) AS expected, coalesce(finish, 'unknown') AS finish FROM v_cards""", types={"pos": "INTEGER"})
def _(t):
    entry = F.struct("card_id", F.struct(F.col("card_ref_id").cast("string").alias("card_ref_id"), "finish", F.lit("").alias("notes")).alias("c"))
    cards = F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["c"])
    photos = t.cards.groupBy("photo_id").agg(F.max("scenario").alias("scenario"), cards.alias("cards"))
    path = storage.scratch(t.spark, "manifest")
    photos.select(F.array(F.struct(F.col("photo_id").alias("file"), "scenario", "cards")).alias("photos")).write.json(path)
    return reports.read_manifest(t.spark, path, one_per_file=False)


@query("src_blocklist", "v_users", """
    SELECT DISTINCT 'd' || (user_id % 300) || '.' || split_part(email, '@', 2) AS domain FROM v_users WHERE user_id % 5 > 1""")
def _(t):
    k = F.col("user_id")
    domain = F.concat(F.lit("d"), (k % 300).cast("string"), F.lit("."), F.split("email", "@")[1])
    line = F.when(k % 5 == 0, F.concat(F.lit("# "), domain)).when(k % 5 == 1, F.lit("  ")).when(k % 5 == 2, F.concat(F.lit(" "), F.upper(domain))).otherwise(domain)
    path = storage.scratch(t.spark, "blocklist")
    t.users.select(line.alias("value")).write.text(path)
    return blocklist.read_blocklist(t.spark, path)


@query("src_blob_listing", "v_cards v_batches", """
    SELECT key, CAST(user_id AS VARCHAR) AS user_id, CAST(batch_id AS VARCHAR) AS batch_id, kind, object_id FROM (
      SELECT DISTINCT b.user_id || '/' || batch_id || '/' || photo_id || '.webp' AS key, b.user_id, batch_id, 'photo' AS kind, photo_id AS object_id FROM v_cards JOIN v_batches b USING (batch_id)
      UNION ALL SELECT b.user_id || '/' || batch_id || '/crops/' || card_id || '.webp', b.user_id, batch_id, 'crop', card_id FROM v_cards JOIN v_batches b USING (batch_id)
      UNION ALL SELECT 'stray/' || batch_id, NULL, NULL, NULL, NULL FROM v_batches)""")
def _(t):
    owned = t.cards.select("batch_id", "photo_id", "card_id").join(t.batches.select("batch_id", "user_id"), "batch_id")
    user, batch = F.col("user_id"), F.col("batch_id")
    keys = (
        owned.select(storage.photo_key(user, batch, F.col("photo_id")).alias("key")).distinct()
        .unionByName(owned.select(storage.crop_key(user, batch, F.col("card_id")).alias("key")))
        .unionByName(t.batches.select(F.concat(F.lit("stray/"), batch.cast("string")).alias("key")))
    )
    return storage.parse_blob_key(keys)


# --- outlines --------------------------------------------------------------------------------

# one outline per card: a 60 x 84 rectangle at a place given by its entity
_QUADS_SQL = """(SELECT batch_id AS photo_id, card_id, row_number() OVER (PARTITION BY batch_id ORDER BY card_id) AS position,
    (card_ref_id * 37 + ordinal) % 400::DOUBLE AS x, (suppkey * 53) % 400::DOUBLE AS y FROM v_cards)"""


def _quads(t: Tables):
    x = ((F.col("card_ref_id") * 37 + F.col("ordinal")) % 400).cast("double")
    y = ((F.col("suppkey") * 53) % 400).cast("double")
    at = Window.partitionBy("batch_id").orderBy("card_id")
    corners = {"x0": x, "y0": y, "x1": x + 60, "y1": y, "x2": x + 60, "y2": y + 84, "x3": x, "y3": y + 84}
    return t.cards.select(F.col("batch_id").alias("photo_id"), F.row_number().over(at).alias("position"), *[v.alias(k) for k, v in corners.items()])


@query("set_union_dedupe", "v_cards", f"""
    SELECT photo_id, x AS x0, y AS y0, min(CASE WHEN position % 3 = 0 THEN 1 ELSE 0 END) AS pass FROM {_QUADS_SQL} GROUP BY 1, 2, 3""")
def _(t):
    quads = _quads(t)
    third = F.col("position") % 3 == 0
    # the second pass finds a third of the outlines alone and half of the others again
    both = layout.union_passes(quads.where(~third), quads.where(third | (F.col("position") % 2 == 0)))
    return both.select("photo_id", "x0", "y0", "pass")


# every pair of outlines of a photo, kept ones found by walking in order
@query("join_proximity_dedupe", "v_cards", f"""
    WITH RECURSIVE q AS (SELECT photo_id, x, y, row_number() OVER (PARTITION BY photo_id ORDER BY position) AS i
                         FROM (SELECT photo_id, x, y, min(position) AS position FROM {_QUADS_SQL} GROUP BY 1, 2, 3)),
    walk AS (
      SELECT photo_id, i, x, y, true AS kept, [[x, y]] AS held FROM q WHERE i = 1
      UNION ALL
      SELECT photo_id, i, x, y, ok, CASE WHEN ok THEN list_concat(held, [[x, y]]) ELSE held END
      FROM (SELECT q.photo_id, q.i, q.x, q.y, w.held, len(list_filter(w.held, lambda k: sqrt((k[1] - q.x) ** 2 + (k[2] - q.y) ** 2) < 0.25 * 72)) = 0 AS ok
            FROM walk w JOIN q ON q.photo_id = w.photo_id AND q.i = w.i + 1))
    SELECT photo_id, x AS x0, y AS y0 FROM walk WHERE kept""")
def _(t):
    return layout.drop_near(layout.union_passes(_quads(t))).select("photo_id", "x0", "y0")


@query("win_reading_order", "v_cards", f"""
    SELECT photo_id, x AS x0, y AS y0, rn - 1 AS ordinal FROM (
      SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY floor((y + 42) / (500 * 0.15::DOUBLE)), x + 30, x, y) AS rn
      FROM (SELECT DISTINCT photo_id, x, y FROM {_QUADS_SQL})) WHERE rn <= 5""", types={"ordinal": "INTEGER"})
def _(t):
    quads = layout.union_passes(_quads(t)).withColumn("height", F.lit(500.0))
    return layout.reading_order(quads, 5).select("photo_id", "x0", "y0", "ordinal")


# --- the whole cascade on fingerprints, vectors and text -------------------------------------

_TEXT_SQL = """(SELECT i.item_id, CASE WHEN i.item_id % 4 = 1 THEN upper(r.name) ELSE r.name END AS name,
      CASE WHEN i.item_id % 3 <> 0 THEN r.number || '/' || r.printed_total END AS number
    FROM (SELECT vec_id AS item_id FROM embeddings) i JOIN named r ON r.id = i.item_id + CASE WHEN i.item_id % 5 = 0 THEN 1 ELSE 0 END)"""
# stored answers of the model about an entity near the item's own: some say nothing, some no number, one item in six has none
_SAID_SQL = """(SELECT i.item_id, CASE WHEN i.item_id % 10 <> 9 THEN upper(r.name) END AS name,
      CASE WHEN i.item_id % 10 <> 9 AND i.item_id % 3 <> 1 THEN r.number || '/' || r.printed_total END AS number,
      CASE WHEN i.item_id % 10 NOT IN (4, 9) THEN i.item_id % 10 * 10 ELSE 0 END AS sure
    FROM (SELECT vec_id AS item_id FROM embeddings WHERE vec_id % 6 <> 5) i JOIN named r ON r.id = i.item_id + i.item_id % 3)"""
_WIDE_SQL = f"""named AS MATERIALIZED (SELECT id, CASE WHEN id % 50 = 0 THEN name || ' ' || id ELSE name END AS name, number, printed_total FROM v_refs),
    g AS (SELECT number, printed_total, count(*) AS n, min(id) AS only_id FROM named GROUP BY 1, 2),
    gn AS (SELECT number, printed_total, lower(name) AS name, min(id) AS id FROM named GROUP BY 1, 2, 3),
    nm AS (SELECT lower(name) AS name, count(*) AS n, min(id) AS id FROM named GROUP BY 1),
    txt AS (SELECT item_id, CASE WHEN g.n = 1 THEN g.only_id WHEN gn.id IS NOT NULL THEN gn.id WHEN nm.n = 1 THEN nm.id END AS ref_id,
                   0.95::DOUBLE * CASE WHEN g.n = 1 THEN 1.0::DOUBLE WHEN gn.id IS NOT NULL THEN 0.9::DOUBLE WHEN nm.n = 1 THEN 0.6::DOUBLE ELSE 0::DOUBLE END AS score
            FROM (SELECT item_id, lower(name) AS name, split_part(number, '/', 1) AS num, split_part(number, '/', 2) AS total FROM {_TEXT_SQL}) o
            LEFT JOIN g ON g.number = o.num AND g.printed_total = o.total
            LEFT JOIN gn ON gn.number = o.num AND gn.printed_total = o.total AND gn.name = o.name LEFT JOIN nm ON nm.name = o.name),
    ans AS (SELECT item_id, CASE WHEN g.n = 1 THEN g.only_id WHEN gn.id IS NOT NULL THEN gn.id WHEN nm.n = 1 THEN nm.id END AS ref_id,
                   sure / 100::DOUBLE * CASE WHEN g.n = 1 THEN 1.0::DOUBLE WHEN gn.id IS NOT NULL THEN 0.9::DOUBLE WHEN nm.n = 1 THEN 0.6::DOUBLE ELSE 0::DOUBLE END AS score
            FROM (SELECT item_id, lower(name) AS name, split_part(number, '/', 1) AS num, split_part(number, '/', 2) AS total, sure FROM {_SAID_SQL}) o
            LEFT JOIN g ON g.number = o.num AND g.printed_total = o.total
            LEFT JOIN gn ON gn.number = o.num AND gn.printed_total = o.total AND gn.name = o.name LEFT JOIN nm ON nm.name = o.name),
    cosine AS MATERIALIZED (SELECT item_id, max(ref_id) FILTER (rn = 1) AS ref_id, max(sim) FILTER (rn = 1)
                     * (0.5::DOUBLE + 0.5::DOUBLE * least(greatest((1 - max(sim) FILTER (rn = 2)) - (1 - max(sim) FILTER (rn = 1)), 0) / 0.05::DOUBLE, 1::DOUBLE)) AS score
               FROM (SELECT q.item_id, p.vec_id AS ref_id, list_cosine_similarity(q.vector, p.coef) AS sim,
                            row_number() OVER (PARTITION BY q.item_id ORDER BY list_cosine_similarity(q.vector, p.coef) DESC, p.vec_id) AS rn
                     FROM v_qvectors q CROSS JOIN v_coef p) WHERE rn <= 5 GROUP BY item_id),
    wide AS MATERIALIZED (SELECT m.item_id, CASE WHEN m.matched THEN m.ref_id END AS h_ref, m.score AS h_score, m.margin, m.agreement,
                    c.ref_id AS a_ref, c.score AS a_score, x.ref_id AS b_ref, coalesce(x.score, CASE WHEN x.item_id IS NOT NULL THEN 0 END) AS b_score,
                    s.ref_id AS c_ref, s.score AS c_score
             FROM v_turned_match m JOIN cosine c USING (item_id) LEFT JOIN txt x USING (item_id) LEFT JOIN ans s USING (item_id) WHERE m.item_id % 60 >= 5)"""


@query("cascade_identify", "v_turned_match v_turns v_qvectors v_coef v_refs", f"""
    WITH {_WIDE_SQL}, decided AS MATERIALIZED (SELECT * FROM {decide_sql('wide')}),
    long AS (SELECT item_id, 'h' AS method, h_ref AS ref_id, h_score AS score FROM wide UNION ALL SELECT item_id, 'a', a_ref, a_score FROM wide
             UNION ALL SELECT item_id, 'b', b_ref, b_score FROM wide UNION ALL SELECT item_id, 'c', c_ref, c_score FROM wide)
    SELECT d.item_id, d.ref_id, d.confidence, d.stage, coalesce(c.candidates, '') AS candidates, t.alternative * 90 AS rotation
    FROM decided d JOIN v_turns t ON t.item_id = d.item_id LEFT JOIN {CANDIDATES_SQL.replace('METHODS', 'long').replace('DECIDED', 'decided')} c ON c.item_id = d.item_id
    UNION ALL SELECT vec_id, NULL, 0, 'unreadable', '', 0 FROM embeddings WHERE vec_id % 60 < 5""", types={"rotation": "INTEGER"})
def _(t):
    return joined_candidates(identify_probes(t)).drop("methods")


def identify_probes(t: Tables):
    k = F.col("item_id")
    ref = named_refs(t).select((F.col("id")).alias("_ref"), "name", "number", "printed_total")
    points = t.coefficients.select(F.col("vec_id").alias("point_id"), F.col("vec_id").alias("ref_id"), F.col("coef").alias("vector"))

    def upright(items):
        return orientations(t, items).select("item_id", (F.col("alternative") * 90).alias("rotation"))

    def by_hash(items):
        turned = t.probe.join(items.select("item_id", "rotation"), "item_id").select(
            "item_id", "hash_type", turned_bits(F.col("hash_bits"), k, (F.col("rotation") / 90).cast("int")).alias("hash_bits"))
        return knn.hamming_match(turned, t.index)

    def by_vector(items):
        return knn.cosine_match(t.query_vectors.join(items.select("item_id"), "item_id", "left_semi"), points)

    def by_text(items):
        wanted = items.select("item_id", (k + F.when(k % 5 == 0, 1).otherwise(0)).alias("_ref")).join(ref, "_ref")
        read = wanted.select(
            "item_id", F.when(k % 4 == 1, F.upper("name")).otherwise(F.col("name")).alias("name"),
            F.when(k % 3 != 0, F.concat("number", F.lit("/"), "printed_total")).alias("number"),
        )
        return resolve.resolve(read, named_refs(t)).select("item_id", "ref_id", (F.col("exactness") * 0.95).alias("score"))

    def by_model(items):
        return cascade.cached_votes(items.withColumn("content_key", key), answers, named_refs(t))[0]

    key = text.content_key(F.concat(F.lit("crop "), k.cast("string")))
    number = F.when(k % 3 != 1, F.concat(F.lit('"number": "'), "number", F.lit("/"), "printed_total", F.lit('", '))).otherwise("")
    sure = F.when(k % 10 == 4, '"high"').otherwise((k % 10 * 10).cast("string"))
    answer = F.concat(F.lit('Sure:\n{"name": "'), F.upper("name"), F.lit('", '), number, F.lit('"confidence": '), sure, F.lit("}\ndone"))
    asked = t.coefficients.select(F.col("vec_id").alias("item_id"), (F.col("vec_id") + F.col("vec_id") % 3).alias("_ref")).where(k % 6 != 5)
    answers = asked.join(ref, "_ref").select(key.alias("content_key"), F.when(k % 10 == 9, "I cannot tell").otherwise(answer).alias("response"))
    items = t.coefficients.select(F.col("vec_id").alias("item_id"), (F.col("vec_id") % 60 + 40).cast("double").alias("sharpness"))
    return cascade.identify(items, {"h": by_hash, "a": by_vector, "b": by_text, "c": by_model}, quality="sharpness", orient=upright)


# --- upkeep ----------------------------------------------------------------------------------

_NOW = "TIMESTAMP '1999-01-01 00:00:00'"


@query("spec_retention", "v_batches v_users v_photos v_prices", f"""
    WITH b AS (SELECT b.*, CASE WHEN u.tier = 'anon' AND b.created_at <= {_NOW} - INTERVAL 24 HOUR THEN 'anonymous'
                 WHEN b.status IN ('pending', 'failed') AND b.created_at <= {_NOW} - INTERVAL 48 HOUR THEN 'abandoned' END AS kind FROM v_batches b JOIN v_users u USING (user_id))
    SELECT kind, CAST(batch_id AS VARCHAR) AS id FROM b WHERE kind IS NOT NULL
    UNION ALL SELECT 'source_photo', photo_id FROM v_photos WHERE batch_id IN (SELECT batch_id FROM b WHERE kind IS NULL AND status = 'complete' AND created_at <= {_NOW} - INTERVAL 7 DAY)
    UNION ALL SELECT 'price', card_ref_id || '/' || finish FROM v_prices WHERE fetched_at <= {_NOW} - INTERVAL 30 DAY""")
def _(t):
    return upkeep.retention(t.batches, t.users, t.photos, t.prices, lit_ts("1999-01-01 00:00:00"))


@query("spec_orphans", "v_photos", """
    SELECT photo_id AS key, CASE WHEN ordinal = 6 THEN 'object without row' ELSE 'row without object' END AS kind FROM v_photos WHERE ordinal IN (6, 7)""")
def _(t):
    objects = t.photos.where(F.col("ordinal") != 7).select(F.col("photo_id").alias("key"))
    rows = t.photos.where(F.col("ordinal") != 6).select(F.col("photo_id").alias("key"))
    return upkeep.orphans(objects, rows)


@query("spec_budget_mode", "v_requests", """
    SELECT request_id, CASE WHEN d >= 900 THEN 'queue' WHEN d * 100 >= 72000 THEN 'degrade' WHEN u >= 9 THEN 'user degrade' ELSE 'normal' END AS mode
    FROM (SELECT request_id, sum(want) OVER (PARTITION BY day ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) - want AS d,
                 sum(want) OVER (PARTITION BY user_id, day ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) - want AS u FROM v_requests)""")
def _(t):
    return upkeep.budget_mode(t.requests.withColumnRenamed("want", "cents"), 900, 9).select("request_id", "mode")


@query("spec_triage", "v_star", """
    SELECT user_id, CASE WHEN coalesce(price_cents, 0) >= 400000 THEN 'grade' WHEN coalesce(price_cents, 0) >= 200000 THEN 'sell' ELSE 'bulk' END AS bucket,
           CAST(sum(quantity) AS BIGINT) AS cards, CAST(sum(coalesce(price_cents, 0)::BIGINT * quantity) AS BIGINT) AS value_cents FROM v_star GROUP BY 1, 2""")
def _(t):
    return upkeep.triage(star(t), 200000, 400000)


@query("spec_population", "v_star", """
    SELECT set_name, CASE WHEN price_cents IS NULL THEN NULL WHEN price_cents >= 400000 THEN 2 WHEN price_cents >= 200000 THEN 1 ELSE 0 END AS band,
           CAST(sum(quantity) AS BIGINT) AS cards, count(DISTINCT user_id) AS owners FROM v_star GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 25""")
def _(t):
    return upkeep.population(star(t), (200000, 400000), 25)


@query("spec_specular", "", """
    SELECT l_partkey AS item_id, CASE WHEN var_pop(l_quantity) >= 205 AND var_pop(l_discount * 100) >= 9 THEN 'holofoil'
        WHEN var_pop(l_discount * 100) >= 9 THEN 'reverseHolofoil' ELSE 'normal' END AS suggested FROM lineitem GROUP BY 1""")
def _(t):
    pixels = t.raw("lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("saturation"), (F.col("l_discount") * 100).alias("brightness"))
    return upkeep.specular_hint(pixels, 205.0, 9.0)
