"""Fingerprint search, vector search and decision queries over the bound tables."""

from pyspark.sql import functions as F

from entityflow.operators import cascade, knn
from entityflow.params import HashParams
from entityflow.plans.bindings import Tables, turned_bits
from entityflow.plans.registry import query


@query("src_hash_index_scan", "v_index", """
    SELECT ref_id, hash_type, hash_bits FROM v_index""")
def _(t):
    # a row of an unknown tier, which the scan must drop, beside every full one
    odd = t.index.where(F.col("hash_type") == "full").withColumn("hash_type", F.lit("thumbnail"))
    return knn.load_index(t.index.unionByName(odd))


@query("join_hamming_knn", "v_knn", "SELECT item_id, hash_type, best_ref, best_dist, second_dist FROM v_knn", types={"best_dist": "INTEGER", "second_dist": "INTEGER"})
def _(t):
    return knn.hamming_knn(t.probe, t.index).drop("hash_bits")


@query("win_best_two_distinct", "v_knn", """
    SELECT item_id, hash_type, best_dist, second_dist - best_dist AS margin FROM v_knn""", types={"best_dist": "INTEGER", "margin": "INTEGER"})
def _(t):
    # bands first, and a fine grid behind them, so that the best two are merged over many cells of both
    return knn.hamming_knn(t.probe, t.index, knn.Grid(1000, 150, bands_from=0)).select(
        "item_id", "hash_type", "best_dist", (F.col("second_dist") - F.col("best_dist")).alias("margin")
    )


@query("join_hamming_ensemble", "v_match", """
    SELECT item_id, CASE WHEN matched THEN ref_id END AS ref_id, round(score, 9) AS score, distance, margin, agreement FROM v_match""", types={"distance": "INTEGER", "margin": "INTEGER", "agreement": "INTEGER"})
def _(t):
    return knn.hamming_match(t.probe, t.index).withColumn("score", F.round("score", 9))


@query("fn_hash_score", "v_methods", """
    SELECT item_id, round(greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE * (1 - (margin * 2)::DOUBLE / 10)
       + 0.3::DOUBLE * least(margin / 10::DOUBLE, 1::DOUBLE) + 0.2::DOUBLE * (agreement / 5::DOUBLE))), 9) AS score
    FROM v_methods WHERE method = 'h'""")
def _(t):
    s = knn.hash_score(F.col("margin") * 2, F.col("margin"), F.col("agreement"), HashParams().accept_distance)
    return t.methods.where(F.col("method") == "h").select("item_id", F.round(s, 9).alias("score"))


@query("join_best_orientation", "v_turns", "SELECT item_id, alternative, distance FROM v_turns", types={"distance": "INTEGER"})
def orientations(t: Tables, items=None):
    full = t.probe.where(F.col("hash_type") == "full")
    if items is not None:
        full = full.join(items.select("item_id"), "item_id", "left_semi")
    k, turns = F.col("item_id"), F.array(*[F.lit(i) for i in range(4)])
    alternatives = full.select(k, "hash_bits", F.explode(turns).alias("alternative")).select(
        k, "alternative", turned_bits(F.col("hash_bits"), k, F.col("alternative")).alias("hash_bits"))
    return knn.best_alternative(alternatives, t.index)


COSINE_SQL = """(SELECT item_id, top_ref AS ref_id,
       sim * (0.5::DOUBLE + 0.5::DOUBLE * least(greatest(coalesce((1 - other) - (1 - sim), 0), 0) / 0.05::DOUBLE, 1::DOUBLE)) AS score
    FROM (SELECT item_id, max(ref_id) FILTER (rn = 1) AS top_ref, max(sim) FILTER (rn = 1) AS sim,
                 max(sim) FILTER (ref_id <> top) AS other
          FROM (SELECT *, first_value(ref_id) OVER (PARTITION BY item_id ORDER BY rn) AS top
                FROM (SELECT q.item_id, p.ref_id, list_cosine_similarity(q.vector, p.vector) AS sim,
                             row_number() OVER (PARTITION BY q.item_id ORDER BY list_cosine_similarity(q.vector, p.vector) DESC, p.point_id) AS rn
                      FROM v_qvectors q CROSS JOIN v_vectors p) WHERE rn <= 5)
          GROUP BY item_id))"""


@query("join_cosine_knn", "v_vectors v_qvectors", f"SELECT item_id, ref_id, round(score, 6) AS score FROM {COSINE_SQL}")
def _(t):
    return knn.cosine_match(t.query_vectors, t.vectors).withColumn("score", F.round("score", 6))


# --- decisions -------------------------------------------------------------------------------

DECIDE_SQL = """(SELECT *, CASE exit WHEN 'h' THEN ['h'] WHEN 'multi' THEN ['h', 'a', 'b'] ELSE ['h', 'a', 'b', 'c'] END AS ran,
       CASE exit WHEN 'h' THEN h_ref WHEN 'multi' THEN multi_ref WHEN 'model' THEN c_ref END AS ref_id,
       CASE exit WHEN 'h' THEN h_conf WHEN 'multi' THEN multi_conf WHEN 'model' THEN model_conf ELSE best_conf END AS confidence,
       CASE WHEN exit IN ('h', 'multi') THEN exit
            WHEN exit = 'model' THEN CASE WHEN model_conf >= 80 THEN 'llm' ELSE 'validation' END
            WHEN best_conf < 40 THEN 'unreadable' ELSE 'validation' END AS stage
    FROM (SELECT *, CASE WHEN h_ref IS NOT NULL AND agreement >= 4 AND h_conf >= 90 THEN 'h'
                         WHEN multi_ref IS NOT NULL THEN 'multi' WHEN partner IS NOT NULL THEN 'model' ELSE 'none' END AS exit,
                 CAST(greatest(0, least(100, 90 + round_even(multi_mean * 10, 0))) AS INTEGER) AS multi_conf,
                 CAST(greatest(0, least(85, 70 + round_even((c_score + partner) / 2 * 15, 0))) AS INTEGER) AS model_conf
          FROM (SELECT *, 85 + least(margin, 10) AS h_conf,
                  CASE WHEN h_ref = a_ref OR h_ref = b_ref THEN h_ref WHEN a_ref = b_ref THEN a_ref END AS multi_ref,
                  CASE WHEN h_ref = a_ref AND h_ref = b_ref THEN (h_score + a_score + b_score) / 3
                       WHEN h_ref = a_ref THEN (h_score + a_score) / 2 WHEN h_ref = b_ref THEN (h_score + b_score) / 2
                       WHEN a_ref = b_ref THEN (a_score + b_score) / 2 END AS multi_mean,
                  CASE WHEN c_ref = h_ref THEN h_score WHEN c_ref = a_ref THEN a_score WHEN c_ref = b_ref THEN b_score END AS partner,
                  CAST(least(60, round_even(greatest(h_score, a_score, b_score, c_score) * 100, 0)) AS INTEGER) AS best_conf
                FROM WIDE)))"""


def decide_sql(wide: str = "v_wide") -> str:
    return DECIDE_SQL.replace("FROM WIDE", f"FROM {wide}")


# candidates: best score per ref among the methods that ran, earlier method first on a tie
CANDIDATES_SQL = """(SELECT item_id, string_agg(CAST(ref_id AS VARCHAR), ',' ORDER BY rn) AS candidates
    FROM (SELECT item_id, ref_id, row_number() OVER (PARTITION BY item_id ORDER BY max(score) DESC, min(pos)) AS rn
          FROM (SELECT m.item_id, m.ref_id, m.score, list_position(['h', 'a', 'b', 'c'], m.method) AS pos
                FROM METHODS m JOIN DECIDED d ON d.item_id = m.item_id AND list_contains(d.ran, m.method)
                WHERE m.ref_id IS NOT NULL) GROUP BY item_id, ref_id)
    WHERE rn <= 3 GROUP BY item_id)"""


@query("cascade_decide", "v_methods v_wide", f"""
    WITH decided AS MATERIALIZED (SELECT * FROM {decide_sql()})
    SELECT d.item_id, d.ref_id, d.confidence, d.stage, coalesce(c.candidates, '') AS candidates
    FROM decided d LEFT JOIN {CANDIDATES_SQL.replace('METHODS', 'v_methods').replace('DECIDED', 'decided')} c ON c.item_id = d.item_id""")
def decided(t: Tables):
    return joined_candidates(cascade.decide(t.methods)).drop("methods")


def joined_candidates(df):
    text = F.array_join(F.transform("candidates", lambda r: r.cast("string")), ",")
    return df.withColumn("candidates", text)


@query("agg_method_vote", "v_methods", """
    SELECT item_id, ref_id, votes, round(mean_score, 9) AS mean_score
    FROM (SELECT item_id, ref_id, count(*) AS votes, avg(score) AS mean_score FROM v_methods
          WHERE ref_id IS NOT NULL AND method <> 'c' GROUP BY 1, 2 HAVING count(*) >= 2)""")
def _(t):
    return cascade.vote(t.methods.where(F.col("method") != "c")).withColumn("mean_score", F.round("mean_score", 9))


@query("agg_topn_candidates", "v_methods", """
    SELECT item_id, ref_id, score, rn FROM (
      SELECT item_id, ref_id, max(score) AS score, row_number() OVER (PARTITION BY item_id
        ORDER BY max(score) DESC, min(list_position(['h', 'a', 'b', 'c'], method))) AS rn
      FROM v_methods WHERE ref_id IS NOT NULL GROUP BY item_id, ref_id) WHERE rn <= 3""", types={"rn": "INTEGER"})
def _(t):
    return cascade.top_candidates(t.methods)


@query("fn_stage_status", "v_wide", f"""
    SELECT item_id, stage, CASE WHEN stage IN ('h', 'multi', 'llm') THEN 'auto' WHEN stage = 'validation' THEN 'validation'
       ELSE 'unreadable' END AS status FROM {decide_sql()}""")
def _(t):
    return cascade.decide(t.methods).select("item_id", "stage", cascade.stage_status(F.col("stage")).alias("status"))


@query("flt_quality_gate", "v_cards", """
    SELECT card_id AS item_id, CASE WHEN confidence < 45 THEN 'unreadable' ELSE 'open' END AS stage,
           CASE WHEN confidence < 45 THEN 0 END AS confidence FROM v_cards""")
def _(t):
    items = t.cards.select(F.col("card_id").alias("item_id"), F.col("confidence").cast("double").alias("sharpness"))
    ok, poor = cascade.quality_gate(items, "sharpness", 45.0)
    return poor.unionByName(ok.select("item_id", F.lit("open").alias("stage"), F.lit(None).cast("int").alias("confidence")))


@query("agg_llm_calls", "v_wide v_cards v_batches", f"""
    SELECT b.user_id, CAST(CAST(c.created_at AS DATE) AS VARCHAR) AS day,
           CAST(sum(CASE WHEN list_contains(d.ran, 'c') THEN 1 ELSE 0 END) AS BIGINT) AS llm_calls
    FROM {decide_sql()} d JOIN v_cards c ON c.card_id = d.item_id JOIN v_batches b USING (batch_id) GROUP BY 1, 2""")
def _(t):
    owners = t.cards.select(F.col("card_id").alias("item_id"), "batch_id", F.col("created_at").cast("date").cast("string").alias("day")).join(
        t.batches.select("batch_id", "user_id"), "batch_id"
    )
    return cascade.model_calls(cascade.decide(t.methods).select("item_id", "methods").join(owners, "item_id"), ["user_id", "day"])
