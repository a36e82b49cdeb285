"""The application tables derived from the test tables: once in Spark, once as SQL text.

``Tables`` gives DataFrames; ``with_views`` prefixes a SQL body with the matching CTEs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityflow.functions.fingerprint import bits_from_coefficients, flip_mask, tier_coefficients
from entityflow.params import FINISHES, STATUSES, TIERS
from entityflow.sources.storage import materialise


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lit_ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# tables whose rows are costly to work on, with the key to spread them by
_SPREAD = {"lineitem": "l_orderkey", "embeddings": "vec_id", "documents": "doc_id"}


# what the three other orientations of an item do to its fingerprints
TURN_MASKS = (0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x00FF00FF00FF00FF, 0x7FFF00007FFF0000)


def turned_bits(bits: Column, item: Column, alternative: Column) -> Column:
    """The fingerprint of an item in an orientation; the stored one belongs to ``item % 4``."""
    mask = F.element_at(F.array(*[F.lit(m).cast("bigint") for m in TURN_MASKS]), (alternative + 1).cast("int"))
    return F.when(item % 4 == alternative, bits).otherwise(bits.bitwiseXOR(mask))


class Tables:
    """DataFrames of one scale directory. Everything is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name not in _SPREAD:
            return df
        # A single small file is one task however much work its rows bring. Where the input has fewer splits than
        # the cluster has slots, its rows are spread first; a large table has more splits and is left alone.
        slots = self.spark.sparkContext.defaultParallelism
        return df.repartition(slots, _SPREAD[name]) if df.rdd.getNumPartitions() < slots else df

    @cached_property
    def users(self) -> DataFrame:
        domain = F.element_at(
            _lit_array(["example.com", "mailinator.com", "a.mailinator.com", "mail.example.org", "yopmail.com", "com"]),
            (F.col("c_custkey") % 6 + 1).cast("int"),
        )
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.concat(F.lit("User"), F.col("c_custkey").cast("string"), F.lit("@"), domain).alias("email"),
            F.when(F.col("c_custkey") % 4 == 0, "anon").otherwise("free").alias("tier"),
            F.when(F.col("c_custkey") % 20 == 0, "suspended").otherwise("active").alias("status"),
        )

    @cached_property
    def batches(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("batch_id"),
            F.col("o_custkey").alias("user_id"),
            F.when(F.col("o_orderstatus") == "F", "complete")
            .when(F.col("o_orderstatus") == "P", "processing")
            .otherwise("pending").alias("status"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def cards(self) -> DataFrame:
        n = F.col("l_linenumber")
        slot = (n * 2 + F.when(F.col("l_linestatus") == "F", 1).otherwise(0)) % len(STATUSES)
        return self.raw("lineitem").select(
            card_key().alias("card_id"),
            F.col("l_orderkey").alias("batch_id"),
            F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string")).alias("photo_id"),
            n.alias("ordinal"),
            F.col("l_partkey").alias("card_ref_id"),
            F.col("l_suppkey").alias("suppkey"),
            F.when(F.col("l_returnflag") == "A", FINISHES[0])
            .when(F.col("l_returnflag") == "N", FINISHES[1])
            .when(n % 3 == 0, F.lit(None).cast("string"))
            .otherwise(FINISHES[2]).alias("finish"),
            F.col("l_quantity").cast("int").alias("quantity"),
            ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + n) % 101).cast("int").alias("confidence"),
            F.element_at(_lit_array(STATUSES), (slot + 1).cast("int")).alias("status"),
            F.col("l_shipdate").alias("created_at"),
            F.col("l_returnflag").alias("scenario"),
        )

    @cached_property
    def photos(self) -> DataFrame:
        b, n = F.col("batch_id"), F.col("ordinal")
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("ordinal"))
            .agg(F.min("l_shipdate").alias("created_at"))
            .select(
                F.concat_ws("-", b.cast("string"), n.cast("string")).alias("photo_id"),
                b, n,
                F.when((b + n) % 11 == 0, "failed").when((b + n) % 13 == 0, "stored").otherwise("done").alias("status"),
                (F.lit(300000) + (b * 31 + n * 17) % 300000).cast("bigint").alias("bytes"),
                "created_at",
            )
        )

    @cached_property
    def refs(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            k.alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("set_id"),
            F.col("p_brand").alias("set_name"),
            F.col("p_size").cast("string").alias("number"),
            (F.col("p_size") + 50 - k % 2).cast("string").alias("printed_total"),
            F.slice(_lit_array(FINISHES), 1, (k % 3 + 1).cast("int")).alias("finishes"),
            F.col("p_retailprice").alias("retail"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        """Price observations with a key; ``unavailable`` ones answer nothing."""
        k = F.col("l_partkey")
        ok = F.col("l_linenumber") % 5 != 0
        cents = F.rint(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("int")
        return self.raw("lineitem").select(
            card_key().alias("obs_id"),
            k.alias("card_ref_id"),
            F.when(F.col("l_returnflag") == "A", FINISHES[0])
            .when(F.col("l_returnflag") == "N", FINISHES[1])
            .when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("string"))
            .otherwise(FINISHES[2]).alias("finish"),
            F.when(F.col("l_suppkey") % 2 == 0, "primary").otherwise("secondary").alias("source"),
            F.when(ok, "ok").otherwise("unavailable").alias("obs_status"),
            F.when(ok & (k % 7 != 0), cents).alias("cents"),
            F.when(k % 7 != 0, cents).alias("book_cents"),
            F.col("l_shipdate").alias("observed_at"),
        ).where(F.col("finish").isNotNull())

    @cached_property
    def prices(self) -> DataFrame:
        return (
            self.observations.where(F.col("card_ref_id") % 11 != 0)
            .groupBy("card_ref_id", "finish")
            .agg(
                F.max_by(
                    F.struct("book_cents", "source", "observed_at"), F.struct("observed_at", "obs_id")
                ).alias("last")
            )
            .select(
                "card_ref_id", "finish",
                F.col("last.book_cents").alias("price_cents"),
                F.col("last.source").alias("source"),
                F.col("last.observed_at").alias("fetched_at"),
            )
        )

    @cached_property
    def requests(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("request_id"),
            F.col("user_id"),
            "ts",
            F.col("ts").cast("date").alias("day"),
            (F.col("event_id") % 7 + 1).cast("int").alias("want"),
            "event_type", "props",
        )

    @cached_property
    def coefficients(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id"), F.col("embedding").cast("array<double>").alias("coef")
        )

    @cached_property
    def index(self) -> DataFrame:
        """(ref_id, hash_type, hash_bits), stored as an index is; every tenth owner is a near twin of its neighbour."""
        vec = self.coefficients
        own = vec.select("vec_id", (F.col("vec_id") - F.when(F.col("vec_id") % 10 == 1, 1).otherwise(0)).alias("src"))
        bits = (
            vec.select("vec_id", F.posexplode(tier_coefficients(F.col("coef"))).alias("t", "c"))
            .select(F.col("vec_id").alias("src"), "t", bits_from_coefficients(F.col("c")).alias("bits"))
        )
        twin = F.col("bits").bitwiseXOR(F.lit((1 << 62) | (1 << 61)))
        rows = bits.join(own, "src").select(
            F.col("vec_id").alias("ref_id"),
            F.element_at(_lit_array(TIERS), F.col("t") + 1).alias("hash_type"),
            F.when(F.col("vec_id") != F.col("src"), twin).otherwise(F.col("bits")).alias("hash_bits"),
        )
        return materialise(rows, "index")

    @cached_property
    def probe(self) -> DataFrame:
        """One query item per index owner, each tier with its own number of flipped bits."""
        t = F.array_position(_lit_array(TIERS), F.col("hash_type")).cast("int") - 1
        k = ((F.col("ref_id") * (t * 2 + 1) + t) % 19).cast("int")
        return self.index.select(
            F.col("ref_id").alias("item_id"),
            "hash_type",
            F.col("hash_bits").bitwiseXOR(flip_mask(t, k)).alias("hash_bits"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """Reference points; two neighbouring points share an owner."""
        return self.coefficients.select(
            F.col("vec_id").alias("point_id"),
            F.floor(F.col("vec_id") / 2).cast("bigint").alias("ref_id"),
            F.col("coef").alias("vector"),
        )

    @cached_property
    def query_vectors(self) -> DataFrame:
        c = F.col("coef")
        rolled = F.concat(F.slice(c, 2, 63), F.slice(c, 1, 1))
        return self.coefficients.select(
            F.col("vec_id").alias("item_id"),
            F.zip_with(c, rolled, lambda a, b: a + b * F.lit(0.5)).alias("vector"),
        )

    @cached_property
    def methods(self) -> DataFrame:
        """One row per (card, method) with ref, score, and for ``h`` margin and agreement."""
        k, n, s = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
        null = F.lit(None).cast("bigint")
        zero = F.lit(0.0)

        def pct(x: Column) -> Column:
            return (x % 100).cast("double") / F.lit(100.0)

        h_ref = F.when(n <= 5, k)
        h_score = F.when(n <= 5, pct(k * 13 + s)).otherwise(zero)
        b_case = s % 4
        b_ref = F.when(b_case == 0, k).when(b_case == 1, k + 1).when(b_case == 2, null).otherwise(k + 5)
        b_score = F.when(b_case <= 1, pct(k + s)).when(b_case == 2, zero).otherwise(pct(k * 3 + s))
        c_case = (k + n) % 4
        c_ref = F.when(c_case == 0, k).when(c_case == 1, k + 9).when(c_case == 2, null).otherwise(k + 5)
        c_score = F.when(c_case <= 1, pct(k + s * 3)).when(c_case == 2, zero).otherwise(pct(k * 11 + s))
        hard = k % 5 == 0
        c_off = hard & (n % 2 == 1)
        low = F.lit(0.3)

        def row(method, ref, score, margin=None, agreement=None):
            i = F.lit(None).cast("int")
            return F.struct(
                F.lit(method).alias("method"),
                ref.cast("bigint").alias("ref_id"),
                score.alias("score"),
                (i if margin is None else margin.cast("int")).alias("margin"),
                (i if agreement is None else agreement.cast("int")).alias("agreement"),
            )

        rows = F.array(
            row("h", h_ref, F.when(hard, h_score * low).otherwise(h_score), k % 7 + 4, s % 3 + 3),
            row("a", F.when(hard, k + 20 + n).otherwise(k + n % 3), F.when(hard, pct(k * 7 + n) * low).otherwise(pct(k * 7 + n))),
            row("b", F.when(hard, null).otherwise(b_ref), F.when(hard, zero).otherwise(b_score)),
            row("c", F.when(c_off, null).otherwise(c_ref), F.when(c_off, zero).otherwise(c_score)),
        )
        return (
            self.raw("lineitem").select(card_key().alias("item_id"), F.explode(rows).alias("m")).select("item_id", "m.*")
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Text lines of the documents as (item, band, pos, text, conf)."""
        return (
            self.raw("documents")
            .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
            .select(
                F.col("doc_id").alias("item_id"),
                F.when(F.col("pos") == 0, "name").otherwise("text").alias("band"),
                "pos", "text",
                ((F.length("text") % 50 + 50).cast("double") / F.lit(100.0)).alias("conf"),
            )
        )


def card_key() -> Column:
    return F.concat_ws(
        "-",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        F.rint(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
    )


# --- the same views as SQL -------------------------------------------------------------------

_KEY = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CAST(round_even(l_extendedprice * 100, 0) AS BIGINT))"
)
_FINISH = (
    "CASE WHEN l_returnflag = 'A' THEN 'normal' WHEN l_returnflag = 'N' THEN 'holofoil' "
    "WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'reverseHolofoil' END"
)
_FINISH_LIST = "['normal', 'holofoil', 'reverseHolofoil']"
_STATUS_LIST = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "]"
_TIER_LIST = "[" + ", ".join(f"'{t}'" for t in TIERS) + "]"

VIEWS: dict[str, tuple[str, str]] = {
    "v_users": ("", """
        SELECT c_custkey AS user_id,
               'User' || c_custkey || '@' || (['example.com', 'mailinator.com', 'a.mailinator.com',
                  'mail.example.org', 'yopmail.com', 'com'])[c_custkey % 6 + 1] AS email,
               CASE WHEN c_custkey % 4 = 0 THEN 'anon' ELSE 'free' END AS tier,
               CASE WHEN c_custkey % 20 = 0 THEN 'suspended' ELSE 'active' END AS status
        FROM customer"""),
    "v_batches": ("", """
        SELECT o_orderkey AS batch_id, o_custkey AS user_id,
               CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'processing' ELSE 'pending' END AS status,
               o_orderdate AS created_at
        FROM orders"""),
    "v_cards": ("", f"""
        SELECT {_KEY} AS card_id, l_orderkey AS batch_id, l_orderkey || '-' || l_linenumber AS photo_id,
               l_linenumber AS ordinal, l_partkey AS card_ref_id, l_suppkey AS suppkey, {_FINISH} AS finish,
               CAST(l_quantity AS INTEGER) AS quantity,
               CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 101 AS INTEGER) AS confidence,
               ({_STATUS_LIST})[(l_linenumber * 2 + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) % 9 + 1] AS status,
               l_shipdate AS created_at, l_returnflag AS scenario
        FROM lineitem"""),
    "v_photos": ("", """
        SELECT batch_id || '-' || ordinal AS photo_id, batch_id, ordinal,
               CASE WHEN (batch_id + ordinal) % 11 = 0 THEN 'failed'
                    WHEN (batch_id + ordinal) % 13 = 0 THEN 'stored' ELSE 'done' END AS status,
               CAST(300000 + (batch_id * 31 + ordinal * 17) % 300000 AS BIGINT) AS bytes, created_at
        FROM (SELECT l_orderkey AS batch_id, l_linenumber AS ordinal, min(l_shipdate) AS created_at
              FROM lineitem GROUP BY 1, 2)"""),
    "v_refs": ("", f"""
        SELECT p_partkey AS id, p_name AS name, p_brand AS set_id, p_brand AS set_name,
               CAST(p_size AS VARCHAR) AS number, CAST(p_size + 50 - p_partkey % 2 AS VARCHAR) AS printed_total,
               ({_FINISH_LIST})[1:p_partkey % 3 + 1] AS finishes, p_retailprice AS retail
        FROM part"""),
    "v_obs": ("", f"""
        SELECT * FROM (
          SELECT {_KEY} AS obs_id, l_partkey AS card_ref_id, {_FINISH} AS finish,
               CASE WHEN l_suppkey % 2 = 0 THEN 'primary' ELSE 'secondary' END AS source,
               CASE WHEN l_linenumber % 5 <> 0 THEN 'ok' ELSE 'unavailable' END AS obs_status,
               CASE WHEN l_linenumber % 5 <> 0 AND l_partkey % 7 <> 0
                    THEN CAST(round_even(l_extendedprice / l_quantity * 100, 0) AS INTEGER) END AS cents,
               CASE WHEN l_partkey % 7 <> 0
                    THEN CAST(round_even(l_extendedprice / l_quantity * 100, 0) AS INTEGER) END AS book_cents,
               l_shipdate AS observed_at
          FROM lineitem) WHERE finish IS NOT NULL"""),
    "v_prices": ("v_obs", """
        SELECT card_ref_id, finish, book_cents AS price_cents, source, observed_at AS fetched_at
        FROM v_obs WHERE card_ref_id % 11 <> 0
        QUALIFY row_number() OVER (PARTITION BY card_ref_id, finish ORDER BY observed_at DESC, obs_id DESC) = 1"""),
    "v_requests": ("", """
        SELECT event_id AS request_id, user_id, ts, CAST(ts AS DATE) AS day,
               CAST(event_id % 7 + 1 AS INTEGER) AS want, event_type, props
        FROM events"""),
    "v_star": ("v_cards v_batches v_refs v_prices", """
        SELECT c.card_id, c.card_ref_id, r.name, r.set_id, r.set_name, r.number, c.finish, c.quantity,
               c.confidence, c.status, p.price_cents, p.source AS price_source, p.fetched_at AS price_fetched_at,
               c.batch_id, b.user_id, c.created_at, (p.card_ref_id IS NOT NULL) AS has_price_row
        FROM v_cards c JOIN v_batches b ON c.batch_id = b.batch_id JOIN v_refs r ON c.card_ref_id = r.id
        LEFT JOIN v_prices p ON p.card_ref_id = c.card_ref_id AND p.finish = c.finish
        WHERE c.status IN ('auto', 'validated', 'corrected')"""),
    "v_coef": ("", """
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS coef FROM embeddings"""),
    "v_tier_coef": ("v_coef", """
        SELECT vec_id, u.t AS t, CASE u.t
            WHEN 0 THEN coef
            WHEN 1 THEN list_transform(range(64), lambda i: coef[(i + 1) % 64 + 1] - coef[i + 1])
            ELSE list_concat(coef[16 * u.t - 31:16 * u.t],
                 list_transform(range(32), lambda i: coef[16 * u.t - 31 + (i + 1) % 32] - coef[16 * u.t - 31 + i])) END AS c
        FROM v_coef, (SELECT unnest(range(5)) AS t) u"""),
    "v_bits": ("v_tier_coef", """
        SELECT vec_id, t, CAST(list_sum(list_transform(range(1, 64), lambda i:
                 CASE WHEN c[i + 1] > med THEN (1::BIGINT << (63 - i)::INTEGER) ELSE 0 END)) AS BIGINT) AS bits
        FROM (SELECT vec_id, t, c, list_sort(c[2:64])[32] AS med FROM v_tier_coef)"""),
    "v_index": ("v_bits", f"""
        SELECT e.vec_id AS ref_id, ({_TIER_LIST})[t + 1] AS hash_type,
               CASE WHEN e.vec_id % 10 = 1 THEN xor(bits, {(1 << 62) | (1 << 61)}) ELSE bits END AS hash_bits
        FROM embeddings e JOIN v_bits b ON b.vec_id = e.vec_id - CASE WHEN e.vec_id % 10 = 1 THEN 1 ELSE 0 END"""),
    "v_probe": ("v_index", f"""
        SELECT ref_id AS item_id, hash_type,
               xor(hash_bits, CAST(coalesce(list_sum(list_transform(range(k), lambda j:
                   (1::BIGINT << (62 - (t + 3 * j) % 63)::INTEGER))), 0) AS BIGINT)) AS hash_bits
        FROM (SELECT *, (ref_id * (2 * t + 1) + t) % 19 AS k
              FROM (SELECT *, list_position({_TIER_LIST}, hash_type) - 1 AS t FROM v_index))"""),
    "v_knn": ("v_index v_probe", """
        SELECT item_id, hash_type, ref_id AS best_ref, dist AS best_dist, coalesce(second, 64) AS second_dist
        FROM (SELECT item_id, hash_type, ref_id, dist,
                     lead(dist) OVER (PARTITION BY item_id, hash_type ORDER BY dist, ref_id) AS second,
                     row_number() OVER (PARTITION BY item_id, hash_type ORDER BY dist, ref_id) AS rn
              FROM (SELECT p.item_id, p.hash_type, i.ref_id, min(bit_count(xor(p.hash_bits, i.hash_bits))) AS dist
                    FROM v_probe p JOIN v_index i ON p.hash_type = i.hash_type GROUP BY ALL))
        WHERE rn = 1"""),
    "v_match": ("v_knn", """
        SELECT item_id, ref_id, distance, margin, agreement, matched,
               CASE WHEN matched THEN greatest(0::DOUBLE, least(1::DOUBLE,
                    0.5::DOUBLE * (1 - distance::DOUBLE / 10) + 0.3::DOUBLE * least(margin / 10::DOUBLE, 1::DOUBLE)
                    + 0.2::DOUBLE * (agreement / 5::DOUBLE))) ELSE 0::DOUBLE END AS score
        FROM (SELECT *, agreement >= 3 AND distance <= 10 AND margin >= 4 AS matched
              FROM (SELECT k.item_id, f.best_ref AS ref_id, f.best_dist AS distance,
                           f.second_dist - f.best_dist AS margin,
                           count(*) FILTER (WHERE k.best_ref = f.best_ref AND k.best_dist <= 10) AS agreement
                    FROM v_knn k JOIN v_knn f ON f.item_id = k.item_id AND f.hash_type = 'full' GROUP BY ALL))"""),
    "v_turns": ("v_index v_probe", f"""
        SELECT item_id, alternative, distance FROM (
          SELECT item_id, alternative, min(bit_count(xor(a.bits, i.hash_bits))) AS distance FROM (
            SELECT item_id, alternative, CASE WHEN item_id % 4 = alternative THEN hash_bits ELSE xor(hash_bits, ({list(TURN_MASKS)})[alternative + 1]) END AS bits
            FROM v_probe, (SELECT unnest([0, 1, 2, 3]) AS alternative) WHERE hash_type = 'full') a
          CROSS JOIN (SELECT hash_bits FROM v_index WHERE hash_type = 'full') i GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY distance, alternative) = 1"""),
    "v_turned": ("v_probe v_turns", f"""
        SELECT p.item_id, p.hash_type, CASE WHEN p.item_id % 4 = t.alternative THEN p.hash_bits
                    ELSE xor(p.hash_bits, ({list(TURN_MASKS)})[t.alternative + 1]) END AS hash_bits
        FROM v_probe p JOIN v_turns t USING (item_id)"""),
    "v_vectors": ("v_coef", "SELECT vec_id AS point_id, vec_id // 2 AS ref_id, coef AS vector FROM v_coef"),
    "v_qvectors": ("v_coef", """
        SELECT vec_id AS item_id,
               list_transform(range(64), lambda i: coef[i + 1] + coef[(i + 1) % 64 + 1] * 0.5::DOUBLE) AS vector
        FROM v_coef"""),
    "v_methods": ("", f"""
        SELECT item_id, 'h' AS method, CASE WHEN n <= 5 THEN k END AS ref_id,
               CASE WHEN n > 5 THEN 0 WHEN hard THEN ((13*k+s) % 100) / 100::DOUBLE * 0.3::DOUBLE
                    ELSE ((13*k+s) % 100) / 100::DOUBLE END AS score,
               CAST(4 + k % 7 AS INTEGER) AS margin, CAST(3 + s % 3 AS INTEGER) AS agreement FROM base
        UNION ALL
        SELECT item_id, 'a', CASE WHEN hard THEN k + 20 + n ELSE k + n % 3 END,
               CASE WHEN hard THEN ((7*k+n) % 100) / 100::DOUBLE * 0.3::DOUBLE
                    ELSE ((7*k+n) % 100) / 100::DOUBLE END, NULL, NULL FROM base
        UNION ALL
        SELECT item_id, 'b', CASE WHEN hard THEN NULL WHEN s % 4 = 0 THEN k WHEN s % 4 = 1 THEN k + 1
                                  WHEN s % 4 = 2 THEN NULL ELSE k + 5 END,
               CASE WHEN hard THEN 0 WHEN s % 4 <= 1 THEN ((k+s) % 100) / 100::DOUBLE WHEN s % 4 = 2 THEN 0
                    ELSE ((3*k+s) % 100) / 100::DOUBLE END, NULL, NULL FROM base
        UNION ALL
        SELECT item_id, 'c', CASE WHEN hard AND n % 2 = 1 THEN NULL WHEN (k+n) % 4 = 0 THEN k
                                  WHEN (k+n) % 4 = 1 THEN k + 9 WHEN (k+n) % 4 = 2 THEN NULL ELSE k + 5 END,
               CASE WHEN hard AND n % 2 = 1 THEN 0 WHEN (k+n) % 4 <= 1 THEN ((k+3*s) % 100) / 100::DOUBLE
                    WHEN (k+n) % 4 = 2 THEN 0 ELSE ((11*k+s) % 100) / 100::DOUBLE END, NULL, NULL FROM base"""
                  .replace("FROM base", f"FROM (SELECT {_KEY} AS item_id, l_partkey AS k, l_linenumber AS n, "
                                        "l_suppkey AS s, l_partkey % 5 = 0 AS hard FROM lineitem)")),
    "v_wide": ("v_methods", """
        SELECT item_id,
               max(ref_id) FILTER (method = 'h') AS h_ref, max(score) FILTER (method = 'h') AS h_score,
               max(margin) FILTER (method = 'h') AS margin, max(agreement) FILTER (method = 'h') AS agreement,
               max(ref_id) FILTER (method = 'a') AS a_ref, max(score) FILTER (method = 'a') AS a_score,
               max(ref_id) FILTER (method = 'b') AS b_ref, max(score) FILTER (method = 'b') AS b_score,
               max(ref_id) FILTER (method = 'c') AS c_ref, max(score) FILTER (method = 'c') AS c_score
        FROM v_methods GROUP BY item_id"""),
    "v_lines": ("", """
        SELECT doc_id AS item_id, CASE WHEN pos = 1 THEN 'name' ELSE 'text' END AS band, pos - 1 AS pos, text,
               (length(text) % 50 + 50) / 100::DOUBLE AS conf
        FROM (SELECT doc_id, unnest(list_zip(range(1, len(parts) + 1), parts)) AS z, z[1] AS pos, z[2] AS text
              FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""),
}


# the ensemble's answers for the turned items
VIEWS["v_turned_knn"] = ("v_index v_turned", VIEWS["v_knn"][1].replace("v_probe", "v_turned"))
VIEWS["v_turned_match"] = ("v_turned_knn", VIEWS["v_match"][1].replace("v_knn", "v_turned_knn"))


def with_views(names: str, body: str) -> str:
    """``WITH`` every named view and what it needs, in dependency order, before the body."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        deps, sql = VIEWS[name]
        for dep in deps.split():
            if dep not in done:
                add(dep)
        done.setdefault(name, sql.strip())

    for name in names.split():
        add(name)
    if not done:
        return body.strip()
    head = ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in done.items())
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
