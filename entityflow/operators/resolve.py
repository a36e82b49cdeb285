"""Resolve read text to a reference entity: number, then name similarity, then unique name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityflow.functions.joins import left_join_sparse
from entityflow.functions.text import (
    PROMO_NUMBER, SLASH_NUMBER, clean_name, content_key, name_ratio, parse_number, split_number,
)

MIN_RATIO = 0.75


def read_regions(lines: DataFrame) -> DataFrame:
    """Text lines (item, band, pos, text, conf) to (item, name, number, mean_conf).

    The surest line of the name band names the item; the number is searched in the lines of the text band joined
    by spaces; the mean runs over that one name line and all text lines.

    A printed number has three parts at most, so it spans at most three lines that are not blank: each line is
    searched together with the next two for a match that begins in it, and nothing has to be joined as a whole.
    """
    name, body = F.col("band") == "name", F.col("band") == "text"
    blank = F.regexp_like("text", F.lit(r"^\s*$"))
    along = Window.partitionBy("item_id", "_searched").orderBy("pos")
    three = F.concat_ws(" ", "text", F.lead("text", 1).over(along), F.lead("text", 2).over(along))
    windowed = lines.withColumn("_searched", body & ~blank).withColumn("_three", three)

    def begins(pattern: str) -> Column:
        at = F.regexp_instr(F.col("_three"), F.lit(pattern))
        return F.col("_searched") & (at > 0) & (at <= F.length("text"))

    def first(pattern: str) -> Column:
        return F.min_by("_three", F.when(begins(pattern), F.col("pos")))

    read = windowed.groupBy("item_id").agg(
        F.max_by(F.struct("text", "conf"), F.when(name, F.struct(F.col("conf"), -F.col("pos")))).alias("best"),
        first(SLASH_NUMBER).alias("slash"), first(PROMO_NUMBER).alias("promo"),
        F.sum(F.when(body, F.col("conf"))).alias("conf_sum"), F.count_if(body).alias("conf_n"),
    )
    total = F.coalesce("conf_sum", F.lit(0.0)) + F.coalesce("best.conf", F.lit(0.0))
    count = F.col("conf_n") + F.when(F.col("best").isNotNull(), 1).otherwise(0)
    cleaned = clean_name(F.col("best.text"))
    return read.select(
        "item_id", F.when(cleaned != "", cleaned).alias("name"),
        F.coalesce(parse_number(F.col("slash")), F.regexp_extract("promo", PROMO_NUMBER, 1)).alias("number"),
        F.when(count > 0, total / count).otherwise(F.lit(0.0)).alias("mean_conf"),
    )


def resolve(observed: DataFrame, refs: DataFrame) -> DataFrame:
    """(item, name, number) to (item, ref_id, exactness).

    1.0 for the only entity with that number and total; 0.9 for the most similar name among several, if similar
    enough; 0.6 for the only entity of that exact name; else no entity and 0. Equal similarity: lowest id.
    """
    num, total = split_number(F.col("number"))
    asked = observed.select(
        "item_id", F.when(F.col("name") != "", F.lower("name")).alias("_name"), num.alias("_num"), total.alias("_total")
    )
    known = refs.select(F.col("id"), F.lower("name").alias("ref_name"), F.col("number").alias("_num"), F.col("printed_total").alias("_total"))
    by_number = known.groupBy("_num", "_total").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_only"))
    by_name = known.groupBy(F.col("ref_name").alias("_name")).agg(F.count(F.lit(1)).alias("_same"), F.min("id").alias("_named"))

    numbered = left_join_sparse(asked, by_number, ["_num", "_total"], "item_id")
    # similarity is asked once per distinct question, and only where the number is ambiguous
    question = ["_num", "_total", "_name"]
    questions = numbered.where((F.col("_n") > 1) & F.col("_name").isNotNull()).select(*question).distinct()
    names = known.groupBy("_num", "_total", "ref_name").agg(F.min("id").alias("id"))
    # nothing beats the very name, so only questions without it are compared with the names of their number
    exact = names.select("_num", "_total", F.col("ref_name").alias("_name"), F.col("id").alias("_exact"))
    asked_names = questions.join(exact, question, "left")
    la, lb = F.length("_name"), F.length(F.coalesce("ref_name", F.lit("")))
    possible = F.least(la, lb) * 2 >= (la + lb) * MIN_RATIO  # no ratio exceeds this bound
    scored = asked_names.where(F.col("_exact").isNull()).join(names, ["_num", "_total"]).where(possible).withColumn(
        "_ratio", name_ratio(F.col("_name"), F.col("ref_name"))
    )
    near = scored.where(F.col("_ratio") >= MIN_RATIO).groupBy(*question).agg(
        F.min_by("id", F.struct(-F.col("_ratio"), F.col("id"))).alias("_similar")
    )
    similar = near.unionByName(
        asked_names.where(F.col("_exact").isNotNull()).select(*question, F.col("_exact").alias("_similar"))
    )
    found = left_join_sparse(left_join_sparse(numbered, similar, question, "item_id"), by_name, ["_name"], "item_id")
    unique = F.when(F.col("_n") == 1, F.col("_only"))
    alone = F.when(F.col("_same") == 1, F.col("_named"))
    return found.select(
        "item_id", F.coalesce(unique, "_similar", alone).alias("ref_id"),
        F.when(unique.isNotNull(), 1.0).when(F.col("_similar").isNotNull(), 0.9)
        .when(alone.isNotNull(), 0.6).otherwise(0.0).alias("exactness"),
    )


def text_match(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """Method ``b``: resolved entity with mean reading confidence times exactness."""
    read = read_regions(lines)
    return resolve(read, refs).join(read.select("item_id", "mean_conf"), "item_id").select(
        "item_id", "ref_id", (F.col("mean_conf") * F.col("exactness")).alias("score")
    )


def cache_split(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the stored response, misses) by content hash; items need ``content``."""
    keyed = items.withColumn("content_key", content_key(F.col("content")))
    hits = keyed.join(cache.select("content_key", "response"), "content_key")
    return hits, keyed.join(cache.select("content_key"), "content_key", "left_anti")


def cache_insert(cache: DataFrame, answers: DataFrame, order: str) -> DataFrame:
    """Cache plus the first answer per new key; an answer that was not understood (NULL) is never stored."""
    usable = answers.where(F.col("response").isNotNull())
    return cache.unionByName(insert_ignore(cache, usable, ["content_key"], order).select(*cache.columns))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows that would be inserted: keys not in the target, the first by ``order`` of each."""
    new = rows.join(target.select(*keys), keys, "left_anti")
    rest = [c for c in new.columns if c not in keys]
    return new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")
