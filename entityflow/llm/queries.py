"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityflow.llm import (
    chat, fim, langid, licences, lines, mixing, packing, planes, quality, revisits, search, simhash, tokenfile,
)
from entityflow.llm.common import row_key, table
from entityflow.llm.oracles import ORACLES
from entityflow.sources.storage import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["QUERIES", "ORACLES"]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out), F.col("text"), F.col("lang"))
    labelled = langid.identify(docs, F.col("text"), model, doc_id=F.col("doc_id"), held_out=held_out)
    return labelled.select("doc_id", "held_out", F.col("lang").alias("lang_pred"), "score", F.size("spans").alias("n_spans"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, F.col("text"), F.col("doc_id"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is captured in full, and its address is asked again twice: a minute to three days later, and, under a
    variant with a tracking parameter, a day off to either side. Validators are right, weak, stale or absent by turns."""
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.left(F.sha2(F.coalesce("html", F.lit("")), 256), F.lit(16)), F.lit('"'))
    dated = F.concat(F.lit("day "), p % 28)
    stored = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), dated,
        F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Date"), (p * 60).cast("string"))
    turn = p % 7
    sent = F.when(turn == 0, F.lit('"stale"')).when(turn == 1, F.lit(None)).when(turn == 2, F.concat(F.lit("W/"), tag)).when(
        turn == 3, F.lit(None)).otherwise(tag)
    since = F.when(turn.isin(1, 2), dated)

    def revisit(at: Column) -> Column:
        given = F.array(
            F.struct(F.lit("etag").alias("k"), sent.alias("v")), F.struct(F.lit("last-modified").alias("k"), since.alias("v")),
            F.struct(F.lit("date").alias("k"), at.cast("string").alias("v")),
            F.struct(F.lit("Content-Length").alias("k"), F.lit("0").alias("v")))
        return F.map_from_entries(F.filter(given, lambda e: e["v"].isNotNull()))

    soon, off = p * 60 + 60 + 86400 * (p % 4), p * 60 + 86400 * (1 - 2 * (p % 2))
    url = F.col("url")
    captures = F.array(
        F.struct((3 * p).alias("record_id"), F.lit("response").alias("kind"), url.alias("url"), (p * 60).alias("captured_at"),
                 F.lit(200).alias("status"), stored.alias("headers")),
        F.struct((3 * p + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(url, F.lit("#again")).alias("url"),
                 soon.alias("captured_at"), F.lit(304).alias("status"), revisit(soon).alias("headers")),
        F.struct((3 * p + 2).alias("record_id"), F.lit("revisit").alias("kind"),
                 F.concat(F.regexp_replace(url, "[?#].*$", ""), F.lit("?utm_source=x")).alias("url"),
                 off.alias("captured_at"), F.lit(304).alias("status"), revisit(off).alias("headers")),
    )
    records = table(spark, sf_dir, "pages").select(F.explode(captures).alias("c")).select("c.*")
    written = F.transform("headers", lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return revisits.resolve_revisits(records).select(
        F.col("row.record_id").alias("record_id"), "url_key", "response_id", "verdict",
        F.array_join(written, "\n").alias("headers"))


@query
def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = row_key(F.col("row.doc_id"), F.col("row.text"))
    whole = licences.scan(docs).select(F.col("row.doc_id").alias("doc_id"), "digest", "licence", *[c.alias(k) for k, c in key.items()])
    by_line = licences.scan_lines(docs, **row_key(F.col("doc_id"), F.col("text")))
    return whole.join(by_line, list(key), "left").select(
        "doc_id", "digest", "licence", F.coalesce(F.array_join("notices", ","), F.lit("")).alias("notices"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = simhash.near_duplicates(docs, F.col("text"), radius=4, shingle=4, doc_id=F.col("doc_id"))
    return groups.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = chat.format_conversations(rows).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("segments")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality.judge(docs, labels, keep_rows=False)
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"),
    )


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.takes(table(spark, sf_dir, "documents"))
    return taken.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_recurring(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_dropped_lines", "n_dropped_words", F.length("text").cast("long").alias("kept_chars"),
        F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search.top_k(rows, F.col("vec_id"), search.scaled(F.col("embedding")), F.col("vec_id") % 50 == 0)


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seed = F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    done = fim.fill_in_middle(docs, F.col("text"), seed, doc_id=F.col("doc_id"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query
def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    done = planes.kmeans(rows, F.col("vec_id"), F.col("embedding"))
    told = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return done.withColumn("centroid_sha256", told).drop("centroid")


@query
def op13_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "tokens")
    tokenfile.write_tokens(docs, F.col("text"), F.col("doc_id"), public_tokenizers.path("word_bpe_49k.json"), path)
    return tokenfile.read_documents(spark, path)
