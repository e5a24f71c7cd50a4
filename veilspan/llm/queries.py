"""The thin contract queries: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact, jaccard, langid, mixing, oracles, suffixes, tokenfile, urlblock, warc

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    c = decontaminate.contamination(F.col("text"), _t(spark, sf, "benchmark"))
    x = _t(spark, sf, "documents").select("doc_id", c.alias("c"))
    items = F.array_join(F.sort_array(F.transform("c.items", lambda i: i.cast("string"))), ",")
    return x.select("doc_id", "c.n_words", "c.n_hit", F.size("c.items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("c.n_hit") > 0).alias("contaminated"))


def op2_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    d = warc.derivatives(warc.parse(warc.responses(_t(spark, sf, "pages"))))
    return d.withColumn("record_length", F.octet_length(warc.head()) + F.col("content_length") + 4).withColumnRenamed("id", "page_id")


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    g = exact.exact_groups(_t(spark, sf, "documents"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urlblock.judge(_t(spark, sf, "pages"), RULES)


def op5_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    m = mixing.pareto_mix(_t(spark, sf, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", F.col("target").cast("double"), (F.col("copies") * F.col("size")).alias("taken"))


def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = suffixes.dedup(_t(spark, sf, "documents"))
    return d.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    g = jaccard.near_groups(_t(spark, sf, "documents"), k=4, num=85, den=100)
    return g.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_chat_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    x = chat.render(*chat.maximal(_t(spark, sf, "conversations")))
    return x.select(F.col("conv").alias("conv_id"), F.col("n").alias("n_turns"), "copies", "rendered")


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.fit(docs.where(fold != 2))
    out = docs.select("doc_id", (fold == 2).alias("held_out"), langid.predict(model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.ambiguous").alias("ambiguous"))


def op10_token_file(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    table = tokenfile.write_tokens(_t(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_tokens(table).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_warc_derivatives, op3_exact_dedup, op4_url_filter, op5_source_mix, op6_suffix_dedup, op7_ngram_jaccard, op8_chat_snapshots, op9_language_id, op10_token_file)}
ORACLES = {"op1_decontaminate": oracles.OP1, "op2_warc_derivatives": oracles.OP2, "op3_exact_dedup": oracles.OP3, "op4_url_filter": oracles.op4(RULES), "op8_chat_snapshots": oracles.OP8}
