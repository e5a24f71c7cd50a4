"""Minting replacements, splicing them in, and restoring: one mapping per scope (document or session)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decode_markdown_token, sanitize_type

TOKEN = r"\{[A-Z0-9]+_[0-9]+\}"


def reserved(docs: DataFrame, scope: str, text: str = "text") -> DataFrame:
    """Numbers already spelled as {TYPE_N} in a scope, raw or escaped: (scope, stype, taken)."""
    t = docs.where(F.col(text).contains("{")).select(scope, F.explode(F.regexp_extract_all(decode_markdown_token(F.col(text)), F.lit(TOKEN), F.lit(0))).alias("tok"))
    t = t.select(scope, F.regexp_extract("tok", r"\{([A-Z0-9]+)_", 1).alias("stype"), F.regexp_extract("tok", r"_([0-9]+)\}", 1).cast("int").alias("n"))
    return t.groupBy(scope, "stype").agg(F.collect_set("n").alias("taken"))


def mint_tokens(spans: DataFrame, docs: DataFrame, scope: str = "doc_id", order: list[str] = ("start",)) -> DataFrame:
    """(scope, surface, type, token): one token per distinct surface, numbered by first appearance in
    each sanitized type, skipping reserved numbers. Two shuffles on the scope, the window over distinct surfaces."""
    first = spans.groupBy(scope, F.col("text").alias("surface")).agg(F.min(F.struct(*order)).alias("at"), F.min_by("type", F.struct(*order)).alias("type"))
    first = first.withColumn("stype", sanitize_type(F.col("type")))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy(scope, "stype").orderBy("at", "surface")))
    x = first.join(reserved(docs, scope), [scope, "stype"], "left")
    from .sessions import nth_free

    n = nth_free(F.col("k"), F.col("taken"))
    return x.select(scope, "surface", "type", F.concat(F.lit("{"), "stype", F.lit("_"), n.cast("string"), F.lit("}")).alias("token"))


def splice(docs: DataFrame, sites: DataFrame, key: str = "doc_id", text: str = "text", replacement: str = "token") -> DataFrame:
    """Documents with disjoint sites (key, start, end, replacement) put in, left to right: gaps and replacements are
    joined once. Documents without sites, null texts among them, come back as they are; `tokenized` is added."""
    s = sites.groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_set(F.struct("start", "end", F.col(replacement).alias("r")))).alias("__sites"))
    x = docs.join(s.hint("merge"), F.col(key) == F.col("__key"), "left")  # as many rows as documents: not for the driver to broadcast
    t, spans = F.col(text), F.col("__sites")
    upto = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    parts = F.transform(spans, lambda p, i: F.concat(F.substring(t, upto(i) + 1, p["start"] - upto(i)), p["r"]))
    done = F.concat(F.array_join(parts, ""), F.substring(t, upto(F.size(spans)) + 1, F.length(t)))
    return x.withColumn("tokenized", F.when(spans.isNull(), t).otherwise(done)).drop("__sites", "__key")


def restore_tokens(docs: DataFrame, mapping: DataFrame, key: str = "doc_id", edited: str = "tokenized") -> DataFrame:
    """One pass over decoded tokens; values are never rescanned; tokens without a value stay and are
    reported as orphans, first seen first. mapping: (key, token, surface)."""
    m = mapping.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "surface"))).alias("map"))
    x = docs.join(m, key, "left").withColumn("__d", decode_markdown_token(F.col(edited)))
    gaps, toks = F.split("__d", TOKEN, -1), F.regexp_extract_all("__d", F.lit(TOKEN), F.lit(0))
    look = lambda k: F.try_element_at("map", k)
    body = F.array_join(F.zip_with(gaps, toks, lambda g, k: F.concat(g, F.when(k.isNull(), "").otherwise(F.coalesce(look(k), k)))), "")
    x = x.withColumn("restored", body).withColumn("restored_count", F.size(F.filter(toks, lambda k: look(k).isNotNull())))
    return x.withColumn("orphans", F.array_distinct(F.filter(toks, lambda k: look(k).isNull()))).drop("map", "__d")


def collision_keys(masks: DataFrame, scope: str = "doc_id") -> DataFrame:
    """Equal masks of one scope keep distinct keys: mask, mask#2, ..."""
    k = F.row_number().over(Window.partitionBy(scope, "mask").orderBy("surface"))
    return masks.withColumn("key", F.when(k == 1, F.col("mask")).otherwise(F.concat("mask", F.lit("#"), k.cast("string"))))
