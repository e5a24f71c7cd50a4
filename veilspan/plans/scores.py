"""Queries of scoring, over labels made from the customers: a nation is a document, a segment a type. Two models report the
customers with faults that follow from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring as sc
from .registry import query, table

TYPES = ("PERSON", "COMPANY", "PHONE", "EMAIL", "DATE")
KIND_SQL = "CASE c_mktsegment WHEN 'BUILDING' THEN 'PERSON' WHEN 'AUTOMOBILE' THEN 'COMPANY' WHEN 'MACHINERY' THEN 'PHONE' WHEN 'HOUSEHOLD' THEN 'EMAIL' ELSE 'DATE' END"
GOLD_SQL = f"SELECT c_nationkey AS doc, 'l' || c_nationkey % 3 AS lang, c_name AS value, {KIND_SQL} AS type, c_custkey % 1000 AS pos, 1000 AS n_chars FROM customer"
PRED_SQL = " UNION ALL ".join(f"SELECT '{m}' AS model, c_nationkey AS doc, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) WHEN c_custkey % {k} = 1 THEN 'Mr ' || c_name ELSE c_name END AS value, CASE WHEN c_custkey % {k} = 2 THEN 'PERSON' ELSE {KIND_SQL} END AS type FROM customer WHERE c_custkey % {k} <> 0" for m, k in (("a", 7), ("b", 4)))
NORM = "lower(trim(regexp_replace(value, '\\s+', ' ', 'g')))"
G_SQL = f"SELECT DISTINCT doc, {NORM} AS v, type FROM ({GOLD_SQL})"
P_SQL = f"SELECT DISTINCT model, doc, {NORM} AS v, type FROM ({PRED_SQL})"
OUT_SQL = f"SELECT coalesce(g.model, p.model) AS model, coalesce(g.doc, p.doc) AS doc, coalesce(g.type, p.type) AS type, coalesce(g.v, p.v) AS v, CASE WHEN g.v IS NULL THEN 0 ELSE 1 END AS ig, CASE WHEN p.v IS NULL THEN 0 ELSE 1 END AS ip FROM (SELECT * FROM ({G_SQL}), (VALUES ('a'), ('b')) AS m(model)) g FULL JOIN ({P_SQL}) p ON g.model = p.model AND g.doc = p.doc AND g.type = p.type AND g.v = p.v"
DOC_SQL = f"SELECT model, doc, sum(ig * ip)::BIGINT AS tp, sum(ip)::BIGINT AS n_pred, sum(ig)::BIGINT AS n_gold FROM ({OUT_SQL}) GROUP BY model, doc"
PRF = "round(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END, 4) AS prec, round(CASE WHEN n_gold > 0 THEN tp / n_gold ELSE 0 END, 4) AS recall, round(CASE WHEN n_pred + n_gold > 0 THEN 2.0 * tp / (n_pred + n_gold) ELSE 0 END, 4) AS f1"


def tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer")
    kind, seg = F.lit("DATE"), F.col("c_mktsegment")
    for name, to in (("BUILDING", "PERSON"), ("AUTOMOBILE", "COMPANY"), ("MACHINERY", "PHONE"), ("HOUSEHOLD", "EMAIL")):
        kind = F.when(seg == name, to).otherwise(kind)
    key = F.col("c_custkey")
    gold = c.select(F.col("c_nationkey").alias("doc"), F.concat(F.lit("l"), (F.col("c_nationkey") % 3).cast("string")).alias("lang"), F.col("c_name").alias("value"), kind.alias("type"), (key % 1000).alias("pos"), F.lit(1000).alias("n_chars"))
    parts = [c.where(key % k != 0).select(F.lit(m).alias("model"), F.col("c_nationkey").alias("doc"), F.when(key % 5 == 0, F.upper("c_name")).when(key % k == 1, F.concat(F.lit("Mr "), "c_name")).otherwise(F.col("c_name")).alias("value"), F.when(key % k == 2, "PERSON").otherwise(kind).alias("type")) for m, k in (("a", 7), ("b", 4))]
    return gold, parts[0].unionByName(parts[1])


def scored(name, sql):
    def put(f):
        query(name, sql)(lambda spark, sf: f(*tables(spark, sf)))
        return f

    return put


scored("j19_strict_matches", f"SELECT p.model, p.doc, p.v, p.type FROM ({P_SQL}) p JOIN ({G_SQL}) g ON p.doc = g.doc AND p.v = g.v AND p.type = g.type")(sc.strict_matches)
scored("u04_missed", f"SELECT model, doc, v, type FROM ({OUT_SQL}) WHERE ip = 0")(sc.missed)
scored("a10_doc_scores", f"SELECT d.*, 0::BIGINT AS n_decoys FROM ({DOC_SQL}) d")(sc.doc_scores)
scored("a11_micro_scores", f"SELECT model, tp, n_pred, n_gold, {PRF} FROM (SELECT model, sum(tp)::BIGINT AS tp, sum(n_pred)::BIGINT AS n_pred, sum(n_gold)::BIGINT AS n_gold FROM ({DOC_SQL}) GROUP BY model)")(lambda g, p: sc.micro(sc.doc_scores(g, p), "model"))
scored("a12_per_type_groups", f"SELECT model, scope, tp, n_pred, n_gold, {PRF} FROM (SELECT model, CASE grouping_id(type) WHEN 0 THEN type ELSE 'all' END AS scope, sum(ig * ip)::BIGINT AS tp, sum(ip)::BIGINT AS n_pred, sum(ig)::BIGINT AS n_gold FROM ({OUT_SQL}) GROUP BY GROUPING SETS ((model, type), (model)) UNION ALL SELECT model, 'critical', sum(ig * ip)::BIGINT, sum(ip)::BIGINT, sum(ig)::BIGINT FROM ({OUT_SQL}) WHERE type <> 'DATE' GROUP BY model)")(sc.by_type)
scored("a14_over_extraction_rates", f"SELECT p.model, p.type, count(*) AS n_pred, count(*) FILTER (g.v IS NULL) AS extra, round(count(*) FILTER (g.v IS NULL) / count(*), 4) AS rate FROM ({P_SQL}) p LEFT JOIN (SELECT DISTINCT doc, v FROM ({G_SQL})) g ON p.doc = g.doc AND p.v = g.v GROUP BY ALL")(sc.over_extraction)
scored("a15_confusions", f"SELECT p.model, g.type AS gold, p.type AS pred, count(*) AS n FROM ({P_SQL}) p JOIN ({G_SQL}) g ON p.doc = g.doc AND p.v = g.v GROUP BY ALL")(sc.confusion)
scored("a18_head_tail", f"SELECT m.model, CASE WHEN g.pos <= 750 THEN 'head' ELSE 'tail' END AS part, count(p.v) AS tp, count(*) AS n, round(count(p.v) / count(*), 4) AS recall FROM (SELECT *, {NORM} AS v FROM ({GOLD_SQL})) g, (VALUES ('a'), ('b')) AS m(model) LEFT JOIN ({P_SQL}) p ON p.model = m.model AND p.doc = g.doc AND p.type = g.type AND p.v = g.v GROUP BY ALL")(sc.head_tail_recall)
scored("a20_inventory", f"SELECT lang, type, count(*) AS n, count(DISTINCT doc) AS n_docs FROM ({GOLD_SQL}) GROUP BY ALL")(lambda g, p: sc.inventory(g))
scored("f23_position_buckets", f"SELECT doc, value, CASE WHEN pos < 500 THEN 'head' WHEN pos <= 750 THEN 'mid' ELSE 'tail' END AS bucket FROM ({GOLD_SQL})")(lambda g, p: sc.position_bucket(g))
scored("j20_lenient_matches", f"SELECT p.model, p.doc, p.type, g.v AS gold, p.v AS pred FROM ({P_SQL}) p JOIN ({G_SQL}) g ON p.doc = g.doc AND p.type = g.type AND (p.v = g.v OR p.v = 'mr ' || g.v)")(sc.lenient_matches)


@query("a13_tiers", "SELECT 'm' AS model, coalesce(lang, 'all') AS lang, tier, count(*) AS n FROM (SELECT lang, CASE WHEN n_chars < 500 THEN 'clean' ELSE 'repaired' END AS tier FROM documents) GROUP BY GROUPING SETS ((lang, tier), (tier))")
def tiers(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("m").alias("model"), "lang", F.when(F.col("n_chars") < 500, "clean").otherwise("repaired").alias("tier"))
    return sc.tier_histogram(d)


@query("a16_costs", "SELECT event_type AS model, count(*) AS n, round(avg(value), 4) AS mean_latency, round(sum(value), 4) AS total_latency, round(sum(user_id) / sum(value), 4) AS tok_per_s FROM events GROUP BY event_type")
def costs(spark, sf):
    return sc.costs(table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("value").alias("latency_s"), F.col("user_id").alias("completion_tokens")))


@query("a17_composites", f"WITH m AS (SELECT model, {PRF} FROM (SELECT model, sum(tp) AS tp, sum(n_pred) AS n_pred, sum(n_gold) AS n_gold FROM ({DOC_SQL}) GROUP BY model)) SELECT model, round(100 * (0.9 * f1 + (1 - 0.9) * CASE model WHEN 'a' THEN 1.0 ELSE 0.5 END), 4) AS composite, array_to_string(list_filter([CASE WHEN recall < 0.7 THEN 'recall' END, CASE WHEN prec < 0.5 THEN 'precision' END], lambda x: x IS NOT NULL), ',') AS failed FROM m")
def composites(spark, sf):
    g, p = tables(spark, sf)
    m = sc.micro(sc.doc_scores(g, p), "model").withColumn("tok_per_s", F.when(F.col("model") == "a", 20.0).otherwise(10.0))
    return sc.composite(m, [("recall", "recall", 0.7), ("precision", "prec", 0.5)])


@query("a24_model_summaries", f"WITH m AS (SELECT model, {PRF} FROM (SELECT model, sum(tp) AS tp, sum(n_pred) AS n_pred, sum(n_gold) AS n_gold FROM ({DOC_SQL}) GROUP BY model)) SELECT model, f1, recall, CASE model WHEN 'a' THEN 9.2 ELSE 0.0 END AS gb, CASE model WHEN 'a' THEN '16GB' ELSE '8GB' END AS tier, CASE WHEN recall >= 0.9 THEN 'fit' ELSE 'rejected' END AS verdict FROM m")
def summaries(spark, sf):
    g, p = tables(spark, sf)
    return sc.model_summary(sc.micro(sc.doc_scores(g, p), "model"), spark.createDataFrame([("a", 9.2), ("z", 1.0)], "model string, gb double"))


@query("f18_gold_problems", "SELECT doc_id AS doc, lang AS value, 'type' AS problem FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, lang, 'not verbatim' FROM documents WHERE lang IS NOT NULL AND NOT coalesce(contains(text, lang), false) UNION ALL SELECT doc_id, lang, 'duplicate' FROM documents WHERE lang IS NOT NULL AND doc_id % 10 = 0 UNION ALL SELECT doc_id, lang, 'decoy' FROM documents WHERE lang = 'en' AND doc_id % 3 = 0")
def gold_problems(spark, sf):
    d = table(spark, sf, "documents")
    one = d.where("lang is not null").select(F.col("doc_id").alias("doc"), F.col("lang").alias("value"), F.lit("LANG").alias("type"))
    gold = one.unionByName(one.where("doc % 10 = 0"))
    return sc.gold_problems(gold, d.select(F.col("doc_id").alias("doc"), "text"), one.where("value = 'en' and doc % 3 = 0"), TYPES)
