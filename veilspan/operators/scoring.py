"""Scoring predictions against gold labels: joins, counts, rates and gates over whole tables.

gold: (model-free) doc, lang, value, type, and pos (first position), n_chars where heads and tails are told apart;
pred: model, doc, value, type. Values compare by norm() unless said otherwise.

Edge cases: null or empty values are dropped; repeated (doc, value, type) count once; a model without predictions isn't
listed unless it is in `models`; rates over nothing are 0; empty inputs give empty results. Extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITICAL = ("PERSON", "COMPANY", "PHONE", "EMAIL", "NATIONAL_ID", "BANK_ACCOUNT", "ADDRESS")


def norm(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def keyed(df: DataFrame, *by: str) -> DataFrame:
    """Distinct (by..., v, type) rows."""
    return df.select(*by, norm(F.col("value")).alias("v"), "type").where("v <> ''").distinct()


def for_each_model(df: DataFrame, pred: DataFrame) -> DataFrame:
    """df repeated for each model of the predictions, a handful of names."""
    names = [r.model for r in pred.select("model").distinct().orderBy("model").collect()]
    kind = pred.schema["model"].dataType.simpleString()
    return df.withColumn("model", F.explode(F.array(*[F.lit(n) for n in names]).cast(f"array<{kind}>")))


def strict_matches(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(model, doc, v, type) in both."""
    return keyed(pred, "model", "doc").join(keyed(gold, "doc"), ["doc", "v", "type"]).select("model", "doc", "v", "type")


def missed(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(model, doc, v, type) of gold that a model lacks."""
    return for_each_model(keyed(gold, "doc"), pred).join(keyed(pred, "model", "doc"), ["model", "doc", "v", "type"], "left_anti").select("model", "doc", "v", "type")


def lenient_pairs(gold: list[str], pred: list[str]) -> list[tuple[int, int]]:
    """J20 for one (model, doc, type): one to one, the longest gold value first: an equal value, else the first left that
    contains or is contained at half the length or more."""
    free, out = list(range(len(pred))), []
    for g in sorted(range(len(gold)), key=lambda k: (-len(gold[k]), gold[k])):
        v = gold[g]
        hit = next((p for p in free if pred[p] == v), None)
        if hit is None:
            hit = next((p for p in free if (v in pred[p] or pred[p] in v) and 2 * min(len(v), len(pred[p])) >= max(len(v), len(pred[p]))), None)
        if hit is not None:
            free.remove(hit)
            out.append((g, hit))
    return out


def lenient_matches(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(model, doc, type, gold, pred): a greedy one-to-one join by containment; work is split by (model, doc, type)."""
    p = keyed(pred, "model", "doc").groupBy("model", "doc", "type").agg(F.sort_array(F.collect_list("v")).alias("ps"))
    g = keyed(gold, "doc").groupBy("doc", "type").agg(F.sort_array(F.collect_list("v")).alias("gs"))
    x = p.join(g, ["doc", "type"])

    def run(batches):
        for batch in batches:
            rows = []
            for i, (gs, ps) in enumerate(zip(batch.column("gs").to_pylist(), batch.column("ps").to_pylist())):
                rows += [(i, gs[a], ps[b]) for a, b in lenient_pairs(gs, ps)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("model", "doc", "type")), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["model", "doc", "type", "gold", "pred"])

    kinds = {f.name: f.dataType.simpleString() for f in x.schema}
    return x.select("model", "doc", "type", "gs", "ps").mapInArrow(run, f"model {kinds['model']}, doc {kinds['doc']}, type string, gold string, pred string")


def outcomes(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(model, doc, type, v, in_gold, in_pred): the full outer join of gold and predictions, for each model."""
    g = for_each_model(keyed(gold, "doc"), pred).withColumn("in_gold", F.lit(1))
    p = keyed(pred, "model", "doc").withColumn("in_pred", F.lit(1))
    return g.join(p, ["model", "doc", "type", "v"], "full").na.fill(0, ["in_gold", "in_pred"])


def doc_scores(gold: DataFrame, pred: DataFrame, decoys: DataFrame | None = None) -> DataFrame:
    """A10: (model, doc, tp, n_pred, n_gold, n_decoys) of every document; decoys: (doc, value) that must not be predicted."""
    out = outcomes(gold, pred).groupBy("model", "doc").agg(F.sum(F.col("in_gold") * F.col("in_pred")).alias("tp"), F.sum("in_pred").alias("n_pred"), F.sum("in_gold").alias("n_gold"))
    if decoys is None:
        return out.withColumn("n_decoys", F.lit(0).cast("bigint"))
    bait = decoys.select("doc", norm(F.col("value")).alias("v")).distinct()
    took = keyed(pred, "model", "doc").select("model", "doc", "v").distinct().join(bait, ["doc", "v"]).groupBy("model", "doc").agg(F.count("*").alias("n_decoys"))
    return out.join(took, ["model", "doc"], "left").na.fill(0, ["n_decoys"])


def _prf(tp: Column, pred: Column, gold: Column) -> list[Column]:
    p = F.when(pred > 0, tp / pred).otherwise(F.lit(0.0))
    r = F.when(gold > 0, tp / gold).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [F.round(p, 4).alias("prec"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1")]


def micro(scores: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 of summed counts, to four places; nothing over nothing is 0."""
    s = scores.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_gold")])
    return s.select(*by, "tp", "n_pred", "n_gold", *_prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


def by_type(gold: DataFrame, pred: DataFrame, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    """Micro scores of each type, of the critical ones together ('critical') and of all ('all'), by grouping sets."""
    x = outcomes(gold, pred).withColumn("critical", F.col("type").isin(*critical))
    x = x.withColumn("scope", F.explode(F.filter(F.array(F.col("type"), F.lit("all"), F.when(F.col("critical"), "critical")), lambda s: s.isNotNull())))
    s = x.groupBy("model", "scope").agg(F.sum(F.col("in_gold") * F.col("in_pred")).alias("tp"), F.sum("in_pred").alias("n_pred"), F.sum("in_gold").alias("n_gold"))
    return micro(s, "model", "scope")


def tier_histogram(parsed: DataFrame) -> DataFrame:
    """(model, lang, tier, n) of parse tiers, each language and over all ('all')."""
    return parsed.withColumn("lang", F.explode(F.array("lang", F.lit("all")))).groupBy("model", "lang", "tier").agg(F.count("*").alias("n"))


def over_extraction(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(model, type, n_pred, extra, rate): predictions whose value no gold entry of the document has."""
    g = gold.select("doc", norm(F.col("value")).alias("v")).distinct().withColumn("hit", F.lit(1))
    x = keyed(pred, "model", "doc").join(g, ["doc", "v"], "left")
    s = x.groupBy("model", "type").agg(F.count("*").alias("n_pred"), F.count_if(F.col("hit").isNull()).alias("extra"))
    return s.withColumn("rate", F.round(F.col("extra") / F.col("n_pred"), 4))


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(model, gold, pred, n): types of equal values."""
    g = keyed(gold, "doc").select("doc", "v", F.col("type").alias("gold"))
    return keyed(pred, "model", "doc").select("model", "doc", "v", F.col("type").alias("pred")).join(g, ["doc", "v"]).groupBy("model", "gold", "pred").agg(F.count("*").alias("n"))


def costs(runs: DataFrame) -> DataFrame:
    """(model, n, mean_latency, total_latency, tok_per_s) of runs (model, latency_s, completion_tokens)."""
    s = runs.groupBy("model").agg(F.count("*").alias("n"), F.avg("latency_s").alias("m"), F.sum("latency_s").alias("t"), F.sum("completion_tokens").alias("c"))
    return s.select("model", "n", F.round("m", 4).alias("mean_latency"), F.round("t", 4).alias("total_latency"), F.round(F.when(F.col("t") > 0, F.col("c") / F.col("t")).otherwise(0.0), 4).alias("tok_per_s"))


def composite(summary: DataFrame, gates: list[tuple[str, str, float]], weight: float = 0.9) -> DataFrame:
    """(model, composite, failed): F1 against throughput relative to the best model; failed: the gates (name,
    column, least value) that aren't met. One row a model: a small window."""
    best = F.max("tok_per_s").over(Window.partitionBy())
    score = weight * F.col("f1") + (1 - weight) * F.when(best > 0, F.col("tok_per_s") / best).otherwise(0.0)
    failed = F.filter(F.array(*[F.when(F.col(c) < least, F.lit(name)) for name, c, least in gates]), lambda g: g.isNotNull())
    return summary.select("model", F.round(100 * score, 4).alias("composite"), F.array_join(failed, ",").alias("failed"))


def head_tail_recall(gold: DataFrame, pred: DataFrame, cut: float = 0.75) -> DataFrame:
    """(model, part, tp, n, recall): gold (doc, value, type, pos, n_chars) first seen in the first `cut` of the text,
    or behind it."""
    g = gold.select("doc", norm(F.col("value")).alias("v"), "type", F.when(F.col("pos") <= cut * F.col("n_chars"), "head").otherwise("tail").alias("part")).dropDuplicates(["doc", "v", "type"])
    x = for_each_model(g, pred).join(keyed(pred, "model", "doc").withColumn("hit", F.lit(1)), ["model", "doc", "v", "type"], "left")
    s = x.groupBy("model", "part").agg(F.count("hit").alias("tp"), F.count("*").alias("n"))
    return s.withColumn("recall", F.round(F.col("tp") / F.col("n"), 4))


def inventory(gold: DataFrame) -> DataFrame:
    """(lang, type, n, n_docs)."""
    return gold.groupBy("lang", "type").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("n_docs"))


def gold_problems(gold: DataFrame, docs: DataFrame, decoys: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(doc, value, problem): gold values that aren't in their text, have no allowed type, occur twice, or are decoys."""
    n = gold.groupBy("doc", "value", "type").agg(F.count("*").alias("n"))
    x = n.join(docs.select("doc", "text"), "doc", "left").join(decoys.select("doc", "value", F.lit(1).alias("bait")).distinct(), ["doc", "value"], "left")
    found = F.array(F.when(F.coalesce(F.instr(F.col("text"), F.col("value")), F.lit(0)) == 0, "not verbatim"), F.when(~F.col("type").isin(*types), "type"), F.when(F.col("n") > 1, "duplicate"), F.when(F.col("bait") == 1, "decoy"))
    return x.select("doc", "value", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def position_bucket(gold: DataFrame) -> DataFrame:
    """(doc, value, bucket): first seen before half of the text, before three quarters, or behind."""
    share = F.col("pos") / F.col("n_chars")
    return gold.select("doc", "value", F.when(share < 0.5, "head").when(share <= 0.75, "mid").otherwise("tail").alias("bucket"))


def model_summary(summary: DataFrame, probe: DataFrame) -> DataFrame:
    """(model, f1, recall, gb, tier, verdict), best first, with the memory probe's gigabytes where there is one."""
    from ..functions.text import hardware_tier

    x = summary.join(probe.select("model", "gb"), "model", "left").withColumn("gb", F.coalesce("gb", F.lit(0.0)))
    x = x.select("model", "f1", "recall", "gb", hardware_tier(F.col("gb")).alias("tier"), F.when(F.col("recall") >= 0.9, "fit").otherwise("rejected").alias("verdict"))
    return x.orderBy(F.desc("f1"), "model")
