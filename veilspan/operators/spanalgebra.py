"""Span relations: islands, greedy folds, sweeps, splits, and anti-joins by range. Keys stay together by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Names of a role, which identify nobody.
ROLE_LABELS = (
    "buyer", "seller", "lender", "borrower", "landlord", "tenant", "licensor", "licensee", "employer", "employee", "contractor", "client", "customer", "supplier", "vendor",
    "guarantor", "trustee", "beneficiary", "plaintiff", "defendant", "party", "parties", "company", "甲方", "乙方", "丙方", "丁方", "买方", "卖方", "出租方", "承租方", "原告", "被告",
)


def drop_role_labels(spans: DataFrame, labels: tuple[str, ...] = ROLE_LABELS, text: str = "text") -> DataFrame:
    """spans whose text, trimmed and in lower case, is a role label are left out. Null text stays."""
    return spans.where(F.coalesce(~F.lower(F.trim(F.col(text))).isin(*labels), F.lit(True)))


def merge_islands(spans: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Role labels go; of equal ranges and texts the best ranked stays; islands of strict overlap have the union as
    range, the best ranked member's identity, and the document's slice as text. Rank: priority, length, start, end, type.

    Null or empty spans are dropped; rows repeated are one; text is shuffled once, at the end, and only that of documents
    with spans."""
    if "text" in spans.columns:
        spans = drop_role_labels(spans)
    by = Window.partitionBy(key).orderBy("start", "end")
    x = spans.where("start < end").withColumn("__far", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("__isle", F.sum(F.when(F.col("__far").isNull() | (F.col("start") >= F.col("__far")), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct(-F.col("priority"), F.col("start") - F.col("end"), F.col("start"), F.col("end"), F.col("type"))
    out = x.groupBy(key, "__isle").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(F.struct("type", "source", "confidence", "priority"), rank).alias("w"))
    out = out.select(key, "start", "end", "w.*").join(docs.select(key, F.col(text).alias("__t")), key)
    return out.select(key, "start", "end", "type", F.substring(F.col("__t"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "source", "confidence", "priority")


def greedy(spans: DataFrame, key: str = "doc_id", order: str = "longest") -> DataFrame:
    """M02 (longest first) or M04 (leftmost, then longest): losers that overlap an accepted span are dropped.
    A fold over each document's spans, which is small after merging."""
    rank = [F.col("start") - F.col("end"), F.col("start")] if order == "longest" else [F.col("start"), F.col("start") - F.col("end")]
    one = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], "end", "start", *[c for c in spans.columns if c not in (key, "start", "end")])
    x = spans.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("all"))
    none = F.slice(F.col("all"), 1, 0)
    keep = F.aggregate("all", none, lambda a, s: F.when(F.exists(a, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), a).otherwise(F.concat(a, F.array(s))))
    return x.select(key, F.inline(keep)).drop("r0", "r1")


def sweep_extend(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapping spans become one manual span with the type of its last manual member, else of its first."""
    by = Window.partitionBy(key).orderBy("start", F.desc("end"))
    x = spans.withColumn("far", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("isle", F.sum(F.when(F.col("far").isNull() | (F.col("start") >= F.col("far")), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.when(F.col("source") == "manual", F.col("type")), F.when(F.col("source") == "manual", F.struct("start", -F.col("end"))))
    first = F.min_by("type", F.struct("start", -F.col("end")))
    return x.groupBy(key, "isle").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.coalesce(last, first).alias("type"), F.when(F.count("*") > 1, "manual").otherwise(F.min("source")).alias("source"), F.max("priority").alias("priority")).drop("isle")


def join_touching(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Consecutive spans that touch, of one type or both organization-like; the last type wins."""
    org = lambda c: c.isin("COMPANY", "TRADEMARK")
    by = Window.partitionBy(key).orderBy("start", "end")
    prev, kind = F.lag("end").over(by), F.lag("type").over(by)
    x = spans.withColumn("isle", F.sum(F.when((prev == F.col("start")) & ((kind == F.col("type")) | (org(kind) & org(F.col("type")))), 0).otherwise(1)).over(by))
    return x.groupBy(key, "isle").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("type", "start").alias("type")).drop("isle")


def split_at_breaks(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Parts between line breaks and tabs, blank parts dropped, with their own offsets."""
    x = spans.withColumn("p", F.expr("""aggregate(split(text, '[\\n\\t]', -1), struct(start AS at, cast(array() AS array<struct<s:int,v:string>>) AS out),
      (a, v) -> struct(cast(a.at + length(v) + 1 AS int) AS at, concat(a.out, array(struct(cast(a.at AS int) AS s, v AS v))) AS out)).out"""))
    x = x.select(*[c for c in spans.columns if c not in ("start", "end", "text")], F.inline("p")).where(F.trim("v") != "")
    return x.withColumnRenamed("s", "start").withColumn("end", F.col("start") + F.length("v")).withColumnRenamed("v", "text")


def overlap_anti(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of left that overlap no row of right in their document: hashed on the document, ranges as residue."""
    r = right.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    return left.join(r, (F.col(key) == F.col("__k")) & (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")), "left_anti")


def dominant_type(values: DataFrame, spans: DataFrame, key: str = "id") -> DataFrame:
    """The widest detection that covers at least 90 % of a value names it; ties by priority, then earliest."""
    x = values.join(spans.select(key, "start", "end", "type", "priority"), key).where((F.col("end") - F.col("start")) >= 0.9 * F.length("value"))
    return x.groupBy(key, "value").agg(F.max_by("type", F.struct(F.col("end") - F.col("start"), "priority", -F.col("start"))).alias("type"))
