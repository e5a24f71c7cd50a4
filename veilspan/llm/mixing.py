"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size gives whole copies of every document, which are certain, and a remaining fraction of
its words, the quota. For the quota documents have inclusion odds in proportion to a weight, by default their size in
words: p = rate * weight, the rate such that the expected words are the quota. Documents whose p would reach 1 are certain
and taken first; the rate is that of the others. The others are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the first ones are taken up to what the certain ones leave of the quota, the one that
crosses it only if that comes nearer: a sample of fixed size in words.

The random numbers are hashes of the id and the text, so reruns agree on any partitioning. Ties in the rank (rows
repeated with the same id) break by id, then share their fate by cumulative size. Weights count to a 64th of an octave, so
that the rate of a source comes from a few thousand sums, however many rows it has. Sources are cut into ranges of ranks
in two levels; only the range that the quota crosses is ranked row by row.

Edge cases: null or empty text has size 0 and takes 0 words; a source without words has target 0; null is a source
of its own, the last; a null, zero or negative weight counts as 2**-40: such documents come last; an empty table gives an empty
result. Only id, text, source and the weight are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

PER_BIN = 512


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, size) -> (source, size, target): weights 1, 2, 3 repeating by code point, null last; shares of the
    sum of sizes, capped at `cap` times the size, the excess reshared by weight. One row a source: small windows."""
    at = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", ((F.row_number().over(at) - 1) % 3 + 1).cast("double"))
    # Sources fill in the order of cap / weight; those before the level that the rest can hold are at their cap.
    by = Window.orderBy(F.col("room"), F.col("source").asc_nulls_last())
    prior, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("limit", cap * F.col("size")).withColumn("room", F.col("limit") / F.col("w"))
    s = s.withColumn("level", (F.sum("size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(prior), F.lit(0.0))) / F.sum("w").over(rest))
    level = F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(Window.partitionBy())
    return s.select("source", "size", F.least(F.col("limit"), F.coalesce(level * F.col("w"), F.col("limit"))).alias("target"))


def inclusion(rows: DataFrame, t: DataFrame) -> DataFrame:
    """(source, rate, from_weight, certain): documents of a weight beyond from_weight are certain (words `certain` in all);
    the others have odds rate * weight."""
    w = rows.groupBy("source", "wt").agg(F.sum("size").cast("double").alias("words"))
    w = w.join(t.select(F.col("source").alias("s2"), "quota"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    by = Window.partitionBy("source").orderBy(F.col("wt").desc())
    w = w.withColumn("above", F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("mass", F.sum(F.col("wt") * F.col("words")).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    w = w.withColumn("rate", F.when(F.col("mass") > 0, (F.col("quota") - F.col("above")) / F.col("mass")))
    # The largest weight that may stay uncertain: with those above it certain, its own odds are below 1.
    ok = w.where((F.col("rate") >= 0) & (F.col("rate") * F.col("wt") <= 1))
    return ok.groupBy("source").agg(F.max(F.struct("wt", "rate", "above")).alias("m")).select("source", F.col("m.rate").alias("rate"), F.col("m.wt").alias("from_weight"), F.col("m.above").alias("certain"))


def pareto_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, cap: float = 3.0, carry: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes each document.

    weight: a column to which inclusion odds are in proportion within a source (default: the size in words). carry: a
    column that tells rows of one id apart, passed through; ties break by it after the id."""
    extra = [carry] if carry else []
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    given = words.cast("double") if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = docs.select(
        F.col(key).alias("id"), F.col(source).alias("source"), words.alias("size"),
        ((F.pmod(F.xxhash64(F.lit("pareto"), F.col(key).cast("string"), F.col(text)), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u"),
        F.when(given > 0, F.pow(F.lit(2.0), F.round(F.log2(given) * 64) / 64)).otherwise(2.0**-40).alias("wt"), *extra,
    )
    rows = materialize(rows, "mix-rows")
    per = materialize(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-sources")
    t = targets(per.select("source", "size"), cap)
    t = t.join(per.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    t = t.withColumn("ratio", F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0))
    t = t.withColumn("whole", F.floor(F.col("ratio") + 1e-12)).withColumn("quota", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")) * F.col("size"))
    t = materialize(t.withColumn("bins", F.greatest(F.lit(1), F.ceil(F.col("n") / PER_BIN))), "mix-shares")
    odds = inclusion(rows, t)
    t = t.join(odds.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    t = materialize(t.select("source", F.col("size").alias("source_size"), "target", "whole", "quota", "bins", "rate", "from_weight", F.coalesce("certain", F.lit(0.0)).alias("certain")), "mix-targets")
    x = rows.join(t.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    sure = (F.col("quota") > 0) & (F.col("wt") > F.col("from_weight"))
    p = F.least(F.greatest(F.col("rate") * F.col("wt"), F.lit(1e-12)), F.lit(1 - 1e-9))
    x = x.withColumn("sure", F.coalesce(sure, F.lit(False))).withColumn("rank", F.when(~F.col("sure") & (F.col("quota") > F.col("certain")), (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))))
    # rank / (1 + rank) lies in (0, 1) and is monotone: its bins cut a source, however hot, into short ranges.
    x = x.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("bins"))).withColumn("room", F.col("quota") - F.col("certain"))
    bins = materialize(x.where("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("room").alias("room")), "mix-bins")
    cross = crossing(crossing(bins.withColumn("outer", F.floor(F.col("bin") / PER_BIN)), "outer", None), "bin", "before")
    cross = materialize(cross.select(F.col("source").alias("s2"), F.col("bin").alias("cbin"), "before"), "mix-cross")
    # A source's quota is crossed in one bin at most; only that bin's documents are ranked one by one.
    x = x.join(cross, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    one = Window.partitionBy("source", "bin").orderBy("rank", "id", *extra).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = x.where("bin = cbin").withColumn("upto", F.sum("size").over(one) + F.col("before"))
    low, high = F.col("upto") - F.col("size"), F.col("upto")
    inside = inside.withColumn("extra", (high <= F.col("room")) | ((low < F.col("room")) & (high - F.col("room") < F.col("room") - low)))
    others = x.where("cbin is null or bin is null or bin <> cbin").withColumn("extra", F.col("sure") | (F.col("bin").isNotNull() & (F.col("cbin").isNull() | (F.col("bin") < F.col("cbin")))))
    cols = ["id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce(F.col("extra"), F.lit(False)).cast("long")).alias("copies"), *extra]
    discard(per, bins)
    return others.select(*cols).unionAll(inside.select(*cols))


def crossing(bins: DataFrame, level: str, start: str | None) -> DataFrame:
    """The rows of bins (source, bin, words, room) in the range of `level` where the words of a source cross its room, with
    `before`: the words of the ranges before it (counted from `start` where given)."""
    run = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(start).alias("base") if start else F.lit(0).alias("base")
    sums = bins.groupBy("source", level).agg(F.sum("words").alias("w"), F.first("room").alias("r"), first)
    sums = sums.withColumn("upto", F.sum("w").over(run) + F.col("base")).withColumn("prior", F.col("upto") - F.col("w"))
    at = sums.where((F.col("upto") >= F.col("r")) & (F.col("prior") < F.col("r"))).select(F.col("source").alias("s3"), F.col(level).alias("l3"), F.col("prior").alias("before"))
    out = bins.drop("before").join(at, F.col("source").eqNullSafe(F.col("s3")) & (F.col(level) == F.col("l3")))
    return out.drop("s3", "l3")
