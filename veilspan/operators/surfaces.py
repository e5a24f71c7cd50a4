"""A text and its other surfaces: decoded offsets, runs, lines, pages and redacted copies, joined by ranges.

Ranges are half-open code points. Every join is by the document's key first, ranges are its residue. Edge cases: null texts
give nothing; empty ranges meet nothing; ties go by the least number or token; only the named columns are read.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, sanitize_type
from .regexspans import matches
from .sessions import nth_free


def original_offsets(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, original_start, original_end) of spans in the text with its escaped tokens decoded: each removed
    backslash before a place moves it on by one."""
    hits = matches(F.col(text), r"\{[A-Z0-9]+\\_[0-9]+\}")
    # Where the i-th backslash stood, in the decoded text.
    cuts = F.transform(hits, lambda m, i: m["start"] + F.instr(m["text"], "\\") - 1 - i)
    x = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__k"), cuts.alias("__cuts"))
    at = lambda c: (c + F.size(F.filter("__cuts", lambda d: d <= c))).cast("int")
    return spans.join(x, F.col(key) == F.col("__k")).select(key, "start", "end", at(F.col("start")).alias("original_start"), (at(F.col("end") - 1) + 1).alias("original_end"))


def paired_runs(docs: DataFrame, sites: DataFrame, key: str = "doc_id", text: str = "text", replacement: str = "token") -> DataFrame:
    """(key, run, replaced, start, end, red_start, red_end): the text and its redacted copy tiled by the sites and what
    lies between them."""
    by = Window.partitionBy(key).orderBy("start")
    s = sites.select(key, "start", "end", F.length(replacement).alias("n"))
    gaps = s.select(key, F.coalesce(F.lag("end").over(by), F.lit(0)).alias("a"), F.col("start").alias("b"))
    last = docs.select(key, F.length(text).alias("len")).join(s.groupBy(key).agg(F.max("end").alias("a")), key, "left").select(key, F.coalesce("a", F.lit(0)).alias("a"), F.col("len").alias("b"))
    kept = gaps.unionByName(last).where("a < b").select(key, F.col("a").alias("start"), F.col("b").alias("end"), (F.col("b") - F.col("a")).alias("n"), F.lit(False).alias("replaced"))
    x = kept.unionByName(s.withColumn("replaced", F.lit(True)))
    upto = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return x.withColumn("red_end", upto.cast("int")).select(key, F.row_number().over(by).alias("run"), "replaced", "start", "end", (F.col("red_end") - F.col("n")).cast("int").alias("red_start"), "red_end")


def selected_original(pairs: DataFrame, selections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id, start, end) in the original of selections (key, id, red_start, red_end) of the redacted copy: a replaced run
    that is touched counts whole, a kept one in part."""
    p = pairs.select(key, "replaced", "start", "end", F.col("red_start").alias("a"), F.col("red_end").alias("b"))
    x = selections.join(p, key).where((F.col("red_start") < F.col("b")) & (F.col("a") < F.col("red_end")))
    lo = F.when(F.col("replaced"), F.col("start")).otherwise(F.col("start") + F.greatest(F.lit(0), F.col("red_start") - F.col("a")))
    hi = F.when(F.col("replaced"), F.col("end")).otherwise(F.col("end") - F.greatest(F.lit(0), F.col("b") - F.col("red_end")))
    return x.groupBy(key, "id").agg(F.min(lo).alias("start"), F.max(hi).alias("end"))


def touched_lines(ranges: DataFrame, lines: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Lines (key, line, start, end) that a range (key, start, end) meets, and how many ranges of each key meet none."""
    r = ranges.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    meet = (F.col(key) == F.col("__k")) & (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")) & (F.col("__s") < F.col("__e")) & (F.col("start") < F.col("end"))
    lost = r.join(lines, meet, "left_anti").groupBy(F.col("__k").alias(key)).agg(F.count("*").alias("unplaced"))
    return lines.join(r, meet, "left_semi"), lost


def reused_tokens(surfaces: DataFrame, seed: DataFrame, scope: str) -> DataFrame:
    """(scope, surface, type, token) of surfaces (scope, surface, type, place): a seed's entry (scope, token, surface, aliases)
    of equal normalized surface or alias gives its token, the least of several; others go on from the seed's numbers."""
    known = seed.select(scope, "token", F.explode(F.concat(F.array("surface"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("s")).where("s is not null")
    known = known.groupBy(scope, normalize(F.col("s")).alias("n")).agg(F.min("token").alias("token"))
    x = surfaces.withColumn("n", normalize(F.col("surface"))).groupBy(scope, "n").agg(F.min_by(F.struct("surface", "type"), "place").alias("s"), F.min("place").alias("place")).select(scope, "n", "s.*", "place")
    old = x.join(known, [scope, "n"]).select(scope, "surface", "type", "token")
    number = F.regexp_extract("token", r"^\{[A-Z0-9]+_([0-9]+)\}$", 1).try_cast("int")
    top = seed.select(scope, F.regexp_extract("token", r"^\{([A-Z0-9]+)_", 1).alias("stype"), number.alias("i")).where("i is not null").groupBy(scope, "stype").agg(F.collect_set("i").alias("taken"), F.max("i").alias("top"))
    new = x.join(known, [scope, "n"], "left_anti").withColumn("stype", sanitize_type(F.col("type")))
    new = new.withColumn("k", F.row_number().over(Window.partitionBy(scope, "stype").orderBy("place", "n"))).join(top, [scope, "stype"], "left")
    token = F.concat(F.lit("{"), "stype", F.lit("_"), nth_free(F.col("k"), F.col("taken"), F.coalesce("top", F.lit(0))).cast("string"), F.lit("}"))
    return old.unionByName(new.select(scope, "surface", "type", token.alias("token")))


def line_tokens(lines: DataFrame, spans: DataFrame, seed: DataFrame, scope: str, key: str = "doc_id") -> DataFrame:
    """(key, line, type, surface, token) of recognized lines (key, scope, line, text): in the lines put together with line
    ends, the longest span (key, start, end, type) inside a line is its own; tokens by reused_tokens()."""
    by = Window.partitionBy(key).orderBy("line")
    at = F.coalesce(F.sum(F.length("text") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    x = lines.withColumn("a", at).withColumn("b", F.col("a") + F.length("text"))
    inside = x.join(spans.select(F.col(key).alias("__k"), "start", "end", "type"), F.col(key) == F.col("__k")).where((F.col("a") <= F.col("start")) & (F.col("end") <= F.col("b")))
    best = inside.groupBy(key, scope, "line", "a", "text").agg(F.max_by(F.struct("start", "end", "type"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("s"))
    best = best.select(key, scope, "line", "s.type", F.substring(F.col("text"), F.col("s.start") - F.col("a") + 1, F.col("s.end") - F.col("s.start")).alias("surface"))
    tokens = reused_tokens(best.withColumn("place", F.struct(key, "line")), seed, scope).select(scope, normalize(F.col("surface")).alias("n"), "token")
    return best.withColumn("n", normalize(F.col("surface"))).join(tokens, [scope, "n"]).select(key, "line", "type", "surface", "token")


def edited_runs(runs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, run, text): text runs (key, run, start, text) with disjoint edits (key, start, end, token): the first run that an
    edit meets takes its token, the others only lose their part."""
    e = edits.select(F.col(key).alias("__k"), F.col("start").alias("es"), F.col("end").alias("ee"), "token")
    x = runs.withColumn("n", F.length("text")).join(e, (F.col(key) == F.col("__k")) & (F.col("start") < F.col("ee")) & (F.col("es") < F.col("start") + F.col("n")))
    first = F.row_number().over(Window.partitionBy(key, "es").orderBy("run")) == 1
    x = x.select(key, "run", F.struct(F.greatest(F.lit(0), F.col("es") - F.col("start")).alias("a"), F.least(F.col("n"), F.col("ee") - F.col("start")).alias("b"), F.when(first, F.col("token")).otherwise("").alias("t")).alias("cut"))
    cuts = x.groupBy(key, "run").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    t, c = F.col("text"), F.col("cuts")
    upto = lambda i: F.coalesce(F.get(c, i - 1)["b"], F.lit(0))
    parts = F.transform(c, lambda p, i: F.concat(F.substring(t, upto(i) + 1, p["a"] - upto(i)), p["t"]))
    new = F.concat(F.array_join(parts, ""), F.substring(t, upto(F.size(c)) + 1, F.length(t)))
    return runs.join(cuts, [key, "run"], "left").select(key, "run", F.when(c.isNull(), t).otherwise(new).alias("text"))


def joined_hits(exact: DataFrame, loose: DataFrame) -> DataFrame:
    """(page, start, end, x0, y0, x1, y1, both): hits of two searches (page, start, end, x0, y0, x1, y1); one text range of a
    page, or one box where a hit has no range, is one hit, the exact one's values first."""
    on = ["page", F.coalesce("start", F.lit(-1)), F.coalesce("end", F.lit(-1)), F.when(F.col("start").isNull(), F.struct("x0", "y0", "x1", "y1"))]
    both = exact.withColumn("w", F.lit(0)).unionByName(loose.withColumn("w", F.lit(1)))
    one = both.groupBy("page", on[1].alias("s"), on[2].alias("e"), on[3].alias("g")).agg(F.min_by(F.struct("start", "end", "x0", "y0", "x1", "y1"), "w").alias("h"), (F.countDistinct("w") > 1).alias("both"))
    return one.select("page", "h.*", "both")


def owned_sites(sites: DataFrame, mapping: DataFrame) -> DataFrame:
    """(page, start, end, text, token): each spelling of sites (page, start, end, text) has one owner in the mapping (token,
    surface): an entry of its exact case, else of any, the least token; sites strictly inside a longer one of their page go."""
    exact = mapping.groupBy(F.col("surface").alias("text")).agg(F.min("token").alias("t0"))
    any_case = mapping.groupBy(F.lower("surface").alias("low")).agg(F.min("token").alias("t1"))
    x = sites.withColumn("low", F.lower("text")).join(exact, "text", "left").join(any_case, "low", "left").select("page", "start", "end", "text", F.coalesce("t0", "t1").alias("token")).where("token is not null")
    o = x.select(F.col("page").alias("__p"), F.col("start").alias("__s"), F.col("end").alias("__e")).distinct()
    return x.join(o, (F.col("page") == F.col("__p")) & (F.col("__s") <= F.col("start")) & (F.col("end") <= F.col("__e")) & (F.col("__e") - F.col("__s") > F.col("end") - F.col("start")), "left_anti")


def linked_aliases(mapping: DataFrame, scope: str) -> DataFrame:
    """The mapping (scope, token, surface, canonical_surface, canonical_token) with the canonical token of an alias entry: the
    least token of an entry whose surface is the canonical one, case aside; one that is set stays."""
    named = mapping.groupBy(scope, F.lower("surface").alias("low")).agg(F.min("token").alias("__c"))
    x = mapping.withColumn("low", F.lower("canonical_surface")).join(named, [scope, "low"], "left").drop("low")
    return x.withColumn("canonical_token", F.coalesce("canonical_token", F.when(F.col("__c") != F.col("token"), F.col("__c")))).drop("__c")


def union_spans(*parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of all sources, by name; a source lacking a column has null there."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def segment_outcomes(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, segments, truncated, invalid, complete, scanned_nothing) of parsed answers, one row an entity or an empty
    segment (key, segment, truncated, invalid, value)."""
    s = rows.groupBy(key, "segment").agg(F.bool_or("truncated").alias("t"), F.bool_or("invalid").alias("i"), F.count("value").alias("n"))
    x = s.groupBy(key).agg(F.count("*").alias("segments"), F.count_if("t").alias("truncated"), F.count_if("i").alias("invalid"), F.sum("n").alias("n"))
    return x.select(key, "segments", "truncated", "invalid", ((F.col("truncated") == 0) & (F.col("invalid") == 0)).alias("complete"), ((F.col("n") == 0) & (F.col("invalid") == F.col("segments"))).alias("scanned_nothing"))


def preview(restored: DataFrame) -> DataFrame:
    """(n_docs, restored, orphans, suspects, ambiguous) of restored texts: the report of what a write of the same rows
    holds."""
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c)
    return restored.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("restored_count"), F.lit(0)).alias("restored"), n("orphans"), n("suspects"), n("ambiguous"))
