"""Regex matches with offsets, natively: split() gives the gaps, regexp_extract_all() the matches, and a running sum
of their lengths the starts. Both use the same matcher, so lookbehinds agree. Offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of the matches of a pattern that never matches the empty string. The matches are found
    once (a lambda's variable holds them), and the gaps only where there are any."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))
    step = lambda a, p: F.struct(
        (a["at"] + p["g"] + F.length(p["m"])).alias("at"),
        F.concat(a["out"], F.array(F.struct((a["at"] + p["g"]).alias("start"), (a["at"] + p["g"] + F.length(p["m"])).alias("end"), p["m"].alias("text")))).alias("out"),
    )

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m"))
        return F.when(F.size(found) == 0, zero["out"]).otherwise(F.aggregate(pairs, zero, step, lambda a: a["out"]))

    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), placed), F.lit(0))


def sql_spans(source: str, pattern: str, key: str = "doc_id", text: str = "text", extra: str = "") -> str:
    """The same in DuckDB (no lookbehind there): SELECT key, start, end, text."""
    p = pattern.replace("'", "''")
    return f"""SELECT {key}, s AS start, s + length(m) AS "end", m AS text{extra} FROM (SELECT {key}, ms[i] AS m,
 CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS INTEGER) AS s
 FROM (SELECT {key}, gaps, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT {key}, string_split_regex({text}, '{p}') AS gaps, regexp_extract_all({text}, '{p}') AS ms FROM {source})))"""
