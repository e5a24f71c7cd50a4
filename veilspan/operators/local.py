"""A document on one row: detect, merge, mint, splice and restore as array expressions, with no shuffle at all.

The scope of a mapping is the document here, so nothing needs its neighbours: one scan of the documents, text never
leaves its row. operators/mint.py has the same steps as relations, for scopes of many documents.

Edge cases: a null text gives no spans and a null tokenized text; an empty one no spans; repeated rows are handled
row by row; columns of the input pass through, clashing names excepted: `found`, `spans`, `mapping`, `tokenized` and
`restored` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .detectors import FOUND, VIEW, Rule, found_in
from .mint import TOKEN
from .spanalgebra import ROLE_LABELS

INTS = "array<int>"


def ranked(found: Column) -> Column:
    """The spans in order, each with its rank: the input of merged()."""
    member = lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.struct((-s["priority"]).alias("p"), (s["start"] - s["end"]).alias("n"), s["start"].alias("s"), s["end"].alias("e"), s["type"].alias("type"), s["confidence"].alias("confidence"), s["priority"].alias("priority")).alias("best"),
    )
    return F.array_sort(F.transform(found, member))


def merged(ordered: Column) -> Column:
    """M01 on one row: islands of strict overlap of ranked() spans, in order; the best ranked member (priority, length, start, end) gives type, confidence and priority."""
    none = F.struct(F.slice(ordered, 1, 0).alias("done"), F.try_element_at(ordered, F.lit(1)).alias("open"))

    def step(a: Column, s: Column) -> Column:
        apart = s["start"] >= a["open"]["end"]
        joined = F.struct(a["open"]["start"].alias("start"), F.greatest(a["open"]["end"], s["end"]).alias("end"), F.least(a["open"]["best"], s["best"]).alias("best"))
        return F.struct(F.when(apart, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"), F.when(apart, s).otherwise(joined).alias("open"))

    flat = lambda a: F.transform(F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["best"]["type"].alias("type"), s["best"]["confidence"].alias("confidence"), s["best"]["priority"].alias("priority")))
    return F.aggregate(ordered, none, step, flat)


def sliced(text: Column, spans: Column) -> Column:
    """The spans with the text they cover, without those whose text is a role label."""
    out = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), s["confidence"].alias("confidence"), s["priority"].alias("priority")))
    return F.filter(out, lambda s: ~F.lower(F.trim(s["text"])).isin(*ROLE_LABELS))


def minted(text: Column, spans: Column) -> Column:
    """T01, T03, T04 on one row: array<struct(surface, type, token)> of the distinct surfaces in order of appearance,
    numbered in each sanitized type past the numbers that the text already spells."""
    surfaces = F.array_distinct(F.transform(spans, lambda s: s["text"]))
    first = F.transform(surfaces, lambda v: F.element_at(F.filter(spans, lambda s: s["text"] == v), F.lit(1))["type"])
    kinds = F.transform(first, tx.sanitize_type)
    spelled = F.when(text.contains("{"), F.regexp_extract_all(tx.decode_markdown_token(text), F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def token(kind: Column, i: Column) -> Column:
        k = F.size(F.filter(F.slice(kinds, F.lit(1), i + 1), lambda x: x == kind))
        taken = F.transform(F.filter(spelled, lambda t: t.startswith(F.concat(F.lit("{"), kind, F.lit("_")))), lambda t: F.regexp_extract(t, r"_([0-9]+)\}", 1).try_cast("int"))
        free = F.array_except(F.sequence(F.lit(1), k + F.size(taken)), taken)
        return F.concat(F.lit("{"), kind, F.lit("_"), F.when(F.size(taken) == 0, k).otherwise(F.element_at(free, k)).cast("string"), F.lit("}"))

    return F.zip_with(F.arrays_zip(surfaces.alias("surface"), first.alias("type")), F.transform(kinds, token), lambda s, t: F.struct(s["surface"].alias("surface"), s["type"].alias("type"), t.alias("token")))


def spliced(text: Column, spans: Column, mapping: Column) -> Column:
    """T02 on one row: gaps and tokens in turn, joined once."""
    look = F.map_from_arrays(F.transform(mapping, lambda m: m["surface"]), F.transform(mapping, lambda m: m["token"]))
    at = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    parts = F.transform(spans, lambda s, i: F.concat(F.substring(text, at(i) + 1, s["start"] - at(i)), F.element_at(look, s["text"])))
    return F.concat(F.array_join(parts, ""), F.substring(text, at(F.size(spans)) + 1, F.length(text)))


def restored(edited: Column, mapping: Column) -> Column:
    """R01, R02 on one row: tokens of the mapping go back to their surfaces, in one pass over the decoded text."""
    look = F.map_from_arrays(F.transform(mapping, lambda m: m["token"]), F.transform(mapping, lambda m: m["surface"]))
    t = tx.decode_markdown_token(edited)
    gaps, toks = F.split(t, TOKEN, -1), F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    return F.array_join(F.zip_with(gaps, toks, lambda g, k: F.concat(g, F.when(k.isNull(), "").otherwise(F.coalesce(F.try_element_at(look, k), k)))), "")


def once(value: Column, name: str) -> Column:
    """A column that is made once, whatever reads it: Catalyst doesn't write a generator's input into what comes after."""
    return F.explode(F.array(value)).alias(name)


def anonymize(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", found: Column | None = None) -> DataFrame:
    """The documents with `spans` (merged, in order), `mapping` and `tokenized`. `found`: spans of your own as an array
    expression, in place of the rules."""
    keep = [c for c in docs.columns if c.lower() not in ("found", "spans", "mapping", "tokenized", "restored", VIEW)]
    t, none = F.col(text), F.array().cast(FOUND)
    x = docs.withColumn(VIEW, tx.pattern_view(t))
    x = x.select(*keep, once(F.coalesce(ranked(found_in(rules) if found is None else found), ranked(none)), "found"))
    x = x.select(*keep, once(merged(F.col("found")), "spans")).select(*keep, once(sliced(t, F.col("spans")), "spans"))
    x = x.select(*keep, "spans", once(minted(t, F.col("spans")), "mapping"))
    return x.select(*keep, "spans", "mapping", once(F.when(F.size("spans") == 0, t).otherwise(spliced(t, F.col("spans"), F.col("mapping"))), "tokenized"))


def restore(anonymized: DataFrame, edited: str = "tokenized") -> DataFrame:
    """The rows with `restored`."""
    keep = [c for c in anonymized.columns if c != "restored"]
    return anonymized.select(*keep, once(restored(F.col(edited), F.col("mapping")), "restored"))
