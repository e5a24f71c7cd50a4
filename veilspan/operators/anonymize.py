"""Documents to protected documents, whole: rules, custom vocabulary and a model's values in, one mapping for each scope out.

Hooks: `extractor`, a function of documents (key, text) to a model's values (key, value, type); `patterns`, custom
vocabulary; `span_filter`, a function of the merged spans to those that stay. Each step is written to the shared folder
(scratch.py) and read back: all in one plan would run rules and extractor several times over, and the driver would hold that
plan anew for each of its stages. Edge cases: as those of the parts; documents without spans come back as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import modelvalues, restoring, sessions, spanalgebra
from .detectors import RULES, Rule, detect
from .locate import rescan
from .mint import splice
from .regexspans import matches
from .scratch import discard, materialize
from .surfaces import union_spans


@dataclass(frozen=True)
class Pattern:
    """A custom term or, with is_regex, a regular expression."""

    pattern: str
    type: str
    case_sensitive: bool = False
    is_regex: bool = False

    def java(self) -> str | None:
        """The pattern for the JVM; None if it is empty, broken, or may match nothing at all."""
        if not self.pattern.strip():
            return None
        body = self.pattern if self.is_regex else r"\Q" + self.pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
        if self.is_regex:
            try:
                if re.compile(self.pattern).match(""):
                    return None
            except re.error:
                return None
        return body if self.case_sensitive else "(?iu)" + body


def custom_spans(docs: DataFrame, patterns: list[Pattern], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of the custom vocabulary, priority 120; a term's hits don't overlap; broken expressions are ignored."""
    x = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).where(F.col("__t").isNotNull())

    def hits(p: Pattern):
        return F.transform(matches(F.col("__t"), p.java()), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(p.type).alias("type"), m["text"].alias("text")))

    found = [hits(p) for p in patterns if p.java()]
    none = F.array().cast("array<struct<start:int,end:int,type:string,text:string>>")
    y = x.select("__k", F.inline(F.concat(none, *found)))
    return y.select(F.col("__k").alias(key), "start", "end", "type", "text", F.lit("manual").alias("source"), F.lit(1.0).alias("confidence"), F.lit(120).alias("priority"))


MODEL_PRIORITY = 30
BROADCAST = 1 << 20  # bytes, by estimate, of a table that a step broadcasts: tables of spans grow with the documents


def spans_of(docs: DataFrame, rules: list[Rule] | None = None, patterns: list[Pattern] = (), extractor: Callable[[DataFrame], DataFrame] | None = None, key: str = "doc_id", text: str = "text", scope: str | None = None, span_filter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Merged spans of documents: rules (all by default), custom vocabulary, a model's values with what is run into words, and
    the names among them found again over the scope. `_inputs`: the scratch tables that the result reads."""
    scope, held = scope or key, []

    def save(df: DataFrame) -> DataFrame:
        held.append(materialize(df, "spans", BROADCAST))
        return held[-1]

    parts = [save(detect(docs, rules if rules is not None else RULES, key, text).drop("rule"))]
    if patterns:
        parts.append(custom_spans(docs, list(patterns), key, text))
    if extractor is not None:
        located = modelvalues.locate_model_rows(extractor(docs.select(key, text)), docs, key, text)
        parts.append(save(located.where(F.col("outcome").isin("span", "run-in")).select(key, "start", "end", "type", "text", F.lit("llm").alias("source"), F.lit(1.0).alias("confidence"), F.when(F.col("outcome") == "span", MODEL_PRIORITY).otherwise(110).alias("priority"))))
        names = parts[-1] if scope == key else save(parts[-1].join(docs.select(key, scope).distinct(), key))
        again = rescan(names, docs.withColumnRenamed(text, "text") if text != "text" else docs, scope, key, save=save)
        parts.append(again.select(key, "start", "end", "type", "text", F.lit("rescan").alias("source"), F.lit(1.0).alias("confidence"), F.lit(MODEL_PRIORITY).alias("priority")))
    out = spanalgebra.merge_islands(union_spans(*parts), docs, key, text)
    out = span_filter(out) if span_filter else out
    out._inputs = held
    return out


def anonymize(docs: DataFrame, scope: str = "doc_id", order: str | None = None, seed: DataFrame | None = None, style: str = "token", key: str = "doc_id", text: str = "text", **hooks) -> tuple[DataFrame, DataFrame]:
    """(documents with `tokenized`, mapping (scope, token, surface, type)): one mapping for each scope, documents in the order
    of `order` (the key by default). style: token or pseudonym."""
    spans = spans_of(docs, key=key, text=text, scope=scope, **hooks)
    placed = spans.join(docs.select(F.col(key).alias("__k"), F.col(scope).alias("__scope"), F.col(order or key).alias("doc_order")).distinct(), F.col(key) == F.col("__k")).drop("__k")
    placed = materialize(placed.withColumnRenamed("__scope", "scope"), "placed", BROADCAST)
    discard(*spans._inputs)
    source = docs.select(F.col(scope).alias("scope"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    if seed is not None:
        seed = seed.withColumnRenamed(scope, "scope")
    mint = sessions.mint_session if style == "token" else sessions.mint_pseudonyms
    mapping = materialize(mint(placed, source, "scope", ("doc_order", "start"), seed).select("scope", "token", "surface", "type"), "mapping", BROADCAST)
    sites = placed.join(mapping.select("scope", F.col("surface").alias("text"), "token").hint("merge"), ["scope", "text"]).select(key, "start", "end", "token")
    return splice(docs, sites, key, text), mapping.withColumnRenamed("scope", scope)


def restore(edited: DataFrame, mapping: DataFrame, scope: str = "doc_id", style: str = "token", key: str = "doc_id", text: str = "tokenized", orphans: bool = True) -> DataFrame:
    """(key, restored, restored_count, orphans, suspects, ambiguous) of edited texts."""
    return restoring.restore(edited, mapping, scope, style, key, text, orphans)
