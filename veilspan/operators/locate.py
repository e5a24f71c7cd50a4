"""Values to occurrences, recall rescans, aliases, boilerplate, model rows, chunks, scoring."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import contains_cjk
from . import modelvalues as mv

NEEDLES = 4096  # values without a unit of a scope that a task searches for at a time


def units_of(value: str) -> list[str]:
    """What a text must hold as tokens (tokens_of) wherever the value stands in it on its own, however spaced or composed:
    its Latin runs of ASCII alone and its ideographs."""
    out, run, clean = [], "", True
    for c in [*mv.clusters(value), " "]:
        forms = (c,) if c.isascii() else (c, c.lower(), c.upper(), unicodedata.normalize("NFC", c), unicodedata.normalize("NFD", c))
        if any(map(mv.LATIN.match, forms)):
            run, clean = run + c, clean and c.isascii()
            continue
        if run and clean:
            out.append(run.lower())
        run, clean = "", True
        if len(c) == 1 and mv.CJK.match(c) and unicodedata.normalize("NFC", c) == unicodedata.normalize("NFD", c) == c:
            out.append(c)
    return list(dict.fromkeys(out))


TOKENS = re.compile(f"{mv.LATIN.pattern}+|{mv.CJK.pattern}")
KELVIN = "\u212a"  # the one sign that isn't a Latin letter here but is the other case of one


def tokens_at(text: str) -> dict[str, list[tuple[int, int]]]:
    """The Latin runs and ideographs of a text, case aside, and where they stand."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t in (text, text.replace(KELVIN, "k")) if KELVIN in text else (text,):
        for m in TOKENS.finditer(t):
            run = m.group()
            low = run.lower() if run.isascii() else run.lower().upper().lower().replace("i\u0307", "i")
            out.setdefault(low, []).append(m.span())
    return out


def near(text: str, value: str, at: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where a value stands in a text, given where one of its units does: only what a hit with that unit can reach is searched."""
    reach, out, a, b = 4 * len(value) + 24 * sum(not mv.LATIN.match(c) for c in value), [], None, 0
    for x, y in [*sorted(at), (None, None)]:
        if a is not None and x is not None and x - reach <= b:
            b = max(b, y + reach)
            continue
        if a is not None:
            out += mv.places(text, value, a, min(len(text), b))[0]
        if x is not None:
            a, b = max(0, x - reach), y + reach
    return out


def occurrences(values: DataFrame, docs: DataFrame, scope: str = "doc_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, type, text, value) of each value (scope, value, type) in its scope's documents: case aside,
    white space runs loose, composed and decomposed alike, not inside a longer Latin word (F09).

    Values meet texts by tokens: a value goes by that of its units which the fewest values of its scope have, to the documents
    that hold it, and is searched for around it alone. Values without a unit (other scripts) go in blocks of NEEDLES; a task
    looks for each in each text of the scope. Null values and texts match nothing; repeated values count once; only the named
    columns are read."""
    shape = f"{key} {docs.schema[key].dataType.simpleString()}, start int, end int, type string, text string, value string"
    v = values.select(F.col(scope).alias("__scope"), "value", "type").where(F.trim("value") != "").distinct().withColumn("__units", units(F.col("value")))
    d = docs.select(F.col(scope).alias("__scope"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    by = v.select("__scope", "value", "type", F.explode("__units").alias("__unit"))
    many = by.groupBy("__scope", "__unit").agg(F.count("*").alias("__n"))
    best = by.join(many, ["__scope", "__unit"]).groupBy("__scope", "value", "type").agg(F.min_by("__unit", F.struct("__n", -F.length("__unit"), "__unit")).alias("__unit"))
    held = d.where("__text is not null").select("__scope", "__key", F.explode(tokens(F.col("__text"))).alias("__unit"))
    met = held.join(best, ["__scope", "__unit"]).groupBy("__scope", F.col("__key").alias("__k")).agg(F.sort_array(F.collect_set(F.struct("value", "type", F.col("__unit").alias("unit")))).alias("__rows"))
    x = d.join(met.withColumnRenamed("__scope", "__s"), (F.col("__scope") == F.col("__s")) & F.col("__key").eqNullSafe(F.col("__k"))).select("__key", "__text", "__rows")
    rest = v.where(F.size("__units") == 0)
    sizes = rest.groupBy("__scope").agg(F.ceil(F.count("*") / NEEDLES).alias("__n"))
    blocks = rest.join(sizes, "__scope").groupBy("__scope", F.pmod(F.xxhash64("value"), "__n").alias("__block")).agg(F.sort_array(F.collect_list(F.struct("value", "type", F.lit(None).cast("string").alias("unit")))).alias("__rows"))
    y = d.join(blocks, "__scope").select("__key", "__text", "__rows")

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, (t, rows) in enumerate(zip(batch.column("__text").to_pylist(), batch.column("__rows").to_pylist())):
                if t is None:
                    continue
                at = tokens_at(t) if rows[0]["unit"] is not None else {}
                for r in rows:
                    value, unit = r["value"].strip(), r["unit"]
                    if unit is None:
                        found = mv.places(t, value)[0]
                    elif all(u in at for u in units_of(value)):
                        found = near(t, value, at[unit])
                    else:
                        continue
                    out += [(a, b, r["type"], t[a:b], r["value"]) for a, b in found]
                    ids += [i] * len(found)
            cols = [pa.array([r[k] for r in out], pa.int32() if k < 2 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(ids, pa.int64())), *cols], [key, "start", "end", "type", "text", "value"])

    return x.mapInArrow(run, shape).unionByName(y.mapInArrow(run, shape))


@F.arrow_udf(T.ArrayType(T.StringType()))
def units(values: pa.Array) -> pa.Array:
    """units_of as a column."""
    return pa.array([units_of((v or "").strip()) for v in values.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def tokens(texts: pa.Array) -> pa.Array:
    """The different tokens of each text."""
    return pa.array([list(tokens_at(t or "")) for t in texts.to_pylist()], pa.list_(pa.string()))


def needles(spans: DataFrame, scope: str, key: str = "doc_id") -> DataFrame:
    """(scope, low, type, value): distinct PERSON and COMPANY surfaces (the first span's type), safe ones (F07), without
    name heads (F08: a short CJK value that ends a longer company name of the scope)."""
    mine = spans.where(F.col("type").isin("PERSON", "COMPANY", "TRADEMARK"))
    n = mine.groupBy(scope, F.lower("text").alias("low")).agg(F.min_by("type", F.struct(key, "start")).alias("type"), F.min("text").alias("value"))
    tails = n.where(F.col("type").isin("COMPANY", "TRADEMARK")).select(scope, F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda k: k < F.length("low")), lambda k: F.substring("low", F.length("low") - k + 1, k))).alias("low")).distinct()
    heads = n.where((F.length("value") <= 3) & contains_cjk(F.col("value"))).join(tails, [scope, "low"], "left_semi").select(scope, "low")
    return n.where(F.col("type").isin("PERSON", "COMPANY")).where(mv.needle_safe("value")).join(heads, [scope, "low"], "left_anti")


def rescan(spans: DataFrame, docs: DataFrame, scope: str = "doc_id", key: str = "doc_id", extra: DataFrame | None = None, save=None) -> DataFrame:
    """The needles of a scope (and extra ones: scope, value, type, such as bound aliases) found again; hits that
    overlap a confirmed span are dropped, overlaps that are left go longest first. save: writes a frame and reads it back, to
    cut lineage between needles, hits and what is left of them."""
    from .spanalgebra import greedy, overlap_anti

    save = save or (lambda df: df)
    n = needles(spans, scope, key).select(scope, "value", "type")
    found = save(occurrences(save(n if extra is None else n.unionByName(extra.select(scope, "value", "type"))), docs, scope, key))
    return greedy(overlap_anti(found.select(key, "start", "end", "type", "text").dropDuplicates([key, "start", "end"]), spans, key), key)


def unswept(spans: DataFrame, docs: DataFrame, scope: str, key: str = "doc_id") -> DataFrame:
    """(key, start, end, type, text) of values confirmed in other documents of the scope that no span of this one covers."""
    from .spanalgebra import overlap_anti

    partners = spans.where(F.col("type").isin("PERSON", "COMPANY")).groupBy(scope, F.lower("text").alias("low")).agg(F.min(key).alias("__first"), F.max(key).alias("__last"))
    hits = occurrences(needles(spans, scope, key).select(scope, "value", "type"), docs, scope, key)
    own = docs.select(key, F.col(scope).alias("__s")).distinct()
    hits = hits.join(own, key).withColumn("low", F.lower("value")).join(partners.withColumnRenamed(scope, "__s"), ["__s", "low"])
    hits = hits.where((F.col("__first") != F.col(key)) | (F.col("__last") != F.col(key)))
    return overlap_anti(hits.select(key, "start", "end", "type", "text").distinct(), spans, key)


def aliases(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Short names in brackets bind to the nearest name that ends at most six characters before, with only blanks and
    closing quotes between, if they derive from it (F06)."""
    x = mv.alias_rows(docs, key, text)
    near = spans.where(F.col("type").isin("PERSON", "COMPANY")).select(key, F.col("end").alias("e"), F.col("text").alias("canonical"), "type")
    y = x.join(near, key).where((F.col("e") <= F.col("anchor")) & (F.col("e") >= F.col("anchor") - 6))
    y = y.withColumn("rk", F.row_number().over(Window.partitionBy(key, "anchor", "alias").orderBy(F.desc("e"), "canonical"))).where("rk = 1")
    gap = F.when(F.col("e") < F.col("anchor"), F.substring(F.col("lead"), F.length("lead") - (F.col("anchor") - F.col("e")) + 1, F.lit(6))).otherwise("")
    return y.where(gap.rlike("^[\\s\\x{A0}\\x{3000}\"'”’」』》]*$")).where(mv.is_derived("alias", "canonical")).select(key, "alias", "canonical", "type")


def precedent_released(spans: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """F13, simplified to captions: names in a `X v. Y` caption of a published opinion's first 25 lines are released."""
    head = docs.withColumn("__h", F.array_join(F.slice(F.split(text, "\n"), 1, 25), "\n")).where(F.col("__h").rlike(r"(?i)supreme court|court of appeals|指导案例|指导性案例"))
    caption = F.regexp_extract("__h", r"(?m)^.{1,120} v\.? .{1,120}$", 0)
    return spans.join(head.select(key, caption.alias("__c")).where("__c <> ''"), key).where(F.col("type").isin("PERSON", "COMPANY") & F.lower("__c").contains(F.lower("text"))).drop("__c")


# --- model rows -------------------------------------------------------------------------------------------------

TYPES = "PERSON COMPANY ADDRESS EMAIL PHONE BANK_ACCOUNT NATIONAL_ID USCC DATE AMOUNT CASE_NUMBER LICENSE_PLATE WECHAT_ID URL SEAL TRADEMARK".split()


def _balanced(text: str, a: str, b: str) -> list[str]:
    """Balanced regions opened by a, outermost first."""
    out, i = [], 0
    while (i := text.find(a, i)) >= 0:
        depth, quoted, k = 0, False, i
        while k < len(text):
            ch = text[k]
            if quoted:
                k += ch == "\\"
                quoted = ch != '"'
            elif ch == '"':
                quoted = True
            elif ch in "{[":
                depth += 1
            elif ch in "}]":
                depth -= 1
                if not depth:
                    break
            k += 1
        if k >= len(text):
            i += 1
            continue
        out.append(text[i : k + 1])
        i = k + 1
    return out


def parse_entities(raw: str | None) -> dict:
    """Rows of a model answer, and whether it was truncated or invalid."""
    text = (raw or "").strip()
    fenced = re.sub(r"^```\w*\s*|\s*```$", "", text).strip()
    bad_rows = False
    for t in dict.fromkeys((text, fenced)):
        tries = [t, *sorted(_balanced(t, "{", "}"), key=len)[-1:], *sorted(_balanced(t, "[", "]"), key=len)[-1:]]
        for cand in tries:
            try:
                v = json.loads(cand)
            except ValueError:
                continue
            rows = v.get("entities") if isinstance(v, dict) else v
            if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
                continue
            good = [(r["value"], r["type"].upper()) for r in rows if isinstance(r.get("value"), str) and r["value"] and isinstance(r.get("type"), str) and r["type"].upper() in TYPES]
            if len(good) == len(rows):
                return {"entities": good, "truncated": False, "invalid": False}
            bad_rows = True
            best = good
    if bad_rows:
        return {"entities": best, "truncated": False, "invalid": True}
    at = fenced.find("[")
    if at < 0:
        return {"entities": [], "truncated": False, "invalid": True}
    good = []
    for obj in _balanced(fenced[at + 1 :], "{", "}"):
        try:
            r = json.loads(obj)
        except ValueError:
            continue
        if isinstance(r.get("value"), str) and r["value"] and str(r.get("type", "")).upper() in TYPES:
            good.append((r["value"], r["type"].upper()))
    closed = fenced.rstrip().endswith(("]", "}")) and fenced.count("[") == fenced.count("]")
    return {"entities": good, "truncated": not closed, "invalid": closed}


def model_rows(segments: DataFrame) -> DataFrame:
    """(doc_id, segment, truncated, invalid, value, type): one row each entity, one with nulls where there is none. Keys of
    any type; a null answer is invalid."""
    kinds = [segments.schema[c].dataType.simpleString() for c in ("doc_id", "segment")]

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for d, s, raw in zip(pdf.doc_id, pdf.segment, pdf.raw_output):
                p = parse_entities(raw)
                out += [(d, s, p["truncated"], p["invalid"], v, k) for v, k in p["entities"] or [(None, None)]]
            yield pd.DataFrame(out, columns=["doc_id", "segment", "truncated", "invalid", "value", "type"])

    return segments.select("doc_id", "segment", "raw_output").mapInPandas(work, f"doc_id {kinds[0]}, segment {kinds[1]}, truncated boolean, invalid boolean, value string, type string")


BRIDGE = 600


def chunk(text: str, target: int = 2000, overlap: int = 350) -> list[tuple[int, int]]:
    """Chunk ranges; the end backs up to a paragraph, line, sentence or hard cut in the window's second half.
    A hard cut gets a chunk of BRIDGE on both sides where the overlap, 150 at least, is less than that."""
    out, at, n, overlap = [], 0, len(text), max(overlap, 150)
    while at < n:
        end, hard = min(n, at + target), False
        if end < n:
            half = at + target // 2
            for sep in ("\n\n", "\n", "。", ". "):
                cut = text.rfind(sep, half, end)
                if cut >= 0:
                    end = cut + len(sep)
                    break
            else:
                hard = True
        out.append((at, end))
        if end >= n:
            break
        if hard and overlap < BRIDGE and end - BRIDGE > at:
            out.append((end - BRIDGE, min(n, end + BRIDGE)))
        at = max(at + 1, end - overlap)
    return out


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = 2000, overlap: int = 350) -> DataFrame:
    """(key, chunk_no, start, text) of every document; null and empty texts have no chunk; keys of any type."""
    kind = docs.schema[key].dataType.simpleString()

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([(k, i, a, t[a:b]) for k, t in zip(pdf[key], pdf[text]) for i, (a, b) in enumerate(chunk(t or "", target, overlap))], columns=[key, "chunk_no", "start", "text"])

    return docs.select(key, text).mapInPandas(work, f"{key} {kind}, chunk_no int, start int, text string")


