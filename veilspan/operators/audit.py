"""Audit trails, reports, registries and batches as relations.

Edge cases: null keys form a group of their own; empty inputs give empty results; ties are broken by the last column
named in each docstring; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import table_cell

GENESIS = "0" * 64
EVENT = ("sequence", "call_id", "phase", "operation", "fingerprint", "bytes", "outcome")


def event_text(row: dict) -> bytes:
    return "\x1f".join("" if row[c] is None else str(row[c]) for c in EVENT).encode()


def chain_step(secret: bytes, row: dict, previous: str) -> str:
    return hmac.new(secret, event_text(row) + b"\x1f" + previous.encode(), hashlib.sha256).hexdigest()


def append_events(events: DataFrame, secret: bytes, session: str = "session_id") -> DataFrame:
    """Q01: events (session, sequence, ...) with previous_digest and digest: HMAC-SHA256 over the event and the digest
    before, zeros at a session's start. A session is one chain, made in order by one task; sessions run in parallel."""

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence", "ascending"), ("call_id", "ascending")])
        before, prev, digest = GENESIS, [], []
        for row in table.to_pylist():
            prev.append(before)
            before = chain_step(secret, row, before)
            digest.append(before)
        return table.append_column("previous_digest", pa.array(prev, pa.string())).append_column("digest", pa.array(digest, pa.string()))

    x = events.select(session, *EVENT)
    schema = T.StructType([*x.schema.fields, T.StructField("previous_digest", T.StringType()), T.StructField("digest", T.StringType())])
    return x.groupBy(session).applyInArrow(chain, schema)


def verify_chain(journal: DataFrame, secret: bytes, session: str = "session_id") -> DataFrame:
    """(session, sequence, valid, problem) of each record: the digest is its own, the previous one the last
    record's, the sequence without a gap. Digests are checked row by row, links by a window in the session."""

    @F.arrow_udf(T.StringType())
    def own(*cols: pa.Array) -> pa.Array:
        lists = [c.to_pylist() for c in cols]
        return pa.array([chain_step(secret, dict(zip(EVENT, row[:-1])), row[-1] or "") for row in zip(*lists)], pa.string())

    by = Window.partitionBy(session).orderBy("sequence", "digest")
    first = F.row_number().over(by) == 1
    x = journal.withColumns({"__own": own(*EVENT, "previous_digest"), "__last": F.lag("digest").over(by), "__seq": F.lag("sequence").over(by), "__first": first})
    problem = (
        F.when(F.col("digest") != F.col("__own"), "digest")
        .when(F.col("__first") & (F.col("previous_digest") != GENESIS), "genesis")
        .when(~F.col("__first") & (F.col("previous_digest") != F.col("__last")), "link")
        .when(~F.col("__first") & (F.col("sequence") != F.col("__seq") + 1), "gap")
    )
    return x.select(session, "sequence", problem.isNull().alias("valid"), problem.alias("problem"))


def retained(events: DataFrame, most: int = 5_000, order: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest `most` events. A top-k: each task keeps its own best, no task sorts the table."""
    return events.orderBy(F.desc(order), F.desc(tie)).limit(most)


def follow_up(batch: DataFrame) -> DataFrame:
    """Q07: (source, kind, note) of batch items that somebody must look at: failed ones with their reason, and finished ones
    with unboxed pages, media, tracked changes or released precedents."""
    flags = (("unboxed", "unboxed"), ("media", "media"), ("tracked_changes", "tracked changes"), ("precedent", "precedent"))
    found = F.array(F.when(F.col("status") == "failed", F.struct(F.lit("failed").alias("kind"), F.col("reason").alias("note"))), *[F.when((F.col("status") == "done") & (F.col(c) > 0), F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("note"))) for c, k in flags])
    return batch.select("source", F.inline(F.filter(found, lambda f: f.isNotNull())))


def rollup_batch(batch: DataFrame) -> DataFrame:
    """(folder, n, done, skipped, failed, replaced, seconds) by folder and over all (null)."""
    x = batch.withColumn("folder", F.when(F.col("source").contains("/"), F.regexp_extract("source", "^(.*)/", 1)).otherwise(""))
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return x.rollup("folder").agg(F.count("*").alias("n"), of("done"), of("skipped"), of("failed"), F.sum("replaced").alias("replaced"), F.round(F.sum("seconds"), 3).alias("seconds"))


def to_do(sources: DataFrame, finished: DataFrame, settings: str) -> DataFrame:
    """Sources (source, bytes, modified) that no finished item (source, bytes, modified, settings, status) covers
    with the same stamp and settings."""
    done = finished.where((F.col("status") == "done") & (F.col("settings") == settings)).select("source", "bytes", "modified").distinct()
    return sources.join(done, ["source", "bytes", "modified"], "left_anti")


def batch_layout(sources: DataFrame) -> DataFrame:
    """Q08: (source, target): the mirrored folder; a file whose base name clashes with another of its folder, case aside, gets
    a folder of its own name."""
    folder, name = F.regexp_extract("source", "^(.*/)?([^/]*)$", 1), F.regexp_extract("source", "^(.*/)?([^/]*)$", 2)
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    x = sources.select("source", folder.alias("folder"), name.alias("name"), base.alias("base"))
    clash = F.count("*").over(Window.partitionBy("folder", F.lower("base"))) > 1
    return x.select("source", F.concat("folder", F.when(clash, F.concat("name", F.lit("/"))).otherwise(""), "name").alias("target"))


def free_name(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(base, name): the base itself if no taken name has it, else the first <base>_N, N from 2."""
    t = taken.select("name").distinct()
    used = t.select(F.regexp_extract("name", r"^(.*)_([0-9]{1,9})$", 1).alias("base"), F.regexp_extract("name", r"^(.*)_([0-9]{1,9})$", 2).try_cast("int").alias("n")).where("n is not null")
    from .sessions import nth_free

    numbers = used.groupBy("base").agg(F.collect_set("n").alias("ns"))
    x = wanted.select("base").distinct().join(t.select(F.col("name").alias("base"), F.lit(True).alias("held")), "base", "left").join(numbers, "base", "left")
    n = nth_free(F.lit(1), F.col("ns"), 1)
    return x.select("base", F.when(F.col("held"), F.concat("base", F.lit("_"), n.cast("string"))).otherwise(F.col("base")).alias("name"))


def lineage(handles: DataFrame) -> DataFrame:
    """Q06: (handle, source_handle, source_workspace, known): derived handles with where they come from."""
    src = handles.select(F.col("handle").alias("source_handle"), F.col("workspace").alias("source_workspace"), F.lit(True).alias("known"))
    return handles.select("handle", "source_handle").join(src, "source_handle", "left").select("handle", "source_handle", "source_workspace", F.coalesce("known", F.col("source_handle").isNull()).alias("known"))


def portfolio(entities: DataFrame) -> DataFrame:
    """Q05: (client, n_entries, types, updated): summaries without any value."""
    return entities.groupBy("client").agg(F.count("*").alias("n_entries"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"), F.max("updated").alias("updated"))


def resolve_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(name, id, candidates, status) of names: an exact id, else a label (case aside): found, ambiguous or not found."""
    by_id = asked.join(known.select(F.col("id").alias("name"), F.col("id")), "name").select("name", "id", F.lit(0).alias("rank"))
    by_label = asked.join(known.select(F.lower("label").alias("low"), "id"), F.lower("name") == F.col("low")).select("name", "id", F.lit(1).alias("rank"))
    hits = by_id.unionByName(by_label).groupBy("name").agg(F.min(F.when(F.col("rank") == 0, F.col("id"))).alias("exact"), F.sort_array(F.collect_set("id")).alias("all"))
    x = asked.select("name").distinct().join(hits, "name", "left").withColumn("n", F.coalesce(F.size("all"), F.lit(0)))
    one = F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("n") == 1, F.col("all")[0])
    return x.select("name", one.alias("id"), F.when(one.isNull(), F.array_join("all", ",")).alias("candidates"), F.when(one.isNotNull(), "found").when(F.col("n") > 1, "ambiguous").otherwise("not found").alias("status"))


def ownership_conflicts(owners: DataFrame) -> DataFrame:
    """(label, ids): labels or aliases (owners: id, label, aliases) that two ids claim, and ids that occur twice."""
    claims = owners.select("id", F.explode(F.array_distinct(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("label")).where("label is not null")
    two = claims.select("id", F.lower(F.trim("label")).alias("label")).groupBy("label").agg(F.sort_array(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
    twice = owners.groupBy("id").count().where("count > 1").select(F.col("id").cast("string").alias("label"), F.array("id").alias("ids"))
    return two.unionByName(twice).select("label", F.array_join("ids", ",").alias("ids"))


def report(counts: DataFrame, title: str = "Report") -> DataFrame:
    """Q03: (scope, markdown): a table of counts (scope, type, n, note) for each scope, from counts alone, cells escaped."""
    cell = lambda c: table_cell(F.coalesce(c.cast("string"), F.lit("")))
    line = F.concat(F.lit("| "), cell(F.col("type")), F.lit(" | "), cell(F.col("n")), F.lit(" | "), cell(F.col("note")), F.lit(" |"))
    x = counts.select("scope", "type", "n", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "line"))), lambda s: s["line"]), "\n")
    head = F.concat(F.lit(f"# {title} "), cell(F.col("scope")), F.lit("\n\n| Type | Count | Note |\n| --- | --- | --- |\n"))
    return x.groupBy("scope").agg(body.alias("body"), F.sum("n").alias("total")).select("scope", F.concat(head, "body", F.lit("\n\nTotal: "), F.col("total").cast("string"), F.lit("\n")).alias("markdown"))


def security_summary(events: DataFrame) -> DataFrame:
    """Q02: (kind, scope, n, failures, last) of the security log."""
    return events.groupBy("kind", "scope").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failures"), F.max("ts").alias("last"))


def posture(calls: DataFrame) -> DataFrame:
    """Q04: (session, calls, bytes, raw): what crossed the boundary in each session."""
    return calls.groupBy("session").agg(F.count("*").alias("calls"), F.sum("bytes").alias("bytes"), F.bool_or("raw").alias("raw"))


def id_shape(ids: DataFrame, most: int = 10_000) -> DataFrame:
    """(request, ok, n_ids, n_bad) of id lists (request, ids): twelve lower-case hex digits each, `most` at most."""
    bad = F.size(F.filter("ids", lambda i: ~F.coalesce(i.rlike("^[0-9a-f]{12}$"), F.lit(False))))
    return ids.select("request", ((bad == 0) & (F.size("ids") <= most)).alias("ok"), F.size("ids").alias("n_ids"), bad.alias("n_bad"))


def handle_ok(c: Column) -> Column:
    return F.coalesce(c.rlike("^(doc|red|res)_[0-9a-f]{12}$"), F.lit(False))


def prompt_problems(prompts: DataFrame) -> DataFrame:
    """(name, missing) of prompts (name, text, slots, anchors) that lack a required slot or output anchor."""
    lack = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda s: ~F.coalesce(F.col("text"), F.lit("")).contains(s))
    return prompts.select("name", F.explode(F.concat(lack(F.col("slots")), lack(F.col("anchors")))).alias("missing"))


def session_label(created: Column, names: Column) -> Column:
    """The day, the first document and how many more."""
    more = F.size(names) - 1
    return F.concat(F.date_format(created, "yyyy-MM-dd"), F.lit(" "), F.coalesce(F.try_element_at(names, F.lit(1)), F.lit("empty")), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def learned(decisions: DataFrame) -> DataFrame:
    """(type, v, accepts, rejects, decision) of decisions (value, type, accepted), by learning key."""
    x = decisions.where(F.trim("value") != "").groupBy("type", F.lower(F.trim("value")).alias("v")).agg(F.count_if("accepted").alias("accepts"), F.count_if(~F.col("accepted")).alias("rejects"))
    return x.withColumn("decision", F.when(F.col("accepts") > F.col("rejects"), "redact").when(F.col("accepts") < F.col("rejects"), "keep").otherwise("undecided"))


def suppressed(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """spans without those whose learning key is net-rejected."""
    keep = learned(decisions).where("decision = 'keep'").select(F.col("type").alias("__t"), F.col("v").alias("__v"))
    return spans.join(keep, (F.col("type") == F.col("__t")) & (F.lower(F.trim("text")) == F.col("__v")), "left_anti")


def excluded(spans: DataFrame, rejected: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Spans without every occurrence of a rejected one's value (key, text) or of a rejected type (key, type; null
    text), and the tally (key, occurrences, distinct_values) of what stays visible."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    values = rejected.where("text is not null").select(F.col(key).alias("__k"), norm(F.col("text")).alias("__v")).distinct()
    types = rejected.where("text is null").select(F.col(key).alias("__k"), F.col("type").alias("__t")).distinct()
    by_value = (F.col(key) == F.col("__k")) & (norm(F.col("text")) == F.col("__v"))
    by_type = (F.col(key) == F.col("__k")) & (F.col("type") == F.col("__t"))
    kept = spans.join(values, by_value, "left_anti").join(types, by_type, "left_anti")
    out = spans.join(values, by_value, "left_semi").unionByName(spans.join(values, by_value, "left_anti").join(types, by_type, "left_semi"))
    tally = out.groupBy(key).agg(F.count("*").alias("occurrences"), F.countDistinct(norm(F.col("text"))).alias("distinct_values"))
    return kept, tally


def coverage_gate(segments: DataFrame, unanchored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status, incomplete, unanchored): documents with an incomplete segment (key, complete) or an unanchored value
    (key, value) are refused."""
    s = segments.groupBy(key).agg(F.count_if(~F.col("complete")).alias("incomplete"))
    u = unanchored.groupBy(key).agg(F.count("*").alias("unanchored"))
    x = s.join(u, key, "full").na.fill(0, ["incomplete", "unanchored"])
    return x.select(key, F.when((F.col("incomplete") > 0) | (F.col("unanchored") > 0), "refused").otherwise("ok").alias("status"), "incomplete", "unanchored")


def merge_profile(fields: DataFrame) -> DataFrame:
    """(key, value, confidence, verified, first_id): fields (id, key, value, confidence, verified) of equal key and
    normalized value are one: verified first, then the surest, then the first."""
    norm = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    best = F.struct((~F.col("verified")).alias("a"), (-F.col("confidence")).alias("b"), F.col("id").alias("c"))
    x = fields.withColumn("norm", norm).groupBy("key", "norm").agg(F.min_by(F.struct("value", "confidence", "verified"), best).alias("w"), F.min("id").alias("first_id"))
    return x.select("key", "w.value", "w.confidence", "w.verified", "first_id")


def conflicted(fields: DataFrame, single: tuple[str, ...]) -> DataFrame:
    """Single-valued keys with more than one distinct value."""
    norm = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    return fields.where(F.col("key").isin(*single)).groupBy("key").agg(F.countDistinct(norm).alias("n")).where("n > 1")


def grounded(fields: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fields (key, field, value, snippet, confidence) with the confidence capped at 0.4 where the snippet isn't in the
    document, case aside, or is empty."""
    x = fields.join(docs.select(key, F.col("text").alias("__t")), key, "left")
    found = (F.trim("snippet") != "") & F.lower("__t").contains(F.lower("snippet"))
    return x.withColumn("confidence", F.when(F.coalesce(found, F.lit(False)), F.col("confidence")).otherwise(F.least("confidence", F.lit(0.4)))).drop("__t")


def match_blanks(blanks: DataFrame, answers: DataFrame, fields: DataFrame, size: int = 12) -> DataFrame:
    """(doc_id, blank_no, batch, field, value) of a model's answers (doc_id, batch, blank, field, value): 1-based
    numbers within batches of `size` blanks, range-checked, the adapted value or else the field's own."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    b = blanks.withColumn("blank_no", n).withColumn("batch", F.floor((F.col("blank_no") - 1) / size).cast("int")).withColumn("blank", F.col("blank_no") - F.col("batch") * size)
    f = fields.withColumn("field", F.row_number().over(Window.partitionBy("doc_id").orderBy("id"))).select("doc_id", "field", F.col("value").alias("own"))
    return b.join(answers, ["doc_id", "batch", "blank"]).join(f, ["doc_id", "field"]).select("doc_id", "blank_no", "batch", "field", F.coalesce(F.nullif(F.trim("value"), F.lit("")), "own").alias("value"))


def blanks_to_fields(blanks: DataFrame, fields: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """(doc_id, blank_no, status, value, candidates): a blank's label, normalized, names a key by the synonyms; one field
    of that key proposes its value, several are candidates, none leaves the blank unmatched."""
    from ..functions.text import label_normalize

    names = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    b = blanks.withColumn("key", F.try_element_at(names, label_normalize(F.col("label"))))
    f = fields.groupBy("key").agg(F.sort_array(F.collect_set("value")).alias("values"))
    x = b.join(f, "key", "left").withColumn("n", F.coalesce(F.size("values"), F.lit(0)))
    return x.select("doc_id", "blank_no", F.when(F.col("n") == 1, "proposed").when(F.col("n") > 1, "candidates").otherwise("unmatched").alias("status"), F.when(F.col("n") == 1, F.col("values")[0]).alias("value"), F.when(F.col("n") > 1, F.array_join("values", "|")).alias("candidates"))


def apply_fill(docs: DataFrame, fills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) with confirmed fills (doc_id, id, start, end, expected, value, status, widget) put in,
    and the skipped ones (doc_id, id, reason). A document with a stale fill (its place no longer reads as expected) is
    refused whole."""
    from .mint import splice

    at = Window.partitionBy("doc_id", "start", "end").orderBy("id")
    x = fills.join(docs.select("doc_id", F.col("text").alias("__t")), "doc_id").withColumn("rk", F.row_number().over(at))
    now = F.substring(F.col("__t"), F.col("start") + 1, F.col("end") - F.col("start"))
    reason = (
        F.when(F.col("rk") > 1, "duplicate location").when(F.col("status") == "rejected", "rejected").when(F.col("status") == "unmatched", "no matching field")
        .when(F.col("status") != "confirmed", "not confirmed").when(F.coalesce("value", F.lit("")) == "", "confirmed without value").when(F.col("widget"), "manual widget")
    )
    x = x.withColumn("reason", reason).withColumn("stale", F.col("reason").isNull() & (now != F.col("expected")))
    refused = x.where("stale").select("doc_id").distinct()
    x = x.withColumn("reason", F.when(F.col("stale"), "stale").otherwise(F.col("reason"))).drop("__t")
    ok = x.where("reason is null").join(refused, "doc_id", "left_anti").select("doc_id", "start", "end", F.col("value").alias("token"))
    out = splice(docs.select("doc_id", "text"), ok).select("doc_id", F.col("tokenized").alias("filled"))
    return out, x.where("reason is not null").select("doc_id", "id", "reason")


def leaks(outputs: DataFrame, values: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, value) of protected values that an output still holds, both folded (P10): Latin ones as whole words,
    CJK ones literally, digits from six on. A document's values go with it as one array."""
    from ..functions.text import contains_cjk, fold_audit

    v = values.where(F.trim("value") != "").select(F.col(key).alias("__k"), "value", fold_audit(F.col("value")).alias("__f")).where("__f <> ''")
    v = v.where(~F.col("value").rlike("^[0-9\\s-]+$") | (F.length(F.regexp_replace("value", "[^0-9]", "")) >= 6))
    lists = v.groupBy("__k").agg(F.collect_set(F.struct("value", "__f")).alias("__all"))
    x = outputs.select(F.col(key).alias("__k"), F.concat(F.lit(" "), fold_audit(F.col("text")), F.lit(" ")).alias("__t")).join(lists, "__k")
    held = lambda s: F.when(contains_cjk(s["__f"]), F.col("__t").contains(s["__f"])).otherwise(F.col("__t").contains(F.concat(F.lit(" "), s["__f"], F.lit(" "))))
    return x.select(F.col("__k").alias(key), F.explode(F.transform(F.filter("__all", held), lambda s: s["value"])).alias("value"))


def malformed_braces(outputs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n) of outputs with nested or doubled braces."""
    n = F.regexp_count(F.col("text"), F.lit(r"\{\{|\}\}|\{[^{}]*\{"))
    return outputs.select(key, n.alias("n")).where("n > 0")


def document_class(text: Column) -> Column:
    """By the head of the text, white space folded: judgment, complaint, disclosure, letter, contract, generic, in this
    order."""
    head = F.lower(F.regexp_replace(F.substring(text, 1, 1500), r"\s+", " "))
    has = lambda *cues: F.coalesce(head.rlike("|".join(cues)), F.lit(False))
    return (
        F.when(has("judgment", "判决书", "裁定书", r"opinion of the court", r"\bv\. "), "judgment")
        .when(has("complaint", "起诉状", r"plaintiff", "statement of claim"), "complaint")
        .when(has("prospectus", "annual report", "form 10-[kq]", "招股说明书", "年度报告", "disclosure"), "disclosure")
        .when(has(r"^\W*dear ", " dear ", "尊敬的", "律师函", "yours (?:sincerely|faithfully)"), "letter")
        .when(has("agreement", "contract", "licen[sc]e", "合同", "协议", "hereinafter"), "contract")
        .otherwise("generic")
    )


def review_groups(spans: DataFrame, ranks: dict[str, int], key: str = "doc_id") -> DataFrame:
    """(key, type, v, n, accepted, token, place): spans by type and value, any accepted, the first token; in the order
    of the types' ranks, then first appearance."""
    x = spans.groupBy(key, "type", F.lower(F.trim("text")).alias("v")).agg(F.count("*").alias("n"), F.bool_or("accepted").alias("accepted"), F.min_by("token", "start").alias("token"), F.min("start").alias("at"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("type")), F.lit(len(ranks)))
    return x.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(rank, "at", "type", "v"))).drop("at")


def legend(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, type, n_values, occurrences, all_kept)."""
    return spans.groupBy(key, "type").agg(F.countDistinct(F.lower("text")).alias("n_values"), F.count("*").alias("occurrences"), F.bool_and("accepted").alias("all_kept"))


def uncovered(sites: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page, uncovered): by token, sites (page, token, start, end) beyond those that boxes (page, start, end) cover;
    sites nested in a longer one of the page don't count."""
    a = sites.select("page", F.col("start").alias("__s"), F.col("end").alias("__e")).distinct()
    own = sites.distinct().join(a.withColumnRenamed("page", "__p"), (F.col("page") == F.col("__p")) & (F.col("__s") <= F.col("start")) & (F.col("end") <= F.col("__e")) & (F.col("__e") - F.col("__s") > F.col("end") - F.col("start")), "left_anti")
    b = boxes.select(F.col("page").alias("__p"), F.col("start").alias("__s"), F.col("end").alias("__e")).distinct()
    covered = own.join(b, (F.col("page") == F.col("__p")) & (F.col("__s") <= F.col("start")) & (F.col("end") <= F.col("__e")), "left_semi").groupBy("page", "token").agg(F.count("*").alias("c"))
    x = own.groupBy("page", "token").agg(F.count("*").alias("n")).join(covered, ["page", "token"], "left")
    return x.groupBy("page").agg(F.sum(F.greatest(F.lit(0), F.col("n") - F.coalesce("c", F.lit(0)))).alias("uncovered"))
