"""Queries of audit trails, batches, registries, reviews, fills and windows over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, locate, segments
from .registry import query, table

SECRET = b"a key of the session"


@query("q01_audit_chain", "SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 5 <> 3 AS valid FROM events")
def audit_chain(spark, sf):
    """Chains of the events of each user; every fifth record is tampered with and must be found."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("sequence", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint"))
    e = e.select(F.col("user_id").alias("session_id"), "sequence", F.col("event_id").cast("string").alias("call_id"), F.lit("end").alias("phase"), F.col("event_type").alias("operation"), F.lit(None).cast("string").alias("fingerprint"), F.col("event_id").alias("bytes"), F.lit("ok").alias("outcome"))
    j = audit.append_events(e, SECRET).withColumn("bytes", F.when(F.col("sequence") % 5 == 3, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return audit.verify_chain(j, SECRET).drop("problem")


@query("q01_broken_links", "SELECT * FROM (VALUES (1, 1, 'genesis'), (1, 3, 'gap'), (2, 2, 'link')) AS t(session_id, sequence, problem)")
def broken_links(spark, sf):
    e = spark.createDataFrame([(s, n, f"c{n}", "end", "op", None, n, "ok") for s in (1, 2) for n in (1, 2, 3)], "session_id int, sequence long, call_id string, phase string, operation string, fingerprint string, bytes long, outcome string")
    j = audit.append_events(e, SECRET).collect()
    rows = []
    for r in j:
        d = r.asDict()
        if (r.session_id, r.sequence) == (1, 1):
            d["previous_digest"] = "f" * 64
            d["digest"] = audit.chain_step(SECRET, d, d["previous_digest"])
        if (r.session_id, r.sequence) == (1, 2):
            first = next(x for x in rows if x["session_id"] == 1)
            d["previous_digest"] = first["digest"]
            d["digest"] = audit.chain_step(SECRET, d, d["previous_digest"])
        if (r.session_id, r.sequence) == (1, 3):
            second = next(x for x in rows if (x["session_id"], x["sequence"]) == (1, 2))
            d["previous_digest"] = second["digest"]
            d["sequence"] = 3
            d["digest"] = audit.chain_step(SECRET, d | {"sequence": 4}, d["previous_digest"])
            d["sequence"] = 4
        if (r.session_id, r.sequence) == (2, 2):
            d["previous_digest"] = "0" * 64
            d["digest"] = audit.chain_step(SECRET, d, d["previous_digest"])
        if (r.session_id, r.sequence) == (2, 3):
            d["previous_digest"] = next(x for x in rows if (x["session_id"], x["sequence"]) == (2, 2))["digest"]
            d["digest"] = audit.chain_step(SECRET, d, d["previous_digest"])
        rows.append(d)
    out = audit.verify_chain(spark.createDataFrame(rows, "session_id int, sequence long, call_id string, phase string, operation string, fingerprint string, bytes long, outcome string, previous_digest string, digest string"), SECRET)
    return out.where("not valid").select("session_id", F.when(F.col("sequence") == 4, 3).otherwise(F.col("sequence")).cast("int").alias("sequence"), "problem")


@query("q02_security_summary", "SELECT event_type AS kind, user_id % 10 AS scope, count(*) AS n, count(*) FILTER (value < 50) AS failures, max(event_id) AS last FROM events GROUP BY ALL")
def security_summary(spark, sf):
    return audit.security_summary(table(spark, sf, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 10).alias("scope"), (F.col("value") >= 50).alias("ok"), F.col("event_id").alias("ts")))


@query("q03_report", "SELECT lang AS scope, '# Report ' || coalesce(lang, '') || chr(10) || chr(10) || '| Type | Count | Note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || coalesce(source, '') || ' | ' || n || ' | a\\|b |', chr(10) ORDER BY source NULLS FIRST) || chr(10) || chr(10) || 'Total: ' || sum(n) || chr(10) AS markdown FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def report(spark, sf):
    return audit.report(table(spark, sf, "documents").groupBy(F.col("lang").alias("scope"), F.col("source").alias("type")).agg(F.count("*").alias("n")).withColumn("note", F.lit("a|b")))


@query("q04_boundary_posture", "SELECT user_id AS session, count(*) AS calls, sum(event_id) AS bytes, bool_or(value < 1) AS raw FROM events GROUP BY user_id")
def posture(spark, sf):
    return audit.posture(table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("bytes"), (F.col("value") < 1).alias("raw")))


@query("q05_portfolio", "SELECT c_nationkey AS client, count(*) AS n_entries, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS types, max(c_custkey) AS updated FROM customer GROUP BY c_nationkey")
def portfolio(spark, sf):
    return audit.portfolio(table(spark, sf, "customer").select(F.col("c_nationkey").alias("client"), F.col("c_mktsegment").alias("type"), F.col("c_custkey").alias("updated")))


@query("q06_lineage", "SELECT * FROM (VALUES ('red_1', 'doc_1', 'w1', true), ('doc_1', NULL, NULL, true), ('res_1', 'red_9', NULL, false)) AS t(handle, source_handle, source_workspace, known)")
def lineage(spark, sf):
    return audit.lineage(spark.createDataFrame([("doc_1", None, "w1"), ("red_1", "doc_1", "w1"), ("res_1", "red_9", "w2")], "handle string, source_handle string, workspace string"))


@query("q07_follow_up", "SELECT o_orderkey AS source, 'failed' AS kind, o_orderpriority AS note FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'media', CAST(o_orderkey % 3 AS VARCHAR) FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 3 > 0")
def follow_up(spark, sf):
    o = table(spark, sf, "orders")
    return audit.follow_up(o.select(F.col("o_orderkey").alias("source"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), F.col("o_orderpriority").alias("reason"), F.lit(0).alias("unboxed"), (F.col("o_orderkey") % 3).alias("media"), F.lit(0).alias("tracked_changes"), F.lit(0).alias("precedent")))


LAYOUT_SQL = "SELECT 'd' || p_size || '/' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.TXT' ELSE '.pdf' END AS source FROM part"


@query("q08_batch_layout", f"SELECT source, regexp_extract(source, '^(.*/)') || CASE WHEN count(*) OVER (PARTITION BY lower(regexp_replace(source, '\\.[^.]*$', ''))) > 1 THEN regexp_extract(source, '[^/]*$') || '/' ELSE '' END || regexp_extract(source, '[^/]*$') AS target FROM (SELECT DISTINCT source FROM ({LAYOUT_SQL}))")
def batch_layout(spark, sf):
    p = table(spark, sf, "part")
    ext = F.when(F.col("p_partkey") % 3 == 0, ".txt").when(F.col("p_partkey") % 3 == 1, ".TXT").otherwise(".pdf")
    return audit.batch_layout(p.select(F.concat(F.lit("d"), F.col("p_size").cast("string"), F.lit("/"), "p_brand", ext).alias("source")).distinct())


@query("a03_batch_rollup", "SELECT 'f' || o_orderkey % 7 AS folder, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS done, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus = 'F') AS failed, sum(o_orderkey % 5) AS replaced, round(sum(o_totalprice), 3) AS seconds FROM orders GROUP BY ROLLUP ('f' || o_orderkey % 7)")
def batch_rollup(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "done").when(F.col("o_orderstatus") == "P", "skipped").otherwise("failed")
    return audit.rollup_batch(o.select(F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("source"), status.alias("status"), (F.col("o_orderkey") % 5).alias("replaced"), F.col("o_totalprice").alias("seconds")))


@query("j21_incremental_anti", "SELECT o_orderkey AS source, o_custkey AS bytes, o_orderkey % 11 AS modified FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0)")
def incremental(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("bytes"), (F.col("o_orderkey") % 11).alias("modified"), "o_orderstatus")
    done = s.where("o_orderstatus = 'F'").select("source", "bytes", F.when(F.col("source") % 5 == 0, F.col("modified") + 1).otherwise(F.col("modified")).alias("modified"), F.when(F.col("source") % 2 == 0, "s1").otherwise("s2").alias("settings"), F.lit("done").alias("status"))
    return audit.to_do(s.drop("o_orderstatus"), done, "s1")


@query("o03_retention_cap", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 5000")
def retention(spark, sf):
    return audit.retained(table(spark, sf, "events").select("event_id", "event_type"), order="event_id")


@query("s12_free_names", "SELECT * FROM (VALUES ('a', 'a_3'), ('b', 'b'), ('c', 'c_2')) AS t(base, name)")
def free_names(spark, sf):
    taken = spark.createDataFrame([("a",), ("a_2",), ("a_4",), ("b_2",), ("c",)], "name string")
    return audit.free_name(spark.createDataFrame([("a",), ("b",), ("c",)], "base string"), taken)


@query("j24_name_or_id", "SELECT lower(n_name) AS name, CAST(n_nationkey AS VARCHAR) AS id, NULL AS candidates, 'found' AS status FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), CAST(n_nationkey AS VARCHAR), NULL, 'found' FROM nation UNION ALL SELECT 'twin', NULL, 'x1,x2', 'ambiguous' UNION ALL SELECT 'nowhere', NULL, NULL, 'not found'")
def name_or_id(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"))
    known = n.union(spark.createDataFrame([("x1", "Twin"), ("x2", "TWIN")], "id string, label string"))
    asked = n.select(F.lower("label").alias("name")).union(n.select("id")).union(spark.createDataFrame([("twin",), ("nowhere",)], "name string"))
    return audit.resolve_names(asked, known)


@query("f21_ownership_conflicts", "SELECT * FROM (VALUES ('acme', '1,2'), ('3', '3')) AS t(label, ids)")
def ownership(spark, sf):
    o = spark.createDataFrame([("1", "Acme", ["A"]), ("2", "Bay", ["acme "]), ("3", "Cy", []), ("3", "Cy", None)], "id string, label string, aliases array<string>")
    return audit.ownership_conflicts(o)


@query("f19_id_shape", "SELECT * FROM (VALUES (1, true, 2, 0), (2, false, 2, 1), (3, false, 3, 0)) AS t(request, ok, n_ids, n_bad)")
def id_shape(spark, sf):
    r = spark.createDataFrame([(1, ["0123456789ab", "ffffffffffff"]), (2, ["0123456789AB", "ffffffffffff"]), (3, ["0123456789ab"] * 3)], "request int, ids array<string>")
    return audit.id_shape(r, most=2)


@query("f24_prompt_problems", "SELECT * FROM (VALUES ('b', '{text}'), ('b', '\"entities\"')) AS t(name, missing)")
def prompt_problems(spark, sf):
    p = spark.createDataFrame([("a", 'read {text} and give "entities"', ["{text}"], ['"entities"']), ("b", "read", ["{text}"], ['"entities"']), ("c", "", None, None)], "name string, text string, slots array<string>, anchors array<string>")
    return audit.prompt_problems(p)


@query("c05_session_label", "SELECT * FROM (VALUES (1, '2024-01-05 a.txt +2'), (2, '2024-01-05 b.txt'), (3, '2024-01-05 empty')) AS t(id, label)")
def session_label(spark, sf):
    d = spark.createDataFrame([(1, ["a.txt", "b", "c"]), (2, ["b.txt"]), (3, [])], "id int, names array<string>")
    return d.select("id", audit.session_label(F.lit("2024-01-05 10:00:00").cast("timestamp"), F.col("names")).alias("label"))


DECISIONS_SQL = "SELECT type, v, count(*) FILTER (a) AS accepts, count(*) FILTER (NOT a) AS rejects, CASE WHEN count(*) FILTER (a) > count(*) FILTER (NOT a) THEN 'redact' WHEN count(*) FILTER (a) < count(*) FILTER (NOT a) THEN 'keep' ELSE 'undecided' END AS decision FROM (SELECT o_orderstatus AS type, lower(o_orderpriority) AS v, o_orderkey % 2 = 0 AS a FROM orders) GROUP BY type, v"


def decisions(spark, sf):
    return table(spark, sf, "orders").select(F.concat(F.lit(" "), "o_orderpriority").alias("value"), F.col("o_orderstatus").alias("type"), (F.col("o_orderkey") % 2 == 0).alias("accepted"))


query("a04_learned_decisions", DECISIONS_SQL)(lambda spark, sf: audit.learned(decisions(spark, sf)))
query("o02_most_reinforced", f"SELECT type, v, accepts + rejects AS n FROM ({DECISIONS_SQL})")(lambda spark, sf: audit.learned(decisions(spark, sf)).select("type", "v", (F.col("accepts") + F.col("rejects")).alias("n")).orderBy(F.desc("n"), "type", "v"))


@query("f12_suppression", f"SELECT o_orderkey AS doc_id, o_orderpriority AS text FROM orders WHERE NOT EXISTS (SELECT 1 FROM ({DECISIONS_SQL}) d WHERE d.decision = 'keep' AND d.type = o_orderstatus AND d.v = lower(o_orderpriority))")
def suppression(spark, sf):
    spans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("text"))
    return audit.suppressed(spans, decisions(spark, sf)).drop("type")


EXCLUDED = "(c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0 OR c_acctbal < 0 AND c_nationkey = 1)"


def exclusions(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc_id"), F.when(F.col("c_acctbal") < 0, "DEBTOR").otherwise("OTHER").alias("type"), F.col("c_mktsegment").alias("text"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"))
    rejected = n.where("doc_id % 2 = 0").select("doc_id", F.lit(None).cast("string").alias("type"), F.lit(" building ").alias("text")).union(n.where("doc_id = 1").select("doc_id", F.lit("DEBTOR"), F.lit(None).cast("string")))
    return audit.excluded(c, rejected)


query("f11_exclusion", f"SELECT c_nationkey AS doc_id, CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE 'OTHER' END AS type, c_mktsegment AS text FROM customer WHERE NOT {EXCLUDED}")(lambda spark, sf: exclusions(spark, sf)[0])
query("a08_exclusion_tally", f"SELECT c_nationkey AS doc_id, count(*) AS occurrences, count(DISTINCT c_mktsegment) AS distinct_values FROM customer WHERE {EXCLUDED} GROUP BY c_nationkey")(lambda spark, sf: exclusions(spark, sf)[1])


@query("f17_coverage_gate", "SELECT conv_id, CASE WHEN count(*) FILTER (length(text) < 40) + count(*) FILTER (text LIKE '%?%') > 0 THEN 'refused' ELSE 'ok' END AS status, count(*) FILTER (length(text) < 40) AS incomplete, count(*) FILTER (text LIKE '%?%') AS unanchored FROM conversations GROUP BY conv_id")
def coverage(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null")
    return audit.coverage_gate(c.select("conv_id", (F.length("text") >= 40).alias("complete")), c.where(F.col("text").contains("?")).select("conv_id", F.lit("v").alias("value")), "conv_id")


FIELDS_SQL = "SELECT c_custkey AS id, c_mktsegment AS key, CASE WHEN c_custkey % 2 = 0 THEN 'v ' ELSE 'V  ' END || c_nationkey AS value, c_custkey % 10 / 10.0 AS confidence, c_custkey % 7 = 0 AS verified FROM customer"


def fields(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    return c.select(k.alias("id"), F.col("c_mktsegment").alias("key"), F.concat(F.when(k % 2 == 0, "v ").otherwise("V  "), F.col("c_nationkey").cast("string")).alias("value"), (k % 10 / 10.0).alias("confidence"), (k % 7 == 0).alias("verified"))


query("a05_profile_merge", f"SELECT key, value, CAST(confidence AS DOUBLE) AS confidence, verified, first_id FROM (SELECT *, row_number() OVER w AS rk, min(id) OVER (PARTITION BY key, n) AS first_id FROM (SELECT *, lower(regexp_replace(value, '\\s+', ' ', 'g')) AS n FROM ({FIELDS_SQL})) WINDOW w AS (PARTITION BY key, n ORDER BY verified DESC, confidence DESC, id)) WHERE rk = 1")(lambda spark, sf: audit.merge_profile(fields(spark, sf)))
query("a06_conflicted_keys", f"SELECT key, count(DISTINCT lower(regexp_replace(value, '\\s+', ' ', 'g'))) AS n FROM ({FIELDS_SQL}) WHERE key IN ('BUILDING', 'MACHINERY') GROUP BY key HAVING count(DISTINCT lower(regexp_replace(value, '\\s+', ' ', 'g'))) > 1")(lambda spark, sf: audit.conflicted(fields(spark, sf), ("BUILDING", "MACHINERY")))


@query("j15_snippet_grounding", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND coalesce(trim(substr(text, 3, 12)), '') <> '' THEN 0.9 ELSE 0.4 END AS confidence FROM documents")
def grounding(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    f = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.substring("text", 3, 12)).otherwise("~ not in any text ~").alias("snippet"), F.lit(0.9).alias("confidence"))
    return audit.grounded(f, d).select("doc_id", "confidence")


@query("j14_model_blank_match", "SELECT * FROM (VALUES (1, 1, 0, 1, 'own 7'), (1, 13, 1, 2, 'adapted')) AS t(doc_id, blank_no, batch, field, value)")
def blank_match(spark, sf):
    b = spark.createDataFrame([(1, i * 10) for i in range(14)], "doc_id int, start int")
    a = spark.createDataFrame([(1, 0, 1, 1, " "), (1, 1, 1, 2, "adapted"), (1, 0, 13, 1, "x"), (1, 0, 2, 9, "x"), (1, 5, 1, 1, "x")], "doc_id int, batch int, blank int, field int, value string")
    f = spark.createDataFrame([(1, 7, "own 7"), (1, 9, "own 9")], "doc_id int, id int, value string")
    return audit.match_blanks(b, a, f)


@query("j13_blank_to_field", "SELECT * FROM (VALUES (1, 1, 'proposed', 'Ann', NULL), (1, 2, 'candidates', NULL, 'Pier 1|Quay 2'), (1, 3, 'unmatched', NULL, NULL)) AS t(doc_id, blank_no, status, value, candidates)")
def blank_to_field(spark, sf):
    b = spark.createDataFrame([(1, 1, "Please insert the name of Client:"), (1, 2, "Address"), (1, 3, "fax")], "doc_id int, blank_no int, label string")
    f = spark.createDataFrame([("client_name", "Ann"), ("address", "Quay 2"), ("address", "Pier 1")], "key string, value string")
    return audit.blanks_to_fields(b, f, {"client": "client_name", "address": "address"})


FILL_OK = "doc_id % 4 = 0 AND length(text) > 3"


def fills(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    one = d.where(F.length("text") > 3).select("doc_id", F.lit(1).alias("id"), F.lit(1).alias("start"), F.lit(3).alias("end"), F.when(F.col("doc_id") % 4 == 1, "~~").otherwise(F.substring("text", 2, 2)).alias("expected"), F.lit("[X]").alias("value"), F.when(F.col("doc_id") % 4 == 2, "proposed").otherwise("confirmed").alias("status"), (F.col("doc_id") % 4 == 3).alias("widget"))
    return audit.apply_fill(d, one.unionByName(one.where("doc_id % 8 = 0").withColumn("id", F.lit(2))))


query("c04_fill_apply", f"SELECT doc_id, CASE WHEN {FILL_OK} THEN substr(text, 1, 1) || '[X]' || substr(text, 4) ELSE text END AS filled FROM documents")(lambda spark, sf: fills(spark, sf)[0])
query("c06_fill_skip_reasons", "SELECT doc_id, 1 AS id, CASE doc_id % 4 WHEN 1 THEN 'stale' WHEN 2 THEN 'not confirmed' ELSE 'manual widget' END AS reason FROM documents WHERE doc_id % 4 <> 0 AND length(text) > 3 UNION ALL SELECT doc_id, 2, 'duplicate location' FROM documents WHERE doc_id % 8 = 0 AND length(text) > 3")(lambda spark, sf: fills(spark, sf)[1])


@query("f15_leak_audit", "SELECT doc_id, lang AS value FROM documents WHERE lang IS NOT NULL AND contains(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g') || ' ', ' ' || lang || ' ')")
def leak_audit(spark, sf):
    d = table(spark, sf, "documents")
    return audit.leaks(d.select("doc_id", "text"), d.where("lang is not null").select("doc_id", F.col("lang").alias("value")))


@query("f22_malformed", "SELECT * FROM (VALUES (1, 2), (3, 1)) AS t(doc_id, n)")
def malformed(spark, sf):
    return audit.malformed_braces(spark.createDataFrame([(1, "{{A_1}}"), (2, "{A_1} {B_2}"), (3, "{A {B_2}"), (4, None)], "doc_id int, text string"))


HEAD = "lower(regexp_replace(substr(text, 1, 1500), '\\s+', ' ', 'g'))"


@query("c01_document_class", f"""SELECT doc_id, CASE WHEN regexp_matches({HEAD}, 'judgment|判决书|裁定书|opinion of the court|\\bv\\. ') THEN 'judgment' WHEN regexp_matches({HEAD}, 'complaint|起诉状|plaintiff|statement of claim') THEN 'complaint'
 WHEN regexp_matches({HEAD}, 'prospectus|annual report|form 10-[kq]|招股说明书|年度报告|disclosure') THEN 'disclosure' WHEN regexp_matches({HEAD}, '^\\W*dear | dear |尊敬的|律师函|yours (?:sincerely|faithfully)') THEN 'letter'
 WHEN regexp_matches({HEAD}, 'agreement|contract|licen[sc]e|合同|协议|hereinafter') THEN 'contract' ELSE 'generic' END AS class FROM documents""")
def document_class(spark, sf):
    return table(spark, sf, "documents").select("doc_id", audit.document_class(F.col("text")).alias("class"))


def reviewed(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_nationkey").alias("doc_id"), F.col("c_mktsegment").alias("type"), F.concat(F.lit(" V"), (F.col("c_custkey") % 3).cast("string")).alias("text"), F.col("c_custkey").alias("start"), (F.col("c_acctbal") > 0).alias("accepted"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token"))


query("a22_review_groups", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE type WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, first_at, type, v) AS place FROM (SELECT c_nationkey AS doc_id, c_mktsegment AS type, 'v' || c_custkey % 3 AS v, count(*) AS n, bool_or(c_acctbal > 0) AS accepted, 't' || min(c_custkey) AS token, min(c_custkey) AS first_at FROM customer GROUP BY ALL)".replace("SELECT *, row_number", "SELECT doc_id, type, v, n, accepted, token, row_number"))(lambda spark, sf: audit.review_groups(reviewed(spark, sf), {"MACHINERY": 0, "BUILDING": 1}))
query("a23_legend", "SELECT c_nationkey AS doc_id, c_mktsegment AS type, count(DISTINCT c_custkey % 3) AS n_values, count(*) AS occurrences, bool_and(c_acctbal > 0) AS all_kept FROM customer GROUP BY ALL")(lambda spark, sf: audit.legend(reviewed(spark, sf)))


@query("a21_uncovered", "SELECT * FROM (VALUES (1, 2), (2, 0)) AS t(page, uncovered)")
def uncovered(spark, sf):
    s = spark.createDataFrame([(1, "A", 0, 5), (1, "A", 10, 15), (1, "B", 20, 40), (1, "C", 25, 30), (2, "A", 0, 5)], "page int, token string, start int, end int")
    return audit.uncovered(s, spark.createDataFrame([(1, 0, 6), (2, 0, 5)], "page int, start int, end int"))


# --- windows over texts -------------------------------------------------------------------------------------------


@query("m12_paragraph_segments", "SELECT doc_id, coalesce(text, '') AS text, true AS short FROM documents WHERE text <> ''")
def paragraph_segments(spark, sf):
    """Pieces put together are the text, and none is too long."""
    s = segments.paragraph_segments(table(spark, sf, "documents").select("doc_id", "text"), limit=800)
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "part"))), lambda x: x["part"]), "").alias("text"), (F.max(F.length("part")) <= 800).alias("short"))


@query("m11_pack_segments", "SELECT doc_id, true AS covered, true AS sliced FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''")
def pack_segments(spark, sf):
    """Windows hold every character that isn't blank, and are slices of the text."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    s = segments.pack_segments(d).join(d, "doc_id")
    x = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("w"), F.first("text").alias("text"), F.bool_and(F.col("part") == F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))).alias("sliced"))
    gaps = F.transform("w", lambda x, i: F.trim(F.substring(F.col("text"), F.coalesce(F.get("w", i - 1)["end"], F.lit(0)) + 1, F.greatest(F.lit(0), x["start"] - F.coalesce(F.get("w", i - 1)["end"], F.lit(0))))))
    return x.select("doc_id", F.forall(gaps, lambda g: g == "").alias("covered"), "sliced")


@query("m10_chunk_cover", "SELECT doc_id, true AS covered, true AS sliced FROM documents WHERE length(text) > 0")
def chunk_cover(spark, sf):
    """Chunks leave no gap, reach the end, and are slices of the text."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("whole"))
    c = locate.chunks(table(spark, sf, "documents")).withColumn("end", F.col("start") + F.length("text")).join(d, "doc_id")
    x = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "start", "end"))).alias("w"), F.first("whole").alias("whole"), F.bool_and(F.col("text") == F.substring(F.col("whole"), F.col("start") + 1, F.length("text"))).alias("sliced"))
    reach = F.aggregate("w", F.lit(0), lambda a, v: F.when(v["start"] <= a, F.greatest(a, v["end"])).otherwise(F.lit(-1)))
    return x.select("doc_id", (reach == F.length("whole")).alias("covered"), "sliced")


@query("m13_token_windows", "SELECT doc_id, CAST(w AS INTEGER) AS window, CAST(w * 4 AS INTEGER) AS first FROM (SELECT doc_id, unnest(range(0, CASE WHEN n <= 8 THEN 1 ELSE CAST(ceil((n - 8) / 4.0) AS INTEGER) + 1 END)) AS w FROM (SELECT doc_id, least(30, length(text)) AS n FROM documents WHERE length(text) > 0))")
def token_windows(spark, sf):
    t = table(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", F.sequence(F.lit(1), F.least(F.lit(30), F.length("text"))).alias("ids"))
    return segments.token_windows(t, 10, 4).drop("ids")


@query("m14_decode_tags", "SELECT * FROM (VALUES (1, 5, 7, 'PERSON', false), (1, 8, 9, 'PERSON', true)) AS t(doc_id, start, \"end\", label, edge)")
def decode_tags(spark, sf):
    o, b, e, s = ([5.0 * (k == i) for k in range(5)] for i in (0, 1, 3, 4))
    w = spark.createDataFrame([(1, 4, [o, b, e, o, s]), (2, 0, [])], "doc_id int, first int, scores array<array<double>>")
    return segments.decode_tags(w, ["PERSON"]).drop("score")


@query("m06_merge_windows", "SELECT * FROM (VALUES (1, 0, 3, 'PERSON', 0.9, false), (1, 5, 7, 'DATE', 0.4, true)) AS t(doc_id, start, \"end\", label, score, edge)")
def merge_windows(spark, sf):
    s = spark.createDataFrame([(1, 0, 3, "PERSON", 0.5, True), (1, 0, 3, "PERSON", 0.9, False), (1, 2, 4, "DATE", 0.99, True), (1, 5, 7, "DATE", 0.4, True)], "doc_id int, start int, end int, label string, score double, edge boolean")
    return segments.merge_windows(s)


@query("m08_snap_to_words", "SELECT * FROM (VALUES (1, 0, 8, 'PERSON', 'Johansen'), (2, 4, 8, 'PERSON', 'Anna'), (3, 2, 5, 'DATE', 'abc')) AS t(doc_id, start, \"end\", type, text)")
def snap(spark, sf):
    d = spark.createDataFrame([(1, "Johansen came"), (2, "mad Annabel, Anna"), (3, "x abc ")], "doc_id int, text string")
    s = spark.createDataFrame([(1, 2, 6, "PERSON"), (2, 4, 8, "PERSON"), (3, 1, 6, "DATE")], "doc_id int, start int, end int, type string")
    return segments.snap_to_words(s, d)


@query("d24_blanks", "SELECT * FROM (VALUES (1, 5, 13, 'Client', 'Name ', ' and ____ x'), (1, 18, 22, '', 'Name [Client] and ', ' x'), (2, 0, 8, 'Date', '', ' ok'), (3, 0, 6, '__x', '', '')) AS t(doc_id, start, \"end\", label, before, after) WHERE doc_id < 3 UNION ALL SELECT 3, 0, 6, 'a__b', '', ''")
def blanks(spark, sf):
    return segments.blanks(spark.createDataFrame([(1, "Name [Client] and ____ x"), (2, "{{Date}} ok"), (3, "[a__b]"), (4, None)], "doc_id int, text string"))


@query("p34_squeeze", "SELECT * FROM (VALUES (1, 'a b', '1,2,4'), (2, '合同', '0,3'), (3, '', '')) AS t(doc_id, squeezed, places)")
def squeeze(spark, sf):
    return segments.squeeze(spark.createDataFrame([(1, " a \tb "), (2, "合  同"), (3, " ")], "doc_id int, text string")).select("doc_id", "squeezed", F.array_join("at", ",").alias("places"))


@query("m17_join_boxes", "SELECT * FROM (VALUES (1, 0.0, 0.0, 9.0, 9.0), (1, 20.0, 0.0, 21.0, 1.0)) AS t(image_id, x0, y0, x1, y1)")
def boxes(spark, sf):
    b = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 9.0), (1, 1.0, 8.0, 9.0, 9.0), (1, 8.0, 0.0, 9.0, 1.0), (1, 20.0, 0.0, 21.0, 1.0)], "image_id int, x0 double, y0 double, x1 double, y1 double")
    return segments.join_boxes(b)


@query("m18_protect_value", "SELECT * FROM (VALUES (1, 0, 4, 'PERSON', 'Anna', 'manual', 120), (1, 10, 20, 'COMPANY', 'Anna & Sons', 'llm', 30), (1, 30, 34, 'PERSON', 'Anna', 'manual', 120)) AS t(doc_id, start, \"end\", type, text, source, priority)")
def protect(spark, sf):
    s = spark.createDataFrame([(1, 0, 4, "COMPANY", "Anna", "llm", 30), (1, 10, 20, "COMPANY", "Anna & Sons", "llm", 30), (1, 28, 32, "DATE", "x An", "llm", 40)], "doc_id int, start int, end int, type string, text string, source string, priority int")
    h = spark.createDataFrame([(1, 0, 4, "Anna"), (1, 10, 14, "Anna"), (1, 30, 34, "Anna")], "doc_id int, start int, end int, text string")
    return segments.protect_value(s, h, "PERSON")


@query("d25_key_sections", "SELECT * FROM (VALUES (1, 'b' || chr(10) || 'c fee' || chr(10) || 'fee d' || chr(10) || 'Fee e' || chr(10) || 'f' || chr(10) || 'g'), (2, 'ab' || chr(10) || 'j')) AS t(doc_id, part) WHERE doc_id = 2 UNION ALL SELECT 1, 'a' || chr(10) || 'b' || chr(10) || 'c fee' || chr(10) || 'fee d' || chr(10) || 'Fee e' || chr(10) || 'f' || chr(10) || 'g'")
def key_sections(spark, sf):
    return segments.key_sections(spark.createDataFrame([(1, "z\na\nb\nc fee\nfee d\nFee e\nf\ng\nh"), (2, "abcdefghij")], "doc_id int, text string"), ("fee",))
