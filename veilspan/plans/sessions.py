"""Queries of sessions (one mapping for many documents), pseudonyms, restoring and model values, over the driver's tables.

A session is a conversation: its turns are the documents, the first word of each turn is a span of the role's type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import local, locate, mint, restoring, sessions
from ..operators import modelvalues as mv
from ..operators.detectors import RULES
from .registry import query, table, values

KEY = "conv_id * 100000 + turn"
SPANS_SQL = f"SELECT conv_id, {KEY} AS doc_id, turn AS doc_order, regexp_extract(text, '^[^ ]+') AS text, upper(role) AS type FROM conversations WHERE regexp_extract(text, '^[^ ]+') <> ''"
FIRST_SQL = f"SELECT conv_id, text AS surface, min(doc_order) AS first_at, arg_min(type, doc_order) AS type FROM ({SPANS_SQL}) GROUP BY conv_id, text"
TOKENS_SQL = f"SELECT conv_id, '{{' || type || '_' || row_number() OVER (PARTITION BY conv_id, type ORDER BY first_at, surface) || '}}' AS token, surface, type FROM ({FIRST_SQL})"


def session(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents (conv_id, doc_id, doc_order, text) and spans of the sessions."""
    d = table(spark, sf, "conversations").select("conv_id", F.expr(KEY).alias("doc_id"), F.col("turn").alias("doc_order"), "role", "text")
    word = F.regexp_extract("text", "^[^ ]+", 0)
    s = d.where(word != "").select("conv_id", "doc_id", "doc_order", F.lit(0).alias("start"), F.length(word).alias("end"), F.upper("role").alias("type"), word.alias("text"))
    return d.drop("role"), s


@query("t06_session_mapping", TOKENS_SQL)
def session_mapping(spark, sf):
    d, s = session(spark, sf)
    return sessions.mint_session(s, d, "conv_id").drop("seeded")


SEED_SQL = "SELECT conv_id, '{SEED_' || (conv_id % 3 + 1) || '}' AS token, regexp_extract(text, '^[^ ]+') AS surface FROM conversations WHERE turn = 0 AND regexp_extract(text, '^[^ ]+') <> ''"


@query("t05_seed_reuse", f"""WITH seed AS ({SEED_SQL}), first AS ({FIRST_SQL})
 SELECT f.conv_id, s.token, f.surface, f.type, true AS seeded FROM first f JOIN seed s ON f.conv_id = s.conv_id AND f.surface = s.surface
 UNION ALL SELECT conv_id, '{{' || type || '_' || row_number() OVER (PARTITION BY conv_id, type ORDER BY first_at, surface) || '}}', surface, type, false FROM first f WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.conv_id = f.conv_id AND s.surface = f.surface)""")
def seed_reuse(spark, sf):
    d, s = session(spark, sf)
    return sessions.mint_session(s, d, "conv_id", seed=seeds(d))


def seeds(d: DataFrame) -> DataFrame:
    x = d.where("doc_order = 0").select("conv_id", F.concat(F.lit("{SEED_"), (F.col("conv_id") % 3 + 1).cast("string"), F.lit("}")).alias("token"), F.regexp_extract("text", "^[^ ]+", 0).alias("surface"), F.lit("SEED").alias("type"))
    return x.where("surface <> ''").withColumns({"surface_text": F.lit(None).cast("string"), "aliases": F.array().cast("array<string>")})


@query("u02_union_mappings", f"""WITH seed AS (SELECT *, 'SEED' AS type FROM ({SEED_SQL})), new AS ({TOKENS_SQL})
 SELECT conv_id, token, surface, type FROM seed UNION SELECT conv_id, token, surface, type FROM new n WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.conv_id = n.conv_id AND s.token = n.token AND s.surface = n.surface)""")
def union_mappings(spark, sf):
    d, s = session(spark, sf)
    return sessions.union_mappings(seeds(d), sessions.mint_session(s, d, "conv_id").drop("seeded"), "conv_id")


@query("t17_client_cycle", f"SELECT 'acme' AS client, '{{USER_9}}' AS token, 'old' AS surface, 'USER' AS type UNION ALL SELECT 'acme', '{{' || type || '_' || (row_number() OVER (PARTITION BY type ORDER BY first_at, surface) + CASE WHEN type = 'USER' THEN 9 ELSE 0 END) || '}}', surface, type FROM ({FIRST_SQL}) WHERE conv_id = 1 AND surface <> 'old'")
def client_cycle(spark, sf):
    d, s = session(spark, sf)
    store = spark.createDataFrame([("acme", "{USER_9}", "old", "USER", None, []), ("other", "{USER_1}", "x", "USER", None, [])], "client string, token string, surface string, type string, surface_text string, aliases array<string>")
    one = "conv_id = 1"
    return sessions.client_cycle(store, "acme", s.where(one), d.where(one), "conv_id")[1].drop("surface_text", "aliases")


@query("t14_emission_counts", f"SELECT m.conv_id, m.token, m.surface, count(*) AS emitted FROM ({TOKENS_SQL}) m JOIN ({SPANS_SQL}) s ON m.conv_id = s.conv_id AND m.surface = s.text GROUP BY ALL")
def emission_counts(spark, sf):
    d, s = session(spark, sf)
    m = sessions.mint_session(s, d, "conv_id")
    return sessions.emission_counts(s.join(m.select("conv_id", F.col("surface").alias("text"), "token"), ["conv_id", "text"]), "conv_id")


@query("w03_emitted_positions", f"SELECT s.doc_id, 0 AS start, CAST(length(m.token) AS INTEGER) AS \"end\", m.token AS replacement FROM ({SPANS_SQL}) s JOIN ({TOKENS_SQL}) m ON m.conv_id = s.conv_id AND m.surface = s.text")
def emitted_positions(spark, sf):
    d, s = session(spark, sf)
    return sessions.emitted_pieces(s.join(sessions.mint_session(s, d, "conv_id").select("conv_id", F.col("surface").alias("text"), "token"), ["conv_id", "text"]))


def pseudonymized(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    d, s = session(spark, sf)
    m = sessions.mint_pseudonyms(s, d, "conv_id")
    sites = s.join(m.select("conv_id", F.col("surface").alias("text"), "token"), ["conv_id", "text"]).select("doc_id", "start", "end", "token")
    return d, m, sites


@query("t07_pseudonyms", f"SELECT conv_id, 'Item ' || row_number() OVER (PARTITION BY conv_id ORDER BY first_at, surface) AS token, surface, type FROM ({FIRST_SQL})")
def pseudonyms(spark, sf):
    return pseudonymized(spark, sf)[1]


@query("t10_pseudonyms_without_seams", "SELECT conv_id, count(*) AS n FROM (" + FIRST_SQL + ") GROUP BY conv_id")
def pseudonyms_without_seams(spark, sf):
    d, s = session(spark, sf)
    return sessions.mint_without_seams(s, d, "conv_id").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("r04_literal_roundtrip", f"SELECT {KEY} AS doc_id, text AS restored FROM conversations")
def literal_roundtrip(spark, sf):
    d, m, sites = pseudonymized(spark, sf)
    out = mint.splice(d, sites).select("doc_id", "conv_id", F.col("tokenized").alias("text"))
    return restoring.restore(out, m, "conv_id", "pseudonym").select("doc_id", "restored")


@query("j17_seams", "SELECT 1 AS doc_id, 0 AS start, 1 AS \"end\", '' AS replacement, true AS found WHERE false")
def seams(spark, sf):
    d, m, sites = pseudonymized(spark, sf)
    return sessions.seam_violations(d, sites, m, "conv_id")


@query("r03_session_roundtrip", f"SELECT {KEY} AS doc_id, text AS restored FROM conversations")
def session_roundtrip(spark, sf):
    d, s = session(spark, sf)
    m = sessions.mint_session(s, d, "conv_id")
    out = mint.splice(d, s.join(m.select("conv_id", F.col("surface").alias("text"), "token"), ["conv_id", "text"]).select("doc_id", "start", "end", "token"))
    return restoring.restore(out.select("doc_id", "conv_id", F.col("tokenized").alias("text")), m, "conv_id").select("doc_id", "restored")


@query("flagship_local", "SELECT doc_id, text AS restored FROM documents")
def flagship_local(spark, sf):
    """All rules, one scan, no shuffle: every document comes back."""
    return local.restore(local.anonymize(table(spark, sf, "documents").select("doc_id", "text"), RULES)).select("doc_id", "restored")


@query("m01_local_spans")
def local_spans(spark, sf):
    x = local.anonymize(table(spark, sf, "documents").select("doc_id", "text"), RULES)
    return x.select("doc_id", F.inline("spans"))


# Model values: a customer's name as a model would report it, in an order's sentence.
ORDERS_SQL = "SELECT o_orderkey AS doc_id, c_name, 'Order of ' || c_name || '; see ' || c_name || 'Co' AS text FROM orders JOIN customer ON o_custkey = c_custkey"


def reported(spark, sf) -> tuple[DataFrame, DataFrame]:
    x = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), "c_name")
    docs = x.select("doc_id", F.concat(F.lit("Order of "), "c_name", F.lit("; see "), "c_name", F.lit("Co")).alias("text"))
    rows = [x.select("doc_id", "c_name", F.lit("PERSON")), x.select("doc_id", F.concat("c_name", F.lit(" Nobody")), F.lit("COMPANY")), x.select("doc_id", F.lit("the Agreement"), F.lit("COMPANY")), x.select("doc_id", F.lower("c_name"), F.lit("DATE"))]
    out = rows[0].toDF("doc_id", "value", "type")
    for r in rows[1:]:
        out = out.union(r)
    return docs, out


@query("j03_model_rows", f"""SELECT doc_id, 'span' AS outcome, 9 AS start, CAST(9 + length(c_name) AS INTEGER) AS "end", 'PERSON' AS type, c_name AS text FROM ({ORDERS_SQL})
 UNION ALL SELECT doc_id, 'phantom', NULL, NULL, 'COMPANY', c_name || ' Nobody' FROM ({ORDERS_SQL})
 UNION ALL SELECT doc_id, 'run-in', CAST(15 + length(c_name) AS INTEGER), CAST(15 + 2 * length(c_name) AS INTEGER), 'PERSON', c_name FROM ({ORDERS_SQL}) WHERE false""")
def model_rows(spark, sf):
    docs, rows = reported(spark, sf)
    return mv.locate_model_rows(rows, docs)


@query("f02_boilerplate", "SELECT * FROM (VALUES ('the Agreement', 'COMPANY', true), ('Exhibit A', 'COMPANY', true), ('Sections', 'COMPANY', true), ('Ada', 'PERSON', false), ('Ada', 'COMPANY', true), ('State of New York', 'COMPANY', true), ('State of Mind Media', 'COMPANY', false), ('New York County', 'ADDRESS', true), ('Margaret Court', 'PERSON', false), ('Supreme Court', 'COMPANY', true), ('Southern District of New York', 'PERSON', true), ('third-party', 'PERSON', true), ('meridianworks.com', 'COMPANY', false), ('customers of ours', 'COMPANY', true), ('Acme and', 'COMPANY', true), ('Minh An', 'PERSON', false), ('甲方', 'COMPANY', true), ('北港贸易', 'COMPANY', false), ('X', 'PERSON', true), ('Fifth Third', 'COMPANY', false)) AS t(value, type, drop)")
def boilerplate(spark, sf):
    v = [("the Agreement", "COMPANY"), ("Exhibit A", "COMPANY"), ("Sections", "COMPANY"), ("Ada", "PERSON"), ("Ada", "COMPANY"), ("State of New York", "COMPANY"), ("State of Mind Media", "COMPANY"), ("New York County", "ADDRESS"), ("Margaret Court", "PERSON"), ("Supreme Court", "COMPANY"), ("Southern District of New York", "PERSON"), ("third-party", "PERSON"), ("meridianworks.com", "COMPANY"), ("customers of ours", "COMPANY"), ("Acme and", "COMPANY"), ("Minh An", "PERSON"), ("甲方", "COMPANY"), ("北港贸易", "COMPANY"), ("X", "PERSON"), ("Fifth Third", "COMPANY")]
    return spark.createDataFrame(v, "value string, type string").withColumn("drop", mv.boilerplate("value", "type"))


@query("f02_names_kept", "SELECT c_name AS value FROM customer UNION ALL SELECT s_name FROM supplier")
def names_kept(spark, sf):
    """No customer or supplier of the tables is boilerplate."""
    v = table(spark, sf, "customer").select(F.col("c_name").alias("value")).union(table(spark, sf, "supplier").select("s_name"))
    return v.where(~mv.boilerplate("value", F.lit("COMPANY")))


@query("f04_defined_terms", "SELECT * FROM (VALUES (1, 'lender'), (2, 'effective time')) AS t(doc_id, term)")
def defined_terms(spark, sf):
    d = spark.createDataFrame([(1, 'Harbour Freight Ltd ("Harbour") and a bank (the "Lender")'), (2, '"Effective Time" means noon'), (3, "plain")], "doc_id int, text string")
    return mv.defined_term_rows(d)


@query("f06_derived_alias", "SELECT * FROM (VALUES ('HFL', 'Harbour Freight Ltd', true), ('Harbour', 'Harbour Freight Ltd', true), ('北贸', '北港贸易有限公司', true), ('贸北', '北港贸易有限公司', false), ('Lender', 'Harbour Freight Ltd', false)) AS t(alias, canonical, derived)")
def derived(spark, sf):
    v = values(spark, "(VALUES ('HFL', 'Harbour Freight Ltd'), ('Harbour', 'Harbour Freight Ltd'), ('北贸', '北港贸易有限公司'), ('贸北', '北港贸易有限公司'), ('Lender', 'Harbour Freight Ltd')) AS t(alias, canonical)")
    return v.withColumn("derived", mv.is_derived("alias", "canonical"))


@query("j04_run_ins", "SELECT 1 AS doc_id, 0 AS start, 4 AS \"end\", 'PERSON' AS type, 'Anna' AS text UNION ALL SELECT 2, 4, 8, 'PERSON', 'Anna'")
def run_ins(spark, sf):
    d = spark.createDataFrame([(1, "AnnaBerg met Annabel and Anna"), (2, "2020Anna")], "doc_id int, text string")
    v = spark.createDataFrame([(1, "Anna", "PERSON"), (2, "Anna", "PERSON")], "doc_id int, value string, type string")
    return mv.run_in_spans(v, d).select("doc_id", "start", "end", "type", "text")


@query("j07_unswept", "SELECT 2 AS doc_id, 4 AS start, 8 AS \"end\", 'PERSON' AS type, 'anna' AS text")
def unswept(spark, sf):
    docs = spark.createDataFrame([(1, 7, "Anna"), (2, 7, "but anna"), (3, 8, "Anna"), (4, 7, "Anna")], "doc_id int, session int, text string")
    spans = spark.createDataFrame([(1, 7, 0, 4, "PERSON", "Anna"), (4, 7, 0, 4, "PERSON", "Anna")], "doc_id int, session int, start int, end int, type string, text string")
    return locate.unswept(spans, docs, "session")


@query("t11_override_rejections", "SELECT * FROM (VALUES (1, 'Ann', '', 'empty', NULL), (1, 'Bo', '{x}', 'braces', NULL), (1, 'Cy', 'Person A', 'collision', 'Person A'), (1, 'Di', 'Person', 'prefix', 'Person A'), (1, 'Ed', 'noon', 'natural', NULL), (1, 'Hy', 'Zed', 'collision', 'Zed')) AS t(scope, surface, replacement, reason, other)")
def override_rejections(spark, sf):
    o = spark.createDataFrame([(1, "Ann", ""), (1, "Bo", "{x}"), (1, "Cy", "Person A"), (1, "Di", "Person"), (1, "Ed", "noon"), (1, "Flo", "Zed"), (1, "Gus", "Quill"), (1, "Hy", "Zed")], "scope int, surface string, replacement string")
    m = spark.createDataFrame([(1, "Person A", "Hal", "PERSON"), (1, "Quill", "Gus", "PERSON")], "scope int, token string, surface string, type string")
    d = spark.createDataFrame([(1, "at noon")], "scope int, text string")
    return sessions.override_rejections(o, d, m, "scope")


@query("t13_glued_sites", "SELECT * FROM (VALUES (1, 'Person A', 'Person Ab'), (1, '甲公司2', '甲公司23')) AS t(doc_id, replacement, spelling)")
def glued_sites(spark, sf):
    d = spark.createDataFrame([(1, "Person Ab, Person A; 甲公司23")], "doc_id int, text string")
    s = spark.createDataFrame([(1, 0, 8, "Person A"), (1, 11, 19, "Person A"), (1, 21, 25, "甲公司2")], "doc_id int, start int, end int, replacement string")
    return restoring.glued_rows(d, s)


@query("r05_refusals", "SELECT * FROM (VALUES (1, 'Ann Zed Zed', 1, 'Zed'), (2, 'a* Al', 1, 'a*')) AS t(doc_id, restored, restored_count, ambiguous)")
def refusals(spark, sf):
    d = spark.createDataFrame([(1, 1, "Person A Zed Zed"), (2, 2, "a* b*")], "doc_id int, scope int, text string")
    m = spark.createDataFrame([(1, "Person A", "Ann", None), (1, "Zed", "Cy", 1), (2, "a*", "Ann", None), (2, "a*", "Abe", None), (2, "b*", "Al", None)], "scope int, token string, surface string, emitted int")
    return restoring.restore(d, m, "scope", "pseudonym").select("doc_id", "restored", "restored_count", F.array_join("ambiguous", ",").alias("ambiguous"))


@query("r07_suspects", "SELECT 1 AS doc_id, '{ person_1 }|[PERSON_2]|{PERSON_3|PERSON_4}|PERSON_5|{Bank Account 1}' AS suspects")
def near_misses(spark, sf):
    d = spark.createDataFrame([(1, 1, "{ person_1 } [PERSON_2] {PERSON_3 and PERSON_4} PERSON_5 {Bank Account 1} {PERSON_1} {DATE_9}")], "doc_id int, scope int, text string")
    m = spark.createDataFrame([(1, "{PERSON_1}", "Ann"), (1, "{BANKACCOUNT_1}", "1")], "scope int, token string, surface string")
    return restoring.restore(d, m, "scope").select("doc_id", F.array_join("suspects", "|").alias("suspects"))


@query("f16_release_preflight", "SELECT '1' AS scope, 'ambiguous: a*' AS reason")
def preflight(spark, sf):
    m = spark.createDataFrame([(1, "a*", "Ann"), (1, "a*", "Abe"), (1, "b*", "Al")], "scope int, token string, surface string")
    none = spark.createDataFrame([], "doc_id int, start int, end int, replacement string, found boolean")
    return restoring.release_preflight(m, none, "scope", "doc_id")
