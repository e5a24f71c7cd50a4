"""Queries of joins, filters, aggregates, windows, sorts, set operations, classification and audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import locate
from ..operators import spanalgebra as sa
from .registry import query, relational, table, values
from .spans import CORE_SQL, MERGED_SQL, core, merged

R = relational
# Spark and DuckDB read the same text; tables are the driver's, spans come from VALUES.
SPANS = "(VALUES (1, 0, 3, 'PERSON', 'Ann', 30), (1, 10, 13, 'PERSON', 'ann', 30), (1, 20, 25, 'PARTY', 'Buyer', 30), (2, 0, 3, 'PERSON', 'Ann', 30), (2, 5, 9, 'DATE', '2020', 40), (2, 9, 9, 'DATE', '', 40)) AS s(doc_id, b, e, type, text, priority)"
ROLES = "(VALUES ('buyer'), ('seller'), ('lender')) AS r(role)"
DECISIONS = "(VALUES ('Ann', 'PERSON', true), ('ann ', 'PERSON', true), ('Ann', 'PERSON', false), ('Acme', 'COMPANY', false), ('Bob', 'PERSON', true), ('Bob', 'PERSON', false)) AS d(value, type, accepted)"
GOLD = "(VALUES (1, 'Ann Lee', 'PERSON', 5), (1, 'Acme Ltd', 'COMPANY', 900), (2, 'Bob', 'PERSON', 10), (2, '5 May 2020', 'DATE', 990)) AS g(doc, value, type, pos)"
PRED = "(VALUES (1, 'ann lee', 'PERSON'), (1, 'Acme', 'COMPANY'), (2, 'Bob', 'COMPANY'), (2, '5 May 2020', 'DATE'), (2, 'Buyer', 'PERSON')) AS p(doc, value, type)"
MAPPING = "(VALUES (1, '{PERSON_1}', 'Ann'), (1, '{PERSON_2}', 'Bob'), (1, 'X', 'Ann'), (1, 'X', 'Bob'), (2, '{PERSON_1}', 'Cy')) AS m(scope, token, value)"
NORM = "trim(regexp_replace(lower(value), '[ ]+', ' '{g}))"

# Filters
R("f01_role_labels", f"SELECT doc_id, text FROM {SPANS} WHERE NOT EXISTS (SELECT 1 FROM {ROLES} WHERE role = lower(trim(text)))")
R("f03_kept_model_types", f"SELECT * FROM {PRED} WHERE type IN ('PERSON', 'COMPANY', 'ADDRESS', 'NATIONAL_ID', 'TRADEMARK', 'CASE_NUMBER')")
R("f14_span_validity", f"SELECT doc_id, b, e FROM {SPANS} WHERE 0 <= b AND b < e AND e <= 25")

# Joins
R("j10_span_replacement", f"SELECT s.doc_id, s.b, m.token FROM {SPANS} JOIN {MAPPING} ON s.doc_id = m.scope AND s.text = m.value WHERE m.token <> 'X'")

# Aggregates
CORE_COUNT = f"SELECT doc_id, type, count(*) AS n FROM ({CORE_SQL}) GROUP BY doc_id, type"
query("a01_entities_per_type", CORE_COUNT)(lambda spark, sf: core(spark, sf).groupBy("doc_id", "type").agg(F.count("*").alias("n")))
query("a02_distinct_identities", f"SELECT type, count(DISTINCT text) AS n FROM ({CORE_SQL}) GROUP BY type")(lambda spark, sf: core(spark, sf).groupBy("type").agg(F.countDistinct("text").alias("n")))
R("a09_scan_verification", "SELECT lang, count(*) AS scanned, sum(CASE WHEN n_chars > 0 THEN 1 ELSE 0 END) AS with_text FROM documents GROUP BY lang")
R("a19_keep_first", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rk FROM conversations) q WHERE rk = 1")

# Windows
query("w01_running_max_end", f"""SELECT doc_id, start, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM ({CORE_SQL})""")(lambda spark, sf: core(spark, sf).select("doc_id", "start", F.max("end").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)).alias("far")))
R("w02_first_appearance_rank", "SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn) AS rk FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role) q")
R("w04_previous_next", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
R("w06_nearest_preceding", f"SELECT doc_id, b, max(CASE WHEN type = 'PERSON' THEN e END) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest FROM {SPANS}")

# Sorts, limits, sets
query("o01_document_order", CORE_SQL)(lambda spark, sf: core(spark, sf).orderBy("doc_id", "start", "end"))
R("o04_receipts_newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey")
R("o05_head_lines", "SELECT conv_id, turn, role FROM conversations WHERE turn < 2")
R("u03_intersect", f"SELECT doc, lower(value) AS v, type FROM {GOLD} INTERSECT SELECT doc, lower(value), type FROM {PRED}")

# Classification, audit, reports
R("j06_party_sentences", "SELECT o_orderkey, 'invoice ' || o_orderkey || ' of ' || c_name AS sentence FROM orders JOIN customer ON o_custkey = c_custkey")


# Operators with code of their own
@query("j01_locate_known_names", """SELECT o_orderkey AS doc_id, CAST(length('Order of ') AS INTEGER) AS start, CAST(length('Order of ') + length(c_name) AS INTEGER) AS "end", 'PERSON' AS type, c_name AS text FROM orders JOIN customer ON o_custkey = c_custkey""")
def known_names(spark, sf):
    d = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    docs = d.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Order of "), "c_name", F.lit("; "), "c_name", F.lit("x")).alias("text"))
    return locate.occurrences(d.select(F.col("o_orderkey").alias("doc_id"), F.lower("c_name").alias("value"), F.lit("PERSON").alias("type")), docs).drop("value")


@query("j05_rescan", "SELECT * FROM (VALUES (1, 12, 15, 'PERSON', 'ANNA')) AS t(doc_id, start, \"end\", type, text) WHERE false UNION ALL SELECT 1, 14, 18, 'PERSON', 'Anna'")
def rescan(spark, sf):
    docs = spark.createDataFrame([(1, "Anna met him. Anna's Annabel")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 0, 4, "PERSON", "Anna")], "doc_id int, start int, end int, type string, text string")
    return locate.rescan(spans, docs)


@query("j06_session_sweep", "SELECT 2 AS doc_id, 4 AS start, 8 AS \"end\", 'PERSON' AS type, 'anna' AS text")
def sweep(spark, sf):
    docs = spark.createDataFrame([(1, 7, "Anna"), (2, 7, "but anna"), (3, 8, "Anna")], "doc_id int, session int, text string")
    spans = spark.createDataFrame([(1, 7, 0, 4, "PERSON", "Anna")], "doc_id int, session int, start int, end int, type string, text string")
    return locate.rescan(spans, docs, scope="session")


@query("j08_alias_binding", "SELECT 1 AS doc_id, 'Harbour' AS alias, 'Harbour Freight Ltd' AS canonical, 'COMPANY' AS type UNION ALL SELECT 2, 'BTA', 'Bay Trade Agency', 'COMPANY'")
def alias_binding(spark, sf):
    docs = spark.createDataFrame([(1, 'Harbour Freight Ltd ("Harbour") and Bo ("Lender")'), (2, 'Bay Trade Agency (the "BTA")')], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 0, 19, "COMPANY", "Harbour Freight Ltd"), (1, 36, 38, "PERSON", "Bo"), (2, 0, 16, "COMPANY", "Bay Trade Agency")], "doc_id int, start int, end int, type string, text string")
    return locate.aliases(docs, spans)


@query("f13_precedent_release", "SELECT 1 AS doc_id, 'Smith' AS text")
def precedent(spark, sf):
    docs = spark.createDataFrame([(1, "SUPREME COURT\nSmith v. Jones\nText"), (2, "memo\nSmith v. Jones")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, "PERSON", "Smith"), (2, "PERSON", "Smith"), (1, "PERSON", "Brown")], "doc_id int, type string, text string")
    return locate.precedent_released(spans, docs).select("doc_id", "text")


@query("p26_model_json", "SELECT * FROM (VALUES (1, 'Ann', 'PERSON', false, false), (2, 'Acme', 'COMPANY', false, false), (3, 'Bo', 'PERSON', true, false), (4, NULL, NULL, false, true), (5, NULL, NULL, false, false), (6, 'Ann', 'PERSON', false, true)) AS t(doc_id, value, type, truncated, invalid)")
def model_json(spark, sf):
    raw = ['{"entities": [{"value": "Ann", "type": "person"}]}', '```json\n[{"value": "Acme", "type": "COMPANY"}]\n```', '{"entities": [{"value": "Bo", "type": "PERSON"}, {"value": "tr', "no list", '{"entities": []}', '[{"value": "Ann", "type": "PERSON"}, {"value": "?", "type": "UNKNOWN"}]']
    seg = spark.createDataFrame([(i + 1, 0, r) for i, r in enumerate(raw)], "doc_id int, segment int, raw_output string")
    return locate.model_rows(seg).drop("segment")


@query("m10_chunks")
def chunked(spark, sf):
    return locate.chunks(table(spark, sf, "documents"))


@query("j05_overlap_anti", f'SELECT * FROM (SELECT doc_id, start, "end", type FROM ({CORE_SQL})) WHERE type <> \'EMAIL\'')
def anti(spark, sf):
    c = core(spark, sf)
    return sa.overlap_anti(c, c.where("type = 'EMAIL'")).select("doc_id", "start", "end", "type")
