"""Queries of the joins between a text and its other surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locate, restoring, sessions
from ..operators import surfaces as sf_
from .registry import query, table
from .sessions import SPANS_SQL, TOKENS_SQL, session
from .spans import CORE_SQL, core

EDITED = r"a {P\_1} and {Q\_22}."


@query("j16_original_offsets", "SELECT * FROM (VALUES (1, 2, 7, 2, 8), (1, 12, 18, 13, 20), (1, 18, 19, 20, 21)) AS t(doc_id, start, \"end\", original_start, original_end)")
def original_offsets(spark, sf):
    d = spark.createDataFrame([(1, EDITED)], "doc_id int, text string")
    return sf_.original_offsets(d, spark.createDataFrame([(1, 2, 7), (1, 12, 18), (1, 18, 19)], "doc_id int, start int, end int"))


def sites(spark, sf):
    d, s = session(spark, sf)
    m = sessions.mint_session(s, d, "conv_id").select("conv_id", F.col("surface").alias("text"), "token")
    return d, s.join(m, ["conv_id", "text"]).select("doc_id", "start", "end", "token")


PAIRS_SQL = f"""SELECT s.doc_id, 1 AS run, true AS replaced, 0 AS start, length(s.text) AS "end", 0 AS red_start, length(m.token) AS red_end FROM ({SPANS_SQL}) s JOIN ({TOKENS_SQL}) m ON m.conv_id = s.conv_id AND m.surface = s.text
 UNION ALL SELECT s.doc_id, 2, false, length(s.text), length(c.text), length(m.token), length(m.token) + length(c.text) - length(s.text) FROM ({SPANS_SQL}) s JOIN ({TOKENS_SQL}) m ON m.conv_id = s.conv_id AND m.surface = s.text JOIN conversations c ON c.conv_id = s.conv_id AND c.turn = s.doc_order WHERE length(c.text) > length(s.text)
 UNION ALL SELECT conv_id * 100000 + turn, 1, false, 0, length(text), 0, length(text) FROM conversations WHERE regexp_extract(text, '^[^ ]+') = '' AND length(text) > 0"""


@query("j18_paired_runs", PAIRS_SQL)
def paired_runs(spark, sf):
    return sf_.paired_runs(*sites(spark, sf))


@query("j18_selected_original", "SELECT * FROM (VALUES (1, 1, 4, 9), (1, 2, 0, 8)) AS t(doc_id, id, start, \"end\")")
def selected_original(spark, sf):
    d = spark.createDataFrame([(1, "see Anna now")], "doc_id int, text string")
    p = sf_.paired_runs(d, spark.createDataFrame([(1, 4, 8, "{PERSON_1}")], "doc_id int, start int, end int, token string"))
    return sf_.selected_original(p, spark.createDataFrame([(1, 1, 6, 15), (1, 2, 0, 5)], "doc_id int, id int, red_start int, red_end int"))


LINES_SQL = "SELECT doc_id, n AS line, n * 50 AS start, n * 50 + 50 AS \"end\" FROM documents, range(0, 4) AS r(n)"


def lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("line")).withColumns({"start": F.col("line") * 50, "end": F.col("line") * 50 + 50})


query("j23_touched_lines", f"SELECT l.* FROM ({LINES_SQL}) l WHERE EXISTS (SELECT 1 FROM ({CORE_SQL}) s WHERE s.doc_id = l.doc_id AND s.start < l.\"end\" AND l.start < s.\"end\")")(lambda spark, sf: sf_.touched_lines(core(spark, sf), lines(spark, sf))[0])
query("j23_unplaced_ranges", f'SELECT doc_id, count(*) AS unplaced FROM ({CORE_SQL}) WHERE start >= 200 GROUP BY doc_id')(lambda spark, sf: sf_.touched_lines(core(spark, sf), lines(spark, sf))[1])


@query("j27_reused_tokens", "SELECT * FROM (VALUES (1, 'ANNA  Berg', 'PERSON', '{PERSON_2}'), (1, 'Bo', 'PERSON', '{PERSON_8}'), (1, 'Acme', 'COMPANY', '{COMPANY_1}')) AS t(scope, surface, type, token)")
def reused_tokens(spark, sf):
    s = spark.createDataFrame([(1, "ANNA  Berg", "PERSON", 1), (1, "Bo", "PERSON", 2), (1, "bo", "PERSON", 3), (1, "Acme", "COMPANY", 4)], "scope int, surface string, type string, place int")
    seed = spark.createDataFrame([(1, "{PERSON_2}", "Anna Berg", []), (1, "{PERSON_7}", "X", ["anna berg"])], "scope int, token string, surface string, aliases array<string>")
    return sf_.reused_tokens(s, seed, "scope")


@query("j22_line_tokens", "SELECT * FROM (VALUES (1, 1, 'PERSON', 'Anna Berg', '{PERSON_4}'), (1, 2, 'DATE', '2020', '{DATE_1}')) AS t(doc_id, line, type, surface, token)")
def line_tokens(spark, sf):
    ln = spark.createDataFrame([(1, 1, 1, "Anna Berg 20"), (1, 1, 2, "in 2020"), (1, 1, 3, "none")], "doc_id int, scope int, line int, text string")
    sp = spark.createDataFrame([(1, 0, 9, "PERSON"), (1, 10, 12, "DATE"), (1, 16, 20, "DATE"), (1, 10, 15, "X")], "doc_id int, start int, end int, type string")
    seed = spark.createDataFrame([(1, "{PERSON_4}", "anna berg", None)], "scope int, token string, surface string, aliases array<string>")
    return sf_.line_tokens(ln, sp, seed, "scope")


@query("j26_edited_runs", "SELECT * FROM (VALUES (1, 1, 'Dear {P_1}'), (1, 2, ''), (1, 3, ' of {C_1}')) AS t(doc_id, run, text)")
def edited_runs(spark, sf):
    r = spark.createDataFrame([(1, 1, 0, "Dear An"), (1, 2, 7, "na "), (1, 3, 10, "Berg of Acme")], "doc_id int, run int, start int, text string")
    return sf_.edited_runs(r, spark.createDataFrame([(1, 5, 14, "{P_1}"), (1, 18, 22, "{C_1}")], "doc_id int, start int, end int, token string"))


@query("j28_joined_hits", "SELECT * FROM (VALUES (1, 0, 4, 1.0, 1.0, 2.0, 2.0, true), (1, NULL, NULL, 5.0, 5.0, 6.0, 6.0, true), (1, 9, 12, 7.0, 7.0, 8.0, 8.0, false)) AS t(page, start, \"end\", x0, y0, x1, y1, two)")
def joined_hits(spark, sf):
    shape = "page int, start int, end int, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(1, 0, 4, 1.0, 1.0, 2.0, 2.0), (1, None, None, 5.0, 5.0, 6.0, 6.0)], shape)
    b = spark.createDataFrame([(1, 0, 4, 1.1, 1.0, 2.0, 2.0), (1, None, None, 5.0, 5.0, 6.0, 6.0), (1, 9, 12, 7.0, 7.0, 8.0, 8.0)], shape)
    return sf_.joined_hits(a, b).withColumnRenamed("both", "two")


@query("f20_owned_sites", "SELECT * FROM (VALUES (1, 0, 9, 'Anna Berg', '{P_2}'), (2, 0, 4, 'anna', '{P_1}'), (2, 9, 13, 'Anna', '{P_3}')) AS t(page, start, \"end\", text, token)")
def owned_sites(spark, sf):
    s = spark.createDataFrame([(1, 0, 9, "Anna Berg"), (1, 0, 4, "Anna"), (2, 0, 4, "anna"), (2, 9, 13, "Anna"), (2, 20, 23, "Bob")], "page int, start int, end int, text string")
    return sf_.owned_sites(s, spark.createDataFrame([("{P_1}", "ANNA"), ("{P_3}", "Anna"), ("{P_2}", "Anna Berg")], "token string, surface string"))


@query("j09_link_aliases", "SELECT * FROM (VALUES (1, '{P_1}', 'Anna Berg', NULL, NULL), (1, '{P_2}', 'Berg', 'ANNA BERG', '{P_1}'), (1, '{P_3}', 'AB', 'Anna Berg', '{P_9}')) AS t(scope, token, surface, canonical_surface, canonical_token)")
def link_aliases(spark, sf):
    m = spark.createDataFrame([(1, "{P_1}", "Anna Berg", None, None), (1, "{P_2}", "Berg", "ANNA BERG", None), (1, "{P_3}", "AB", "Anna Berg", "{P_9}")], "scope int, token string, surface string, canonical_surface string, canonical_token string")
    return sf_.linked_aliases(m, "scope")


@query("u01_union_sources", f"SELECT doc_id, start, \"end\", type, priority FROM ({CORE_SQL}) UNION ALL SELECT doc_id, 0, 1, 'MANUAL', 120 FROM documents")
def union_sources(spark, sf):
    manual = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("MANUAL").alias("type"), F.lit(120).alias("priority"))
    return sf_.union_spans(core(spark, sf), manual).select("doc_id", "start", "end", "type", "priority")


@query("c03_segment_outcomes", "SELECT * FROM (VALUES (1, 2, 1, 0, false, false), (2, 1, 0, 1, false, true), (3, 1, 0, 0, true, false)) AS t(doc_id, segments, truncated, invalid, complete, scanned_nothing)")
def segment_outcomes(spark, sf):
    raw = [(1, 0, '{"entities": [{"value": "Bo", "type": "PERSON"}, {"value": "tr'), (1, 1, '{"entities": []}'), (2, 0, "no list"), (3, 0, '[{"value": "A", "type": "PERSON"}]')]
    return sf_.segment_outcomes(locate.model_rows(spark.createDataFrame(raw, "doc_id int, segment int, raw_output string")))


@query("r12_restore_preview", f"SELECT count(*) AS n_docs, (SELECT count(*) FROM ({SPANS_SQL})) AS restored, 0 AS orphans, 0 AS suspects, 0 AS ambiguous FROM conversations")
def restore_preview(spark, sf):
    from ..operators import mint

    d, s = session(spark, sf)
    m = sessions.mint_session(s, d, "conv_id")
    out = mint.splice(d, s.join(m.select("conv_id", F.col("surface").alias("text"), "token"), ["conv_id", "text"]).select("doc_id", "start", "end", "token"))
    return sf_.preview(restoring.restore(out.select("doc_id", "conv_id", F.col("tokenized").alias("text")), m, "conv_id"))
