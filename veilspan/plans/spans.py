"""Queries of detectors, span algebra, minting and restoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import local, mint
from ..operators import spanalgebra as sa
from ..operators.detectors import RULES, Rule, detect
from ..operators.regexspans import sql_spans
from .registry import query, table, values

BY_ID = {r.id: r for r in RULES}
EMAIL_RE2 = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,251})\.[A-Za-z]{2,63}"
US_JAVA = r"(?<![0-9+])\([0-9]{3}\)[ .-]?[0-9]{3,4}[ .-][0-9]{4}(?![0-9])"
US_RE2 = r"\([0-9]{3}\)[ .-]?[0-9]{3,4}[ .-][0-9]{4}"
BANK_RE2 = r"[0-9]{12,19}"
BANK_JAVA = r"(?<![0-9])[0-9]{12,19}(?![0-9])"


CORE = [BY_ID["D01"], Rule("D02a", "PHONE", 60, 0.9, US_JAVA, need=r"\)[ .-]?[0-9]"), Rule("D12a", "BANK_ACCOUNT", 50, 0.85, BANK_JAVA, need="[0-9]{12}")]


def core(spark, sf) -> DataFrame:
    """The part of D01, D02 and D12 that RE2 can run too, so that SQL can check it; whole() is the whole job."""
    return detect(table(spark, sf, "documents"), CORE).drop("rule")


CORE_SQL = " UNION ALL ".join(f"""SELECT doc_id, start, "end", '{k}' AS type, text, 'deterministic' AS source, {c} AS confidence, {p} AS priority FROM ({sql_spans("documents", r)}){w}""" for k, r, p, c, w in (("EMAIL", EMAIL_RE2, 80, 0.99, ""), ("PHONE", US_RE2, 60, 0.9, ""), ("BANK_ACCOUNT", r"[0-9]+", 50, 0.85, " WHERE length(text) BETWEEN 12 AND 19")))
ISLANDS = """SELECT doc_id, min(start) AS start, max("end") AS "end", arg_min(type, k) AS type, arg_min(source, k) AS source, arg_min(confidence, k) AS confidence, arg_min(priority, k) AS priority FROM (
 SELECT *, [-priority, start - "end", start, "end"] AS k, sum(flag) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS isle FROM (
 SELECT *, CASE WHEN start >= coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS flag FROM ({0}))) GROUP BY doc_id, isle"""
MERGED_SQL = f'SELECT doc_id, start, "end", type, substr(text, start + 1, "end" - start) AS text, source, confidence, priority FROM ({ISLANDS.replace("{0}", CORE_SQL)}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id)'
MINT_SQL = f"""SELECT doc_id, surface, type, '{{' || st || '_' || row_number() OVER (PARTITION BY doc_id, st ORDER BY first_at, surface) || '}}' AS token FROM (
 SELECT doc_id, text AS surface, min(start) AS first_at, arg_min(type, start) AS type, replace(arg_min(type, start), '_', '') AS st FROM ({MERGED_SQL}) GROUP BY doc_id, text)"""

query("d_core_documents", CORE_SQL)(core)


def _core_detector(name, kind):
    @query(name, f"SELECT * FROM ({CORE_SQL}) WHERE type = '{kind}'")
    def run(spark, sf):
        return core(spark, sf).where(F.col("type") == kind)


for _n, _k in (("d01_email", "EMAIL"), ("d02_phone_us", "PHONE"), ("d12_bank_account", "BANK_ACCOUNT")):
    _core_detector(_n, _k)

# One line a rule: text, and the spans expected in it.
LINES = {
    "D02": ("call +33 6 12 34 56 78, 13912345678 or 010-62345678", ["+33 6 12 34 56 78", "13912345678", "010-62345678"]),
    "D03": ("身份证11010519491231002X，错号110105194912310021。", ["11010519491231002X"]),
    "D04": ("SSN 123-45-6789 not 000-45-6789 nor 1123-45-67890", ["123-45-6789"]),
    "D05": ("代码91350100M000100Y43及91350100M000100Y44", ["91350100M000100Y43", "91350100M000100Y44"]),
    "D06": ("见（2021）京0105民初12345号与（2010）朝民初字第1234号，(2023) 京0105民初1234号之一", ["（2021）京0105民初12345号", "（2010）朝民初字第1234号", "(2023) 京0105民初1234号之一"]),
    "D07": ("车牌京A12345和粤B1234学、粤A1234领，x京A12345", ["京A12345", "粤B1234学", "粤A1234领"]),
    "D08": ("微信号：harbour_88，另 wxid_ab12cd34", ["harbour_88", "wxid_ab12cd34"]),
    "D09": ("（北港贸易有限公司公章）", ["北港贸易有限公司公章"]),
    "D10": ("see https://a.example/x). or www.bay.example/p and bay-co.com/q.", ["https://a.example/x", "www.bay.example/p", "bay-co.com/q"]),
    "D11": ("住广东省深圳市南山区海港路18号3栋", ["广东省深圳市南山区海港路18号3栋"]),
    "D12": ("账户6222 0212 3456 7890 123", ["6222 0212 3456 7890 123"]),
    "D13": ("2024-01-05; 3 March 2021; 2020年5月6日; 12.11.2019; March 2020", ["2024-01-05", "3 March 2021", "2020年5月6日", "12.11.2019", "March 2020"]),
    "D14": ("$1,200.50; EUR 30 million; 人民币500万元; 伍佰元整; PHP 8.1; TRY 5; NZ$40; 7 US dollars; 1.200,50 QAR", ["$1,200.50", "EUR 30 million", "人民币500万元", "伍佰元整", "NZ$40", "7 US dollars", "1.200,50 QAR"]),
    "D15": ("分别为10，20、30万元", ["10", "20"]),
    "D16": ("Passport No: E12345678; SSN 123 45 6789", ["E12345678", "123 45 6789"]),
    "D17": ("账号：1234567", ["1234567"]),
    "D18": ("IBAN GB82 WEST 1234 5698 7654 32. BE68 5390 0754 7034 PAID", ["GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034"]),
    "D19": ("1:20-cv-01234, HCA 123/2020", ["1:20-cv-01234", "HCA 123/2020"]),
}


def _line_detector(rule_id, line, found):
    rows = " UNION ALL ".join(f"SELECT 1 AS doc_id, instr(t, '{f}') - 1 AS start, '{f}' AS text" for f in found)

    @query(f"{rule_id.lower()}_{BY_ID[rule_id].kind.lower()}_line", f"SELECT doc_id, CAST(start AS INTEGER) AS start, text, '{BY_ID[rule_id].kind}' AS type, {BY_ID[rule_id].priority} AS priority FROM (SELECT '{line}' AS t), LATERAL ({rows})")
    def run(spark, sf):
        return detect(spark.createDataFrame([(1, line)], "doc_id int, text string"), [BY_ID[rule_id]]).select("doc_id", "start", "text", "type", "priority")


for _r, (_l, _f) in LINES.items():
    _line_detector(_r, _l, _f)


def whole(spark, sf) -> DataFrame:
    """All rules over all documents. No SQL: their lookarounds are beyond RE2; tests/test_operators.py has the spans."""
    return detect(table(spark, sf, "documents"), RULES)


query("d_all_documents")(whole)


def _rule_on_documents(rule_id):
    @query(f"{rule_id.lower()}_{BY_ID[rule_id].kind.lower()}_documents")
    def run(spark, sf):
        return detect(table(spark, sf, "documents"), [BY_ID[rule_id]])


for _r in ("D02", "D12"):
    _rule_on_documents(_r)


@query("m01_merge_islands", MERGED_SQL)
def merged(spark, sf, found=core):
    return sa.merge_islands(found(spark, sf), table(spark, sf, "documents").select("doc_id", "text"))


query("m01_merge_islands_all")(lambda spark, sf: merged(spark, sf, whole))


OVERLAPS = "(VALUES (1, 0, 5, 'PERSON', 'a', 30), (1, 3, 9, 'EMAIL', 'b', 80), (1, 9, 12, 'DATE', 'c', 40), (1, 10, 12, 'DATE', 'd', 40), (2, 0, 4, 'COMPANY', 'e', 30), (2, 4, 8, 'TRADEMARK', 'f', 30), (2, 8, 9, 'PERSON', 'g', 30), (2, 20, 30, 'DATE', 'h', 40), (2, 25, 40, 'DATE', 'i', 40)) AS t(doc_id, start, \"end\", type, text, priority)"
OVERLAPS_SPARK = OVERLAPS.replace('"end"', "`end`")


@query("m02_longest_first", "SELECT * FROM (VALUES (1, 3, 9, 'EMAIL', 'b', 80), (1, 9, 12, 'DATE', 'c', 40), (2, 0, 4, 'COMPANY', 'e', 30), (2, 4, 8, 'TRADEMARK', 'f', 30), (2, 8, 9, 'PERSON', 'g', 30), (2, 25, 40, 'DATE', 'i', 40)) AS t(doc_id, start, \"end\", type, text, priority)")
def longest_first(spark, sf):
    return sa.greedy(values(spark, OVERLAPS_SPARK))


@query("m04_leftmost_longest", "SELECT * FROM (VALUES (1, 0, 5, 'PERSON', 'a', 30), (1, 9, 12, 'DATE', 'c', 40), (2, 0, 4, 'COMPANY', 'e', 30), (2, 4, 8, 'TRADEMARK', 'f', 30), (2, 8, 9, 'PERSON', 'g', 30), (2, 20, 30, 'DATE', 'h', 40)) AS t(doc_id, start, \"end\", type, text, priority)")
def leftmost_longest(spark, sf):
    return sa.greedy(values(spark, OVERLAPS_SPARK), order="leftmost")


@query("m03_sweep_extend", "SELECT * FROM (VALUES (1, 0, 9, 'EMAIL', 'manual', 80), (1, 9, 12, 'DATE', 'manual', 40), (2, 0, 4, 'COMPANY', 'llm', 30), (2, 4, 8, 'TRADEMARK', 'llm', 30), (2, 8, 9, 'PERSON', 'llm', 30), (2, 20, 40, 'DATE', 'manual', 40)) AS t(doc_id, start, \"end\", type, source, priority)")
def sweep(spark, sf):
    return sa.sweep_extend(values(spark, OVERLAPS_SPARK).withColumn("source", F.when(F.col("text") == "b", "manual").otherwise("llm")))


@query("m07_join_touching", "SELECT * FROM (VALUES (1, 0, 5, 'PERSON'), (1, 3, 9, 'EMAIL'), (1, 9, 12, 'DATE'), (1, 10, 12, 'DATE'), (2, 0, 8, 'TRADEMARK'), (2, 8, 9, 'PERSON'), (2, 20, 30, 'DATE'), (2, 25, 40, 'DATE')) AS t(doc_id, start, \"end\", type)")
def touching(spark, sf):
    return sa.join_touching(values(spark, OVERLAPS_SPARK).select("doc_id", "start", "end", "type"))


@query("m09_split_at_breaks", "SELECT 1 AS doc_id, 10 AS start, 13 AS \"end\", 'abc' AS text, 'PERSON' AS type UNION ALL SELECT 1, 15, 17, 'de', 'PERSON'")
def split_breaks(spark, sf):
    return sa.split_at_breaks(spark.createDataFrame([(1, 10, 17, "abc\n\tde", "PERSON")], "doc_id int, start int, end int, text string, type string"))


@query("d22_dominant_type", "SELECT 1 AS id, 'a@b.example' AS value, 'EMAIL' AS type")
def dominant(spark, sf):
    v = spark.createDataFrame([(1, "a@b.example"), (2, "no match")], "id int, value string")
    return sa.dominant_type(v, detect(v, key="id", text="value"), key="id")


@query("t01_mint_tokens", MINT_SQL)
def minted(spark, sf, found=core):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mint.mint_tokens(merged(spark, sf, found), docs)


query("t01_mint_tokens_all")(lambda spark, sf: minted(spark, sf, whole))


@query("t04_skip_reserved", "SELECT * FROM (VALUES (1, 'Ann', '{PERSON_2}'), (1, 'Bob', '{PERSON_4}')) AS t(doc_id, surface, token)")
def skip_reserved(spark, sf):
    docs = spark.createDataFrame([(1, "Ann met Bob, see {PERSON_1} and {PERSON\\_3}")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 0, 3, "PERSON", "Ann"), (1, 8, 11, "PERSON", "Bob")], "doc_id int, start int, end int, type string, text string")
    return mint.mint_tokens(spans, docs).select("doc_id", "surface", "token")


def anonymized(spark, sf, rules=CORE) -> DataFrame:
    """Every document with its spans, mapping and tokenized text: one scan, no shuffle."""
    return local.anonymize(table(spark, sf, "documents").select("doc_id", "text"), rules)


@query("t02_emit_walk", "SELECT doc_id, count(*) AS n_sites FROM (" + MERGED_SQL + ") GROUP BY doc_id")
def emit(spark, sf, rules=CORE):
    t = anonymized(spark, sf, rules).where(F.size("spans") > 0)
    return t.select("doc_id", (F.size(F.regexp_extract_all("tokenized", F.lit(mint.TOKEN), F.lit(0))) - F.size(F.regexp_extract_all("text", F.lit(mint.TOKEN), F.lit(0)))).cast("long").alias("n_sites"))


query("t02_emit_walk_all")(lambda spark, sf: emit(spark, sf, RULES))


@query("flagship_roundtrip", f"WITH m AS ({MERGED_SQL}) SELECT type, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs, true AS roundtrip_ok FROM m GROUP BY type")
def flagship(spark, sf, rules=CORE):
    """Detect, merge, mint, splice, restore; spans by type and whether every document came back. One scan; what is
    shuffled is a type and an id for each span."""
    x = local.restore(anonymized(spark, sf, rules)).select("doc_id", F.col("restored").eqNullSafe(F.col("text")).alias("ok"), F.explode_outer(F.transform("spans", lambda s: s["type"])).alias("type"))
    by = x.groupBy("type").agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"), F.bool_and("ok").alias("ok"))
    # One row a type: a small window. Documents without a span count too.
    return by.withColumn("roundtrip_ok", F.bool_and("ok").over(Window.partitionBy())).where("type is not null").drop("ok")


query("flagship_roundtrip_all")(lambda spark, sf: flagship(spark, sf, RULES))


@query("r02_restore_tokens", "SELECT doc_id, text AS restored FROM documents")
def restore(spark, sf):
    return local.restore(anonymized(spark, sf)).select("doc_id", "restored")


@query("t02_relational", "SELECT doc_id, text AS restored FROM documents")
def relational_roundtrip(spark, sf):
    """The same as relations, as sessions of many documents need it: mint, splice and restore by joins."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    m, sites = minted(spark, sf), merged(spark, sf)
    out = mint.splice(docs, sites.join(m.select("doc_id", F.col("surface").alias("text"), "token"), ["doc_id", "text"]))
    return mint.restore_tokens(out, m).select("doc_id", "restored")


@query("r02_restore_orphans", "SELECT 1 AS doc_id, 'Ann {X_1} Ann {Y_2}' AS restored, 2 AS restored_count, '{X_1},{Y_2}' AS orphans")
def orphans(spark, sf):
    d = spark.createDataFrame([(1, "{PERSON\\_1} {X_1} {PERSON_1} {Y_2}")], "doc_id int, tokenized string")
    m = spark.createDataFrame([(1, "{PERSON_1}", "Ann")], "doc_id int, token string, surface string")
    return mint.restore_tokens(d, m).select("doc_id", "restored", "restored_count", F.array_join("orphans", ",").alias("orphans"))


@query("t12_collision_keys", "SELECT * FROM (VALUES ('ab', 'a*', 'a*'), ('ac', 'a*', 'a*#2'), ('x', '*', '*')) AS t(surface, mask, key)")
def collisions(spark, sf):
    return mint.collision_keys(spark.createDataFrame([(1, "ab", "a*"), (1, "ac", "a*"), (1, "x", "*")], "doc_id int, surface string, mask string")).drop("doc_id")
