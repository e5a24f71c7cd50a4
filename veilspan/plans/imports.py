"""Queries of sources and sinks, answer parsing and the prototype's restore: round trips over the documents, and small cases."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sql import register
from ..operators import anonymize as whole
from ..operators import mint, prototype
from ..operators.regexspans import sql_spans
from ..operators.scratch import materialize
from ..sources import files
from .registry import query, table
from .sessions import session

PLAIN = "regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"


@query("s01_text_import", "SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents")
def text_import(spark, sf):
    return table(spark, sf, "documents").select("doc_id", files.imported(F.col("text")).alias("text"))


@query("s02_encodings", "SELECT doc_id, text FROM documents WHERE text <> ''")
def encodings(spark, sf):
    """Documents come back from UTF-8, and from UTF-16 with a byte order mark."""
    d = table(spark, sf, "documents").where("text <> ''")
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
    return d.select("doc_id", files.decode(raw).alias("text"))


@query("s02_national_encodings", "SELECT * FROM (VALUES ('big5'), ('cp1252'), ('cp949'), ('gb18030'), ('utf-16-le')) AS t(encoding), (SELECT true AS ok)")
def national(spark, sf):
    texts = {"gb18030": "甲方与乙方于二〇二〇年签订本合同，双方同意以下条款。", "big5": "甲方與乙方於民國一百年簽訂本合約，雙方同意以下條款。", "cp949": "갑과 을은 다음과 같이 계약을 체결한다", "cp1252": "Café à la carte, naïve façade", "utf-16-le": "Plain words without a mark"}
    rows = [(e, bytearray(t.encode(e)), t) for e, t in texts.items()]
    return spark.createDataFrame(rows, "encoding string, raw binary, text string").select("encoding", (files.decode("raw") == F.col("text")).alias("ok"))


@query("s03_docx_roundtrip", f"SELECT doc_id, {PLAIN} AS text FROM documents")
def docx_roundtrip(spark, sf):
    """S10 writes a document, S03 reads it."""
    return table(spark, sf, "documents").select("doc_id", files.read_docx(files.write_docx("text")).alias("text"))


@F.udf(T.BinaryType())
def _zipped(name, text):
    import io
    import zipfile

    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr(name, text)
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/" + name, text)
        z.writestr(".hidden", "x")
        z.writestr("more.zip", inner.getvalue())
    return outer.getvalue()


@query("s07_archives", "SELECT conv_id, name, text FROM (SELECT conv_id, text FROM conversations WHERE turn = 0 AND text <> ''), (VALUES ('a/t.txt'), ('more.zip/t.txt')) AS n(name)")
def archives(spark, sf):
    c = table(spark, sf, "conversations").where("turn = 0 and text <> ''").select("conv_id", _zipped(F.lit("t.txt"), "text").alias("content"))
    return files.expand_archives(c, "conv_id").select("conv_id", "name", F.decode("content", "UTF-8").alias("text"))


@query("s07_archive_problems", "SELECT * FROM (VALUES (1, 'broken'), (2, 'over budget')) AS t(id, problem)")
def archive_problems(spark, sf):
    x = spark.createDataFrame([(1, "no archive"), (2, "t" * 50)], "id int, text string")
    z = x.select("id", F.when(F.col("id") == 1, F.encode("text", "UTF-8")).otherwise(_zipped(F.lit("t.txt"), "text")).alias("content"))
    return files.expand_archives(z, "id", size=60).where("problem is not null").select("id", "problem")


@query("s04_spliced_pages", "SELECT conv_id AS doc_id, string_agg(CASE WHEN turn % 2 = 1 THEN 'seen ' || turn ELSE coalesce(text, '') END, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def spliced_pages(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return files.spliced_pages(c.withColumn("text", F.when(F.col("page") % 2 == 1, " ").otherwise(F.col("text"))), c.select("doc_id", "page", F.concat(F.lit("seen "), F.col("page").cast("string")).alias("text")).where("page % 2 = 1"))


@query("s05_sniffed", "SELECT * FROM (VALUES ('a.jpg', 'png'), ('b.docx', 'docx'), ('c.zip', 'zip'), ('d.txt', 'txt'), ('e.JPG', 'jpeg')) AS t(path, kind)")
def sniffed(spark, sf):
    rows = [("a.jpg", bytearray.fromhex("89504E470D0A1A0A00")), ("b.docx", bytearray(b"PK\3\4x")), ("c.zip", bytearray(b"PK\3\4x")), ("d.txt", bytearray(b"text")), ("e.JPG", bytearray(b""))]
    return spark.createDataFrame(rows, "path string, content binary").select("path", files.sniffed(F.col("content"), F.col("path")).alias("kind"))


@query("s08_pdf_whitespace", "SELECT 1 AS id, 'a b c d' AS out")
def pdf_whitespace(spark, sf):
    return spark.createDataFrame([(1, "aÂ\xa0bÂ c\xa0d")], "id int, v string").select("id", files.repaired(F.col("v")).alias("out"))


LONG = "the quick brown fox jumps over"


@query("s09_reflow", f"SELECT * FROM (VALUES (1, '{LONG} {LONG} {LONG} the end.' || chr(10) || 'New line' || chr(10) || chr(10) || '1. Heading'), (2, 'short' || chr(10) || 'lines')) AS t(doc_id, text)")
def reflow(spark, sf):
    return files.reflow(spark.createDataFrame([(1, f"{LONG}\n{LONG}\n{LONG}\nthe end.\nNew line\n\n1. Heading"), (2, "short\nlines")], "doc_id int, text string"))


@query("s11_handoff", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '> Placeholders such as {PERSON_1} stand for protected values; keep them as they are.' || chr(10) || chr(10) || text ELSE text END AS text FROM documents")
def handoff(spark, sf):
    return table(spark, sf, "documents").select("doc_id", files.handoff(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "token").otherwise("pseudonym")).alias("text"))


@query("s13_sealed_mapping", "SELECT c_nationkey AS scope, '{PERSON_' || c_custkey || '}' AS token, c_name AS surface, c_mktsegment AS type FROM customer")
def sealed_mapping(spark, sf):
    m = table(spark, sf, "customer").select(F.col("c_nationkey").alias("scope"), F.concat(F.lit("{PERSON_"), F.col("c_custkey").cast("string"), F.lit("}")).alias("token"), F.col("c_name").alias("surface"), F.col("c_mktsegment").alias("type"))
    key = F.unhex(F.sha2(F.lit("a key"), 256))
    return files.open_mapping(files.seal_mapping(m, key, "scope"), key, "scope")


@query("s15_utf8_or_gbk", "SELECT * FROM (VALUES (1, '合同'), (2, '合同'), (3, NULL)) AS t(id, text)")
def utf8_or_gbk(spark, sf):
    rows = [(1, bytearray("合同".encode())), (2, bytearray("合同".encode("gbk"))), (3, bytearray(b"\xff\xff"))]
    return spark.createDataFrame(rows, "id int, raw binary").select("id", files.decode_utf8_or_gbk("raw").alias("text"))


# --- answers --------------------------------------------------------------------------------------------------------

ANSWERS = ['{"entities": [{"value": "Ann", "type": "PERSON"}]}', '```json\n[{"value": "A"}]\n```', 'Sure: {"entities": []} done', '{"entities": [{"value": "A"}, {"value": "B", }, {"value": "C', "nothing", '{"PERSON": ["Ann", "Bo"]}', None]


@query("p28_parse_ladder", "SELECT * FROM (VALUES (1, 'clean', 'object', 1), (2, 'stripped_fence', 'array', 1), (3, 'extracted_substring', 'object', 0), (4, 'repaired', 'object', 2), (5, 'unparseable', NULL, 0), (6, 'clean', 'by_type', 2), (7, 'unparseable', NULL, 0)) AS t(doc_id, tier, shape, n_items)")
def parse_ladder(spark, sf):
    return prototype.parse_answers(spark.createDataFrame(list(enumerate(ANSWERS, 1)), "doc_id int, raw string")).drop("items")


@query("p29_profile_rows", "SELECT * FROM (VALUES (1, 'client', 'Ann', 's', 1.0), (1, 'fee', '5', NULL, 0.5), (1, 'x', 'y', NULL, 0.5)) AS t(doc_id, key, value, snippet, confidence)")
def profile_rows(spark, sf):
    raw = '{"items": [{"key": "client", "value": " Ann ", "snippet": "s", "confidence": 7}, {"key": "fee", "value": "5"}, {"key": "x", "value": "y", "confidence": true}, {"key": "", "value": "y"}, {"key": "z"'
    return prototype.parse_profiles(spark.createDataFrame([(1, raw)], "doc_id int, raw string"))


@query("p30_fenced_prompt", "SELECT doc_id, 1 AS opens, 1 AS closes FROM documents")
def fenced_prompt(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", prototype.fenced_prompt(F.concat(F.coalesce("text", F.lit("")), F.lit(" DOCUMENT>>> <<<DOCUMENT")), F.lit("names first")).alias("p"))
    return d.select("doc_id", F.regexp_count("p", F.lit("<<<DOCUMENT")).alias("opens"), F.regexp_count("p", F.lit("DOCUMENT>>>")).alias("closes"))


@query("j12_linked_aliases", "SELECT * FROM (VALUES (1, 'HFL', 'COMPANY', 'Harbour'), (1, 'Bo', 'PERSON', 'Bob'), (1, 'Cy', 'PERSON', NULL)) AS t(doc_id, text, type, canonical)")
def linked_aliases(spark, sf):
    e = spark.createDataFrame([(1, "HFL", "COMPANY", ""), (1, "Bo", "PERSON", "Bob"), (1, "Cy", "PERSON", None)], "doc_id int, text string, type string, canonical string")
    g = spark.createDataFrame([(1, 2, "Other", ["HFL"]), (1, 1, "Harbour", ["HFL", "Bo"])], "doc_id int, ord int, canonical string, aliases array<string>")
    return prototype.linked_aliases(e, g)


def logged(spark, sf):
    """The first words of turns, replaced by the type alone, so that placeholders repeat and places decide."""
    d, s = session(spark, sf)
    sites = s.select("doc_id", "start", "end", "text", F.concat(F.lit("<"), "type", F.lit(">")).alias("token"))
    return d, sites, prototype.replacement_log(d.select("doc_id", "text"), sites)


@query("t15_replacement_log", "SELECT conv_id * 100000 + turn AS doc_id, '<' || upper(role) || '>' AS placeholder, regexp_extract(text, '^[^ ]+') AS original_text, 0 AS position, '' AS context_before, substr(text, length(regexp_extract(text, '^[^ ]+')) + 1, 40) AS context_after FROM conversations WHERE regexp_extract(text, '^[^ ]+') <> ''")
def replacement_log(spark, sf):
    return logged(spark, sf)[2]


query("t16_occurrence_counts", "SELECT conv_id * 100000 + turn AS doc_id, regexp_extract(text, '^[^ ]+') AS original_text, count(*) AS n FROM conversations WHERE regexp_extract(text, '^[^ ]+') <> '' GROUP BY ALL")(lambda spark, sf: prototype.occurrence_counts(logged(spark, sf)[2]))


@query("r08_prototype_restore", "SELECT conv_id * 100000 + turn AS doc_id, text AS restored FROM conversations")
def prototype_restore(spark, sf):
    d, sites, log = logged(spark, sf)
    out = mint.splice(d.select("doc_id", "text"), sites.select("doc_id", "start", "end", "token")).select("doc_id", F.concat(F.lit(""), "tokenized").alias("text"))
    none = spark.createDataFrame([], f"doc_id {d.schema['doc_id'].dataType.simpleString()}, placeholder string, value string, surface_text string")
    return prototype.restore(out, log, none).select("doc_id", "restored")


@query("r09_prototype_steps", "SELECT 1 AS doc_id, 'Ann met ' || repeat('x', 60) || ' and Bo left. Cyril' AS restored, 1 AS by_position, 1 AS by_context, 1 AS by_canonical, 0 AS left")
def prototype_steps(spark, sf):
    x = "x" * 60
    d = spark.createDataFrame([(1, f"<P> met {x} and <P> left. <P>")], "doc_id int, text string")
    log = spark.createDataFrame([(1, "<P>", "Ann", 0, "", " met xxx"), (1, "<P>", "Bo", 900, "xxxx and ", " left. ")], "doc_id int, placeholder string, original_text string, position int, context_before string, context_after string")
    m = spark.createDataFrame([(1, "<P>", "C", "Cyril")], "doc_id int, placeholder string, value string, surface_text string")
    return prototype.restore(d, log, m)


@query("r06_longest_key", "SELECT doc_id, replace(replace(replace(text, 'the', chr(1)), 'th', 'X'), chr(1), 'th') AS rewritten FROM documents")
def longest_key(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.lit(1).alias("scope"))
    return prototype.rewrite(d, spark.createDataFrame([(1, "th", "X"), (1, "the", "th")], "scope int, old string, new string"), "scope")


@query("d23_manual_types", "SELECT * FROM (VALUES (1, 'EMAIL'), (2, 'URL'), (3, 'COMPANY'), (4, 'ADDRESS'), (5, 'PERSON'), (6, 'DATE')) AS t(id, guess)")
def manual_types(spark, sf):
    v = [(1, "a@b", None), (2, "bay.example.com/x", None), (3, "Harbour Ltd", None), (4, "5 Pier Street, Bay City", None), (5, "Anna Berg", None), (6, "2020", "DATE")]
    return prototype.manual_types(spark.createDataFrame(v, "id int, value string, dominant string"))


@query("d21_learned_patterns", "SELECT lower(o_orderpriority) AS value, o_orderstatus AS type, 120 AS priority FROM orders GROUP BY ALL HAVING count(*) FILTER (o_orderkey % 2 = 0) > count(*) FILTER (o_orderkey % 2 = 1)")
def learned_patterns(spark, sf):
    from .registers import decisions

    return prototype.learned_patterns(decisions(spark, sf))


# --- whole documents, hooks -----------------------------------------------------------------------------------------


@query("d20_custom_vocabulary", f"SELECT doc_id, start, \"end\", 'TERM' AS type, text FROM ({sql_spans('documents', '(?i)data')}) UNION ALL SELECT doc_id, start, \"end\", 'CODE', text FROM ({sql_spans('documents', '[A-Z]{2,}[0-9]+')})")
def custom_vocabulary(spark, sf):
    """A term, an expression, and three that are ignored: empty, broken, able to match nothing."""
    p = [whole.Pattern("DATA", "TERM"), whole.Pattern("[A-Z]{2,}[0-9]+", "CODE", True, True), whole.Pattern(" ", "X"), whole.Pattern("(", "X", False, True), whole.Pattern("a*", "X", False, True)]
    return whole.custom_spans(table(spark, sf, "documents"), p).select("doc_id", "start", "end", "type", "text")


def customers(spark, sf):
    """Letters to customers, a session for each nation; the extractor reports the names."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("nation"), F.concat(F.lit("Dear "), "c_name", F.lit(", write to x"), F.col("c_custkey").cast("string"), F.lit("@b.example; "), "c_name", F.lit(" owes EUR 5.")).alias("text"))
    return c, lambda d: d.select("doc_id", F.regexp_extract("text", "^Dear ([^,]+),", 1).alias("value"), F.lit("PERSON").alias("type"))


@query("t00_anonymize_sessions", "SELECT c_custkey AS doc_id, 'Dear {PERSON_' || n || '}, write to {EMAIL_' || n || '}; {PERSON_' || n || '} owes {AMOUNT_1}.' AS tokenized FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)")
def anonymize_sessions(spark, sf):
    c, names = customers(spark, sf)
    return whole.anonymize(c, "nation", extractor=names)[0].select("doc_id", "tokenized")


@query("r00_restore_sessions", "SELECT c_custkey AS doc_id, 'Dear ' || c_name || ', write to x' || c_custkey || '@b.example; ' || c_name || ' owes EUR 5.' AS restored FROM customer")
def restore_sessions(spark, sf):
    """The same under pseudonyms, kept amounts, and back."""
    c, names = customers(spark, sf)
    out, mapping = whole.anonymize(c, "nation", style="pseudonym", extractor=names, span_filter=lambda s: s.where("type <> 'AMOUNT'"))
    out = materialize(out.select("doc_id", "nation", "tokenized"), "letters")
    return whole.restore(out, mapping, "nation", "pseudonym", orphans=False).select("doc_id", "restored")


@query("p00_sql_functions", "SELECT doc_id, regexp_replace(upper(coalesce(source, '')), '[^A-Z0-9]', '', 'g') AS stype, sha256(text) AS digest, lang || '|' || lower(trim(source)) AS key FROM documents WHERE regexp_matches(upper(coalesce(source, '')), '^[^A-Z0-9]*[A-Z]')")
def sql_functions(spark, sf):
    register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("vs_documents")
    return spark.sql("SELECT doc_id, vs_sanitize_type(coalesce(source, '')) AS stype, vs_text_digest(text) AS digest, vs_learning_key(lang, source) AS key FROM vs_documents WHERE regexp_like(upper(coalesce(source, '')), '^[^A-Z0-9]*[A-Z]')")
