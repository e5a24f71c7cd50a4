"""Queries of the scalar text functions (P01 to P33) over small inline fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from .registry import query, table, values

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CJK = "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}"
WIDE = CJK + "\\x{3000}-\\x{303F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}"
NAMES = "(VALUES (1, 'PERSON', 'Maria Lopez'), (2, 'PERSON', '欧阳明月'), (3, 'PERSON', '李雷'), (4, 'PHONE', '13800138000'), (5, 'NATIONAL_ID', '110101199003070000'), (6, 'COMPANY', 'Harbour Freight Ltd'), (7, 'AMOUNT', '5'), (8, 'PERSON', 'X')) AS t(id, kind, v)"
TEXTS = "(VALUES (1, 'Tel： ＋８６（10）‐6'), (2, '  Two   Words　here '), (3, '合同 ABC 编号 12 号'), (4, 'plain'), (5, ''), (6, 'Naïve Café — owner''s COPY'), (7, '1bank account'), (8, 'bank_account')) AS t(id, v)"
IDS = "(VALUES (1, '11010519491231002X'), (2, '110105194912310021'), (3, '91350100M000100Y43'), (4, '91350100M000100Y44'), (5, '123-45-6789'), (6, '000-45-6789'), (7, '900-11-1111'), (8, '123-00-6789'), (9, 'GB82 WEST 1234 5698 7654 32'), (10, 'GB82 WEST 1234 5698 7654 33'), (11, '440524188001010014')) AS t(id, v)"
LABELS = "(VALUES (1, 'Please insert the name of Client:'), (2, 'Enter  the DATE'), (3, 'Amount：'), (4, 'the the x')) AS t(id, v)"
MODEL = "(VALUES (1, '<think>hm\n x</think> [1]'), (2, 'a <REASONING>b</REASONING>c'), (3, 'plain')) AS t(id, v)"
TIERS = "(VALUES (1, 3.5), (2, 6.5), (3, 13.8), (4, 21.0), (5, 22.1)) AS t(id, gb)"


def scalar(name, fixture, column, sql):
    @query(name, f"SELECT id, {sql} AS out FROM {fixture}")
    def run(spark, sf):
        return values(spark, fixture).select("id", column().alias("out"))


v, c = (lambda: F.col("v")), F.col
_norm = "trim(regexp_replace(lower(v), '[\\s\\p{Z}]+', ' ', 'g'), ' ')"
scalar("p01_pattern_view", TEXTS, lambda: tx.pattern_view(v()), f"translate(v, '{tx.FULL_FROM}', '{tx.FULL_TO}')")
SEPS = {"3．14": "3.14", "1，234，567元": "1,234,567元", "12，34": "12，34", "a，123": "a，123", "99，000": "99,000", "100，200": "100，200", "1234，567": "1234，567", "100，000元": "100,000元", "100，200，300元": "100，200，300元", "1，000，2，000元": "1,000，2,000元", "123，456．78元": "123,456.78元", "1，250，000．00元": "1,250,000.00元", "．5": "．5", "": ""}


@query("p02_fullwidth_separators", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SEPS.items()) + ") AS t(v, out)")
def separators(spark, sf):
    return spark.createDataFrame([(k,) for k in SEPS], "v string").withColumn("out", tx.fullwidth_separators(F.col("v")))


scalar("p03_sanitize_type", TEXTS, lambda: tx.sanitize_type(v()), "CASE WHEN regexp_replace(upper(v), '[^A-Z0-9]', '', 'g') = '' THEN 'UNKNOWN' WHEN regexp_matches(regexp_replace(upper(v), '[^A-Z0-9]', '', 'g'), '^[0-9]') THEN 'X' || regexp_replace(upper(v), '[^A-Z0-9]', '', 'g') ELSE regexp_replace(upper(v), '[^A-Z0-9]', '', 'g') END")
scalar("p04_normalize", TEXTS, lambda: tx.normalize(v()), _norm)
scalar("p05_significant_words", TEXTS, lambda: F.array_join(F.array_sort(tx.significant_words(v())), " "), "array_to_string(list_sort(list_distinct(list_filter(string_split_regex(strip_accents(lower(v)), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 4))), ' ')")
scalar("p06_cjk_tighten", TEXTS, lambda: tx.cjk_tighten(v()), f"regexp_replace(regexp_replace(v, '([{CJK}]) +([A-Za-z0-9])', '\\1\\2', 'g'), '([A-Za-z0-9]) +([{CJK}])', '\\1\\2', 'g')")
scalar("p07_contains_cjk", TEXTS, lambda: tx.contains_cjk(v()), f"regexp_matches(v, '[{CJK}]')")
scalar("p08_safe_doc_type", TEXTS, lambda: tx.safe_doc_type(v()), "coalesce(nullif(substr(regexp_replace(regexp_replace(upper(v), '[^\\p{L}\\p{N}\\p{M}_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), ''), 'DOCUMENT')")
scalar("p09_display_width", TEXTS, lambda: tx.display_width(v()), f"CAST(length(v) + length(regexp_replace(v, '[^{WIDE}]', '', 'g')) AS INTEGER)")
scalar("p10_fold_audit", TEXTS, lambda: tx.fold_audit(v()), "trim(regexp_replace(lower(v), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g'), ' ')")
scalar("p11_strict_normalize", "(VALUES (1, ' ＡＢＣ  Ltd. '), (2, '(Maria)'), (3, 'ﬁne')) AS t(id, v)", lambda: tx.strict_normalize(v()), "CASE id WHEN 1 THEN 'abc ltd' WHEN 2 THEN 'maria' ELSE 'fine' END")
scalar("p12_estimate_tokens", TEXTS, lambda: tx.estimate_tokens(v()), f"CAST(length(regexp_replace(v, '[^{CJK}]', '', 'g')) + ceil(length(regexp_replace(v, '[{CJK}]', '', 'g')) / 4.0) AS BIGINT)")
scalar("p13_label_normalize", LABELS, lambda: tx.label_normalize(v()), "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(v)), '^please ', ''), '^insert ', ''), '^enter ', ''), '^the ', ''), '^name of ', ''), '\\s+', ' ', 'g'), '[:：]', '', 'g'))")
@query("p14_context_window", "SELECT doc_id, substr(text, 1, 10) AS before, substr(text, 16, 120) AS after FROM documents")
def context(spark, sf):
    w = tx.context_window(F.col("text"), F.lit(10), F.lit(15))
    return table(spark, sf, "documents").select("doc_id", w["before"].alias("before"), w["after"].alias("after"))


scalar("p15_text_digest", TEXTS, lambda: F.sha2(v(), 256), "sha256(v)")
scalar("p16_entity_id", NAMES, lambda: tx.entity_id(F.lit("doc_0123456789ab"), c("kind"), c("id"), c("id") + 5), "substr(sha256('doc_0123456789ab|' || kind || '|' || id || '|' || (id + 5)), 1, 12)")
scalar("p17_learning_key", NAMES, lambda: tx.learning_key(c("kind"), v()), "kind || '|' || lower(trim(v))")
_A = tx.USCC_ALPHABET
scalar("p18_cn_id_checksum", IDS, lambda: tx.cn_id_ok(v()), "coalesce(regexp_full_match(v, '[0-9]{17}[0-9Xx]') AND substr('10X98765432', CAST(list_sum(list_transform(range(1, 18), lambda i: TRY_CAST(v[i] AS INTEGER) * ((1 << (18 - i)) % 11))) % 11 + 1 AS INTEGER), 1) = upper(v[18]), false)")
scalar("p19_uscc_checksum", IDS, lambda: F.when(F.length("v") == 18, tx.uscc_ok(v())).otherwise(False), f"length(v) = 18 AND instr('{_A}', v[18]) - 1 = (31 - list_sum(list_transform(range(1, 18), lambda i: (instr('{_A}', v[i]) - 1) * (CAST(pow(3, i - 1) AS BIGINT) % 31))) % 31) % 31")
scalar("p20_iban_mod97", IDS, lambda: tx.iban_ok(v()), "regexp_full_match(replace(v, ' ', ''), '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}') AND coalesce(TRY_CAST(array_to_string(list_transform(range(1, length(replace(v, ' ', '')) + 1), lambda i: CAST(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4))[i]) - 1 AS VARCHAR)), '') AS HUGEINT) % 97 = 1, false)")
scalar("p21_ssn_structure", IDS, lambda: F.when(v().rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), tx.ssn_ok(v())).otherwise(False), "regexp_full_match(v, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND substr(v, 1, 3) NOT IN ('000', '666') AND substr(v, 1, 3) < '900' AND substr(v, 5, 2) <> '00' AND substr(v, 8) <> '0000'")
scalar("p23_asterisk_mask", NAMES, lambda: tx.asterisk_mask(v(), c("kind")), "CASE id WHEN 1 THEN 'M**** L****' WHEN 2 THEN '欧**月' WHEN 3 THEN '李*' WHEN 4 THEN '138****8000' WHEN 5 THEN '110*************00' WHEN 6 THEN 'Har*************Ltd' ELSE '*' END")
LETTERS = {0: "A", 25: "Z", 26: "AA", 51: "AZ", 52: "BA", 701: "ZZ", 702: "AAA", 18277: "ZZZ", 18278: "AAAA"}


@query("p24_letter_sequence", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in LETTERS.items()) + ") AS t(n, out)")
def letters(spark, sf):
    return spark.createDataFrame([(k,) for k in LETTERS], "n int").withColumn("out", tx.letter_sequence(F.col("n")))


PSEUDONYMS = [("EMAIL", "latin", 2, "contact3@example.com"), ("PERSON", "latin", 0, "Person A"), ("PERSON", "latin", 27, "Person AB"), ("BANK_ACCOUNT", "latin", 2, "Account 3"), ("WECHAT_ID", "latin", 0, "Item 1"), ("COMPANY", "zh", 0, "甲公司"), ("COMPANY", "zh", 12, "丙一公司"), ("COMPANY", "zh", 115, "己11公司"), ("PERSON", "zh", 1, "李某"), ("PERSON", "zh", 50, "人物51"), ("ADDRESS", "zh", 26, "某地址AA"), ("PHONE", "zh", 1, "某电话2"), ("URL", "zh", 4, "某某5")]


@query("p25_pseudonym_candidates", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{z}', {i}, '{o}')" for k, z, i, o in PSEUDONYMS) + ") AS t(kind, script, i, out)")
def candidates(spark, sf):
    from ..operators.sessions import pseudonym

    return spark.createDataFrame([r[:3] for r in PSEUDONYMS], "kind string, script string, i int").withColumn("out", pseudonym(F.col("kind"), F.col("script"), F.col("i")))


PREFIXES = {"BE68 5390 0754 7034 PAID": "BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32": "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33": None, "BE68-5390-0754-7034": "BE68-5390-0754-7034"}


@query("p20_iban_prefix", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {repr(v) if v else 'NULL'})" for k, v in PREFIXES.items()) + ") AS t(v, out)")
def iban_prefixes(spark, sf):
    return spark.createDataFrame([(k,) for k in PREFIXES], "v string").withColumn("out", tx.iban_prefix(F.col("v")))


TAILS = {"https://a.example/x).).).).).).": "https://a.example/x", "https://a.example/w_(x)": "https://a.example/w_(x)", "www.b.example/!?": "www.b.example/", "https://c.example/[a]]": "https://c.example/[a]", "https://d.example/q?a=1,": "https://d.example/q?a=1", "": ""}


@query("p22_trim_url_tail", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TAILS.items()) + ") AS t(v, out)")
def url_tails(spark, sf):
    return spark.createDataFrame([(k,) for k in TAILS], "v string").withColumn("out", tx.trim_url_tail(F.col("v")))


scalar("p31_think_strip", MODEL, lambda: tx.think_strip(v()), "trim(regexp_replace(v, '(?is)<think>.*?</think>|<reasoning>.*?</reasoning>', '', 'g'), ' ')")
scalar("p32_table_cell", "(VALUES (1, 'a|b'), (2, 'x\ny')) AS t(id, v)", lambda: tx.table_cell(v()), "regexp_replace(replace(v, '|', chr(92) || '|'), '[\\r\\n]+', ' ', 'g')")
scalar("p33_hardware_tier", TIERS, lambda: tx.hardware_tier(c("gb")), "CASE WHEN gb <= 6.5 THEN '8GB' WHEN gb <= 14 THEN '16GB' WHEN gb <= 21 THEN '24GB' ELSE '32GB+' END")
scalar("r01_decode_tokens", "(VALUES (1, '{PERSON' || chr(92) || '_1} x'), (2, '{DATE_2}')) AS t(id, v)", lambda: tx.decode_markdown_token(v()), "replace(v, chr(92), '')")
scalar("c02_script_of_surface", NAMES, lambda: F.when(tx.contains_cjk(v()), "cjk").otherwise("latin"), f"CASE WHEN regexp_matches(v, '[{CJK}]') THEN 'cjk' ELSE 'latin' END")
