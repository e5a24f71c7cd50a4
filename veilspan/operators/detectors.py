"""Detector rules: one row each. `pattern` runs on the folded view (P01); `keep` filters matches; the text of a span
is sliced from the original."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .regexspans import matches

# Needs run on every text: a class of ideographs is held by its range first, codes are looked for back from a digit alone.
# Province abbreviations (simplified, then traditional), case type characters, currency codes and words,
# month names, organization endings.
PROVINCES = "京津冀晋蒙辽吉黑沪苏浙皖闽赣鲁豫鄂湘粤桂琼渝川黔贵云藏陕甘青宁新" + "晉遼滬蘇閩贛魯粵瓊貴雲陝寧"
CASE_TYPES = "民刑行执赔委破财保申再初终监辖催督他撤特认异复恢协准更医救司知港澳台提减假强清" + "執賠財終監轄認異復協醫減強"
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
MOIS = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
CODES = "RMB|USD|EUR|GBP|CNY|JPY|HKD|TWD|SGD|MYR|THB|IDR|VND|INR|KRW|AUD|NZD|CAD|CHF|SEK|NOK|DKK|PLN|CZK|HUF|BGN|UAH|ILS|AED|QAR|KWD|BHD|OMR|JOD|EGP|ZAR|NGN|KES|BRL|MXN|CLP"
DOLLARS = r"(?<![A-Za-z])(?:US|HK|NZ|NT|AU|CA|SG|A|C|S|R)\$"
CN_MONEY = "人民币|港币|港元|美元|欧元|英镑|日元|新台币|台币|澳元|加元|新加坡元|瑞士法郎"
ORG_ENDS = "有限责任公司|股份有限公司|有限公司|公司|事务所|委员会|法院|银行|中心|集团|医院|大学|厂"
TLDS = "com|org|net|edu|gov|io|co|cn|hk|tw|uk|de|fr|es|jp|eu|us|info|biz|ai|app|dev|me|ca|au|ch|nl"

VIEW = "__v"
FOUND = "array<struct<start:int,end:int,type:string,confidence:double,priority:int,rule:string>>"
NUM = r"(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?|[0-9]{1,3}(?:[ \x{A0}\x{202F}][0-9]{3})+(?:,[0-9]{1,2})?|[0-9]+(?:[.,][0-9]+)?)"
MAG = r"(?:[ \x{A0}]?(?:million|billion|trillion|thousand|mn|bn|m|k)(?![A-Za-z]))?[万亿萬億]{0,2}"
GAP = r"[ \x{3000}]{0,2}"


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    priority: int
    confidence: float
    pattern: str
    keep: Callable[[Column], Column] | None = None
    score: Callable[[Column], Column] | None = None
    trim: Callable[[Column], Column] | None = None
    need: str | None = None  # a cheap pattern that every text with a match holds


def _cued(cues: str, value: str, gap: str = r"[ ]{0,2}[:：#]?[ ]{0,2}") -> str:
    return f"(?i)(?<=(?:{cues}){gap}){value}"


RULES = [
    Rule("D01", "EMAIL", 80, 0.99, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,251})\.[A-Za-z]{2,63}", need=r"@"),
    Rule("D02", "PHONE", 60, 0.9, r"\+[0-9]{1,3} [0-9](?:[ .][0-9]{2}){4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}|(?<![0-9])1[3-9][0-9]{9}(?![0-9])|(?<![0-9+])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])(?:0[0-9]{2,3}-|\(0[0-9]{2,3}\) ?)[0-9]{7,8}(?![0-9-])|(?<![0-9+])0[1-9](?:[ .][0-9]{2}){4}(?![0-9])", need=r"[0-9]{2}"),
    Rule("D03", "NATIONAL_ID", 100, 1.0, r"(?<![0-9A-Za-z])[0-9]{17}[0-9Xx](?![0-9A-Za-z])", keep=tx.cn_id_ok, need=r"[0-9]{17}"),
    Rule("D04", "NATIONAL_ID", 92, 0.9, r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", keep=tx.ssn_ok, need=r"[0-9]{3}-[0-9]{2}-"),
    Rule("D05", "USCC", 95, 0.9, r"(?<![0-9A-Za-z])[0-9A-HJ-NP-RTUWXY]{2}[0-9]{6}[0-9A-HJ-NP-RTUWXY]{10}(?![0-9A-Za-z])", score=lambda t: F.when(tx.uscc_ok(t), 0.98).otherwise(0.9), need=r"[0-9]{6}"),
    Rule("D06", "CASE_NUMBER", 90, 0.99, rf"[（(][12][0-9]{{3}}[）)]{GAP}(?:(?:最高法|(?:[{PROVINCES}]兵?[团團]?|兵[团團]?|[军軍]){GAP}[0-9]{{0,4}}){GAP}[{CASE_TYPES}]{{1,4}}{GAP}[0-9]{{1,8}}{GAP}[号號](?:之[一二三四五六七八九十]{{1,3}})?|[\p{{IsHan}}0-9]{{0,12}}?(?:[（(]\p{{IsHan}}{{1,2}}[）)])?\p{{IsHan}}{{0,4}}?字第{GAP}[0-9]{{1,8}}{GAP}[号號])", need=r"[号號]"),
    Rule("D07", "LICENSE_PLATE", 85, 0.95, rf"(?<![A-Za-z0-9])[{PROVINCES}][A-HJ-NP-Z][·• ]?[A-HJ-NP-Z0-9]{{4,6}}[挂学警港澳领]?(?![A-Za-z0-9])", need=rf"[一-鿿&&[{PROVINCES}]][A-Z]"),
    Rule("D08", "WECHAT_ID", 58, 0.9, r"(?<=(?:微信号?|WeChat|wechat|weixin)(?: ID)?[ ]{0,2}[:：]?[ ]{0,2})[A-Za-z][A-Za-z0-9_-]{5,19}(?![A-Za-z0-9_-])|(?<![A-Za-z0-9_])wxid_[A-Za-z0-9]{6,20}", need=r"(?i)we(?:chat|ixin)|微信|wxid_"),
    Rule("D09", "SEAL", 56, 0.9, rf"[一-鿿A-Za-z0-9]{{2,30}}(?<={ORG_ENDS})(?:公章|合同专用章|财务专用章|发票专用章|印章)", need=r"章"),
    Rule("D10", "URL", 75, 0.9, rf"https?://[A-Za-z0-9][^\s<>\"一-鿿，。；]*|(?<![A-Za-z0-9._@/-])www(?:\.[A-Za-z0-9-]+){{1,5}}\.[A-Za-z]{{2,}}(?:/[^\s<>\"一-鿿]*)?|(?<![A-Za-z0-9._@/-])(?:[A-Za-z0-9][A-Za-z0-9-]{{0,62}}\.){{1,5}}(?:{TLDS})(?![A-Za-z0-9-])(?:/[^\s<>\"一-鿿]*)?", trim=tx.trim_url_tail, need=r"[A-Za-z0-9]\.[A-Za-z]|://"),
    Rule("D11", "ADDRESS", 55, 0.9, r"(?:[一-鿿&&[^住在于位址和与及是的为]]{1,8}[省市区县縣區]){1,4}[一-鿿0-9]{1,12}[路街道巷][0-9]{1,5}[号號弄](?:[0-9A-Za-z一-十]{1,5}[栋幢楼室层号棟樓層])*", need=r"[路街道巷][0-9]"),
    Rule("D12", "BANK_ACCOUNT", 50, 0.85, r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])", need=r"[0-9][0-9 -]{11}"),
    Rule("D13", "DATE", 40, 0.8, rf"(?<![0-9])[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}(?![0-9])|(?<![0-9])[0-9]{{1,4}}/[0-9]{{1,2}}/[0-9]{{1,4}}(?![0-9])|(?<![0-9])[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}(?![0-9])|[0-9]{{4}}[ ]{{0,4}}年[ ]{{0,4}}[0-9]{{1,2}}[ ]{{0,4}}月(?:[ ]{{0,4}}[0-9]{{1,2}}[ ]{{0,4}}[日号])?|(?:民國|民国)[0-9]{{2,3}}年[0-9]{{1,2}}月[0-9]{{1,2}}日|[〇零一二三四五六七八九]{{4}}年[一二三四五六七八九十]{{1,2}}月(?:[一二三四五六七八九十]{{1,3}}日)?|(?<![A-Za-z])(?:{MONTHS})\.? [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}}|(?<![0-9])[0-9]{{1,2}}(?:st|nd|rd|th)?(?: day)?(?: of)? (?:{MONTHS})\.?,? [0-9]{{4}}|(?<![A-Za-z])(?:{MONTHS})\.? [0-9]{{4}}|(?<![0-9])(?:1er|[0-9]{{1,2}}) (?:{MOIS}) [0-9]{{4}}", need=r"[0-9]{2}|年"),
    Rule("D14", "AMOUNT", 45, 0.8, rf"(?i)(?:{DOLLARS}|(?<![A-Za-z])(?:{CODES})\$?|[¥￥$€£]|{CN_MONEY})[ \x{{A0}}]?{NUM}{MAG}(?:[ \x{{A0}}]?[元圆][整正]?)?|(?<![0-9.,]){NUM}{MAG}[ \x{{A0}}]?(?:[元圆]|{CN_MONEY}|{CODES}|U\.S\.\s{{1,2}}dollars?|US\s{{1,2}}dollars?|dollars?|euros?|pounds?(?:\s{{1,2}}sterling)?|yen|yuan|renminbi|[€£¥￥])[整正]?(?![A-Za-z])|(?<![0-9.])[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?[万亿萬億]元?|(?:人民币)?[零壹贰叁肆伍陆柒捌玖拾佰仟][零壹贰叁肆伍陆柒捌玖拾佰仟万亿]{{0,23}}[元圆](?:[零壹贰叁肆伍陆柒捌玖]{{1,2}}[角分]){{0,2}}[整正]?|(?:人民币)?(?=[一二三四五六七八九十两〇零百千万亿]{{0,15}}[十百千万亿])[一二三四五六七八九十两][一二三四五六七八九十百千万亿两零〇]{{0,15}}[元圆]整?", need=rf"[$£¥[€-￥&&[€￥元圆万亿萬億币镑郎]]]|(?i:[0-9](?:[ \x{{A0}}]?(?:[A-Z]{{3}}\b|dollar|euro|pound|yen|yuan|renminbi|million|billion|trillion|thousand|U\.S\.|mn|bn|[mk]\b)|(?<=(?:{CODES})[ \x{{A0}}]?[0-9])))"),
    Rule("D15", "AMOUNT", 45, 0.8, r"(?<![0-9.])[0-9]+(?:\.[0-9]+)?(?=(?:[，、][0-9]+(?:\.[0-9]+)?){1,10}(?:万元|亿元|元|万|亿))", need=r"[0-9][，、][0-9]"),
    Rule("D16", "NATIONAL_ID", 92, 0.95, _cued("passport(?: no\\.?| number)?|护照号?码?|通行证号?码?|身份证号?码?|HKID|ITIN|SSN", r"(?:[A-Z]{1,2}[0-9]{6,9}(?:\([0-9A]\))?|[0-9]{17}[0-9X]|[0-9]{15}|9[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4})(?![0-9A-Za-z])"), need=r"(?i)passport|护照|通行证|身份证|HKID|ITIN|SSN"),
    Rule("D17", "BANK_ACCOUNT", 50, 0.85, _cued("account(?: no\\.?| number)?|a/c|账号|账户|帐号", r"[0-9]{6,11}(?![0-9])"), need=r"(?i)account|a/c|账号|账户|帐号"),
    Rule("D18", "BANK_ACCOUNT", 50, 0.95, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", trim=tx.iban_prefix, need=r"[A-Z]{2}[0-9]{2}"),
    Rule("D19", "CASE_NUMBER", 90, 0.9, r"(?<![A-Za-z0-9:])[0-9]{1,2}:[0-9]{2}-[a-z]{2,4}-[0-9]{3,6}(?:-[A-Z]{2,4})?|(?<![A-Za-z])(?:HCA|HCMP|CACV|CACC|DCCC|DCCJ|FACV|HCAL|CFA) ?[0-9]{1,5}/[0-9]{4}|(?<=(?:Case|Docket) No\. ?)[A-Z]{1,4}[0-9]{1,4}(?:[-/][0-9A-Z]{1,6}){1,4}", need=r"[0-9]:[0-9]|[A-Z]{2} ?[0-9]+/|No\."),
]


def _found(r: Rule) -> Column:
    """array<struct> of one rule's matches on the folded view. A rule runs only where the view holds what it needs."""

    def trimmed(m: Column) -> Column:
        value = r.trim(m["text"]) if r.trim else m["text"]
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(value)).alias("end"), value.alias("v"))

    def span(m: Column) -> Column:
        conf = r.score(m["v"]) if r.score else F.lit(r.confidence)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(r.kind).alias("type"), conf.cast("double").alias("confidence"), F.lit(r.priority).alias("priority"), F.lit(r.id).alias("rule"))

    found = F.transform(matches(F.col(VIEW), r.pattern), trimmed)
    if r.keep:
        found = F.filter(found, lambda m: r.keep(m["v"]))
    elif r.trim:
        found = F.filter(found, lambda m: F.length(m["v"]) > 0)
    out = F.transform(found, span)
    return F.when(F.col(VIEW).rlike(r.need), out).otherwise(F.array().cast(FOUND)) if r.need else out


def found_in(rules: list[Rule] | None = None) -> Column:
    """array<struct(start, end, type, confidence, priority, rule)> of all rules on the column VIEW."""
    return F.concat(*[_found(r) for r in rules or RULES])


def detect(docs: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, type, text, source, confidence, priority, rule) of every match; one scan of the documents,
    all rules on the row, no shuffle. Overlaps are kept. Null and empty texts have no spans; rows repeated with one key
    are scanned row by row; only key and text are read, so other columns may have any name."""
    view = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t"), tx.pattern_view(F.col(text)).alias(VIEW)).where(F.col("__t").isNotNull())
    x = view.select("__k", "__t", F.explode(found_in(rules)).alias("s"))
    return x.select(F.col("__k").alias(key), "s.start", "s.end", "s.type", F.substring(F.col("__t"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"), F.lit("deterministic").alias("source"), "s.confidence", "s.priority", "s.rule")
