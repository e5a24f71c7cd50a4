"""Scalar text functions as Column expressions; all stay in the JVM unless marked Arrow. Null in, null out."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"
WIDE = CJK + "　-〿＀-｠￠-￦"
FULL_FROM = "‐‑－０１２３４５６７８９＋（）"
FULL_TO = "---0123456789+()"
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"


def pattern_view(c: Column) -> Column:
    """One-to-one fold, so offsets stay valid."""
    return F.translate(c, FULL_FROM, FULL_TO)


CHAIN = re.compile(r"[0-9]+(?:，[0-9]+)+")


def _group_commas(m: re.Match) -> str:
    """Full-width commas of one chain of digit runs: those that group thousands become ','."""
    runs, tail = m.group().split("，"), m.string[m.end() : m.end() + 2]
    decimal = len(tail) == 2 and tail[0] in ".．" and tail[1].isdecimal() and tail[1].isascii()
    reach, zeros = list(range(len(runs))), [False] * len(runs)
    for k in range(len(runs) - 2, -1, -1):  # how far the runs of three go on, and whether one of them is 000
        if len(runs[k + 1]) == 3:
            reach[k], zeros[k] = reach[k + 1], zeros[k + 1] or runs[k + 1] == "000"
    out, k = runs[0], 0
    while k < len(runs):
        n, end = len(runs[k]), reach[k]
        if end > k and n <= 3 and (n < 3 or zeros[k] or (decimal and end == len(runs) - 1)):
            out += "".join("," + x for x in runs[k + 1 : end + 1])
            k = end
        k += 1
        if k < len(runs):
            out += "，" + runs[k]
    return out


@F.arrow_udf(T.StringType())
def _grouped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else CHAIN.sub(_group_commas, t) for t in texts.to_pylist()], pa.string())


def fullwidth_separators(c: Column) -> Column:
    """U+FF0E between digits is a point; U+FF0C is a comma where it groups thousands: runs of three after a lead of
    one or two digits, or of three where a later run is 000 or a decimal part follows. Lengths stay. (Arrow for texts
    with such a comma between digits; null stays null.)"""
    grouped = F.when(c.rlike("[0-9]，[0-9]"), _grouped(c)).otherwise(c)
    return F.regexp_replace(grouped, "(?<=[0-9])．(?=[0-9])", ".")


def sanitize_type(c: Column) -> Column:
    t = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(t == "", "UNKNOWN").when(t.rlike("^[0-9]"), F.concat(F.lit("X"), t)).otherwise(t)


def normalize(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", " "))


@F.arrow_udf(T.StringType())
def fold_marks(texts: pa.Array) -> pa.Array:
    """Lower case without diacritics (Arrow: Unicode decomposition has no built-in); null stays null."""
    plain = lambda t: "".join(ch for ch in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(ch))
    return pa.array([None if t is None else t.lower() if t.isascii() else plain(t) for t in texts.to_pylist()], pa.string())


def significant_words(c: Column) -> Column:
    """Distinct words of four letters or digits at least, without diacritics."""
    return F.array_distinct(F.filter(F.split(fold_marks(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4))


def share_significant(a: Column, b: Column) -> Column:
    """Whether two values share a significant word."""
    return F.arrays_overlap(significant_words(a), significant_words(b))


def context_window(text: Column, start: Column, end: Column, width: int = 120) -> Column:
    """(before, after) of a range: at most `width` characters on each side, cut at the text's ends."""
    lo = F.greatest(F.lit(0), start - width)
    return F.struct(F.substring(text, lo + 1, start - lo).alias("before"), F.substring(text, end + 1, F.lit(width)).alias("after"))


def cjk_tighten(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"(?<=[{CJK}]) +(?=[A-Za-z0-9])", ""), f"(?<=[A-Za-z0-9]) +(?=[{CJK}])", "")


def contains_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")


def safe_doc_type(c: Column) -> Column:
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.upper(c), r"(?U)[^\w]+", "_"), "^_+|_+$", ""), 1, 40)
    return F.when(F.coalesce(slug, F.lit("")) == "", "DOCUMENT").otherwise(slug)


def display_width(c: Column) -> Column:
    return F.length(c) + F.length(F.regexp_replace(c, f"[^{WIDE}]", ""))


def fold_audit(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}]+", " "))


def estimate_tokens(c: Column) -> Column:
    wide = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    return (wide + F.ceil((F.length(c) - wide) / 4)).cast("long")


def label_normalize(c: Column) -> Column:
    x = F.trim(F.lower(c))
    for p in ("please ", "insert ", "enter ", "the ", "name of "):
        x = F.regexp_replace(x, "^" + p, "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "[:：]", ""))


def entity_id(handle: Column, kind: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", handle, kind, start.cast("string"), end.cast("string")), 256), 1, 12)


def learning_key(kind: Column, value: Column) -> Column:
    return F.concat_ws("|", kind, F.lower(F.trim(value)))


def _weighted(c: Column, weights: list[int], alphabet: str) -> Column:
    chars = F.split(c, "")
    return F.aggregate(F.zip_with(chars, F.array(*[F.lit(w) for w in weights]), lambda ch, w: F.when(w.isNotNull(), (F.instr(F.lit(alphabet), ch) - 1) * w).otherwise(0)), F.lit(0), lambda a, x: a + x)


def cn_id_ok(c: Column) -> Column:
    """ISO 7064 mod 11-2."""
    total = _weighted(F.substring(c, 1, 17), [2**k % 11 for k in range(17, 0, -1)], "0123456789")
    return c.rlike("^[0-9]{17}[0-9Xx]$") & (F.substring(F.lit("10X98765432"), (total % 11 + 1), F.lit(1)) == F.upper(F.substring(c, 18, 1)))


def uscc_ok(c: Column) -> Column:
    """Mod 31 over weights 3**i."""
    total = _weighted(F.substring(c, 1, 17), [3**k % 31 for k in range(17)], USCC_ALPHABET)
    return F.coalesce(F.instr(F.lit(USCC_ALPHABET), F.substring(c, 18, 1)) - 1 == (31 - total % 31) % 31, F.lit(False))


def iban_ok(c: Column) -> Column:
    """P20: mod 97 of the rearranged digits, folded left to right."""
    x = F.upper(F.regexp_replace(c, "[ -]", ""))
    turned = F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))
    digits = F.transform(F.split(turned, ""), lambda ch: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ch) - 1)
    return x.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (F.aggregate(digits, F.lit(0), lambda a, d: F.when(d < 0, a).when(d < 10, (a * 10 + d) % 97).otherwise((a * 100 + d) % 97)) == 1)


def iban_prefix(c: Column) -> Column:
    """P20: the longest prefix of whole groups (parted by a blank or dash) that is a valid IBAN; null if none is."""
    parts = F.split(c, "[ -]", -1)
    ends = F.transform(parts, lambda _, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda a, w: a + F.length(w)) + i)
    prefixes = F.transform(ends, lambda e: F.substring(c, F.lit(1), e))
    return F.try_element_at(F.filter(prefixes, iban_ok), F.lit(-1))


def ssn_ok(c: Column) -> Column:
    area = F.substring(c, 1, 3)
    return ~area.isin("000", "666") & (area < "900") & (F.substring(c, 5, 2) != "00") & (F.substring(c, 8, 4) != "0000")


def trim_url_tail(c: Column) -> Column:
    """Closing punctuation goes, closing brackets only while unbalanced. A walk back over the characters: each is
    judged by the brackets that are left, counted once."""
    count = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    start = F.struct(F.lit(0).alias("cut"), F.lit(False).alias("done"), (count(")") - count("(")).alias("round"), (count("]") - count("[")).alias("square"))

    def step(a: Column, ch: Column) -> Column:
        go = F.when(ch == ")", a["round"] > 0).when(ch == "]", a["square"] > 0).otherwise(ch.isin(*".,;:!?'\""))
        go = ~a["done"] & go
        one = go.cast("int")
        return F.struct((a["cut"] + one).alias("cut"), (a["done"] | ~go).alias("done"), (a["round"] - F.when(ch == ")", one).otherwise(0)).alias("round"), (a["square"] - F.when(ch == "]", one).otherwise(0)).alias("square"))

    tail = F.split(F.reverse(F.regexp_extract(c, r"[.,;:!?'\")\]]+$", 0)), "")
    return F.aggregate(F.filter(tail, lambda ch: ch != ""), start, step, lambda a: F.substring(c, F.lit(1), F.length(c) - a["cut"]))


def _keep(c: Column, head: Column | int, tail: Column | int) -> Column:
    head, tail = F.lit(head), F.lit(tail)
    return F.concat(F.substring(c, F.lit(1), head), F.repeat(F.lit("*"), F.length(c) - head - tail), F.when(tail > 0, F.substring(c, F.length(c) - tail + 1, tail)).otherwise(""))


def asterisk_mask(c: Column, kind: Column) -> Column:
    """P23."""
    n = F.length(c)
    person = F.when(contains_cjk(c), F.when(n >= 3, _keep(c, 1, 1)).otherwise(_keep(c, 1, 0))).otherwise(F.array_join(F.transform(F.split(c, " "), lambda w: F.when(F.length(w) > 1, F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), F.length(w) - 1))).otherwise(w)), " "))
    fifth = F.floor(n * 0.2).cast("int")
    return F.when(n <= 1, "*").when(kind == "PERSON", person).when((kind == "PHONE") & (n > 7), _keep(c, 3, 4)).when((kind == "NATIONAL_ID") & (n > 5), _keep(c, 3, 2)).otherwise(_keep(c, fifth, fifth))


def letter_sequence(n: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, 702 -> AAA: digits of n in base 26 without a zero. Seven letters hold any int."""
    step = lambda a, _: F.struct(
        F.when(a["left"] < 0, a["left"]).otherwise(F.floor(a["left"] / 26) - 1).alias("left"),
        F.when(a["left"] < 0, a["out"]).otherwise(F.concat(F.char(F.pmod(a["left"], F.lit(26)) + 65), a["out"])).alias("out"),
    )
    zero = F.struct(n.cast("bigint").alias("left"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), zero, step, lambda a: a["out"])


def decode_markdown_token(c: Column) -> Column:
    return F.regexp_replace(c, r"\{([A-Z0-9]+)\\_([0-9]+)\}", "{$1_$2}")


def think_strip(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "(?is)<(think|reasoning)>.*?</\\1>", ""))


def table_cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit(r"\|")), r"[\r\n]+", " ")


def hardware_tier(gb: Column) -> Column:
    return F.when(gb <= 6.5, "8GB").when(gb <= 14, "16GB").when(gb <= 21, "24GB").otherwise("32GB+")


@F.pandas_udf(T.StringType())
def strict_normalize(s: pd.Series) -> pd.Series:
    """P11 (Arrow): NFKC has no built-in."""

    def one(t):
        if t is None:
            return None
        t = "".join(ch for ch in unicodedata.normalize("NFKC", t) if ch not in "​‌‍﻿")
        return " ".join(t.split()).strip(" .,;:!?\"'()[]{}<>").casefold()

    return s.map(one)
