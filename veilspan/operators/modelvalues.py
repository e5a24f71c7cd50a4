"""From a model's values to spans: boilerplate and defined terms out, every occurrence found, misses classified.

The work on one document is plain Python on its own text and its own values, run over Arrow batches; the values are
grouped by document first, so a document's text is read once, whatever the number of its values.

Edge cases: null or blank values are dropped; a null text has no occurrence; values repeated in one document (case and
outer blanks aside) count once for each type; rows with a null key match nothing; other columns are not read. Offsets are
code points.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spanalgebra import ROLE_LABELS

KEPT_TYPES = ("PERSON", "COMPANY", "ADDRESS", "NATIONAL_ID", "TRADEMARK", "CASE_NUMBER")


def plural(noun: str) -> str:
    return noun[:-1] + "ies" if noun.endswith("y") and noun[-2] not in "aeo" else noun + "s"


# Nouns that name a role, an organ or a part of a document (their plurals by rule), phrases, bodies and
# shorthands; jurisdictions; last words of an instrument's name; words that end a clipped phrase.
NOUNS = (
    "company corporation employer employee executive customer supplier vendor licensor licensee collaborator consultant contractor subcontractor person individual entity "
    "subsidiary affiliate successor assign representative agent attorney party user client recipient signatory witness arbitrator buyer seller lender borrower tenant landlord "
    "guarantor trustee president agreement contract exhibit schedule amendment section article recital invention"
).split()
NOUN_PHRASES = ("former employer", "third party", "associated third party", "other person", "such person", "trade secret")
PHRASES = (
    "third-party", "associated third", "parent company", "counsel", "clients and customers", "mediator", "beneficiaries", "vice president", "ceo", "cfo", "coo", "cto", "cio",
    "chief executive officer", "chief financial officer", "chief operating officer", "chief technology officer", "chairman", "chairwoman", "chairperson", "chair", "secretary", "treasurer",
    "general counsel", "managing director", "executive officer", "board of directors", "board", "human resources", "this agreement", "appendix", "appendices", "addendum", "addenda", "whereas",
    "confidential information", "company confidential information", "proprietary information", "intellectual property", "work product", "services", "effective date",
    "公司", "本公司", "本协议", "协议", "合同", "本合同", "员工", "客户", "供应商", "第三方", "关联方", "子公司", "附属公司", "董事会", "董事长", "总经理", "首席执行官", "法定代表人",
)
BODIES = (
    "jams", "aaa", "american arbitration association", "icc", "lcia", "siac", "hkiac", "cietac", "sec", "securities and exchange commission", "irs", "internal revenue service",
    "internal revenue service center", "eeoc", "equal employment opportunity commission", "nlrb", "national labor relations board", "osha", "occupational safety and health administration",
    "dol", "department of labor", "department of justice", "doj", "ftc", "federal trade commission", "fcc", "federal communications commission", "faa", "federal aviation administration",
    "cftc", "commodity futures trading commission", "finra", "financial industry regulatory authority", "ssa", "social security administration", "attorney general", "supreme court",
    "district court", "court of chancery", "delaware court of chancery", "court of appeals", "new york court of appeals", "southern district of new york", "eastern district of new york",
    "erisa", "cobra", "hipaa", "gdpr", "ccpa", "flsa", "dtsa", "cplr", "adea", "fmla", "userra", "title vii",
)
NOT_PERSON_NOUNS = ("unit", "share", "option", "award", "grant", "warrant", "restricted stock unit", "rsu", "stock option")
JURISDICTIONS = (
    "united states", "united states of america", "us", "usa", "u.s.", "u.s.a.", "america", "district of columbia", "eu", "european union", "china", "people's republic of china", "prc",
    "hong kong", "macau", "taiwan", "singapore", "japan", "south korea", "korea", "india", "united kingdom", "uk", "england", "england and wales", "wales", "scotland", "ireland", "canada",
    "australia", "new zealand", "germany", "france", "switzerland", "netherlands", "luxembourg", "cayman islands", "british virgin islands", "bvi", "bermuda",
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas",
    "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey",
    "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah",
    "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming",
)
INSTRUMENTS = "act regulation statute ordinance agreement contract policy tribunal exhibit schedule section article amendment notice".split()
ALSO_SURNAMES = "law rule code plan court".split()  # instruments of a company value only
DANGLING = {"PERSON": "and of for with by any all each such other".split(), "COMPANY": "and or of the a an to for with by in on at any all each such other".split()}
CONNECTORS = frozenset("and or of the a an to for with by in on at".split())

TERMS = frozenset([*NOUNS, *map(plural, NOUNS), *NOUN_PHRASES, *map(plural, NOUN_PHRASES), *PHRASES, *BODIES, *ROLE_LABELS])
NOT_PERSON = frozenset(["ada", "incentive award", *NOT_PERSON_NOUNS, *map(plural, NOT_PERSON_NOUNS)])
PLACES = frozenset(JURISDICTIONS)
HEADS = {"PERSON": frozenset([*INSTRUMENTS, *map(plural, INSTRUMENTS), "information", "addendum", "release"])}
HEADS["COMPANY"] = HEADS["PERSON"] | {*ALSO_SURNAMES, *map(plural, ALSO_SURNAMES)}
HAN = "々-〇㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f"
CJK = re.compile(f"[{HAN}]")
CJK_OR_KANA = re.compile("[㐀-鿿豈-﫿\U00020000-\U0002fa1f぀-ヿ가-힯]")
PART = re.compile(r"(?:exhibit|schedule|appendix|annex|attachment|section|article) [^\W_.-][\w.-]{0,3}|(?:exhibit|schedule|appendix|annex|attachment|section|article) [.-][\w.-]{0,3}")
DOMAIN = re.compile(r"[^\s.]+\.[^\W\d_]\S*")


def is_boilerplate(value: str, kind: str) -> bool:
    """whether a model's value of this type is legal boilerplate rather than somebody's name."""
    value = value.strip()
    low = value.lower()
    bare = re.sub(r"^(?:the|an|a) ", "", low)
    if len(value) < 2 or low in TERMS or bare in TERMS or PART.fullmatch(bare):
        return True
    if kind != "PERSON":
        of = re.fullmatch(r"(?:state|commonwealth) of (.+)|(.+) county", bare)
        if bare in NOT_PERSON or low in PLACES or bare in PLACES or (of and (of.group(1) or of.group(2)) in PLACES):
            return True
    if kind not in ("PERSON", "COMPANY"):
        return False
    if "district court" in bare or (" district of " in bare and bare.rpartition(" district of ")[2] in PLACES):
        return True
    last = "".join(ch for ch in (bare.split() or [""])[-1] if ch.isalpha())
    if last and (last in HEADS[kind] or last in DANGLING[kind]):
        return True
    return not any(ch.isupper() for ch in value) and not CJK_OR_KANA.search(value) and not DOMAIN.fullmatch(value)


@F.arrow_udf(T.BooleanType())
def boilerplate(values: pa.Array, kinds: pa.Array) -> pa.Array:
    """F02 as a column; null or blank values are boilerplate."""
    return pa.array([v is None or is_boilerplate(v, k or "") for v, k in zip(values.to_pylist(), kinds.to_pylist())], pa.bool_())


# --- defined terms -----------------------------------------------------------------------------------------------

QUOTE, NOT_QUOTE = "[\"“”]", "[^\"“”)）]"
LEAD_IN = r"(?:(?:the|an?|each|together|collectively|individually|hereinafter|hereafter|referred|to|as|and|or|any|,)\s*){0,12}"
PAREN = re.compile(rf"[(（]\s*{LEAD_IN}{QUOTE}({NOT_QUOTE}{{2,70}}){QUOTE}", re.I)
MEANS = re.compile(rf"{QUOTE}([^\"“”]{{2,70}}){QUOTE}\s*(?:means|shall mean)", re.I)
CJK_SHORT = re.compile(r"[(（]\s*(?:以下|下文)?(?:合称|统称|简称|下称)为?\s*[:：]?\s*([^(（)）]{1,80}?)\s*[)）]")
QUOTED = re.compile("[\"“”'‘’「『]([^\"“”'‘’「」『』]{1,60})[\"“”'‘’」』]")


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def folded(text: str) -> str:
    return " ".join(text.lower().split())


def is_acronym(term: list[str], of: list[str]) -> bool:
    """Whether a term of one word spells the initials of the last words."""
    if len(term) != 1 or len(term[0]) < 2:
        return False
    tail = [w for w in of if w not in CONNECTORS][-len(term[0]) :]
    return len(tail) == len(term[0]) and all(w[0] == ch for w, ch in zip(tail, term[0]))


def derived_alias(alias: str, canonical: str) -> bool:
    """whether an alias is made of a name: its characters in order (CJK), its words, or its initials."""
    alias = alias.strip()
    if not alias:
        return False
    if CJK.search(alias):
        rest = iter(canonical)
        return alias in canonical or all(ch in rest for ch in alias)
    a, c = words(alias), words(canonical)
    own = [w for w in a if w not in CONNECTORS]
    return bool(a and c) and (bool(own) and set(own) <= set(c) or is_acronym(a, c))


def droppable_definition(term: str, before: str) -> bool:
    """Whether a bracketed definition names a role or a thing rather than abbreviating the name just before it."""
    own = words(term)
    if not own:
        return True
    spelled = re.findall(r"[^\W_]+", before)
    low = [w.lower() for w in spelled]
    mine = [w for w in own if w not in CONNECTORS]
    from_name = bool(mine) and set(mine) <= set(low) or is_acronym(own, low) or (CJK.search(term) is not None and term.strip() in before)
    if not from_name:
        return True
    tail = spelled[-6:]
    least = min(max(1, len(mine)), len(tail))
    return not tail or any(is_boilerplate(" ".join(tail[-n:]), "COMPANY") for n in range(least, len(tail) + 1))


def defined_terms(text: str) -> set[str]:
    """the terms a document defines that don't abbreviate a name."""
    out = {folded(m.group(1)) for m in PAREN.finditer(text) if droppable_definition(m.group(1), text[max(0, m.start() - 90) : m.start()])}
    return out | {folded(m.group(1)) for m in MEANS.finditer(text)}


def aliases_in(text: str) -> list[tuple[int, str]]:
    """(anchor, alias) of the short names that a document gives in brackets."""
    out = set()
    for m in CJK_SHORT.finditer(text):
        inner = m.group(1)
        for alias in [q.strip() for q in QUOTED.findall(inner)] or [inner.strip()]:
            if alias:
                out.add((m.start(), alias))
    for m in PAREN.finditer(text):
        if m.group(1).strip() and not droppable_definition(m.group(1), text[max(0, m.start() - 90) : m.start()]):
            out.add((m.start(), m.group(1).strip()))
    return sorted(out)


def covered(value: str, terms: set[str]) -> bool:
    """whether a value is a defined term, or made of their words alone."""
    if not terms:
        return False
    if folded(value) in terms:
        return True
    own = words(value)
    return bool(own) and set(own) <= {w for t in terms for w in words(t)} | CONNECTORS


# --- occurrences ---------------------------------------------------------------------------------------------------

GAP = r"[\t\n\x0b\x0c\r \x85\xa0  -     　]"
LATIN = re.compile("[0-9A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ]")


def clusters(text: str) -> list[str]:
    """Characters with the combining marks that follow them."""
    out: list[str] = []
    for ch in text:
        if out and unicodedata.combining(ch):
            out[-1] += ch
        else:
            out.append(ch)
    return out


def spelled(text: str) -> str:
    """A pattern of a literal whose characters match composed and decomposed."""
    parts = []
    for c in clusters(text):
        forms = list(dict.fromkeys((unicodedata.normalize("NFC", c), unicodedata.normalize("NFD", c), c)))
        parts.append(re.escape(forms[0]) if len(forms) == 1 else "(?:" + "|".join(map(re.escape, forms)) + ")")
    return "".join(parts)


def variant_pattern(needle: str) -> str | None:
    """A pattern of the needle with other white space: runs are gaps of up to twelve, a border between CJK and ASCII
    may hold a gap, two ideographs up to two blanks. None where that adds nothing."""
    pieces, run, prev, blank = [], "", "", False
    for ch in needle:
        if ch.isspace():
            blank = True
            continue
        if prev:
            han, before = bool(CJK.match(ch)), bool(CJK.match(prev))
            border = han != before and (ch.isascii() and ch.isalnum() or prev.isascii() and prev.isalnum())
            gap = f"{GAP}{{{0 if border else 1},12}}" if blank or border else r"[ \xa0\u3000]{0,2}" if han and before else ""
            if gap:
                pieces += [spelled(run), gap]
                run = ""
        run, prev, blank = run + ch, ch, False
    return "".join([*pieces, spelled(run)]) if pieces else None


@lru_cache(4096)
def finders(value: str) -> tuple[re.Pattern, re.Pattern | None]:
    loose = variant_pattern(value)
    return re.compile(spelled(value), re.I), re.compile(loose, re.I) if loose else None


def joins(outside: str, edge: str, left: bool) -> bool:
    """F10 on one edge: a digit outside a letter, or a capital behind a small letter."""
    if outside.isdigit() or edge.isdigit():
        return outside.isdigit() and not edge.isdigit()
    a, b = (outside, edge) if left else (edge, outside)
    return a.islower() and b.isupper()


def edges(text: str, a: int, b: int) -> list[bool]:
    """For each edge that cuts a Latin word (F09): whether it reads as a run-in."""
    out = []
    if a and LATIN.match(text[a - 1]) and LATIN.match(text[a]):
        out.append(joins(text[a - 1], text[a], True))
    if b < len(text) and LATIN.match(text[b - 1]) and LATIN.match(text[b]):
        out.append(joins(text[b], text[b - 1], False))
    return out


def places(text: str, value: str, at: int = 0, upto: int = sys.maxsize) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Where a value stands in a text, and where it is run into a word. Exact and loose white space search
    together; the leftmost hit wins, exact on ties; a refused hit resumes one character on. at, upto: the part searched."""
    exact, loose = finders(value)
    anchored, run_ins = [], []
    one, two = exact.search(text, at, upto), loose.search(text, at, upto) if loose else None
    while one or two:
        m = one if one and (not two or one.start() <= two.start()) else two
        cuts = edges(text, *m.span())
        if not cuts:
            anchored.append(m.span())
            at = m.end()
        else:
            if all(cuts):
                run_ins.append(m.span())
            at = m.start() + 1
        if one and one.start() < at:
            one = exact.search(text, at, upto)
        if two and two.start() < at:
            two = loose.search(text, at, upto)
    return anchored, run_ins


def located(text: str | None, rows: list[tuple[str, str]]) -> list[tuple]:
    """J03 for one document: (outcome, start, end, type, text): spans, run-ins, unlocated and phantom values."""
    text = text or ""
    rows = [(v.strip(), t) for v, t in rows if v and v.strip() and t in KEPT_TYPES and not is_boilerplate(v, t)]
    terms = defined_terms(text)
    defined = [covered(v, terms) for v, _ in rows]
    names = [r for r, d in zip(rows, defined) if not d]
    rows = [r for r, d in zip(rows, defined) if not d or any(t == r[1] and derived_alias(r[0], v) for v, t in names)]
    out, seen, flat = [], set(), None
    for value, kind in rows:
        if (value.lower(), kind) in seen:
            continue
        seen.add((value.lower(), kind))
        anchored, run_ins = places(text, value)
        out += [("span", a, b, kind, text[a:b]) for a, b in anchored]
        out += [("run-in", a, b, kind, text[a:b]) for a, b in run_ins]
        if anchored and run_ins:
            out.append(("unlocated", None, None, kind, value))
        if not anchored:
            flat = "".join(text.lower().split()) if flat is None else flat
            out.append(("unlocated" if "".join(value.lower().split()) in flat else "phantom", None, None, kind, value))
    return list(dict.fromkeys(out))


def by_document(values: DataFrame, docs: DataFrame, work, shape: str, key: str, text: str) -> DataFrame:
    """work(text, [(value, type)]) -> rows of `shape`, for each document that has values."""
    lists = values.where(F.col("value").isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_list(F.struct(F.col("ord") if "ord" in values.columns else F.lit(0).alias("ord"), "value", "type"))).alias("__rows"))
    x = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(lists, "__key")
    kind = docs.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_type = None
        for batch in batches:
            ids, found = [], []
            for i, (t, rows) in enumerate(zip(batch.column("__text").to_pylist(), batch.column("__rows").to_pylist())):
                got = work(t, [(r["value"], r["type"]) for r in rows])
                found += got
                ids += [i] * len(got)
            out_type = [ARROW[f.split()[1]] for f in shape.split(", ")]
            cols = [pa.array([r[k] for r in found], out_type[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(ids, pa.int64())), *cols], [key, *names])

    return x.mapInArrow(run, f"{key} {kind}, {shape}")


ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}


def locate_model_rows(values: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, outcome, start, end, type, text) of model rows (key, value, type, optionally ord for their order): spans,
    run-ins (J04 protects them), unlocated values and phantoms."""
    return by_document(values, docs, located, "outcome string, start int, end int, type string, text string", key, text)


def run_in_spans(values: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of priority 110 where a value is run into a word and stands nowhere anchored at that place."""
    work = lambda t, rows: [(a, b, k, (t or "")[a:b]) for v, k in dict.fromkeys(rows) if v.strip() for a, b in places(t or "", v.strip())[1]]
    x = by_document(values, docs, work, "start int, end int, type string, text string", key, text)
    return x.withColumns({"source": F.lit("llm"), "confidence": F.lit(1.0), "priority": F.lit(110)})


def defined_term_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term) of every document; a cheap look for quotes comes first."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(i, t) for i, x in enumerate(batch.column(1).to_pylist()) for t in sorted(defined_terms(x))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string())], [key, "term"])

    return docs.where(F.col(text).rlike('["“”]')).select(key, text).mapInArrow(run, f"{key} {kind}, term string")


def alias_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, anchor, alias, lead): short names in brackets, with the six characters before, for J08."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(i, a, v, x[max(0, a - 6) : a]) for i, x in enumerate(batch.column(1).to_pylist()) for a, v in aliases_in(x)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.string()) for k in (2, 3))], [key, "anchor", "alias", "lead"])

    return docs.where(F.col(text).rlike("[(（]")).select(key, text).mapInArrow(run, f"{key} {kind}, anchor int, alias string, lead string")


@F.arrow_udf(T.BooleanType())
def is_derived(aliases: pa.Array, canonicals: pa.Array) -> pa.Array:
    """F06 as a column; null is no alias."""
    return pa.array([a is not None and c is not None and derived_alias(a, c) for a, c in zip(aliases.to_pylist(), canonicals.to_pylist())], pa.bool_())


@F.arrow_udf(T.BooleanType())
def needle_safe(values: pa.Array) -> pa.Array:
    """whether a value may be searched for everywhere: two CJK characters, three capitals or digits, else four."""

    def ok(v):
        v = (v or "").strip()
        least = 2 if CJK.search(v) else 3 if v and all(ch.isupper() or ch.isdigit() for ch in v) else 4
        return len(v) >= least and not is_boilerplate(v, "COMPANY")

    return pa.array([ok(v) for v in values.to_pylist()], pa.bool_())
