"""One mapping for the documents of a scope: seeds reused, tokens and pseudonyms minted, overrides judged, seams repaired.

Mappings are relations (scope, token, surface, type), seeds also with surface_text and aliases. Numbers skip what a scope
already spells by a fold over the taken numbers alone, so a scope of any size sorts its distinct surfaces once and holds
nothing else.

Edge cases: null or empty surfaces are dropped; a null scope is a scope without documents; repeated seed rows count once;
ties in order go by surface; empty inputs give an empty mapping. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .mint import reserved, splice
from .restoring import literal_site_rows

# The enumeration of parties, numerals, surnames and labels of pseudonyms.
STEMS = "甲乙丙丁戊己庚辛壬癸"
NUMERALS = "一二三四五六七八九十"
SURNAMES = "张李王赵刘陈杨黄周吴徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程苏魏吕任卢沈"
LABELS = {"PHONE": ("Phone", "电话"), "BANK_ACCOUNT": ("Account", "账户"), "NATIONAL_ID": ("ID", "证件"), "USCC": ("Code", "代码"), "DATE": ("Date", "日期"), "AMOUNT": ("Amount", "金额"), "SEAL": ("Seal", "印章"), "TRADEMARK": ("Trademark", "商标")}


def nth_free(k: Column, taken: Column, base: Column | int = 0) -> Column:
    """The k-th integer above base that isn't taken: k, moved on by each taken number it reaches."""
    base = F.lit(base) if isinstance(base, int) else base
    mine = F.array_sort(F.array_distinct(F.filter(F.coalesce(taken, F.array().cast("array<int>")), lambda t: t > base)))
    return F.aggregate(mine, (base + k).cast("int"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))


def seed_surfaces(seed: DataFrame, scope: str) -> DataFrame:
    """(scope, surface, token): every spelling a seed knows; the least token where two claim one."""
    known = F.array_distinct(F.filter(F.concat(F.array("surface", "surface_text"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda v: v.isNotNull() & (v != "")))
    return seed.select(scope, "token", F.explode(known).alias("surface")).groupBy(scope, "surface").agg(F.min("token").alias("token"))


def surfaces(spans: DataFrame, scope: str, order: tuple[str, ...]) -> DataFrame:
    """(scope, surface, at, type): distinct surfaces with their first place and its type."""
    at = F.struct(*order)
    return spans.where(F.col("text") != "").groupBy(scope, F.col("text").alias("surface")).agg(F.min(at).alias("at"), F.min_by("type", at).alias("type"))


def mint_session(spans: DataFrame, docs: DataFrame, scope: str, order: tuple[str, ...] = ("doc_order", "start"), seed: DataFrame | None = None) -> DataFrame:
    """(scope, token, surface, type, seeded): the documents of a scope in order share one mapping. A surface that
    the seed knows keeps its token; the others are numbered past the seed's numbers, skipping those the texts spell."""
    first = surfaces(spans, scope, order).withColumn("stype", tx.sanitize_type(F.col("type")))
    old = first.limit(0).select(scope, F.lit("").alias("token"), "surface", "type", F.lit(True).alias("seeded"))
    top = first.limit(0).select(scope, "stype", F.lit(0).alias("top"))
    if seed is not None:
        known = seed_surfaces(seed, scope)
        old = first.join(known, [scope, "surface"]).select(scope, "token", "surface", "type", F.lit(True).alias("seeded"))
        first = first.join(known, [scope, "surface"], "left_anti")
        number = F.regexp_extract("token", r"^\{[A-Z0-9]+_([0-9]+)\}$", 1).try_cast("int")
        top = seed.select(scope, F.regexp_extract("token", r"^\{([A-Z0-9]+)_", 1).alias("stype"), number.alias("n")).where("n is not null").groupBy(scope, "stype").agg(F.max("n").alias("top"))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy(scope, "stype").orderBy("at", "surface")))
    x = first.join(reserved(docs, scope), [scope, "stype"], "left").join(top, [scope, "stype"], "left")
    n = nth_free(F.col("k"), F.col("taken"), F.coalesce("top", F.lit(0)))
    new = x.select(scope, F.concat(F.lit("{"), "stype", F.lit("_"), n.cast("string"), F.lit("}")).alias("token"), "surface", "type", F.lit(False).alias("seeded"))
    return old.unionByName(new)


def union_mappings(seed: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """All entries of a seed and the new ones; of one (scope, token, surface) the seed's stays."""
    cols = [scope, "token", "surface", "type"]
    both = seed.select(*cols, F.lit(0).alias("__late")).unionByName(new.select(*cols, F.lit(1).alias("__late")))
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(scope, "token", "surface").orderBy("__late", "type"))).where("__r = 1").drop("__r", "__late")


def client_cycle(store: DataFrame, client: str, spans: DataFrame, docs: DataFrame, scope: str, order: tuple[str, ...] = ("doc_order", "start")) -> tuple[DataFrame, DataFrame]:
    """The session's mapping with the client's stored one as seed, and the client's store after it. store: (client,
    token, surface, type, surface_text, aliases)."""
    mine = store.where(F.col("client") == client)
    one = docs.select(scope).limit(1).collect()  # all documents given are one session
    seed = mine.withColumn(scope, F.lit(one[0][0] if one else None).cast(docs.schema[scope].dataType))
    minted = mint_session(spans, docs, scope, order, seed)
    keep = mine.select(F.lit(client).alias("client"), "token", "surface", "type", "surface_text", "aliases")
    fresh = minted.where(~F.col("seeded")).select(F.lit(client).alias("client"), "token", "surface", "type", F.lit(None).cast("string").alias("surface_text"), F.array().cast("array<string>").alias("aliases"))
    return minted, keep.unionByName(fresh)


# --- pseudonyms ---------------------------------------------------------------------------------------------------


def script_of(kind: Column, surface: Column) -> Column:
    """C02: 'zh' for a surface with CJK, but never for an email; else 'latin'."""
    return F.when((kind != "EMAIL") & tx.contains_cjk(surface), "zh").otherwise("latin")


def _label(kind: Column, which: int, other: str) -> Column:
    out = F.lit(other)
    for name, labels in LABELS.items():
        out = F.when(kind == name, labels[which]).otherwise(out)
    return out


def pseudonym(kind: Column, script: Column, i: Column) -> Column:
    """P25: the i-th candidate (from 0) of a type and script."""
    number, letters = (i + 1).cast("string"), tx.letter_sequence(i)
    stem, cycle = F.substring(F.lit(STEMS), i % 10 + 1, F.lit(1)), F.floor(i / 10).cast("int")
    company = F.concat(stem, F.when(cycle == 0, "").when(cycle <= 10, F.substring(F.lit(NUMERALS), cycle, F.lit(1))).otherwise(cycle.cast("string")), F.lit("公司"))
    person = F.when(i < len(SURNAMES), F.concat(F.substring(F.lit(SURNAMES), i.cast("int") + 1, F.lit(1)), F.lit("某"))).otherwise(F.concat(F.lit("人物"), number))
    zh = F.when(kind == "COMPANY", company).when(kind == "PERSON", person).when(kind == "ADDRESS", F.concat(F.lit("某地址"), letters)).otherwise(F.concat(F.lit("某"), _label(kind, 1, "某"), number))
    latin = F.when(kind.isin("COMPANY", "PERSON", "ADDRESS"), F.concat(F.initcap(kind), F.lit(" "), letters)).otherwise(F.concat(_label(kind, 0, "Item"), F.lit(" "), number))
    return F.when(kind == "EMAIL", F.concat(F.lit("contact"), number, F.lit("@example.com"))).when(script == "zh", zh).otherwise(latin)


def _letters_index(c: Column) -> Column:
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("bigint"), lambda a, ch: a * 26 + F.ascii(ch) - 64) - 1


def spelled_candidates(texts: DataFrame, scope: str, text: str = "text") -> DataFrame:
    """(scope, family, i): the candidates, by family and index, that a scope's texts spell, prefixes of longer
    ones among them. A family is a candidate's fixed part."""
    t = F.col(text)
    heads = lambda run: F.transform(F.sequence(F.lit(1), F.length(run)), lambda k: F.substring(run, F.lit(1), k))
    entry = lambda family, i: F.struct(family.alias("family"), i.cast("bigint").alias("i"))
    runs = lambda pattern, index: F.flatten(F.transform(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)), index))
    fixed = lambda m, tail: F.regexp_replace(m, tail, "")
    lettered = runs("(?:Person|Company|Address) [A-Z]{1,7}|某地址[A-Z]{1,7}", lambda m: F.transform(heads(F.regexp_extract(m, "[A-Z]+$", 0)), lambda p: entry(F.trim(fixed(m, "[A-Z]+$")), _letters_index(p))))
    names = "|".join(x for pair in LABELS.values() for x in (pair[0] + " ", "某" + pair[1]))
    numbered = runs(f"(?:{names}|Item |人物|某某)[1-9][0-9]{{0,8}}", lambda m: F.transform(heads(F.regexp_extract(m, "[0-9]+$", 0)), lambda p: entry(F.trim(fixed(m, "[0-9]+$")), p.cast("bigint") - 1)))
    mails = runs("contact[1-9][0-9]{0,8}@example\\.com", lambda m: F.array(entry(F.lit("contact"), F.regexp_extract(m, "[0-9]+", 0).cast("bigint") - 1)))
    cycle = lambda m: F.regexp_extract(m, f"^[{STEMS}](.*)公司$", 1)
    firms = runs(f"[{STEMS}](?:[{NUMERALS}]|[1-9][0-9]{{0,8}})?公司", lambda m: F.array(entry(F.lit("公司"), F.instr(F.lit(STEMS), F.substring(m, 1, 1)) - 1 + 10 * F.when(cycle(m) == "", 0).when(F.instr(F.lit(NUMERALS), cycle(m)) > 0, F.instr(F.lit(NUMERALS), cycle(m))).otherwise(cycle(m).try_cast("bigint")))))
    people = runs(f"[{SURNAMES}]某", lambda m: F.array(entry(F.lit("人物"), F.instr(F.lit(SURNAMES), F.substring(m, 1, 1)) - 1)))
    return texts.where(t.isNotNull()).select(scope, F.inline(F.concat(lettered, numbered, mails, firms, people))).distinct()


def family_of(kind: Column, script: Column) -> Column:
    """The family of a type's candidates, as spelled_candidates() names it."""
    zh = F.when(kind == "COMPANY", "公司").when(kind == "PERSON", "人物").when(kind == "ADDRESS", "某地址").otherwise(F.concat(F.lit("某"), _label(kind, 1, "某")))
    latin = F.when(kind.isin("COMPANY", "PERSON", "ADDRESS"), F.initcap(kind)).otherwise(_label(kind, 0, "Item"))
    return F.when(kind == "EMAIL", "contact").when(script == "zh", zh).otherwise(latin)


def mint_pseudonyms(spans: DataFrame, docs: DataFrame, scope: str, order: tuple[str, ...] = ("doc_order", "start"), seed: DataFrame | None = None, banned: DataFrame | None = None) -> DataFrame:
    """(scope, token, surface, type): the next candidate of each surface's type and script that no text of the scope
    spells, no seed uses and no ban (scope, family, i) names."""
    first = surfaces(spans, scope, order).withColumn("script", script_of(F.col("type"), F.col("surface"))).withColumn("family", family_of(F.col("type"), F.col("script")))
    blocked = spelled_candidates(docs, scope)
    old = first.limit(0).select(scope, F.lit("").alias("token"), "surface", "type")
    if seed is not None:
        known = seed_surfaces(seed, scope)
        old = first.join(known, [scope, "surface"]).select(scope, "token", "surface", "type")
        first = first.join(known, [scope, "surface"], "left_anti")
        blocked = blocked.unionByName(spelled_candidates(seed, scope, "token"))
    if banned is not None:
        blocked = blocked.unionByName(banned.select(scope, "family", F.col("i").cast("bigint").alias("i")))
    taken = blocked.groupBy(scope, "family").agg(F.collect_set((F.col("i") + 1).cast("int")).alias("taken"))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy(scope, "family").orderBy("at", "surface")))
    i = nth_free(F.col("k"), F.col("taken")) - 1
    return old.unionByName(first.join(taken, [scope, "family"], "left").select(scope, pseudonym(F.col("type"), F.col("script"), i).alias("token"), "surface", "type"))


def emitted_pieces(sites: DataFrame, key: str = "doc_id", replacement: str = "token") -> DataFrame:
    """Where each replacement ends up in the emitted text: (key, start, end, replacement)."""
    grown = F.sum(F.length(replacement) - (F.col("end") - F.col("start"))).over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    at = (F.col("start") + F.coalesce(grown, F.lit(0))).cast("int")
    return sites.select(key, at.alias("start"), (at + F.length(replacement)).alias("end"), F.col(replacement).alias("replacement"))


def seam_violations(docs: DataFrame, sites: DataFrame, mapping: DataFrame, scope: str, key: str = "doc_id") -> DataFrame:
    """Restoring the emitted text must find the pieces that were emitted and nothing else: (key, start, end,
    replacement, found) of what differs; found: whether a reading found it (else an emitted piece is shadowed)."""
    emitted = splice(docs, sites, key).select(key, scope, F.col("tokenized").alias("text"))
    read = literal_site_rows(emitted, mapping, scope, key)
    pieces = emitted_pieces(sites, key)
    on = [key, "start", "end", "replacement"]
    return read.join(pieces, on, "left_anti").select(*on, F.lit(True).alias("found")).unionByName(pieces.join(read, on, "left_anti").select(*on, F.lit(False).alias("found")))


def mint_without_seams(spans: DataFrame, docs: DataFrame, scope: str, key: str = "doc_id", passes: int = 8, save=None) -> DataFrame:
    """Pseudonyms, minted again with the offending ones banned until no seam misreads, at most `passes` times; raises
    if one still does. save: writes a frame and reads it back, to cut lineage between passes."""
    save = save or (lambda df: df)
    banned = None
    for _ in range(passes):
        mapping = save(mint_pseudonyms(spans, docs, scope, banned=banned))
        sites = spans.join(mapping.select(scope, F.col("surface").alias("text"), "token"), [scope, "text"])
        bad = seam_violations(docs, sites.select(key, "start", "end", "token"), mapping, scope, key)
        bad = bad.join(docs.select(key, scope), key).select(scope, F.col("replacement").alias("text")).distinct()
        if bad.isEmpty():
            return mapping
        more = save(spelled_candidates(bad, scope))
        banned = more if banned is None else save(banned.unionByName(more).distinct())
    raise ValueError("pseudonyms still run into their neighbours")


def override_rejections(overrides: DataFrame, docs: DataFrame, mapping: DataFrame, scope: str, style: str = "pseudonym") -> DataFrame:
    """(scope, surface, replacement, reason, other) of forced pseudonyms (scope, surface, replacement) that can't be
    used: style, empty, braces, collision, prefix, natural, in this order; the first of each. (Seams: seam_violations.)"""
    o = overrides.select(scope, F.coalesce("surface", F.lit("")).alias("surface"), F.coalesce("replacement", F.lit("")).alias("replacement"))
    own = seed_surfaces(mapping, scope).select(scope, "surface", F.col("token").alias("mine")) if "aliases" in mapping.columns else mapping.select(scope, "surface", F.col("token").alias("mine"))
    entries = mapping.select(scope, F.col("token").alias("other"), F.col("surface").alias("owner"), F.lit(False).alias("claimed"))
    others = entries.unionByName(o.select(scope, F.col("replacement").alias("other"), F.col("surface").alias("owner"), F.lit(True).alias("claimed"))).where("other <> ''").distinct()
    mine = own.select(scope, "surface", F.col("mine").alias("other"))
    none = F.lit(None).cast("string")
    rule = lambda df, rank, reason, other=none: df.select(scope, "surface", "replacement", F.lit(rank).alias("rank"), F.lit(reason).alias("reason"), other.alias("other"))
    # Prefixes meet as keys: every head of a replacement against whole ones, both ways.
    heads = lambda df, c: df.withColumn("head", F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.substring(F.col(c), F.lit(1), k))))
    full = o.where("replacement <> ''")
    foreign = others.join(mine, [scope, "other"], "left").where("surface is null or surface = owner").select(scope, "other", "owner", "claimed")
    longer = full.join(heads(foreign, "other").where("head <> other").withColumnRenamed("head", "replacement"), [scope, "replacement"])
    shorter = heads(full, "replacement").where("head <> replacement").join(foreign.withColumnRenamed("other", "head"), [scope, "head"]).withColumnRenamed("head", "other")
    same = full.join(foreign.withColumn("replacement", F.col("other")), [scope, "replacement"])
    # Overrides claim their replacements in the order of surfaces: the later of two has the conflict.
    not_own = (F.col("owner") != F.col("surface")) & (~F.col("claimed") | (F.col("owner") < F.col("surface")))
    lists = full.groupBy(scope).agg(F.collect_set("replacement").alias("all"))
    spelled = docs.select(scope, "text").join(lists, scope).select(scope, F.explode(F.filter("all", lambda r: F.col("text").contains(r))).alias("replacement")).distinct()
    found = [rule(o.where(F.lit(style != "pseudonym")), 0, "style"), rule(o.where("surface = '' or replacement = ''"), 1, "empty"), rule(o.where("replacement rlike '[{}]'"), 2, "braces"), rule(same.where(not_own), 3, "collision", F.col("other")), rule(longer.where(not_own).unionByName(shorter.where(not_own)), 4, "prefix", F.col("other")), rule(full.join(spelled, [scope, "replacement"], "left_semi"), 5, "natural")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    first = F.row_number().over(Window.partitionBy(scope, "surface", "replacement").orderBy("rank", "other"))
    return out.withColumn("__r", first).where("__r = 1").drop("__r", "rank")


def emission_counts(sites: DataFrame, scope: str, replacement: str = "token", surface: str = "text") -> DataFrame:
    """How often each replacement went out for each surface in this handoff."""
    return sites.groupBy(scope, F.col(replacement).alias("token"), F.col(surface).alias("surface")).agg(F.count("*").alias("emitted"))
