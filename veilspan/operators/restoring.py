"""Restoring edited texts: literal replacements, carried literals beside tokens, refusals, and near-miss placeholders.

The work on one text is plain Python with an automaton of its scope's replacements, run over Arrow batches; the entries of a
scope stream in before its texts, once for each GROUP of them, and bound what a task holds.

Edge cases: a null text gives a null result; a scope without a mapping restores nothing; entries without a token are
dropped; repeated entries count once; replacements shared by two values are refused and reported; other columns are not
read. Offsets are code points.
"""

from __future__ import annotations

import re
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .modelvalues import CJK

TOKEN = re.compile(r"\{[A-Z0-9]+_[0-9]+\}")
ESCAPED = re.compile(r"\{([A-Z0-9]+)\\_([0-9]+)\}")
REACH = 24  # characters that a glued spelling is followed on each side


def touches(neighbour: str, edge: str, han: bool) -> bool:
    """Whether a neighbour continues a replacement's edge as one word."""
    if not han:
        return neighbour.isalnum() and edge.isalnum() and not CJK.match(neighbour) and not CJK.match(edge)
    if edge == "某":
        return neighbour == "某"
    return edge.isascii() and neighbour.isascii() and (edge.isdigit() and neighbour.isdigit() or edge.isalpha() and neighbour.isalpha())


def widened(text: str, a: int, b: int, replacement: str) -> tuple[str, int, int] | None:
    """None where a replacement stands alone; else 'doubtful' or 'part' (it ends a capital before a small letter, so it is the
    head of another word) with the range of the word it is glued into."""
    han = CJK.search(replacement) is not None
    first, last = replacement[0], replacement[-1]
    before = a > 0 and touches(text[a - 1], first, han)
    after = b < len(text) and touches(text[b], last, han)
    if not before and not after:
        return None
    lo, hi = a, b
    while lo > max(0, a - REACH) and touches(text[lo - 1], first, han):
        lo -= 1
    while hi < min(len(text), b + REACH) and touches(text[hi], last, han):
        hi += 1
    part = not han and not before and last.isupper() and text[b].islower()
    return "part" if part else "doubtful", lo, hi


def glued_spellings(text: str, sites: list[tuple[int, int, str]]) -> list[tuple[str, str]]:
    """(replacement, spelling) of the emitted sites that a letter or digit touches."""
    out = {(r, text[w[1] : w[2]]) for a, b, r in sites if r and (w := widened(text, a, b, r))}
    return sorted(out)


def automaton(replacements) -> ahocorasick.Automaton | None:
    words = ahocorasick.Automaton()
    for r in replacements:
        words.add_word(r, r)
    if not len(words):
        return None
    words.make_automaton()
    return words


def literal_sites(text: str, words, glued: dict[str, set[str]] | None) -> tuple[list[tuple[int, int, str, bool]], list[str]]:
    """M04 over literal hits: ([(start, end, replacement, shadows a shorter one)], doubtful spellings). glued: recorded
    spellings; where given for a replacement, hits inside a word count only if recorded."""
    hits, doubts, last = [], [], {}
    for end, r in words.iter(text) if words else ():
        a, b = end + 1 - len(r), end + 1
        if a < last.get(r, 0):
            continue  # hits of one replacement don't overlap
        last[r] = b
        w = widened(text, a, b, r) if glued is not None and r in glued else None
        if w is None or text[w[1] : w[2]] in glued[r]:
            hits.append((a, b, r))
        elif w[0] == "doubtful":
            doubts.append((w[1], w[2]))
    hits.sort(key=lambda h: (h[0], h[0] - h[1], h[2]))
    out, at = [], 0
    for k, (a, b, r) in enumerate(hits):
        if a >= at:
            n = k + 1
            shadows = False
            while n < len(hits) and hits[n][0] == a:
                shadows, n = shadows or hits[n][2] != r, n + 1
            out.append((a, b, r, shadows))
            at = b
    shown = [text[a:b] for a, b in sorted(doubts) if not any(x < b and a < y for x, y, _, _ in out)]
    return out, list(dict.fromkeys(shown))


def values_of(entries: list[dict]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for e in sorted(entries, key=lambda e: (e["token"] or "", e["surface"] or "")):
        if e["token"] and e["surface"] is not None and e["surface"] not in out.setdefault(e["token"], []):
            out[e["token"]].append(e["surface"])
    return out


def over_returned(returned: list[str], entries: list[dict]) -> set[str]:
    """Forced replacements that come back more often than they went out."""
    count: dict[str, int] = {}
    for r in returned:
        count[r] = count.get(r, 0) + 1
    return {e["token"] for e in entries if e.get("emitted") is not None and count.get(e["token"], 0) > max(0, e["emitted"])}


def emit(text: str, sites: list[tuple[int, int, str]], value: dict[str, str]) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for a, b, r in sites:
        out += [text[at:a], value.get(r, text[a:b])]
        n += r in value
        at = b
    return "".join([*out, text[at:]]), n


class Mapping:
    """The entries of a scope, made ready once for all its texts."""

    def __init__(self, entries: list[dict]):
        self.entries, self.value, self.glued = entries, values_of(entries), {}
        for e in entries:
            if e.get("glued") is not None and e["token"]:
                self.glued.setdefault(e["token"], set()).update(e["glued"])
        self.shared = {r for r, v in self.value.items() if len(v) > 1}
        self.first = {r: v[0] for r, v in self.value.items()}
        self.counted = [e for e in entries if e.get("emitted") is not None]
        self.carried = {r for r in self.value if not TOKEN.fullmatch(r)}
        self.types = types_of(entries)

    @cached_property
    def words(self) -> ahocorasick.Automaton | None:
        return automaton(self.value)

    @cached_property
    def carried_words(self) -> ahocorasick.Automaton | None:
        return automaton(self.carried)

    def literals(self, text: str, asterisk: bool = False, orphans: bool = True) -> dict:
        """restore_literals for one text; orphans are left out on demand: a text lacks nearly all of a large scope's."""
        sites, doubts = literal_sites(text, self.words, self.glued)
        refused = self.shared | over_returned([s[2] for s in sites], self.counted)
        no = [s[2] in refused or (asterisk and s[3]) for s in sites]
        out, n = emit(text, [s[:3] for s, x in zip(sites, no) if not x], self.first)
        reported = list(dict.fromkeys(s[2] for s, x in zip(sites, no) if x))
        back = {s[2] for s, x in zip(sites, no) if not x}
        return {"restored": out, "restored_count": n, "orphans": sorted(set(self.value) - back - set(reported)) if orphans else None, "suspects": doubts, "ambiguous": reported}

    def tokens_and_literals(self, text: str) -> dict:
        """restore_tokens_and_literals for one text."""
        text = ESCAPED.sub(r"{\1_\2}", text)
        exact = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
        glued = {r: v for r, v in self.glued.items() if r in self.carried}

        def decided(words) -> list:
            return [s for s in literal_sites(text, words, glued)[0] if not any(a < s[1] and s[0] < b for a, b, _ in exact)]

        sites = decided(self.carried_words)
        over = over_returned([s[2] for s in sites], [e for e in self.counted if e["token"] in self.carried])
        if over:
            sites = decided(automaton(self.carried - over))
        take = [s[:3] for s in sites if s[2] not in self.shared]
        mapped = lambda t: t in self.first and t not in self.carried
        out, n = emit(text, sorted([t for t in exact if mapped(t[2])] + take), self.first)
        orphans = list(dict.fromkeys(t for _, _, t in exact if not mapped(t)))
        reported = list(dict.fromkeys([*sorted(over), *(s[2] for s in sites if s[2] in self.shared)]))
        return {"restored": out, "restored_count": n, "orphans": orphans, "suspects": suspects(text, self.types), "ambiguous": reported}


def restore_literals(text: str, entries: list[dict], asterisk: bool = False) -> dict:
    """Replacements back to values in one pass. Shared and over-returned ones are refused, under the asterisk style
    also a longer mask that shadows a shorter one; what never came back is an orphan."""
    return Mapping(entries).literals(text, asterisk)


def restore_tokens_and_literals(text: str, entries: list[dict]) -> dict:
    """Tokens and the literals carried beside them are decided in one pass over the decoded text; tokens win
    overlaps; unmapped tokens are orphans."""
    return Mapping(entries).tokens_and_literals(text)


def types_of(entries: list[dict]) -> list[str]:
    return sorted({m.group(1) for e in entries if e["token"] and (m := re.fullmatch(r"\{([A-Z0-9]+)_[0-9]+\}", e["token"]))})


DRIFT = re.compile(r"[{\[(<]\s{0,4}([A-Za-z][A-Za-z0-9_\- ]{0,63}?)\s{0,4}[_ ]?\s{0,4}[0-9]+\s{0,4}[}\])>]")


def suspects(text: str, types: list[str]) -> list[str]:
    """Near misses of the placeholders of known types, first seen first: blanks inside braces, other brackets, a brace
    missing at the end or the start, none at all, and separators adrift in the type's name."""
    exact = [m.span() for m in TOKEN.finditer(text)]
    found: dict[tuple[int, int], str] = {}
    for kind in types:
        any_case = f"(?i:{re.escape(kind)})"
        for shape in (
            rf"\{{\s{{0,4}}{any_case}\s{{0,4}}[_ ]\s{{0,4}}[0-9]+\s{{0,4}}\}}",
            rf"[\[(<]\s{{0,4}}{any_case}\s{{0,4}}[_ ]\s{{0,4}}[0-9]+\s{{0,4}}[\])>]",
            rf"\{{{any_case}_[0-9]+(?!\s*\}})",
            rf"(?<![{{\[(<])\b{any_case}_[0-9]+\}}",
            rf"(?<![{{\[(<])\b{re.escape(kind)}_[0-9]+\b(?![\])>}}])",
        ):
            found |= {m.span(): m.group() for m in re.finditer(shape, text)}
    found |= {m.span(): m.group() for m in DRIFT.finditer(text) if re.sub("[^A-Z0-9]", "", m.group(1).upper()) in types}
    spans = [s for s in found if not any(a < s[1] and s[0] < b for a, b in exact)]
    outer = [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)]
    return list(dict.fromkeys(found[s] for s in sorted(outer)))


# --- frames -------------------------------------------------------------------------------------------------------


RESULT = {"restored": pa.string(), "restored_count": pa.int32(), "orphans": pa.list_(pa.string()), "suspects": pa.list_(pa.string()), "ambiguous": pa.list_(pa.string())}


GROUP = 10_000  # texts of a scope that one run over its entries serves


def beside(texts: DataFrame, mapping: DataFrame, scope: str, key: str, text: str) -> DataFrame:
    """(__scope, __part, __text, __key, __entry): the texts of a scope in parts of about GROUP, each behind the scope's entries,
    in one sort; an entry goes to each part once, not to each text."""
    emitted = F.col("emitted").cast("int") if "emitted" in mapping.columns else F.lit(None).cast("int")
    glued = F.col("glued") if "glued" in mapping.columns else F.lit(None).cast("array<string>")
    entry = mapping.where("token <> ''").select(F.col(scope).alias("__scope"), F.struct("token", "surface", emitted.alias("emitted"), glued.alias("glued")).alias("__entry")).distinct()
    x = texts.select(F.col(scope).alias("__scope"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    # Few scopes are large: as many rows as all texts over GROUP at most.
    parts = texts.groupBy(F.col(scope).alias("__scope")).agg(F.ceil(F.countDistinct(F.col(key)) / GROUP).cast("int").alias("__parts")).where("__parts > 1")
    x = x.join(F.broadcast(parts), "__scope", "left").withColumn("__part", F.pmod(F.xxhash64("__key"), F.coalesce("__parts", F.lit(1))).cast("int"))
    y = entry.join(F.broadcast(parts), "__scope", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    kind = texts.schema[key].dataType.simpleString()
    z = y.select("__scope", "__part", F.lit(False).alias("__late"), F.lit(None).cast(kind).alias("__key"), F.lit(None).cast("string").alias("__text"), "__entry")
    z = z.unionByName(x.select("__scope", "__part", F.lit(True).alias("__late"), "__key", "__text"), allowMissingColumns=True)
    return z.repartition("__scope", "__part").sortWithinPartitions("__scope", "__part", "__late")


def with_mapping(batches):
    """(batch, [(row, text, Mapping of its scope)]) of what beside() gives, text by text."""
    at, entries, ready = None, [], None
    for batch in batches:
        rows = []
        for i, (s, part, late, t, e) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("__scope", "__part", "__late", "__text", "__entry")))):
            if at != (s, part):
                at, entries, ready = (s, part), [], None
            if not late:
                entries.append(e)
            else:
                if ready is None:
                    ready = Mapping([] if s is None else entries)
                rows.append((i, t, ready))
        yield batch, rows


def restore(edited: DataFrame, mapping: DataFrame, scope: str, style: str = "token", key: str = "doc_id", text: str = "text", orphans: bool = True) -> DataFrame:
    """R03 (token style) or R04 (pseudonym, asterisk): (key, restored, restored_count, orphans, suspects, ambiguous). Without
    `orphans` those of literal styles are null: of a scope with many texts each text lacks nearly all replacements."""
    work = (lambda t, m: m.tokens_and_literals(t)) if style == "token" else lambda t, m: m.literals(t, style == "asterisk", orphans)

    def run(batches):
        for batch, texts in with_mapping(batches):
            rows = [None if t is None else work(t, m) for _, t, m in texts]
            yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array([i for i, _, _ in texts], pa.int64())), *(pa.array([r and r[c] for r in rows], kind) for c, kind in RESULT.items())], [key, *RESULT])

    return beside(edited, mapping, scope, key, text).mapInArrow(run, f"{key} {edited.schema[key].dataType.simpleString()}, restored string, restored_count int, orphans array<string>, suspects array<string>, ambiguous array<string>")


def literal_site_rows(texts: DataFrame, mapping: DataFrame, scope: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, replacement): where a reading of the text finds the mapping's replacements."""

    def run(batches):
        for batch, rows in with_mapping(batches):
            ids, out = [], []
            for i, t, m in rows:
                got = literal_sites(t or "", m.words, None)[0]
                out += got
                ids += [i] * len(got)
            yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(ids, pa.int64())), *(pa.array([r[k] for r in out], pa.int32() if k < 2 else pa.string()) for k in range(3))], [key, "start", "end", "replacement"])

    return beside(texts, mapping, scope, key, text).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, start int, end int, replacement string")


def glued_rows(texts: DataFrame, sites: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, replacement, spelling) of emitted sites (key, start, end, replacement) that touch a letter or digit."""
    lists = sites.groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("__sites"))
    x = texts.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(lists, "__key")

    def run(batches):
        for batch in batches:
            rows = [(i, *g) for i, (t, s) in enumerate(zip(batch.column("__text").to_pylist(), batch.column("__sites").to_pylist())) for g in glued_spellings(t or "", [(v["start"], v["end"], v["replacement"]) for v in s])]
            yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], [key, "replacement", "spelling"])

    return x.mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, replacement string, spelling string")


def ambiguous_replacements(mapping: DataFrame, scope: str) -> DataFrame:
    """Replacements of a scope that stand for more than one value, with the values."""
    return mapping.where("token <> ''").groupBy(scope, "token").agg(F.sort_array(F.collect_set("surface")).alias("surfaces")).where(F.size("surfaces") > 1)


def release_preflight(mapping: DataFrame, seams: DataFrame, scope: str, key: str) -> DataFrame:
    """F16: (scope, reason) of what refuses a release: an ambiguous mask, or a seam that misreads (key, ...). Empty: go."""
    masks = ambiguous_replacements(mapping, scope).select(F.col(scope).cast("string").alias("scope"), F.concat(F.lit("ambiguous: "), "token").alias("reason"))
    return masks.unionByName(seams.select(F.col(key).cast("string").alias("scope"), F.concat(F.lit("seam: "), "replacement").alias("reason")).distinct())
