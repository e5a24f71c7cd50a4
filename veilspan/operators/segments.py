"""Windows over texts and the spans that come back from them: packing, windows of tokens, decoding tags, snapping edges,
blanks, offset maps, rectangles. Sequential walks over one text are plain Python over Arrow batches; the rest is relational.

Edge cases: null and empty texts give no window and no span; ties are told in each docstring; keys may have any type; rows
repeated with one key are handled row by row; only the named columns are read. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .regexspans import matches
from .spanalgebra import greedy, overlap_anti

TYPES = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def each_row(df: DataFrame, columns: list[str], shape: str, work: Callable, key: str = "doc_id") -> DataFrame:
    """work(*columns) -> rows of `shape`, for each row; the key goes along."""
    names, kinds = zip(*(f.split() for f in shape.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in columns))):
                got = work(*row)
                out += got
                ids += [i] * len(got)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(ids, pa.int64())), *(pa.array([r[k] for r in out], TYPES[t]) for k, t in enumerate(kinds))], [key, *names])

    return df.select(key, *[c for c in columns if c != key]).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {shape}")


# --- windows over texts -------------------------------------------------------------------------------------------

BOUNDARY = (("\n\n", 0), ("\n", 200), ("。", 200), (". ", 200), (" ", 200))


def packed(text: str, target: int = 2000, hard: int = 350) -> list[tuple[int, int]]:
    """Windows of at most `target` characters. An end backs up, in the window's second half, to a paragraph, line,
    sentence or blank, else it is hard. The next window starts at once behind a paragraph, 200 characters earlier (moved to
    a word's start) behind a softer end, 350 behind a hard one. Blank windows are dropped; CRLF is one line end."""
    out, at, n = [], 0, len(text)
    while at < n:
        end, back = min(n, at + target), 0
        if end < n:
            half = at + target // 2
            for mark, overlap in BOUNDARY:
                cut = max(text.rfind(m, half, end) + len(m) if text.rfind(m, half, end) >= 0 else -1 for m in ((mark, "\r\n\r\n") if mark == "\n\n" else (mark,)))
                if cut > half:
                    end, back = cut, overlap
                    break
            else:
                back = hard
                if text[end - 1] == "\r" and text[end] == "\n":
                    end += 1
        if text[at:end].strip():
            out.append((at, end))
        if end >= n:
            break
        nxt = end - back
        if back and back != hard:
            while nxt < end and nxt > 0 and not text[nxt - 1].isspace():
                nxt += 1
        at = max(at + 1, nxt)
    return out


def pack_segments(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = 2000) -> DataFrame:
    """(key, segment, start, end, part)."""
    work = lambda t: [(i, a, b, t[a:b]) for i, (a, b) in enumerate(packed(t or "", target))]
    return each_row(docs, [text], "segment int, start int, end int, part string", work, key)


SENTENCE = re.compile(r"(?<=[.!?。！？；;])\s*")


def paragraphs(text: str, limit: int = 10_000) -> list[str]:
    """Pieces of at most `limit` characters that put together are the text: whole paragraphs where they fit, the long
    ones by sentences with the white space behind them, longer sentences cut hard."""
    units: list[str] = []
    for part in re.split(r"(?<=\n)(?=[^\n])", text):
        if len(part) <= limit:
            units.append(part)
            continue
        at = 0
        for m in SENTENCE.finditer(part):
            units.append(part[at : m.end()])
            at = m.end()
        units.append(part[at:])
    out, held = [], ""
    for u in units:
        if held and len(held) + len(u) > limit:
            out.append(held)
            held = ""
        held += u
        while len(held) > limit:
            out.append(held[:limit])
            held = held[limit:]
    return [*out, held] if held else out


def paragraph_segments(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 10_000) -> DataFrame:
    """(key, segment, part)."""
    return each_row(docs, [text], "segment int, part string", lambda t: list(enumerate(paragraphs(t or "", limit))), key)


def token_windows(tokens: DataFrame, length: int = 512, stride: int = 256, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, window, first, ids) of an array column: length - 2 tokens each (two are the model's own), one every
    `stride`, the last one reaching the end."""
    size, body = F.size(ids), length - 2
    n = F.when(size <= body, 1).otherwise(F.ceil((size - body) / stride) + 1).cast("int")
    x = tokens.where(size > 0).select(key, ids, F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    return x.select(key, "window", (F.col("window") * stride).alias("first"), F.slice(F.col(ids), F.col("window") * stride + 1, F.lit(body)).alias("ids"))


# --- decoding tags ------------------------------------------------------------------------------------------------


def tag_states(labels: list[str]) -> list[tuple[str, str]]:
    return [("O", "")] + [(t, label) for label in labels for t in "BIES"]


def allowed(a: tuple[str, str], b: tuple[str, str]) -> bool:
    """Whether state b may follow a: inside a span goes on with its label, elsewhere a span starts or there is none."""
    return b[0] in "IE" and a[1] == b[1] if a[0] in "BI" else b[0] in "OBS"


def viterbi(scores: np.ndarray, labels: list[str]) -> list[int]:
    """The best path of states through scores (tokens x states); log-softmax, constrained steps, ties to the lowest
    state. A path starts in O, B or S and ends in O, E or S, where the tokens allow it."""
    states = tag_states(labels)
    if not len(scores):
        return []
    logp = scores - scores.max(1, keepdims=True)
    logp = logp - np.log(np.exp(logp).sum(1, keepdims=True))
    step = np.array([[0.0 if allowed(a, b) else -np.inf for b in states] for a in states])
    first = np.array([0.0 if s[0] in "OBS" else -np.inf for s in states])
    best, back = logp[0] + first, []
    for row in logp[1:]:
        paths = best[:, None] + step
        back.append(paths.argmax(0))
        best = paths.max(0) + row
    last = best + np.array([0.0 if s[0] in "OES" else -np.inf for s in states])
    at = int((last if np.isfinite(last).any() else best).argmax())
    out = [at]
    for b in reversed(back):
        out.append(at := int(b[at]))
    return out[::-1]


def tag_spans(path: list[int], labels: list[str]) -> list[tuple[int, int, str, bool]]:
    """(first token, end token, label, cut): spans of a path; cut where one touches the window's edge unfinished."""
    states, out, start = tag_states(labels), [], None
    for i, s in enumerate(path):
        tag, label = states[s]
        if tag == "S":
            out.append((i, i + 1, label, i in (0, len(path) - 1)))
        elif tag == "B":
            start = i
        elif tag == "E":
            out.append((start if start is not None else i, i + 1, label, start in (None, 0) or i == len(path) - 1))
            start = None
    if start is not None:
        out.append((start, len(path), states[path[start]][1], True))
    return out


def decode_tags(windows: DataFrame, labels: list[str], key: str = "doc_id") -> DataFrame:
    """(key, start, end, label, score, edge) of windows (key, first, scores: array of arrays): token offsets in the
    document; score is the mean probability of the path's states in the span."""

    def work(first, scores):
        x = np.array(scores or [], float).reshape(-1, 1 + 4 * len(labels))
        path = viterbi(x, labels)
        p = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
        p = p / p.sum(1, keepdims=True) if len(x) else p
        return [(first + a, first + b, label, float(np.mean([p[i, path[i]] for i in range(a, b)])), cut) for a, b, label, cut in tag_spans(path, labels)]

    return each_row(windows, ["first", "scores"], "start int, end int, label string, score double, edge boolean", work, key)


def merge_windows(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Copies of a span from several windows are one (best score; cut only if cut in all); then the uncut go first,
    by score, length, start, and what overlaps an accepted one is dropped."""
    one = spans.groupBy(key, "start", "end", "label").agg(F.max("score").alias("score"), F.bool_and("edge").alias("edge"))
    rank = F.struct(F.col("edge").cast("int").alias("r0"), (-F.col("score")).alias("r1"), (F.col("start") - F.col("end")).alias("r2"), "start", "end", "label", "score", "edge")
    x = one.groupBy(key).agg(F.array_sort(F.collect_list(rank)).alias("all"))
    keep = F.aggregate("all", F.slice("all", 1, 0), lambda a, s: F.when(F.exists(a, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), a).otherwise(F.concat(a, F.array(s))))
    return x.select(key, F.inline(keep)).drop("r0", "r1", "r2")


# --- edges, halves, blanks ----------------------------------------------------------------------------------------


def snapped(text: str, a: int, b: int, reach: int = 40) -> tuple[int, int] | None:
    """A span grown to whole ASCII words, at most `reach` characters on each side, blanks trimmed; a span whose text
    stands alone elsewhere in the text stays as it is. None if nothing is left."""
    word = lambda ch: ch.isascii() and (ch.isalnum() or ch == "_")
    value = text[a:b]
    alone = any((m.start() == 0 or not word(text[m.start() - 1])) and (m.end() == len(text) or not word(text[m.end()])) for m in re.finditer(re.escape(value), text) if m.start() != a) if value.strip() else False
    if not alone:
        lo, hi = a, b
        while lo > max(0, a - reach) and word(text[lo - 1]) and word(text[lo]):
            lo -= 1
        while 0 < hi < min(len(text), b + reach) and word(text[hi]) and word(text[hi - 1]):
            hi += 1
        # A word longer than the reach isn't one to grow into.
        a = lo if lo == 0 or not word(text[lo - 1]) else a
        b = hi if hi == len(text) or not word(text[hi]) else b
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return (a, b) if a < b else None


def snap_to_words(spans: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, type, text)."""
    lists = spans.groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_set(F.struct("start", "end", "type"))).alias("__spans"))
    x = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(lists, "__key")
    work = lambda t, ss: list(dict.fromkeys((*at, s["type"], t[at[0] : at[1]]) for s in ss if (at := snapped(t, s["start"], s["end"]))))
    return each_row(x, ["__text", "__spans"], "start int, end int, type string, text string", lambda t, ss: work(t or "", ss), "__key").withColumnRenamed("__key", key)


def halves(text: str) -> tuple[str, str]:
    """A text cut at its middle, not inside a character with its combining marks, a surrogate join or CRLF."""
    import unicodedata

    at = len(text) // 2
    joined = lambda i: unicodedata.combining(text[i]) or text[i] in "‍️" or text[i - 1] == "‍" or text[i - 1 : i + 1] == "\r\n"
    while 0 < at < len(text) and joined(at):
        at += 1
    return text[:at], text[at:]


DELIMITED = r"\[[^\[\]\n]{1,60}\]|【[^【】\n]{1,60}】|\{\{[^{}\n]{1,60}\}\}|«[^«»\n]{1,60}»|<<[^<>\n]{1,60}>>"
BARE = r"_{2,}|[•●○□▢]{2,}|\.{6,}|…{2,}"


def blanks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, label, before, after): delimited blanks, leftmost longest, and bare ones that overlap
    none of them; with 120 characters of context."""
    from ..functions.text import context_window

    t = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col("__text").rlike(f"{DELIMITED}|{BARE}"))
    found = lambda p, n: t.select("__key", F.inline(matches(F.col("__text"), p))).withColumn("priority", F.lit(n))
    framed = greedy(found(DELIMITED, 40), "__key", order="leftmost")
    bare = overlap_anti(found(BARE, 10), framed, "__key")
    label = F.trim(F.regexp_replace("text", r"^[\[【{«<]+|[\]】}»>]+$|^[_•●○□▢.…]+$", ""))
    x = framed.unionByName(bare).join(t, "__key").withColumn("c", context_window(F.col("__text"), F.col("start"), F.col("end")))
    return x.select(F.col("__key").alias(key), "start", "end", label.alias("label"), F.col("c.before").alias("before"), F.col("c.after").alias("after"))


def squeezed(text: str) -> tuple[str, list[int]]:
    """White space runs become one blank, none between two wide characters and at the start; for each character that
    stays, where it came from."""
    wide = lambda ch: "ᄀ" <= ch and (ch <= "ᅟ" or "⺀" <= ch <= "꓏" or "가" <= ch <= "힣" or "豈" <= ch <= "﫿" or "︰" <= ch <= "﹏" or "＀" <= ch <= "｠" or "￠" <= ch <= "￦" or ch >= "\U00020000")
    out, at, gap = [], [], None
    for i, ch in enumerate(text):
        if ch.isspace():
            gap = i if gap is None else gap
            continue
        if gap is not None and out and not (wide(out[-1]) and wide(ch)):
            out.append(" ")
            at.append(gap)
        gap = None
        out.append(ch)
        at.append(i)
    return "".join(out), at


def squeeze(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, squeezed, at)."""
    return each_row(docs, [text], "squeezed string, at array<int>", lambda t: [squeezed(t)] if t is not None else [], key)


def joined_boxes(boxes: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Boxes (x0, y0, x1, y1) joined while any two meet in more than an edge; a joint box covers both."""
    out: list[tuple] = []
    for box in sorted(boxes):
        while hit := next((o for o in out if o[0] < box[2] and box[0] < o[2] and o[1] < box[3] and box[1] < o[3]), None):
            out.remove(hit)
            box = (min(box[0], hit[0]), min(box[1], hit[1]), max(box[2], hit[2]), max(box[3], hit[3]))
        out.append(box)
    return sorted(out)


def join_boxes(boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, x0, y0, x1, y1); the boxes of one image are handled together."""
    lists = boxes.groupBy(key).agg(F.collect_list(F.array("x0", "y0", "x1", "y1")).alias("__boxes"))
    return each_row(lists, ["__boxes"], "x0 double, y0 double, x1 double, y1 double", lambda b: joined_boxes([tuple(map(float, v)) for v in b]), key)


def protect_value(spans: DataFrame, hits: DataFrame, kind: str, key: str = "doc_id") -> DataFrame:
    """A value's occurrences (key, start, end, text) become manual spans of `kind`: equal spans are retyped, free places
    added; an occurrence strictly inside an accepted span is left to it; other spans it overlaps give way."""
    cols = [key, "start", "end", "type", "text", "source", "priority"]
    h = hits.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e")).distinct()
    inside = h.join(spans, (F.col(key) == F.col("__k")) & (F.col("start") <= F.col("__s")) & (F.col("__e") <= F.col("end")) & (F.col("end") - F.col("start") > F.col("__e") - F.col("__s")), "left_semi")
    mine = h.join(inside, ["__k", "__s", "__e"], "left_anti")
    manual = mine.join(hits, (F.col(key) == F.col("__k")) & (F.col("start") == F.col("__s")) & (F.col("end") == F.col("__e"))).select(key, "start", "end", F.lit(kind).alias("type"), "text", F.lit("manual").alias("source"), F.lit(120).alias("priority")).distinct()
    return overlap_anti(spans.select(*cols), manual, key).unionByName(manual)


def upper_quartile(widths: list[int]) -> int:
    """The width at place (n - 1) / 4 of the falling order."""
    w = sorted(widths, reverse=True)
    return w[(len(w) - 1) // 4] if w else 0


def key_sections(docs: DataFrame, words: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part): paragraphs within two of one that holds a key word, in order; with fewer than three such, the
    first 15 % and the last 10 % of the text."""
    t = docs.select(key, F.col(text).alias("__text"), F.length(text).alias("__n"))
    p = t.select(key, "__n", F.posexplode(F.split("__text", "\n")).alias("i", "part")).withColumn("hit", F.lower("part").rlike("|".join(re.escape(w.lower()) for w in words)).cast("int"))
    near = Window.partitionBy(key).orderBy("i").rowsBetween(-2, 2)
    p = p.withColumn("near", F.max("hit").over(near))
    s = p.groupBy(key).agg(F.sum("hit").alias("hits"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("near") == 1, F.struct("i", "part")))), lambda x: x["part"]), "\n").alias("near"))
    head, tail = F.ceil(F.col("__n") * 0.15).cast("int"), F.floor(F.col("__n") * 0.1).cast("int")
    ends = F.concat(F.substring(F.col("__text"), F.lit(1), head), F.lit("\n"), F.substring(F.col("__text"), F.col("__n") - tail + 1, tail))
    return t.join(s, key).select(key, F.when(F.col("hits") >= 3, F.col("near")).otherwise(ends).alias("part"))
