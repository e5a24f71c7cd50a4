"""Language ID by error-correcting output codes over hashed byte n-grams.

Each language gets a codeword; one binary n-gram classifier per bit predicts that bit; the language whose codeword
has the least weighted loss wins, and a small lead over the runner-up is flagged as ambiguous.

Edge cases: null text, empty text and text without a letter are `und` with score 0; with no labelled row at all
every text is `und`; one language only is always predicted, with score 1. Very long texts are read whole, in pieces
of rows. Other columns pass through, whatever their names (the result is one struct column named by the caller).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, materialize, runs, settle

BITS = 15
SLICES = 16
ORDERS = (2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")
FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not (97 <= LOWER[b] <= 122)]] = 32
RESULT = "struct<lang:string,score:double,margin:double,ambiguous:boolean>"


def grams(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """One array of buckets for each order; those that would leave their row go to the last bucket + 1."""
    t = FOLD[data].astype(np.uint32)
    for n in ORDERS:
        code = np.zeros(len(t), np.uint32)
        for k in range(n):
            code[: len(t) - k] += t[k:] << np.uint32(8 * k)
        code = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
        for k in range(1, n):
            at = offs[1:] - k
            code[at[(at >= offs[:-1]) & (at >= 0)]] = 1 << BITS
        yield code


def codebook(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1/-1. Up to five languages: the exhaustive code; beyond, the best of 64 random codes of
    10 log2 k bits by least distance between rows."""
    if k < 2:
        return np.ones((k, 1), np.float32)
    if k <= 5:
        cols = [c for c in itertools.product((-1, 1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols, np.float32).T
    rng, best, score = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(k)))
    for _ in range(64):
        m = rng.choice(np.array([-1, 1], np.float32), (k, bits))
        m = m[:, np.abs(m.sum(0)) < k]
        d = ((m.shape[1] - m @ m.T) / 2 + np.eye(k) * 1e9).min()
        if d > score:
            best, score = m, d
    return best


def counts_by_lang(rows: DataFrame) -> dict[str, np.ndarray]:
    """Bucket counts of each language over the sample `rows` (text, lang): each task sums its own, slices are added up."""

    def work(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for i, j, part, o in runs(batch.column(0)):
                for lang in set(langs[i:j]):
                    keep = np.repeat(langs[i:j] == lang, np.diff(o))
                    acc = total.setdefault(lang, np.zeros(1 << BITS))
                    for code in grams(part, o):
                        acc += np.bincount(code[keep], minlength=(1 << BITS) + 1)[:-1]
        parts = [(lang, k, x.astype("<f8").tobytes()) for lang, v in total.items() for k, x in enumerate(np.split(v, SLICES)) if x.any()]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([x[0] for x in parts], pa.string()), "slice": pa.array([x[1] for x in parts], pa.int32()), "vec": pa.array([x[2] for x in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), "<f8") for v in table.column("vec"))
        return pa.table({"lang": table.column("lang")[:1], "slice": table.column("slice")[:1], "vec": pa.array([total.tobytes()], pa.binary())})

    shape = "lang string, slice int, vec binary"
    out: dict[str, np.ndarray] = {}
    for r in rows.select("text", "lang").mapInArrow(work, shape).groupBy("lang", "slice").applyInArrow(add, shape).collect():
        out.setdefault(r.lang, np.zeros((SLICES, (1 << BITS) // SLICES)))[r.slice] = np.frombuffer(r.vec, "<f8")
    return {lang: v.ravel() for lang, v in out.items()}


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = 20_000) -> dict:
    """Fit on about `max_rows` labelled rows at most (the bound on the training sample), chosen by a hash of the
    key; fewer rows are all used. Returns the model: languages, codewords, bit weights, classifier table."""
    settle(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h")).where("text is not null and lang is not null")
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod("h", F.lit(1 << 40)) < int(max_rows / n * (1 << 40)))
    # The sample is drawn by all tasks at once and written: what reads it is as small as it.
    sample = materialize(rows.select("text", "lang"), "lang-sample")
    by = counts_by_lang(sample)
    discard(sample)
    langs = sorted(by)
    if not langs:
        return {"langs": []}
    code = codebook(len(langs))
    p = np.stack([by[x] + 0.5 for x in langs])
    p /= p.sum(1, keepdims=True)
    table = np.zeros(((1 << BITS) + 1, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        yes, no = code[:, b] > 0, code[:, b] < 0
        if yes.any() and no.any():
            table[:-1, b] = np.log(p[yes].mean(0)) - np.log(p[no].mean(0))
    expected = p @ table[:-1]  # mean output of each bit on each language's own n-grams
    worst = (expected * code).min(0).clip(1e-3)
    table /= np.abs(expected).mean(0).clip(1e-3)
    return {"langs": langs, "code": code, "weight": (worst / worst.sum()).astype(np.float32), "table": table}


def decode(model: dict, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding of bit outputs (rows x bits): best codeword, its score, lead over the next."""
    loss = (np.log1p(np.exp(-3 * f[:, None, :] * model["code"][None])) * model["weight"]).sum(2)
    if loss.shape[1] == 1:
        return np.zeros(len(f), int), np.ones(len(f)), np.full(len(f), np.inf)
    like = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    two = np.sort(loss, 1)[:, :2]
    return loss.argmin(1), 1 / like.sum(1), two[:, 1] - two[:, 0]


def has_letter(text: Column) -> Column:
    """Whether a text holds a letter, by the test of predict(); null has none."""

    @F.arrow_udf("boolean")
    def letter(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            yield pa.array([x is not None and LETTER.search(x) is not None for x in arr.to_pylist()], pa.bool_())

    return letter(text)


def predict(model: dict, text: Column, ambiguous_below: float = 0.05) -> Column:
    """Struct column (lang, score, margin, ambiguous) for each whole text."""

    @F.arrow_udf(RESULT)
    def ecoc(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            n = len(arr)
            lang = np.array([None] * n, object)
            score, margin = np.zeros(n), np.zeros(n)
            has = np.array([x is not None and LETTER.search(x) is not None for x in arr.to_pylist()], bool)
            lang[:] = "und"
            if model["langs"] and n:
                for i, j, data, o in runs(arr):
                    total, size = np.zeros((j - i, model["table"].shape[1])), np.diff(o)
                    full = np.flatnonzero(size)
                    if not len(full):
                        continue
                    for code in grams(data, o):
                        total[full] += np.add.reduceat(model["table"][code], o[:-1][full], 0)
                    f = total / np.maximum(1, len(ORDERS) * size - sum(n - 1 for n in ORDERS))[:, None]
                    k, s, m = decode(model, f)
                    lang[i:j], score[i:j], margin[i:j] = np.array(model["langs"], object)[k], s, m
            lang[~has], score[~has], margin[~has] = "und", 0, 0
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(margin), pa.array(margin < ambiguous_below)], ["lang", "score", "margin", "ambiguous"])

    return ecoc(text)
