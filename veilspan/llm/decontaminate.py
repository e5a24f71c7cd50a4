"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of a task's documents. Its words become ids of the benchmark's vocabulary; runs of words whose
every neighbouring pair occurs in the benchmark (no other words can hold a window) form the shard's text, which is
indexed. The windows whose first pair occurs there are searched backwards together through the wavelet ranks,
occurrences are located by sampled suffix positions, and their spans merge into removal spans. Nothing is shuffled:
documents stay where they are read.

The benchmark is a stated query set. The driver reads it in blocks of BLOCK bytes of text (one item more at most) and
ships each block's windows packed; one function searches all blocks, and a worker holds one of them unpacked at a time.

Edge cases: null text has no words; items without words have no window; an empty benchmark hits nothing; a window
that several items share counts for each; rows repeated with the same id are judged row by row. Other columns pass
through, whatever their names (the result is one struct column). A text longer than SHARD is a shard of its own. Words
are told apart by 64-bit hashes of their bytes and length.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, run_hashes, runs, settle, utf8, word_runs
from .fmindex import FMIndex

BLOCK = 8 << 20
SHARD = 1 << 20
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
SPAN = T.StructType().add("word", T.IntegerType()).add("word_end", T.IntegerType()).add("byte", T.IntegerType()).add("byte_end", T.IntegerType())
RESULT = T.StructType().add("n_words", T.LongType()).add("n_hit", T.LongType()).add("spans", T.ArrayType(SPAN)).add("items", T.ArrayType(T.LongType()))
CUT = T.StructType(RESULT.fields + [T.StructField("rest", T.StringType())])


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, first word of each row, hashes."""
    low = LOWER[data]
    starts, ends, first = word_runs(IS_WORD[low], offs)
    return starts, ends, first, run_hashes(low, starts, ends)


class Windows:
    """The windows of one block of items, as rows of vocabulary ids (2 and up; 1 parts runs) by length."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        _, _, first, h = words_of(*utf8(pa.array([t for _, t in items], pa.string())))
        self.vocab = np.unique(h)
        ids = np.searchsorted(self.vocab, h) + 2
        of: dict[tuple, set] = {}
        for k, (item, _) in enumerate(items):
            w = ids[first[k] : first[k + 1]].tolist()
            for i in range(max(1, len(w) - n + 1) if w else 0):
                of.setdefault(tuple(w[i : i + n]), set()).add(item)
        by: dict[int, list] = {}
        for w in of:
            by.setdefault(len(w), []).append(w)
        self.rows = {m: np.array(ws, np.int64) for m, ws in by.items()}
        self.items = {m: [sorted(of[w]) for w in ws] for m, ws in by.items()}
        self.lead = {m: rows[:, 0] << 32 | rows[:, 1] for m, rows in self.rows.items() if m > 1}
        self.pairs = np.unique(np.array([a << 32 | b for w in of for a, b in zip(w, w[1:])], np.int64))
        self.single = np.unique(self.rows[1][:, 0]) if 1 in self.rows else np.zeros(0, np.int64)
        self.least = min((m for m in by if m > 1), default=0)

    def find(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Word indexes where windows start, the windows' lengths, their items, in one shard of hashed words."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if not len(h) or not len(self.vocab):
            return none
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        ids = np.where(self.vocab[at] == h, at + 2, 0)
        keep = np.isin(ids, self.single) & (ids > 0)
        if self.least:
            pair = ids[:-1] << 32 | ids[1:]
            link = np.zeros(len(h), bool)
            both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            link[both] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair[both]), len(self.pairs) - 1)] == pair[both]
            link[first[1:][first[1:] > 0] - 1] = False
            runs = np.flatnonzero(np.diff(np.concatenate([[0], link.astype(np.int8), [0]])))
            a, b = runs[0::2], runs[1::2] + 1  # words [a, b)
            long = b - a >= self.least
            mark = np.zeros(len(h) + 1, np.int32)
            np.add.at(mark, a[long], 1)
            np.add.at(mark, b[long], -1)
            keep |= np.cumsum(mark)[:-1] > 0
        else:
            link = np.zeros(len(h), bool)
        kept = np.flatnonzero(keep)
        if not len(kept):
            return none
        part = np.append(False, (kept[1:] != kept[:-1] + 1) | ~link[kept[:-1]])
        where = kept.repeat(1 + part)
        text = ids[where]
        sep = np.flatnonzero(part) + np.arange(int(part.sum()))
        text[sep], where[sep] = 1, -1
        index = FMIndex(text, len(self.vocab) + 2)
        inside = np.unique(text[:-1] << 32 | text[1:])
        starts, sizes, items = [], [], []
        for m, rows in self.rows.items():
            here = np.flatnonzero(np.isin(self.lead[m], inside) if m > 1 else np.isin(rows[:, 0], text))
            if not len(here):
                continue
            rows = rows[here]
            lo, hi = index.search(rows)
            n = hi - lo
            hit = np.repeat(np.arange(len(rows)), n)
            at = index.locate(np.repeat(lo, n) + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n))
            starts.append(where[at])
            sizes.append(np.full(len(at), m, np.int64))
            items += [self.items[m][k] for k in here[hit]]
        return (np.concatenate(starts), np.concatenate(sizes), items) if starts else none


def blocks(bench: DataFrame, item: str, text: str, n: int) -> Iterator[Windows]:
    held, size = [], 0
    for r in bench.select(item, text).where(F.col(text).isNotNull()).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= BLOCK:
            yield Windows(held, n)
            held, size = [], 0
    yield Windows(held, n)


def without(raw: bytes, spans: list) -> str:
    at, kept = 0, []
    for _, _, a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode()


def contamination(text: Column, bench: DataFrame, item: str = "item_id", bench_text: str = "text", n: int = 10, cut: bool = False) -> Column:
    """Struct column (n_words, n_hit, spans, items) of each whole text against the whole benchmark; with `cut` also rest:
    the text without its spans where it has any, else null."""
    sc = settle(bench.sparkSession).sparkContext
    packed = [sc.broadcast(zlib.compress(pickle.dumps(w), 1)) for w in blocks(bench, item, bench_text, n)]

    def judged(arr: pa.Array, unpack) -> pa.Array:
        n_words, n_hit, spans, items, rest = [], [], [], [], []
        for i, j, data, base in runs(arr, SHARD):
            starts, ends, first, h = words_of(data, base)
            mark = np.zeros(len(h) + 1, np.int64)
            found: dict[int, set] = {}
            for k in range(len(packed)):
                at, size, its = unpack(k).find(h, first)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + size, -1)
                for r, x in zip((np.searchsorted(first, at, "right") - 1).tolist(), its):
                    found.setdefault(r, set()).update(x)
            hit = np.cumsum(mark)[:-1] > 0
            total = np.append(0, np.cumsum(hit))
            n_words += np.diff(first).tolist()
            n_hit += (total[first[1:]] - total[first[:-1]]).tolist()
            a, b, own = word_runs(hit, first)
            for k in range(j - i):
                mine = [(x - first[k], y - first[k], starts[x] - base[k], ends[y - 1] - base[k]) for x, y in zip(a[own[k] : own[k + 1]].tolist(), b[own[k] : own[k + 1]].tolist())]
                spans.append(mine)
                items.append(sorted(found.get(k, ())))
                if cut:
                    rest.append(without(data[base[k] : base[k + 1]].tobytes(), mine) if mine else None)
        flat = [s for x in spans for s in x]
        cols = [pa.array([s[c] for s in flat], pa.int32()) for c in range(4)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in spans])), pa.int32()), pa.StructArray.from_arrays(cols, fields=[pa.field(f.name, pa.int32()) for f in SPAN]))
        out = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "spans": lists, "items": pa.array(items, pa.list_(pa.int64()))}
        if cut:
            out["rest"] = pa.array(rest, pa.string())
        return pa.StructArray.from_arrays(list(out.values()), list(out))

    @F.arrow_udf(CUT if cut else RESULT)
    def fm_index(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held: dict[int, Windows] = {}

        def unpack(k: int) -> Windows:
            if k not in held:
                held.clear()
                held[k] = pickle.loads(zlib.decompress(packed[k].value))
            return held[k]

        for arr in it:
            yield judged(arr, unpack)

    # Not that it is: so that Catalyst evaluates it once, however often its fields are used.
    return fm_index.asNondeterministic()(text)
