"""Suffix-array dedup: remove every byte covered by a `length`-byte string that also starts earlier in the corpus.

1. Anchors. Each window of `length` bytes elects the gram of GRAM bytes with the least hash in it, leftmost on ties.
   Equal windows elect equal grams at equal offsets, so a window repeats only where its anchor does. The windows that
   share one anchor occurrence are one context: some 40 windows for each row that is shuffled.
2. Copies of one context are collapsed before bytes are shuffled: the first occurrence stands for them, the others are
   removed whole. The grams seen once, most of the corpus, end here.
3. Contexts that share their gram but differ go to suffix buckets (by gram), one occurrence of each. A task takes whole
   grams up to PIECE bytes as one text and sorts one bucket of its suffixes at a time (Block): by their first 8 bytes, then,
   for longer ties, by ranks of a difference-cover sample modulo V worked out once for the text. Any two suffixes have an
   offset below V at which both are sampled, whatever their residues, and their ranks there decide. Neighbours with a
   common prefix of `length` bytes form groups; all but the earliest are removed.
4. Removed intervals go back to their documents, which alone are shuffled if those are few enough to broadcast ids.

A gram with more than HOT different contexts (a passage that very many documents share between different neighbours) isn't
gathered: its windows are aggregated by two 64-bit hashes to their least position, each task combining its own first.

Edge cases: null text is empty; texts shorter than `length` lose nothing; ids should be unique (rows repeated with
one id count as the same occurrence, so neither loses bytes to the other); rows with a null id lose nothing and take
nothing from others; an empty table gives an empty result. Very long texts are cut into overlapping segments for step 1
only. Only id and text are read. Contexts are told apart by two 64-bit hashes (gram, context), windows in step 3 by their
bytes.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, U64, discard, materialize, mix, run_hashes, runs, sized

GRAM, V, SEGMENT, PIECE, BUCKET, HOT = 20, 7, 1 << 18, 1 << 19, 1 << 16, 5_000
POS_BITS = 23


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of data[i:i+k] at each i, from hashes of powers of two."""
    h, size, base = BYTE_CODE[data], 1, 0x9E3779B97F4A7C15
    out, done = None, 0
    while size <= k:
        if k & size:
            n = len(data) - done - size + 1
            out = h[:n].copy() if out is None else out[:n] * U64(pow(base, size, 1 << 64)) + h[done : done + n]
            done += size
        h = h[: len(h) - size] * U64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def contexts(data: np.ndarray, offs: np.ndarray, length: int):
    """(row, start, windows, offset of the anchor, gram, context) arrays over the rows of data."""
    size = np.diff(offs)
    segs = [(r, a, min(a + SEGMENT + length - 1, n)) for r, n in enumerate(size.tolist()) if n >= length for a in range(0, n - length + 1, SEGMENT)]
    i = 0
    while i < len(segs):
        j, total = i, 0
        while j < len(segs) and (j == i or total + segs[j][2] - segs[j][1] <= PIECE):
            total += segs[j][2] - segs[j][1]
            j += 1
        part = segs[i:j]
        i = j
        base = offs[:-1]
        d = np.concatenate([data[base[r] + a : base[r] + b] for r, a, b in part])
        lens = np.array([b - a for _, a, b in part])
        ends = np.cumsum(lens)
        g = gram_hashes(d, GRAM)
        low = U64((1 << POS_BITS) - 1)
        win = sliding_min((g & ~low) | np.arange(len(g), dtype=U64), length - GRAM + 1)
        valid = np.ones(len(d), bool)
        for e in ends.tolist():
            valid[e - length + 1 : e] = False
        idx = np.flatnonzero(valid[: len(win)])
        at = (win[idx] & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], len(idx)) - 1
        s, n, a = idx[first], idx[last] - idx[first] + 1, at[first]
        ctx = mix(run_hashes(d, s, s + n - 1 + length) + (a - s).astype(U64))
        seg = np.searchsorted(ends, s, "right")
        rows, starts = np.array([p[0] for p in part]), np.array([p[1] for p in part])
        yield rows[seg], s - (ends - lens)[seg] + starts[seg], n, a - s, g[a].view(np.int64), ctx.view(np.int64)


def anchored(rows: DataFrame, length: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            ids, text = batch.column("id"), batch.column("text")
            for i, row, s, n, d, g, c in ((i, *x) for i, _, data, offs in runs(text, PIECE) for x in contexts(data, offs, length)):
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), ids.take(pa.array(row + i)), pa.array(s), pa.array(n.astype(np.int32)), pa.array(d.astype(np.int32))], ["gram", "ctx", "id", "s", "n", "d"])

    return rows.mapInArrow(work, f"gram bigint, ctx bigint, id {kind}, s bigint, n int, d int")


def cover(v: int) -> np.ndarray:
    """A least difference cover modulo v (v small): every residue is a difference of two of its members."""
    for size in range(1, v + 1):
        for c in itertools.combinations(range(v), size):
            if len({(x - y) % v for x in c for y in c}) == v:
                return np.array(c)


def dense(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks by the keys, the first the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Block:
    """Contexts laid out in one text, and ranks of its difference-cover sample: by `length` bytes at least."""

    def __init__(self, parts: list[bytes], length: int):
        self.starts = np.cumsum([0, *[len(raw) + 1 for raw in parts]])[:-1]
        text = b"\0".join(parts)
        n = len(text)
        t = np.frombuffer(text + b"\0" * (2 * length + 4 * V + 8), np.uint8)
        words = np.zeros(len(t) - 7, U64)
        for k in range(8):
            words |= t[k : k + len(words)].astype(U64) << U64(56 - 8 * k)
        self.words, self.length = words, length
        inside = np.zeros(V, bool)
        inside[cover(V)] = True
        # For two residues, the least offset that leads both into the sample.
        self.meet = np.array([[next(k for k in range(V) if inside[(x + k) % V] and inside[(y + k) % V]) for y in range(V)] for x in range(V)])
        sample = np.flatnonzero(np.resize(inside, n + 2 * V))
        self.index = np.full(n + 2 * length + 4 * V, -1, np.int64)
        self.index[sample] = np.arange(len(sample))
        rank, depth = dense(words[sample]), V
        while depth < length:
            nxt = self.index[np.minimum(sample + depth, len(self.index) - 1)]
            rank = dense(rank * (len(sample) + 1) + np.where(nxt >= 0, rank[nxt] + 1, 0))
            depth *= 2
        self.rank = rank

    def sort(self, pos: np.ndarray) -> np.ndarray:
        """Suffixes at pos in order, one bucket (a range of first 8 bytes) at a time."""
        lead = self.words[pos]
        cuts = np.unique(np.sort(lead)[BUCKET::BUCKET]) if len(pos) > BUCKET else lead[:0]
        bucket = np.searchsorted(cuts, lead, "right")
        return np.concatenate([self.bucket(pos[bucket == b] if len(cuts) else pos) for b in range(len(cuts) + 1)])

    def bucket(self, pos: np.ndarray) -> np.ndarray:
        """One bucket in order. Suffixes that no other shares 8 bytes with stand by those; the others are counted, against
        those of each residue, by their ranks where both are sampled."""
        _, group, size = np.unique(self.words[pos], return_inverse=True, return_counts=True)
        tied = size[group] > 1
        place = (np.cumsum(size) - size)[group]
        p, g = pos[tied], group[tied] * (len(self.rank) + 1)
        residue = p % V
        of = [np.flatnonzero(residue == r) for r in range(V)]
        less = np.zeros(len(p), np.int64)
        for y in range(V):
            keys: dict[int, np.ndarray] = {}
            for x in range(V):
                k = int(self.meet[x, y])
                if k not in keys:
                    keys[k] = np.sort(g[of[y]] + self.rank[self.index[p[of[y]] + k]])
                less[of[x]] += np.searchsorted(keys[k], g[of[x]] + self.rank[self.index[p[of[x]] + k]])
        # `less` counts the tied suffixes of all groups before; within a group it is the order.
        place[tied] = place[tied] + less - np.searchsorted(np.sort(g), g)
        return pos[np.argsort(place, kind="stable")]

    def same(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether `length` bytes agree at p and q."""
        eq = np.ones(len(p), bool)
        for k in [*range(0, self.length - 8, 8), self.length - 8]:
            eq &= self.words[p + k] == self.words[q + k]
        return eq


def repeats_in(block: list[tuple], length: int) -> list[tuple]:
    """(id, start, end) removed among the contexts (id, s, n, bytes) of whole grams."""
    b = Block([x[3] for x in block], length)
    n = np.array([x[2] for x in block])
    own = np.repeat(np.arange(len(block)), n)
    rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = b.starts[own] + rel
    inv = np.full(pos.max() + 1, -1, np.int64)
    inv[pos] = np.arange(len(pos))
    order = inv[b.sort(pos)]
    group = np.empty(len(pos), np.int64)
    group[order] = np.cumsum(np.append(True, ~b.same(pos[order[:-1]], pos[order[1:]])))
    ids = sorted({x[0] for x in block})
    rank = {x: k for k, x in enumerate(ids)}
    idr = np.array([rank[x[0]] for x in block])[own]
    off = np.array([x[1] for x in block])[own] + rel
    by = np.lexsort((off, idr, group))
    g = group[by]
    first = np.append(True, g[1:] != g[:-1])
    lead = by[np.flatnonzero(first)[np.cumsum(first) - 1]]
    dup = np.zeros(len(pos), bool)
    dup[by] = (idr[by] != idr[lead]) | (off[by] != off[lead])
    edge = np.flatnonzero(dup & np.append(True, ~dup[:-1] | (own[1:] != own[:-1])))
    stop = np.flatnonzero(dup & np.append(~dup[1:] | (own[1:] != own[:-1]), True))
    return [(ids[i], int(a), int(z) + length) for i, a, z in zip(idr[edge].tolist(), off[edge], off[stop])]


def removed_intervals(rows: DataFrame, length: int = 100) -> DataFrame:
    """(id, a, b): removed byte ranges of each document, overlapping ones included."""
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.where("id is not null")
    anchors = anchored(rows, length)
    grams = anchors.groupBy("gram").agg(F.count("*").alias("c"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("c > 1")
    grams = materialize(grams.select("gram", (F.col("c0") != F.col("c1")).alias("mixed")), "suffix-grams")
    again = materialize(anchors.join(grams, "gram"), "suffix-again")
    top = rows.agg(F.max(F.abs(F.col("id"))) if kind in ("bigint", "int") else F.lit(None), F.max(F.octet_length("text"))).first()
    packed = top[0] is not None and top[0] < 1 << 36 and (top[1] or 0) < 1 << 26
    again = again.withColumn("pos", F.col("id").cast("bigint") * (1 << 26) + F.col("s") if packed else F.struct("id", "s"))
    firsts = materialize(again.groupBy("gram", "ctx").agg(F.min("pos").alias("first"), F.count("*").alias("c"), F.first("mixed").alias("mixed")).where("c > 1 or mixed"), "suffix-first")
    whole = again.join(firsts.where("c > 1").select("gram", "ctx", "first"), ["gram", "ctx"]).where("pos <> first").select("id", F.col("s").alias("a"), (F.col("s") + F.col("n") - 1 + length).alias("b"))
    whole = materialize(whole, "suffix-whole")
    counts = firsts.where("mixed").groupBy("gram").agg((F.count("*") > HOT).alias("hot"))
    reps = again.where("mixed").join(firsts.select("gram", "ctx", "first"), ["gram", "ctx"]).where("pos = first").select("gram", "ctx", "id", "s", "n", "d").join(counts, "gram")
    lists = materialize(reps.dropDuplicates(["gram", "ctx"]).groupBy("id").agg(F.collect_list(F.struct("gram", "s", "n", "d", "hot")).alias("reps")), "suffix-reps")
    near = rows.join(sized(materialize(lists.select("id"), "suffix-ids")), "id", "left_semi").join(lists, "id")

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, text, reps in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "reps"))):
                raw = text.encode()
                out += [(r["gram"], i, r["s"], r["n"], raw[r["s"] : r["s"] + r["n"] - 1 + length]) for r in reps if not r["hot"]]
                if len(out) >= 1 << 13:
                    yield table(out, batch.schema.field("id").type)
                    out = []
            if out:
                yield table(out, batch.schema.field("id").type)

    def windows(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, text, reps in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "reps"))):
                raw = text.encode()
                for r in reps:
                    for p in range(r["n"] if r["hot"] else 0):
                        a = r["s"] + p
                        h = np.frombuffer(hashlib.blake2b(raw[a : a + length], digest_size=16).digest(), np.int64)
                        out.append((int(h[0]), int(h[1]), i, a))
                if len(out) >= 1 << 15:
                    yield hashed(out, batch.schema.field("id").type)
                    out = []
            if out:
                yield hashed(out, batch.schema.field("id").type)

    def hashed(out, id_type):
        c = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], id_type), pa.array(c[3], pa.int64())], ["h1", "h2", "id", "a"])

    def table(out, id_type):
        c = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], id_type), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.binary())], ["gram", "id", "s", "n", "raw"])

    def sort(batches):
        held, size, id_type = [], 0, None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for x in zip(*(batch.column(c).to_pylist() for c in ("gram", "id", "s", "n", "raw"))):
                if size >= PIECE and x[0] != held[-1][0]:
                    yield intervals(held, id_type)
                    held, size = [], 0
                held.append(x)
                size += len(x[4])
        if held:
            yield intervals(held, id_type)

    def intervals(held, id_type):
        found = repeats_in([h[1:] for h in held], length)
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], id_type), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], ["id", "a", "b"])

    parts = near.mapInArrow(cut, f"gram bigint, id {kind}, s bigint, n int, raw binary")
    found = [whole, materialize(parts.repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, f"id {kind}, a bigint, b bigint"), "suffix-sorted")]
    if not counts.where("hot").isEmpty():
        w = materialize(near.mapInArrow(windows, f"h1 bigint, h2 bigint, id {kind}, a bigint"), "suffix-windows")
        least = w.groupBy("h1", "h2").agg(F.min(F.struct("id", "a")).alias("first"), F.count("*").alias("c")).where("c > 1").select("h1", "h2", "first")
        gone = w.join(materialize(least, "suffix-least"), ["h1", "h2"]).where(F.struct("id", "a") != F.col("first")).select("id", "a", (F.col("a") + length).alias("b"))
        found.append(materialize(gone, "suffix-hot"))
        discard(w)
    out = materialize(functools.reduce(DataFrame.unionAll, found), "suffix-intervals")
    discard(grams, again, firsts, lists, *found)
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept: the remaining bytes."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    spans = removed_intervals(rows, length).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    spans = materialize(spans, "suffix-spans")
    ids = sized(materialize(spans.select("id"), "suffix-hit"))
    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"

    def apply(batches):
        for batch in batches:
            n, gone, runs, sha, kept = [], [], [], [], []
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            for t, ss in zip(batch.column("text").cast(pa.binary()).to_pylist(), spans):
                at, parts, k, out = 0, [], 0, 0
                for s in ss or ():
                    if s["b"] <= at and k:
                        continue
                    if not k or s["a"] > at:
                        parts.append(t[at : s["a"]])
                        k += 1
                        out += s["b"] - s["a"]
                    else:
                        out += s["b"] - at
                    at = s["b"]
                rest = b"".join([*parts, t[at:]])
                n.append(len(t))
                gone.append(out)
                runs.append(k)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    # Only documents that lose something are shuffled, unless their ids are too many to broadcast (then Catalyst decides).
    hit = rows.join(ids, "id", "left_semi").join(spans, "id").mapInArrow(apply, schema)
    return rows.join(ids, "id", "left_anti").mapInArrow(apply, schema).unionAll(hit)
