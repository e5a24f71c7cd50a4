"""N-gram Jaccard join with adaptive multi-match prefixes, up to connected components.

Documents with equal shingle sets are one class. A class's shingles are ordered from rare to frequent by a counting
sketch over all documents. With n shingles and least overlap a = ceil(t n), any partner shares at least l of the
first n - a + l shingles of both, l being the smaller of the two documents' choices. Each class chooses the l (its
prefix's lengthening) with the least estimated cost: posting entries scanned plus verifications, by the sketch.

Components rather than pairs are wanted, so no group is expanded into all its pairs: first each class is verified
against one hub, the least class of its shared prefix shingles, if it shares enough of them; then only pairs from different components that share
the required number of prefix shingles (and can still reach the overlap by position) are verified, exactly, on sets.
Shingles in the prefixes of more than LIGHT classes would give pairs by the square. A pair whose rarest common shingle is
light meets there; how many heavy ones it may share besides is allowed for. Any other pair shares a heavy shingle of both
its shortest prefixes (those for one match) and has like sizes: the classes of a heavy shingle and a band of sizes are
compared in tiles inside a task, by parity bitmaps of BITMAP bits alone, and what passes is verified by whole sets. A tile
gives the CLOSEST pairs of each component, so no more rows than it has members; verified links join components. Tiles that
hold back pairs run again, with more pairs a component each time, until none does: no link is lost, no group is expanded.

Edge cases: null text and text without words have an empty set, linked with nothing (component: own id); fewer words
than k make one shingle; rows repeated with the same id are copies, and an id with several texts joins their components; a
row with a null id belongs to the rows of equal text, and alone stays alone (component: null); an empty table gives an
empty result. Only id and text are read. Shingles are told apart by 64-bit hashes, classes by two independent ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, components, discard, materialize, mix, run_hashes, runs, sized, word_runs

SKETCH, SLICES, MOST = 1 << 18, 16, 8
LIGHT, TILE_ROWS, BITMAP, CLOSEST = 32, 1 << 15, 2048, 2  # a tile's bitmaps take 8 MB
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def shingle_sets(arr: pa.Array, k: int):
    """The sorted distinct shingle hashes of each row, in turn."""
    for _, _, data, offs in runs(arr):
        low = LOWER[data]
        starts, ends, first = word_runs(IS_WORD[low], offs)
        w = run_hashes(low, starts, ends)
        x = w.copy()
        for s in range(1, k):
            x[: len(w) - s] = mix(x[: len(w) - s] * U64(0x9E3779B97F4A7C15) + w[s:])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                yield np.unique(x[a : b - k + 1])
            elif b > a:
                y = U64(b - a) * np.ones(1, U64)
                for s in range(a, b):
                    y = mix(y * U64(0x9E3779B97F4A7C15) + w[s : s + 1])
                yield y
            else:
                yield x[:0]


def class_of(s: np.ndarray, seed: int) -> int:
    return int(mix(s + U64(seed)).sum(dtype=U64).view(np.int64))


def check_of(s: np.ndarray, seed: int) -> int:
    """A second hash of a set, independent of its class."""
    return int(mix(s ^ U64(0xD6E8FEB86659FD93 + seed)).sum(dtype=U64).view(np.int64))


def described(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, n, cls, check, slice, counts): a row for each document, and the task's counting sketch in slices."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches):
        sketch, id_type = np.zeros(SKETCH, np.int64), None
        for batch in batches:
            n, a, b, seen = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                a.append(class_of(s, seed) if len(s) else 0)
                b.append(check_of(s, seed) if len(s) else 0)
                seen.append(s)
            if seen:
                sketch += np.bincount((np.concatenate(seen) >> U64(64 - 18)).astype(np.int64), minlength=SKETCH)
            id_type = batch.schema.field("id").type
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if id_type is not None and sketch.any():
            parts, none = sketch.reshape(SLICES, -1), pa.nulls(SLICES)
            yield pa.RecordBatch.from_arrays([none.cast(id_type), *[none.cast(pa.int64())] * 3, pa.array(range(SLICES), pa.int32()), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary())], names)

    names = ["id", "n", "cls", "check", "slice", "counts"]
    return rows.mapInArrow(work, f"id {kind}, n bigint, cls bigint, check bigint, slice int, counts binary")


def sketch_of(desc: DataFrame) -> np.ndarray:
    """The summed sketch: SKETCH counters, whatever the size of the input."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), "<u4").astype(np.int64) for c in table.column("counts"))
        return pa.table({"slice": table.column("slice")[:1].cast(pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    out = np.zeros((SLICES, SKETCH // SLICES), np.int64)
    for r in desc.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], "<i8")
    return out.ravel()


def prefix_lengths(n: int, est: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost; est: excess counts of the ordered shingles."""
    base = n - -(-num * n // den)
    most = min(MOST, n - base)
    scan = np.cumsum(est[: base + most])[base : base + most] + 1e-9
    ell = np.arange(1, most + 1)
    best = int(np.argmin(scan + n * scan / ell + ell))
    return best + 1, base + best + 1


def prefixes(rows: DataFrame, sketch: np.ndarray, k: int, num: int, den: int, seed: int) -> DataFrame:
    """(token, cls, n, ell, pos) of each class, once a task."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def work(batches):
        sk = shared.value
        rare = np.median(sk)
        rank = np.floor(np.log2(np.maximum(1, sk / max(1.0, rare))) * 4).clip(0, 255).astype(U64) << U64(56)
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for s in shingle_sets(batch.column("text"), k):
                if not len(s) or (c := class_of(s, seed)) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(c)
                slot = (s >> U64(64 - 18)).astype(np.int64)
                # Within a rank the order must be the same everywhere and not follow the slot: a mix of the hash.
                key = rank[slot] | mix(s) >> U64(8)
                longest = min(len(s), len(s) - -(-num * len(s) // den) + MOST)
                order = np.argpartition(key, longest - 1)[:longest] if longest < len(s) else np.arange(len(s))
                order = order[np.argsort(key[order])]
                ell, p = prefix_lengths(len(s), np.maximum(0, sk[slot[order]] - rare), num, den)
                out.append((s[order[:p]].view(np.int64), c, len(s), ell))
            if out:
                size = np.array([len(o[0]) for o in out])
                rep = lambda col, kind: np.repeat(np.array([o[col] for o in out], kind), size)
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(rep(1, np.int64)), pa.array(rep(2, np.int32)), pa.array(rep(3, np.int32)), pa.array(pos.astype(np.int32))], ["token", "cls", "n", "ell", "pos"])

    return rows.select("text").mapInArrow(work, "token bigint, cls bigint, n int, ell int, pos int")


def bitmaps(need: DataFrame, rows: DataFrame, k: int, seed: int) -> DataFrame:
    """(cls, bits): for the classes in need (cls, rep), which of BITMAP slots hold an odd number of their shingles."""

    def work(batches):
        for batch in batches:
            out, own = [], []
            for c, s in zip(batch.column("cls").to_pylist(), shingle_sets(batch.column("text"), k)):
                own.append(class_of(s, seed) == c)
                odd = np.bincount((s & U64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1
                out.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(out, pa.binary())], ["cls", "bits"]).filter(pa.array(own, pa.bool_()))

    texts = rows.join(sized(need.select("rep", "cls")), F.col("id") == F.col("rep")).select("cls", "text")
    return materialize(texts.mapInArrow(work, "cls bigint, bits binary").dropDuplicates(["cls"]), "ngram-bits")


def tile_pairs(cls: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], num: int, den: int, most: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of left x right, for each two sides, of different components that may be alike: the `most` closest of each
    component; and whether that is all."""
    got = [np.zeros((0, 5), np.int64)]
    for left, right in sides:
        step = max(1, (1 << 20) // max(1, len(right) * bits.shape[1]))
        for a in range(0, len(left) if len(right) else 0, step):
            rows = left[a : a + step]
            # The parity bitmaps differ in no more bits than the sets differ in shingles.
            apart = np.bitwise_count(bits[rows][:, None, :] ^ bits[right][None, :, :]).sum(2, dtype=np.int64)
            near = (apart * (den + num) <= (n[rows][:, None] + n[right][None, :]) * (den - num)) & (comp[rows][:, None] != comp[right][None, :])
            x, y = np.nonzero(near)
            i, j = rows[x], right[y]
            got.append(np.stack([comp[i], comp[j], apart[x, y], np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], 1))
    pairs = np.concatenate(got)
    keep = np.zeros(len(pairs), bool)
    for side in (0, 1) if len(pairs) else ():
        order = np.lexsort((pairs[:, 4], pairs[:, 3], pairs[:, 2], pairs[:, side]))
        own = pairs[order, side]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        keep[order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < most]] = True
    return sorted({(int(a), int(b)) for a, b in pairs[keep, 3:]}), bool(keep.all())


TILE = ["token", "band", "i", "j"]


def tile(num: int, den: int, most: int):
    """tile_pairs() on the rows of one tile: (token, band, i, j, a, b); a null pair says that some were held back."""

    def pairs(table: pa.Table) -> pa.Table:
        cls, comp, n, blk, own = (table.column(c).to_numpy() for c in ("cls", "comp", "n", "blk", "own"))
        words = np.frombuffer(b"".join(table.column("bits").to_pylist()), U64).reshape(-1, BITMAP // 64)
        at = {c: table.column(c)[0].as_py() for c in TILE}
        # Classes of the band below meet each other there: here a pair has one class at least of this band.
        mine, other = np.flatnonzero((blk == at["i"]) & own), np.flatnonzero(blk == at["j"])
        sides = [(mine, other)]
        if at["i"] != at["j"]:
            sides.append((np.flatnonzero((blk == at["i"]) & ~own), np.flatnonzero((blk == at["j"]) & own)))
        got, whole = tile_pairs(cls, comp, n, words, sides, num, den, most)
        rows = got if whole else [*got, (None, None)]
        keys = {c: pa.array([v] * len(rows), pa.int64() if c == "token" else pa.int32()) for c, v in at.items()}
        return pa.table({**keys, "a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})

    return pairs


def heavy_links(heavy: DataFrame, links: DataFrame, rows: DataFrame, reps: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame:
    """Links (a, b) among the classes of heavy shingles (token, cls, n, pos, comp), beyond those given."""
    x = heavy.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * num / den))
    x = x.select("token", "cls", "n", "comp", F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num * 1.0001))).cast("int").alias("band"))
    # Sizes of a pair lie in one band or two neighbours: each class stands in its own and in the next.
    x = x.withColumn("b", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") + F.col("b")).withColumn("own", F.col("b") == 0).drop("b")
    x = materialize(x, "ngram-heavy")
    size = x.groupBy("token", "band").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("blocks"), F.min("cls").alias("c0"), F.max("cls").alias("c1")).where("c0 <> c1").drop("c0", "c1")
    x = materialize(x.join(size, ["token", "band"]).withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")), "ngram-members")
    bits = bitmaps(x.select("cls").distinct().join(reps.select("cls", "rep"), "cls"), rows, k, seed)
    # Only what is too large for one tile is cut into blocks, each member then standing in a tile for each block.
    whole, cut = x.where("blocks = 1").withColumn("o", F.lit(0)), x.where("blocks > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = whole.unionByName(cut).select("token", "band", "cls", "n", "blk", "own", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
    found, tried, most = links.limit(0), links.limit(0), CLOSEST
    while True:
        comp = components(links.unionAll(found), "ngram-cc").withColumnRenamed("node", "cls")
        held = tiles.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).join(bits, "cls")
        got = materialize(held.groupBy(*TILE).applyInArrow(tile(num, den, most), "token bigint, band int, i int, j int, a bigint, b bigint"), "ngram-tiles")
        fresh = materialize(got.where("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
        found = materialize(found.unionAll(verified(fresh, rows, reps, k, num, den, seed)), "ngram-found")
        tried, most = materialize(tried.unionAll(fresh), "ngram-tried"), most * 8
        more = materialize(got.where("a is null").select(*TILE), "ngram-open")
        discard(got, fresh)
        if more.isEmpty():
            discard(x, bits, tried)
            return found
        tiles = tiles.join(more, TILE, "left_semi")


def verified(pairs: DataFrame, rows: DataFrame, reps: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame:
    """The pairs (a, b) of classes whose Jaccard similarity is at least num / den, by whole sets."""

    def judge(batches):
        for batch in batches:
            near = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), shingle_sets(batch.column("ta"), k), shingle_sets(batch.column("tb"), k)):
                n = len(np.intersect1d(x, y, assume_unique=True))
                # An id may have several texts: only those of the two classes count.
                near.append(den * n >= num * (len(x) + len(y) - n) and class_of(x, seed) == a and class_of(y, seed) == b)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    # Texts, which shuffle in less room than their sets, meet in one shuffle, by a.
    left = materialize(pairs.select("a").distinct().join(reps.select(F.col("cls").alias("a"), "rep"), "a"), "ngram-left")
    right = materialize(pairs.join(reps.select(F.col("cls").alias("b"), "rep"), "b").select("a", "b", "rep"), "ngram-right")
    one = rows.join(sized(left), F.col("id") == F.col("rep")).select("a", F.col("text").alias("ta"))
    two = rows.join(sized(right), F.col("id") == F.col("rep")).select("a", "b", F.col("text").alias("tb"))
    out = materialize(two.join(one, "a").select("a", "b", "ta", "tb").mapInArrow(judge, "a bigint, b bigint").distinct(), "ngram-links")
    discard(left, right)
    return out


def candidates(met: DataFrame, a: str, b: str, num: int, den: int, spare: Column) -> DataFrame:
    """(a, b, c) of the pairs of classes that share c prefix shingles, of rows (a, b, n, n2, ell, ell2, pos, pos2), one for
    each shared shingle: those of like size that share as many as the lesser of their choices, and whose texts can
    still share enough behind the last shared position. spare: how many shingles they may share besides."""
    least = lambda x: F.ceil(F.col(x) * num / den)
    return (
        met.where(den * F.least("n", "n2") >= num * F.greatest("n", "n2"))
        .groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
        .agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("n", "n2", "ell", "ell2")], F.max("pos").alias("p"), F.max("pos2").alias("p2"), F.max(spare).alias("spare"))
        .where(F.col("c") + F.col("spare") >= F.least("ell", "ell2"))
        .where(F.col("c") + F.col("spare") + F.least(F.col("n") - F.col("p") - 1, F.col("n2") - F.col("p2") - 1) >= F.greatest(least("n"), least("n2")))
        .select("a", "b", "c")
    )


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) of every row; links: den * intersection >= num * union."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    for seed in range(8):  # a second seed is needed only if two sets share a 64-bit class hash
        desc = materialize(described(rows, k, seed), "ngram-docs")
        reps = materialize(desc.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.min("check").alias("c0"), F.max("check").alias("c1")), "ngram-classes")
        if reps.where("c0 <> c1").isEmpty():
            break
    post = prefixes(rows, sketch_of(desc), k, num, den, seed)
    # Most prefix shingles are of one class alone and end here.
    hubs = post.groupBy("token").agg(F.min("cls").alias("hub"), F.max("cls").alias("other")).where("hub <> other").select("token", "hub")
    hubs = materialize(hubs, "ngram-hubs")
    post = materialize(post.join(hubs, "token").distinct(), "ngram-postings")
    of_hub = post.where("cls = hub").select("token", *[F.col(c).alias(c + "2") for c in ("n", "ell", "pos")])
    star = candidates(post.where("cls <> hub").join(of_hub, "token"), "cls", "hub", num, den, F.lit(0)).groupBy("a").agg(F.max(F.struct("c", "b")).alias("m"))
    star = materialize(star.select(F.col("m.b").alias("a"), F.col("a").alias("b")), "ngram-star")
    discard(hubs)
    links = verified(star, rows, reps, k, num, den, seed)
    comp = components(links, "ngram-cc")
    held = post.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("token", "cls", "n", "ell", "pos", F.coalesce("comp", "cls").alias("comp"))
    held = materialize(held, "ngram-held")
    discard(post)
    del post
    mixed = held.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).where("c0 <> c1").select("token", (F.col("m") > LIGHT).alias("heavy"))
    posted = materialize(held.join(mixed, "token"), "ngram-mixed")
    discard(held)
    del held, mixed
    heavy = posted.where("heavy")
    cross = posted.where("not heavy").join(heavy.groupBy("cls").agg(F.count("*").alias("h")), "cls", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    cross = materialize(cross.select("token", "cls", "n", "ell", "pos", "comp", "h"), "ngram-cross")
    other = cross.select("token", *[F.col(c).alias(c + "2") for c in ("cls", "n", "ell", "pos", "comp", "h")])
    pairs = candidates(cross.join(other, "token").where("comp < comp2"), "cls", "cls2", num, den, F.least("h", "h2"))
    pairs = materialize(pairs.select("a", "b"), "ngram-pairs")
    discard(cross)
    links = materialize(links.unionAll(verified(pairs, rows, reps, k, num, den, seed)), "ngram-light")
    if not heavy.isEmpty():
        links = materialize(links.unionAll(heavy_links(heavy, links, rows, reps, k, num, den, seed)), "ngram-all")
    discard(posted, pairs)
    whole = components(links, "ngram-cc")
    named = reps.join(whole.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
    least_id = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(least_id, "comp").select("cls", "component_id"), "ngram-named")
    out = desc.where("slice is null").join(named, (F.col("n") > 0) & (desc["cls"] == named["cls"]), "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    discard(reps, links, whole)
    out._inputs = [desc, named]  # scratch tables that the result reads: for a caller who writes it
    return out
