"""Exact dedup with counting quotient filters.

A fingerprint of 64 bits splits into a quotient (its high bits: the slot it wants) and a remainder. Each partition
packs its fingerprints into filters, one for each block of quotients; filters of one block merge without loss by
merging their sorted remainders and adding the counts. Only fingerprints counted above one go to the byte
verification, which groups by the text itself.

Edge cases: a null text counts as empty; empty texts are copies of each other; rows repeated with the same id form
one group whose kept id is that id; a row with a null id is a copy like others, kept only where its whole group has
none; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize


def pack(fp: np.ndarray, count: np.ndarray, qbits: int) -> bytes:
    """Fingerprints (sorted, distinct) of one block as a counting quotient filter: a bit for each occupied quotient,
    a bit for each slot that ends a run, the remainders in order, and counts as bytes with escape 255 + int64."""
    q = (fp >> np.uint64(64 - qbits)).astype(np.int64)
    lo = int(q[0]) if len(q) else 0
    occupied = np.zeros(int(q[-1]) - lo + 1 if len(q) else 0, bool)
    occupied[q - lo] = True
    ends = np.append(q[1:] != q[:-1], True)[: len(q)]
    rem = fp & np.uint64((1 << (64 - qbits)) - 1)
    big = count >= 255
    head = np.array([lo, len(occupied), len(fp), int(big.sum())], "<i8")
    return b"".join((head.tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), rem.astype("<u8").tobytes(), np.minimum(count, 255).astype(np.uint8).tobytes(), count[big].astype("<i8").tobytes()))


def unpack(raw: bytes, qbits: int) -> tuple[np.ndarray, np.ndarray]:
    lo, span, n, big = np.frombuffer(raw, "<i8", 4).tolist()
    at = 32
    occupied = np.unpackbits(np.frombuffer(raw, np.uint8, -(-span // 8), at), count=span).astype(bool)
    at += -(-span // 8)
    ends = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(bool)
    at += -(-n // 8)
    rem = np.frombuffer(raw, "<u8", n, at)
    count = np.frombuffer(raw, np.uint8, n, at + 8 * n).astype(np.int64)
    count[count == 255] = np.frombuffer(raw, "<i8", big, at + 9 * n)
    run = np.cumsum(ends) - ends  # the run each slot is in
    q = (np.flatnonzero(occupied) + lo)[run].astype(np.uint64)
    return (q << np.uint64(64 - qbits)) | rem, count


def merge(filters: list[bytes], qbits: int) -> bytes:
    """Lossless: the sorted remainders of two filters at a time run together, counts of equal ones add up."""
    parts = [unpack(f, qbits) for f in filters]
    while len(parts) > 1:
        parts = [run_together(*parts[k], *parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return pack(*parts[0], qbits)


def run_together(fp: np.ndarray, count: np.ndarray, fp2: np.ndarray, count2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct fingerprints as one."""
    at = np.searchsorted(fp, fp2)
    same = np.zeros(len(fp2), bool)
    inside = at < len(fp)
    same[inside] = fp[at[inside]] == fp2[inside]
    count = count.copy()
    count[at[same]] += count2[same]
    return np.insert(fp, at[~same], fp2[~same]), np.insert(count, at[~same], count2[~same])


def add(fp: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(fp, kind="stable")
    fp, count = fp[order], count[order]
    first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])[: len(fp)])
    return fp[first], np.add.reduceat(count, first) if len(first) else count


@F.arrow_udf(T.StructType().add("fp", T.LongType()).add("sha", T.StringType()))
def digests(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for arr in it:
        texts = pc.ascii_lower(pc.fill_null(arr, "")).cast(pa.large_binary())
        fp, sha = np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            raw = t.as_buffer()
            fp[i] = np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64)
            sha.append(hashlib.sha256(raw).hexdigest())
        yield pa.StructArray.from_arrays([pa.array(fp), pa.array(sha, pa.string())], ["fp", "sha"])


@F.arrow_udf(T.StringType())
def ascii_lower(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for arr in it:
        yield pc.ascii_lower(pc.fill_null(arr, ""))


def repeated(fps: DataFrame, n: int, per_block: int = 400_000) -> DataFrame:
    """Fingerprints (fp) that occur more than once among the n rows of fps."""
    bbits = max(4, int(np.ceil(np.log2(max(2, n / per_block)))))
    qbits = min(40, bbits + int(np.ceil(np.log2(per_block))))

    def build(batches):
        held: list[np.ndarray] = []

        def flush():
            fp, c = add(np.concatenate(held), np.ones(sum(map(len, held)), np.int64))
            block = (fp >> np.uint64(64 - bbits)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            ends = np.append(cuts[1:], len(fp))
            yield pa.RecordBatch.from_pydict({"block": pa.array(block[cuts]), "filter": pa.array([pack(fp[a:b], c[a:b], qbits) for a, b in zip(cuts, ends)], pa.binary())})
            held.clear()

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= 1 << 20:
                yield from flush()
        if held and sum(map(len, held)):
            yield from flush()

    def join(table: pa.Table) -> pa.Table:
        fp, c = unpack(merge(table.column("filter").to_pylist(), qbits), qbits)
        return pa.table({"fp": pa.array(fp[c > 1].view(np.int64))})

    return fps.select("fp").mapInArrow(build, "block bigint, filter binary").groupBy("block").applyInArrow(join, "fp bigint")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sha, keep_id, group_size): every row with the kept id (the largest) of its group of equal texts."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    d = digests("text")
    base = materialize(rows.select("id", d.alias("d")).select("id", "d.fp", "d.sha"), "exact-base")
    many = materialize(repeated(base, base.count()), "exact-many")
    routed = rows.select("id", ascii_lower("text").alias("text"), digests("text").alias("d")).select("id", "text", "d.fp", "d.sha").join(many, "fp", "left_semi")
    groups = materialize(routed.groupBy("fp", "sha", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).drop("text"), "exact-groups")
    discard(many)
    return base.join(groups, ["fp", "sha"], "left").select("id", "sha", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
