"""Shared plumbing: scratch tables (operators/scratch.py), Arrow text buffers, hashes of byte runs, connected components.

Everything works on the UTF-8 bytes of Arrow string buffers, so no Python string is made on the hot paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import discard, materialize, settle, shared_dir  # noqa: F401

U64 = np.uint64
_POW = {"p": np.ones(1, U64), "inv": np.ones(1, U64)}
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    held = {c.lower() for c in df.columns}
    while f"__{name}".lower() in held:
        name += "_"
    return f"__{name}"


def sized(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Broadcast df (a scratch table) only if its rows hold at most `limit` bytes, counted: eight for each column and what
    its strings hold; else leave the join to Catalyst, which shuffles and splits skewed partitions."""
    width = 8 * len(df.columns) * F.count(F.lit(1))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width += F.coalesce(F.sum(F.octet_length(F.col(name))), F.lit(0))
        elif kind not in ("bigint", "int", "double", "boolean", "date", "timestamp"):
            return df
    return F.broadcast(df) if df.agg(width).first()[0] <= limit else df


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]] if len(arr) else data[:0], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes (or one row)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def runs(arr: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of at most `limit` bytes (or one row): only a slice is copied."""
    size = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False)
    for i, j in pieces(np.append(0, np.cumsum(size, dtype=np.int64)), limit):
        yield i, j, *utf8(arr.slice(i, j - i))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        for k, b in (("p", _BASE), ("inv", _BASE_INV)):
            x = np.full(n, b, U64)
            x[0] = 1
            _POW[k] = np.cumprod(x, dtype=U64)
    return _POW["p"], _POW["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run data[start:end]: differences of prefix sums of a polynomial modulo 2**64."""
    p, inv = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * p[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U64))


def word_runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross rows, and the first run of each row (with the total last)."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | cut[1:n]
    last[:-1] &= ~mask[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, comp) of the undirected edges (a, b): comp is the least node reachable. Distributed min-label rounds
    with pointer jumping; each round is written to the shared folder. A hub costs one partial aggregate row per
    task, and the label join is an ordinary equi-join that AQE can split, so a hot node isn't gathered anywhere."""
    both = edges.where("a <> b").select("a", "b").unionAll(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, tag + "-e")
    lab = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("node"), "comp"), tag)
    while True:
        seen = both.join(lab.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("m"))
        hop = lab.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = (
            lab.join(seen.withColumnRenamed("a", "node"), "node")
            .withColumn("best", F.least("comp", "m"))
            .join(hop.withColumnRenamed("comp", "best"), "best", "left")
            .select("node", F.least("best", F.coalesce("up", "best")).alias("comp"), (F.least("best", F.coalesce("up", "best")) < F.col("comp")).alias("moved"))
        )
        new = materialize(new, tag)
        moved = not new.where("moved").isEmpty()
        discard(lab)
        path, lab = new._scratch, new.drop("moved")
        lab._scratch = path
        if not moved:
            discard(both)
            return lab
