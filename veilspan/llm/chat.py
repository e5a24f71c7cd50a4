"""Chat formatting with cumulative-snapshot collapse.

Logs hold the same conversation again and again, each time some turns longer. A hash chained over the turns names
every prefix of a conversation; a conversation whose own hash is a proper prefix of another's is dropped by an
anti-join, of equal ones the least id stays, and the maximal conversations are rendered.

Edge cases: null role or text counts as empty; turns with equal number are ordered by role, then text; rows with a
null id form one conversation with a null id; an empty table gives an empty result. A conversation streams through
the hash; only rendering holds a whole one, which is its output value. Only id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, n, h, last): the chained hash after each turn. turns: conv, turn, role, text."""

    def chain(batches):
        held, conv, n, h = None, object(), 0, b""
        for batch in batches:
            out: list[tuple] = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "text"))):
                if held and held[0] != c:
                    out.append((*held, True))
                elif held:
                    out.append((*held, False))
                if not held or held[0] != c:
                    n, h = 0, b""
                role, text = role.encode(), text.encode()
                n, h = n + 1, hashlib.blake2b(h + len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()
                held = (c, n, h)
            if out:
                yield rows(out, batch.schema.field("conv").type)
                kind = batch.schema.field("conv").type
            kind = batch.schema.field("conv").type
        if held:
            yield rows([(*held, True)], kind)

    def rows(out, kind):
        a = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a[0], kind), pa.array(a[1], pa.int64()), pa.array(a[2], pa.binary()), pa.array(a[3])], ["conv", "n", "h", "last"])

    kind = turns.schema["conv"].dataType.simpleString()
    return turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(chain, f"conv {kind}, n bigint, h binary, last boolean")


def maximal(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, kept): the turns read, and (conv, n, copies) of the maximal conversations."""
    blank = F.lit("")
    turns = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text"))
    p = materialize(prefixes(turns), "chat-prefix")
    ends = p.where("last").groupBy("h", "n").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    kept = materialize(ends.join(p.where("not last").select("h").distinct(), "h", "left_anti").select("conv", "n", "copies"), "chat-kept")
    discard(p)
    return turns, kept


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv, n, copies, rendered): role headers and turn ends as in a chat template."""
    mine = turns.join(kept.withColumnRenamed("conv", "kc"), F.col("conv").eqNullSafe(F.col("kc"))).drop("kc")
    one = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    joined = F.array_join(F.transform(one, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")
    return mine.groupBy("conv", "n", "copies").agg(joined.alias("rendered"))
