"""Token-ID output: tokenize whole texts and write them, in ascending id order, as range-coded segments.

A segment holds some two million ids of whole documents and the index of those documents; a file is a table of
segments in the shared folder (one row each), so any store that Spark writes can hold it. Reading back needs no
shuffle: each segment is decoded where its row is read, and offsets come from a running sum over segments.

Texts are tokenized by pieces where the tokenizer has the byte-level splitter and no normalizer (its file says so): a
boundary before blanks is always a token boundary of that splitter, so the ids of a text are the ids of its pieces put
together, and pieces repeat; so is one between an ASCII letter or digit and a sign. Texts with other white space, or
holding one of the tokenizer's added tokens, are encoded whole; so are all texts of any other tokenizer. A worker keeps
the pieces of late in two generations of CACHE bytes each.

Edge cases: null text is empty and has the end id only; rows repeated with one id are written one after the other; an
empty table writes no segment; null ids come first. Only id and text are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, runs, settle, utf8
from .rangecoder import decode, encode

SEGMENT = 2_000_000
CHUNK = 1 << 22  # bytes of text tokenized at a time (or one text)
SPACES = r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CACHE = 40 << 20  # bytes of a generation of pieces kept by a worker, counted as ENTRY each: they are words
ENTRY = 200
LONG = 64  # longer pieces aren't kept
BLANK, WORD, SIGN = 1, 2, 3  # kinds of bytes: blanks; ASCII letters and digits; other printing ASCII
KIND = np.zeros(256, np.uint8)
KIND[[32, 9, 10, 13]] = BLANK
for c in range(33, 127):
    KIND[c] = WORD if chr(c).isalnum() else SIGN
BLANKS = b" \t\n\r"
_ENCODERS: dict = {}  # of this worker, so that its next task finds the cache filled


class Encoder:
    """Texts to ids by cached pieces."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.end, self.cache, self.before, self.held = Tokenizer.from_file(path), end_id, {}, {}, 0
        spec = json.loads(self.tok.to_str())
        cut = spec.get("pre_tokenizer") or {}
        self.by_pieces = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.odd = "|".join([SPACES, *(re.escape(t) for t in added)])
        # Only texts that hold one of these bytes can be odd: leads of other white space, first bytes of added tokens.
        self.suspect = np.zeros(256, bool)
        self.suspect[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, *(t.encode()[0] for t in added if t)]] = True
        names = self.tok.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():  # a byte-level token has a character for each byte
            self.bytes_of[i] = len(name)

    def learn(self, new: list[bytes], odd: set[bytes]) -> list[bytes]:
        """The ids of new pieces. Those of a blank and a word are joined, encoded together and told apart by the tokens'
        lengths; the others are encoded one by one."""
        by = self.by_pieces
        plain = [by and p[0] in BLANKS and p[-1] not in BLANKS and p not in odd for p in new]
        joint, alone, got = [p for p, x in zip(new, plain) if x], [k for k, x in enumerate(plain) if not x], []
        for i in range(0, len(joint), 20_000):
            groups = [joint[k : k + 500] for k in range(i, min(i + 20_000, len(joint)), 500)]
            texts = [b"".join(g).decode() for g in groups]
            for g, e in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                ends = np.cumsum(np.fromiter(map(len, g), np.int64, len(g)))
                at = np.cumsum(self.bytes_of.take(ids, mode="clip"))
                cut = np.searchsorted(at, ends)
                if len(at) and cut[-1] == len(at) - 1 and (at[cut] == ends).all():
                    raw, cut = ids.tobytes(), [0, *(4 * (cut + 1)).tolist()]
                    got += [raw[x:y] for x, y in zip(cut, cut[1:])]
                else:  # a tokenizer whose tokens don't spell the bytes
                    got += self.one_by_one(g)
        if not alone:
            return got
        out, rest = iter(got), iter(self.one_by_one([new[k] for k in alone]))
        return [next(out) if x else next(rest) for x in plain]

    def one_by_one(self, pieces: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for i in range(0, len(pieces), 10_000) for e in self.tok.encode_batch_fast([p.decode() for p in pieces[i : i + 10_000]], add_special_tokens=False)]

    def ids_of(self, names: list[bytes], odd: set[bytes]) -> list[bytes]:
        """Ids of different pieces, from the two generations of the cache or made now."""
        if self.held > CACHE:  # odd texts are pieces too, but never stay
            self.before, self.cache, self.held = self.cache, {}, 0
        own = list(map(self.cache.get, names))
        lack = [k for k, o in enumerate(own) if o is None]
        again = [names[k] for k in lack]
        late = list(map(self.before.get, again))
        new = [p for p, o in zip(again, late) if o is None]
        if new:
            made = iter(self.learn(new, odd))
            late = [next(made) if o is None else o for o in late]
        for k, o in zip(lack, late):
            own[k] = o
        self.cache.update((p, o) for p, o in zip(again, late) if len(p) <= LONG)
        self.held += ENTRY * len(again)
        return own

    def pieces_of(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, set[bytes]]:
        """The pieces of the texts as one array, the first piece of each text (with the total last), and the odd texts: a
        piece is a run of blanks and the word after it, cut where a sign follows an ASCII letter or digit. An odd text is
        one piece."""
        data, offs = utf8(texts)
        cut = np.zeros(len(data) + 1, bool)
        odd = set()
        if self.by_pieces and len(data):
            kind = KIND.take(data)
            cut[1:-1] = (kind[1:] == BLANK) & (kind[:-1] != BLANK) | (kind[:-1] == WORD) & (kind[1:] == SIGN)
            rows = np.unique(np.searchsorted(offs, np.flatnonzero(self.suspect.take(data)), "right") - 1)
            if len(rows):
                hit = pc.match_substring_regex(texts.take(pa.array(rows)), self.odd).to_numpy(zero_copy_only=False)
                for i in rows[hit.astype(bool)]:
                    cut[offs[i] : offs[i + 1]] = False
                    odd.add(data[offs[i] : offs[i + 1]].tobytes())
        cut[offs] = True
        at = np.flatnonzero(cut)
        if len(at) < 2:  # no text at all
            return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64), odd
        arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        return arr, np.searchsorted(at, offs), odd

    def chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; how many each text has)."""
        arr, first, odd = self.pieces_of(texts)
        coded = arr.dictionary_encode()
        names = []
        if len(coded.dictionary):
            at = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
            own = coded.dictionary.buffers()[2].to_pybytes()
            names = [own[a:b] for a, b in zip(at, at[1:])]
        own = self.ids_of(names, odd)
        flat = np.append(np.frombuffer(b"".join(own), "<u4"), np.uint32(self.end))
        width = np.fromiter(map(len, own), np.int64, len(own)) // 4
        start = np.cumsum(width) - width
        # The end id of each text is one more piece behind its own.
        which = coded.indices.to_numpy()
        ends = first[1:]
        width = np.insert(width.take(which), ends, 1)
        start = np.insert(start.take(which), ends, len(flat) - 1)
        done = np.append(0, np.cumsum(width))
        ids = flat.take(np.repeat(start - done[:-1], width) + np.arange(done[-1]))
        return ids, np.diff(done[np.append(0, ends + np.arange(1, len(ends) + 1))])


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token file; returns its table: (file, segment, n_ids, data)."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("file", F.spark_partition_id())

    def work(batches):
        enc, ids, sizes, keys, seg, file, held = encoder(tokenizer, end_id), [], [], [], 0, 0, 0

        def segment():
            flat, key, size = np.concatenate(ids), pa.concat_arrays(keys), np.concatenate(sizes)
            index = zlib.compress(key.fill_null(0).to_numpy().astype("<i8").tobytes() + size.astype("<u4").tobytes() + key.is_null().to_numpy(zero_copy_only=False).tobytes(), 1)
            data = struct.pack("<II", len(size), len(index)) + index + encode(flat)
            ids.clear(), sizes.clear(), keys.clear()
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "segment": pa.array([seg], pa.int32()), "n_ids": pa.array([len(flat)], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            file = batch.column("file")[0].as_py()
            text, key = batch.column("text"), batch.column("id").cast(pa.int64())
            for i, j, _, _ in runs(text, CHUNK):
                flat, size = enc.chunk(text.slice(i, j - i))
                ids.append(flat), sizes.append(size), keys.append(key.slice(i, j - i))
                held += len(flat)
                if held >= SEGMENT:
                    yield segment()
                    seg, held = seg + 1, 0
        if keys:
            yield segment()

    return materialize(rows.mapInArrow(work, "file int, segment int, n_ids bigint, data binary"), "tokens")


def read_tokens(table: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the file alone."""
    settle(table.sparkSession)
    heads = table.select("file", "segment", "n_ids")
    by = Window.orderBy("file", "segment").rowsBetween(Window.unboundedPreceding, -1)
    heads = materialize(heads.withColumn("base", F.coalesce(F.sum("n_ids").over(by), F.lit(0))).select("file", "segment", "base"), "token-bases")

    def work(batches):
        for batch in batches:
            for file, seg, data in zip(*(batch.column(c).to_pylist() for c in ("file", "segment", "data"))):
                n, size = struct.unpack_from("<II", data)
                index = zlib.decompress(data[8 : 8 + size])
                ids = decode(data[8 + size :]).astype("<u4")
                sizes = np.frombuffer(index, "<u4", n, 8 * n).astype(np.int64)
                none = np.frombuffer(index, bool, n, 12 * n)
                ends = np.cumsum(sizes)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * n, pa.int32()), "segment": pa.array([seg] * n, pa.int32()), "id": pa.array(np.frombuffer(index, "<i8", n), mask=none), "at": pa.array(ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64())})

    docs = table.mapInArrow(work, "file int, segment int, id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(heads, ["file", "segment"]).select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
