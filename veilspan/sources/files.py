"""Files in and out: folders, archives, encodings, office documents, sealed mappings, run files.

Readers go through Spark's own sources, so any store that Spark reads will do; bytes become text in Arrow functions of one
file each. Edge cases: an empty file is an empty text; bytes of no known encoding, broken archives and documents give null
text, which the caller tells by `kind`; names repeated in one archive are kept apart by their place in it.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import display_width

# The extensions that an import takes, and what a file may begin with.
EXTENSIONS = ("txt", "md", "docx", "pdf", "png", "jpg", "jpeg")
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "pdf": "25504446", "zip": "504B0304"}


def read_folder(spark: SparkSession, path: str, most: int = 200, most_bytes: int = 500 << 20) -> DataFrame:
    """(path, bytes, modified, content) of a folder's files, subfolders too, in order of their paths; hidden ones and
    other extensions are left out. Raises if they are more or larger than allowed: sizes come from the listing alone."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    x = x.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*EXTENSIONS) & ~F.col("path").rlike(r"/\.[^/]*(?:/|$)"))
    n, size = x.agg(F.count("path"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n > most or size > most_bytes:
        raise ValueError(f"{n} files of {size} bytes: {most} of {most_bytes} are allowed")
    return x.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content").orderBy("path")


def sniffed(content: Column, path: Column) -> Column:
    """The kind of a file by its first bytes, else by its extension."""
    head, kind = F.hex(F.substring(content, 1, 8)), F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    out = F.when(kind == "jpg", "jpeg").otherwise(kind)
    for name, magic in MAGIC.items():
        hit = head.startswith(magic)
        out = F.when(hit & ((kind == "docx") if name == "zip" else F.lit(False)), "docx").when(hit, name).otherwise(out)
    return out


# --- encodings ----------------------------------------------------------------------------------------------------

BOMS = ((b"\xff\xfe\x00\x00", "utf-32-le", 4), (b"\x00\x00\xfe\xff", "utf-32-be", 4), (b"\xef\xbb\xbf", "utf-8", 1), (b"\xff\xfe", "utf-16-le", 2), (b"\xfe\xff", "utf-16-be", 2))


def tried(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except (UnicodeDecodeError, LookupError):
        return None


def plausible(text: str) -> bool:
    """Assigned characters, no controls but blanks, and mostly of one script's common blocks."""
    if not text or any(unicodedata.category(ch) in ("Cc", "Cn", "Co", "Cs") and ch not in "\t\n\r\f" for ch in text):
        return False
    common = sum(ch.isascii() or "À" <= ch <= "ӿ" or "　" <= ch <= "ヿ" or "一" <= ch <= "鿿" or "가" <= ch <= "힣" or "＀" <= ch <= "￯" or " " <= ch <= "⁯" for ch in text)
    return common >= 0.9 * len(text)


def common_share(text: str, encoding: str) -> float:
    """Share of the wide characters that lie in the block of common ones of a national set: its first level."""
    wide = [ch for ch in text if ord(ch) > 0x7F]
    if not wide:
        return 0.0

    def common(ch: str) -> bool:
        raw = ch.encode(encoding, "ignore")
        if len(raw) != 2:
            return False
        if encoding == "gb18030":
            return 0xB0 <= raw[0] <= 0xD7 and raw[1] >= 0xA1 or 0xA1 <= raw[0] <= 0xA3
        if encoding == "big5hkscs":
            return 0xA4 <= raw[0] <= 0xC6 or 0xA1 <= raw[0] <= 0xA3
        return 0xB0 <= raw[0] <= 0xC8 and raw[1] >= 0xA1 or 0xA1 <= raw[0] <= 0xA3

    return sum(map(common, wide)) / len(wide)


def western(text: str) -> bool:
    """At most three in ten characters beyond ASCII, never more than three together, letters mostly."""
    far = [ch for ch in text if ord(ch) > 0x7F]
    runs = re.findall(r"[^\x00-\x7f]+", text)
    controls = any(unicodedata.category(ch) == "Cc" and ch not in "\t\n\r\f" for ch in text)
    return not controls and len(far) <= 0.3 * len(text) and all(len(r) <= 3 for r in runs)


def decoded(raw: bytes | None) -> str | None:
    """A byte order mark decides; then strict UTF-8 without NUL; plausible UTF-16; GB18030, Big5 or CP949 by the share
    of common characters, 0.6 at least; Windows-1252 or Latin-1 if plausibly western; else null."""
    if raw is None:
        return None
    for mark, encoding, unit in BOMS:
        if raw.startswith(mark):
            return tried(raw[len(mark) :], encoding) if len(raw) % unit == 0 else None
    utf8 = tried(raw, "utf-8")
    if utf8 is not None and "\0" not in utf8:
        return utf8
    if len(raw) % 2 == 0:
        for encoding in ("utf-16-le", "utf-16-be"):
            text = tried(raw, encoding)
            if text is not None and plausible(text):
                return text
    if utf8 is not None:
        return utf8
    shares = [(common_share(t, e), k, t) for k, e in enumerate(("gb18030", "big5hkscs", "cp949")) if (t := tried(raw, e)) is not None]
    best = max(shares, key=lambda s: (s[0], -s[1]), default=(0.0, 0, ""))
    # Korean text is Hangul syllables; their codes are common characters of the Chinese sets too.
    korean = next((t for _, k, t in shares if k == 2), None)
    if korean and sum("가" <= ch <= "힣" for ch in korean) >= 0.9 * max(1, sum(ord(ch) > 0x7F for ch in korean)):
        return korean
    if best[0] >= 0.6:
        return best[2]
    for encoding in ("cp1252", "latin-1"):
        text = tried(raw, encoding)
        if text is not None and western(text):
            return text
    return None


@F.arrow_udf(T.StringType())
def decode(content: pa.Array) -> pa.Array:
    """S02 as a column."""
    return pa.array([decoded(v) for v in content.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def decode_utf8_or_gbk(content: pa.Array) -> pa.Array:
    """UTF-8, else GBK, else null."""
    return pa.array([None if v is None else t if (t := tried(v, "utf-8-sig")) is not None else tried(v, "gbk") for v in content.to_pylist()], pa.string())


def imported(text: Column) -> Column:
    """Without a byte order mark, with LF line ends."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


# --- office documents and archives --------------------------------------------------------------------------------

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")


def docx_text(raw: bytes | None) -> str | None:
    """The text runs of word/document.xml, a paragraph a line; tabs and breaks as such."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = []
    for p in root.iter(W + "p"):
        lines.append("".join(e.text or "" if e.tag == W + "t" else "\t" if e.tag == W + "tab" else "\n" if e.tag in (W + "br", W + "cr") else "" for e in p.iter()))
    return "\n".join(lines)


def docx_bytes(text: str | None) -> bytes:
    """A minimal document, a paragraph a line; characters that XML can't hold are dropped."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in NOT_XML.sub("", (text or "").replace("\r\n", "\n").replace("\r", "\n")).split("\n"))
    parts = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in parts.items():
            z.writestr(zipfile.ZipInfo(name), part)
    return out.getvalue()


@F.arrow_udf(T.StringType())
def read_docx(content: pa.Array) -> pa.Array:
    return pa.array([docx_text(v) for v in content.to_pylist()], pa.string())


@F.arrow_udf(T.BinaryType())
def write_docx(texts: pa.Array) -> pa.Array:
    return pa.array([docx_bytes(v) for v in texts.to_pylist()], pa.binary())


def unpacked(raw: bytes | None, entries: int, size: int, depth: int = 2, prefix: str = "") -> tuple[list[tuple[str, bytes]], str | None]:
    """(path, bytes) of an archive's files, archives in it too, under one budget of entries and inflated bytes; a problem
    where the budget is passed or the archive is broken. Folders and hidden names are left out."""
    out: list[tuple[str, bytes]] = []
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            for info in z.infolist():
                if info.is_dir() or any(p.startswith(".") or p == "__MACOSX" for p in info.filename.split("/")):
                    continue
                entries -= 1
                size -= info.file_size
                if entries < 0 or size < 0:
                    return out, "over budget"
                with z.open(info) as f:
                    data = f.read(info.file_size + 1)
                if len(data) != info.file_size:
                    return out, "size differs"
                if info.filename.lower().endswith(".zip") and depth > 0:
                    inner, problem = unpacked(data, entries, size, depth - 1, f"{prefix}{info.filename}/")
                    out += inner
                    entries -= len(inner)
                    size -= sum(len(b) for _, b in inner)
                    if problem:
                        return out, problem
                else:
                    out.append((prefix + info.filename, data))
    except (zipfile.BadZipFile, zipfile.LargeZipFile, RuntimeError, NotImplementedError, EOFError):
        return out, "broken"
    return out, None


def expand_archives(files: DataFrame, key: str = "path", content: str = "content", entries: int = 1_000, size: int = 500 << 20) -> DataFrame:
    """(key, place, name, content, problem) of the archives' files; a broken or too large one gives a last row with the
    problem alone."""

    def run(batches):
        for batch in batches:
            for i, raw in enumerate(batch.column(1).to_pylist()):
                got, problem = unpacked(raw, entries, size)
                rows = [(n, b, None) for n, b in got] + ([(None, None, problem)] if problem else [])
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows), pa.int64())), pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], [key, "place", "name", "content", "problem"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"{key} {kind}, place int, name string, content binary, problem string")


# --- pages --------------------------------------------------------------------------------------------------------


def spliced_pages(pages: DataFrame, ocr: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): pages (key, page, text) in order, an empty one replaced by its recognized text, a blank line between."""
    x = pages.join(ocr.select(key, "page", F.col("text").alias("__o")), [key, "page"], "left")
    text = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.col("__o")).otherwise(F.col("text"))
    return x.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce(text, F.lit("")).alias("t")))), lambda p: p["t"]), "\n\n").alias("text"))


def repaired(text: Column) -> Column:
    """A stray U+00C2 before a blank goes; no-break blanks are blanks."""
    return F.replace(F.replace(F.replace(text, F.lit("Â\xa0"), F.lit(" ")), F.lit("Â "), F.lit(" ")), F.lit("\xa0"), F.lit(" "))


def reflow(pages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with soft line ends undone. A page's measure is its upper-quartile line width; with three
    full lines and 24 columns at least, a line that reaches it (less 6 % or four columns) goes on in the next unless that is
    blank, indented or a heading; nothing joins them behind CJK, a hyphen or inside a URL, else a blank."""
    lines = pages.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("i", "line")).withColumn("w", display_width(F.rtrim("line")))
    by = Window.partitionBy(key)
    falling = F.row_number().over(by.orderBy(F.desc("w"), "i"))
    x = lines.withColumn("filled", F.trim("line") != "").withColumn("n", F.count_if("filled").over(by)).withColumn("rank", falling)
    x = x.withColumn("measure", F.max(F.when(F.col("rank") == F.floor((F.col("n") - 1) / 4) + 1, F.col("w"))).over(by))
    full = F.col("w") >= F.col("measure") - F.greatest(F.lit(4), F.floor(F.col("measure") * 0.06))
    x = x.withColumn("full", F.coalesce(full, F.lit(False))).withColumn("n_full", F.count_if("full").over(by))
    order = by.orderBy("i")
    nxt = F.lead("line").over(order)
    heading = nxt.rlike(r"^(?:#|第[一二三四五六七八九十0-9]+[章节条]|[0-9]+(?:\.[0-9]+)*[.)、]\s|[A-Z][A-Z \d]{2,60}$|[-*•]\s)")
    joins = F.col("full") & (F.col("n_full") >= 3) & (F.col("measure") >= 24) & (F.trim("line") != "") & nxt.isNotNull() & (F.trim(nxt) != "") & ~nxt.rlike(r"^[\s　]") & ~heading
    tight = F.rtrim("line").rlike("[\\x{3000}-\\x{303F}\\x{3400}-\\x{9FFF}\\x{FF00}-\\x{FFEF}-]$") & (nxt.rlike("^[\\x{3000}-\\x{303F}\\x{3400}-\\x{9FFF}\\x{FF00}-\\x{FFEF}]") | F.rtrim("line").endswith("-")) | F.col("line").rlike(r"https?://\S+$")
    x = x.withColumn("end", F.when(nxt.isNull(), "").when(F.coalesce(joins, F.lit(False)), F.when(tight, "").otherwise(" ")).otherwise("\n"))
    piece = F.concat(F.when(F.col("end").isin("", " ") & nxt.isNotNull(), F.rtrim("line")).otherwise(F.col("line")), F.col("end"))
    x = x.withColumn("piece", piece)
    return x.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda p: p["piece"]), "").alias("text"))


# --- handoffs, mappings, runs -------------------------------------------------------------------------------------

PREAMBLE = "> Placeholders such as {PERSON_1} stand for protected values; keep them as they are.\n\n"


def handoff(text: Column, style: Column, preamble: str = PREAMBLE) -> Column:
    """The token style gets a line of explanation, others are handed over as they are."""
    return F.concat(F.when(style == "token", F.lit(preamble)).otherwise(""), text)


def seal_mapping(mapping: DataFrame, key: Column, scope: str, header: str = "mapping/1") -> DataFrame:
    """(scope, header, sealed): a scope's entries as JSON under AES-GCM, the header authenticated with it. key: 16, 24 or
    32 bytes; deriving one from a passphrase is the caller's."""
    rows = F.to_json(F.array_sort(F.collect_list(F.struct("token", "surface", "type"))))
    return mapping.groupBy(scope).agg(rows.alias("json")).select(scope, F.lit(header).alias("header"), F.aes_encrypt(F.col("json"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.lit(header).cast("binary")).alias("sealed"))


def open_mapping(sealed: DataFrame, key: Column, scope: str) -> DataFrame:
    """The entries back; a wrong key, header or byte fails the job."""
    plain = F.aes_decrypt(F.col("sealed"), key, F.lit("GCM"), F.lit("DEFAULT"), F.col("header").cast("binary")).cast("string")
    return sealed.select(scope, F.inline(F.from_json(plain, "array<struct<token string, surface string, type string>>")))


def save_mapping(mapping: DataFrame, path: str) -> None:
    """One JSON object a line."""
    mapping.write.mode("errorifexists").json(path)


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("scope string, token string, surface string, type string").json(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file, with its name."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1))
