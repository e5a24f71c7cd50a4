"""WARC derivative builder: each response record yields a metadata record and a plain-text conversion record.

A response comes as its record: WARC header lines and the HTTP message. parse() reads them; both derivatives refer to the
response (WARC-Refers-To, with its date and target URI), carry its payload digest and the type its source header gave; the
metadata record keeps the source's HTTP header lines and lists title and outlinks; the conversion record is the page's
text. Record ids are name-based (from the response's id), so a rerun writes the same records.

Edge cases: a null message is empty, which still gives both records (empty text); one without a blank line is all payload;
a header without a digest has it computed; header values can't hold line ends (they become blanks); rows repeated with the
same id give equal records; an empty table gives an empty result. Very long pages are read whole. Only the named columns
are read. Expressed with built-in functions: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What opens and never closes is dropped up to the end: each opening is read once.
DROP = r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
BREAK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|title|head|body|html)\b[^>]*>"
ANY_TAG = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
OUTLINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def urn(name: Column) -> Column:
    h = F.md5(name)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-"))][:-1], F.lit(">"))


def plain_text(html: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, DROP, " "), BREAK, "\n"), ANY_TAG, " ")
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\x0B\f]+", " "), r" ?\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(t, r"^\n+|\n+$", ""))


def line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n"))


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages: (id, header, message). Pages carry no headers of their own: these are the least."""
    payload = F.coalesce(F.col(html), F.lit(""))
    uri = F.coalesce(F.col(url), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"))
    x = pages.select(F.col(page_id).alias("id"), uri.alias("uri"), urn(F.concat_ws("|", F.lit("response"), F.col(page_id).cast("string"), uri)).alias("rid"), F.concat(F.lit("sha256:"), F.sha2(payload, 256)).alias("digest"), F.concat(http, F.lit("\r\n"), payload).alias("message"))
    header = F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit("response")), line("WARC-Record-ID", F.col("rid")), line("WARC-Target-URI", F.col("uri")), line("WARC-Date", F.lit(date)), line("WARC-Payload-Digest", F.col("digest")), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("message")))
    return x.select("id", header.alias("header"), "message")


def parse(records: DataFrame) -> DataFrame:
    """(id, record_id, uri, date, source_type, http_header, payload, payload_digest) of response records (id, header,
    message)."""
    field = lambda name, of="header": F.regexp_extract(F.col(of), rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    x = records.select("id", F.coalesce("header", F.lit("")).alias("header"), F.coalesce("message", F.lit("")).alias("message")).withColumn("cut", F.instr("message", "\r\n\r\n"))
    x = x.withColumn("http_header", F.when(F.col("cut") > 0, F.substring(F.col("message"), F.lit(1), F.col("cut") + 1)).otherwise(""))
    x = x.withColumn("payload", F.when(F.col("cut") > 0, F.substring(F.col("message"), F.col("cut") + 4, F.length("message"))).otherwise(F.col("message")))
    given = field("WARC-Payload-Digest")
    return x.select("id", field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("uri"), field("WARC-Date").alias("date"), field("Content-Type", "http_header").alias("source_type"), "http_header", "payload", F.when(given != "", given).otherwise(F.concat(F.lit("sha256:"), F.sha2("payload", 256))).alias("payload_digest"))


def derivatives(resp: DataFrame) -> DataFrame:
    """Two rows a parsed response: id, record_type, record_id, refers_to, target_uri, date, source_type, content_type,
    content_length, block_digest, source_digest, block (the record's body)."""
    links = F.regexp_extract_all("payload", F.lit(OUTLINK), F.lit(1))
    meta = F.concat(
        F.col("http_header"), F.lit("title: "), F.trim(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[\r\n\t ]+", " ")), F.lit("\r\n"),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"[\r\n]+", " "), F.lit("\r\n"))), ""),
    )
    # Each body is made once: the projection of the array is evaluated before it is exploded.
    two = F.array(
        F.struct(F.lit("metadata").alias("t"), F.lit("application/warc-fields").alias("c"), meta.alias("b")),
        F.struct(F.lit("conversion").alias("t"), F.lit("text/plain").alias("c"), plain_text(F.col("payload")).alias("b")),
    )
    x = resp.select("id", "record_id", "uri", "date", "source_type", "payload_digest", F.explode(two).alias("r"))
    return x.select(
        "id", F.col("r.t").alias("record_type"), urn(F.concat_ws("|", "r.t", "record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), F.col("uri").alias("target_uri"), "date", "source_type",
        F.col("r.c").alias("content_type"), F.octet_length("r.b").cast("long").alias("content_length"), F.concat(F.lit("sha256:"), F.sha2(F.col("r.b"), 256)).alias("block_digest"),
        F.col("payload_digest").alias("source_digest"), F.col("r.b").alias("block"),
    )


def head() -> Column:
    """The header of a derivative record, with the blank line behind it."""
    c = F.col
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", c("record_type")), line("WARC-Record-ID", c("record_id")), line("WARC-Refers-To", c("refers_to")), line("WARC-Refers-To-Target-URI", c("target_uri")), line("WARC-Refers-To-Date", c("date")),
        line("WARC-Target-URI", c("target_uri")), line("WARC-Date", c("date")), line("WARC-Source-Content-Type", c("source_type")), line("WARC-Source-Payload-Digest", c("source_digest")), line("WARC-Block-Digest", c("block_digest")),
        line("Content-Type", c("content_type")), line("Content-Length", c("content_length")), F.lit("\r\n"),
    )


def serialize(records: DataFrame) -> DataFrame:
    """(id, record_type, record): each derivative as the text of a WARC/1.1 record."""
    return records.select("id", "record_type", F.concat(head(), "block", F.lit("\r\n\r\n")).alias("record"))
