"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response gives two linked records. The conversion holds the page's plain text;
the metadata holds the source's headers and digests as warc-fields. Both refer to the
response (WARC-Refers-To), the metadata also to the conversion (WARC-Concurrent-To).
Identifiers derive from the response's, so a run after a lost task gives the same
records. All of it is column expressions: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
_BLOCKS = "p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|header|footer|nav|head|title|body|html|blockquote|pre|hr|form|main|aside"
#: Named entities that plain text spells out; & comes last.
ENTITIES = [("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("copy", "©"), ("middot", "·"), ("amp", "&")]
#: (pattern, replacement) in order, in the syntax that Java and RE2 share.
STEPS = [
    ("(?s)<!--.*?-->", ""),
    ("(?is)<script[ \\t\\r\\n>].*?</script[ \\t\\r\\n]*>", "\n"),
    ("(?is)<style[ \\t\\r\\n>].*?</style[ \\t\\r\\n]*>", "\n"),
    (f"(?i)</?(?:{_BLOCKS})(?:[ \\t\\r\\n/][^>]*)?>", "\n"),
    ("</?[A-Za-z!?][^>]*>", ""),
]
SPACES = [("[ \\t\\r\\f\\x0B]+", " "), (" ?\\n[ \\n]*", "\n"), ("^[ \\n]+", "")]


def plain_text(html: Column) -> Column:
    """The text of a page: comments, scripts and styles dropped, block elements as line ends, white space run together."""
    for pattern, to in STEPS:
        html = F.regexp_replace(html, pattern, to)
    for name, to in ENTITIES:
        html = F.replace(html, F.lit(f"&{name};"), F.lit(to))
    for pattern, to in SPACES:
        html = F.regexp_replace(html, pattern, to)
    return F.rtrim(html, F.lit(" \n"))


def urn(*parts: Column) -> Column:
    """A record identifier that depends on parts alone."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *(F.concat(F.substring(h, a, n), F.lit("-" if a < 21 else "")) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses_of(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages (page_id, url, html): record_id, target_uri, date, http_header, payload. A null html is empty, a null url an empty one."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF))
    return pages.select(
        "page_id", urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.sha2(html, 256)).alias("record_id"),
        url.alias("target_uri"), F.lit(date).alias("date"), header.alias("http_header"), html.alias("payload"),
    )


def _record(kind: str, rid: Column, concurrent: Column | None, content_type: str, block: Column) -> Column:
    """A whole WARC record."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}"), line("WARC-Record-ID", rid), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.col("record_id")), *([line("WARC-Concurrent-To", concurrent)] if concurrent is not None else []), line("WARC-Block-Digest", digest(block)),
        F.lit(f"Content-Type: {content_type}{CRLF}"), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block, F.lit(CRLF + CRLF),
    )


def derive(responses: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata and its conversion record.

    Columns: page_id, warc_type, record_id, refers_to, concurrent_to (null for
    conversions), target_uri, content_type, content_length, block_digest,
    source_digest (of the response's block), source_payload_digest, block, record.
    Repeated responses give repeated records with equal identifiers. An empty payload gives
    an empty conversion; payloads of any length are converted whole; further columns of
    responses, also those named like columns of the records, are not read. A null header,
    payload or address is an empty one, a null date DATE; a response without an identifier
    gets one of its page_id, address and block.
    """
    r = responses.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("http_header", ""), ("payload", ""), ("target_uri", ""), ("date", DATE))})
    whole = F.concat("http_header", "payload")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    r = r.withColumn("record_id", F.coalesce("record_id", urn(F.lit("response"), page, F.col("target_uri"), F.sha2(whole, 256))))
    r = r.withColumns({"source_digest": digest(whole), "source_payload_digest": digest(F.col("payload")), "text": plain_text(F.col("payload"))})
    r = r.withColumns({"conversion_id": urn(F.lit("conversion"), F.col("record_id")), "metadata_id": urn(F.lit("metadata"), F.col("record_id"))})
    title = F.trim(F.regexp_replace(F.regexp_extract("payload", "(?is)<title[^>]*>([^<]*)", 1), "[ \\t\\r\\n]+", " "))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.replace(F.regexp_replace("http_header", "[\\r\\n]+$", ""), F.lit(CRLF), F.lit(f"{CRLF}source-http: "))
    fields = F.concat(
        field("title", title), field("source-http", http), field("source-block-digest", F.col("source_digest")), field("source-payload-digest", F.col("source_payload_digest")),
        field("conversion-digest", digest(F.col("text"))), field("conversion-chars", F.length("text").cast("string")),
    )
    r = r.withColumn("fields", fields)

    def row(kind: str, rid: str, other: str | None, content_type: str, block: str) -> Column:
        b = F.col(block)
        return F.struct(
            F.lit(kind).alias("warc_type"), F.col(rid).alias("record_id"), F.col("record_id").alias("refers_to"), (F.col(other) if other else F.lit(None).cast("string")).alias("concurrent_to"),
            F.lit(content_type).alias("content_type"), F.octet_length(b).cast("long").alias("content_length"), digest(b).alias("block_digest"), b.alias("block"),
            _record(kind, F.col(rid), F.col(other) if other else None, content_type, b).alias("record"),
        )

    both = F.array(row("metadata", "metadata_id", "conversion_id", "application/warc-fields", "fields"), row("conversion", "conversion_id", None, "text/plain; charset=utf-8", "text"))
    out = r.select("page_id", "target_uri", "source_digest", "source_payload_digest", F.explode(both).alias("x"))
    return out.select("page_id", "x.warc_type", "x.record_id", "x.refers_to", "x.concurrent_to", "target_uri", "x.content_type", "x.content_length", "x.block_digest", "source_digest", "source_payload_digest", "x.block", "x.record")
