"""WARC derivatives: metadata and plain-text conversion records from responses.

A response's block is an HTTP message. From each response come two records that
refer to it by its record id: a ``metadata`` record with the source's status
line, headers, title, language and outlinks as warc-fields, and a ``conversion``
record with the page's text. Ids, block and payload digests are functions of the
content, so a rerun gives the same records. All of it is one projection; the
wire form of a record is a column expression too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# WARC 1.1 names and formats.
VERSION = "WARC/1.1"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: The inside of a tag; ``>`` within a quoted value does not end it. Possessive, so that long tags need no stack.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
#: Each kind of hidden part ends at its own end tag; a script or style that never ends hides the rest, as in a browser.
HIDDEN = r"(?is)<(?:%s)" % "|".join(rf"{name}\b{_INSIDE}>.*?(?:</{name}\s*>{end})" for name, end in (("script", r"|\z"), ("style", r"|\z"), ("noscript", ""), ("template", "")))
TITLE = rf"(?is)<title\b{_INSIDE}>(.*?)</title\s*>"
BREAK = rf"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|body|title|blockquote|pre)\b{_INSIDE}>"
TAG = rf"(?s)<[A-Za-z/!?]{_INSIDE}>"
LANGUAGE = r"(?is)<html\b[^>]*\blang=[\"']?([A-Za-z-]+)"
_VALUE = r"""\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
LINK = r"""(?is)<a\b(?:(?!\shref\s*=)[^>"']|"[^"]*+"|'[^']*+')*+""" + _VALUE
#: The same for an engine without lookahead.
LINK_SQL = r"""(?is)<a\b(?:[^>"']|"[^"]*"|'[^']*')*?""" + _VALUE
#: A text in pieces: references with their semicolon, and what lies between.
PIECE = r"&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]{0,31});|[^&]+|&"
#: Named references, those of Latin-1 first: a lookup ends at its find.
NAMES = dict(sorted((("&" + k, v) for k, v in html5.items() if k.endswith(";")), key=lambda x: (x[1] not in "&<>\"'\xa0", max(map(ord, x[1])), x[0])))
#: What numbers from 128 to 159 stand for: the characters of Windows-1252, where it has them.
C1 = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160)]
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]{1,15})[ \t]*\r?$")
BLANKS = "[ \\t\\r\\f ]+"


def plain_pattern(pattern: str) -> str:
    """``pattern`` for an engine without possessive loops, which matches the same."""
    return pattern.replace("++", "+").replace("*+", "*")


def _character(code: Column) -> Column:
    """The character of a code point; null, surrogates and numbers beyond Unicode give U+FFFD."""
    known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return (
        F.when(~known, F.lit("�")).when(code.between(128, 159), F.element_at(F.array(*map(F.lit, C1)), (code - 127).cast("int")))
        .when(code == 0xFEFF, F.lit("﻿")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _unescape(x: Column) -> Column:
    """Character references read once: every name of HTML and all numbers, if a semicolon ends them; others stay, control characters too."""
    # A map for each first letter, found by its place: a map is searched from its beginning.
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    said = lambda first: "\x02".join(f"{k}\x01{v}" for k, v in NAMES.items() if k[1] == first)
    maps = F.array(*(F.str_to_map(F.lit(said(x)), F.lit("\x02"), F.lit("\x01")) for x in letters))

    def read(piece):
        number = F.when(F.substring(piece, 3, 1).isin("x", "X"), F.conv(F.regexp_extract(piece, "^&#[xX]([0-9A-Fa-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(piece, "^&#([0-9]+)", 1))
        decoded = F.when(piece.startswith("&#"), _character(number.cast("long"))).otherwise(F.coalesce(F.try_element_at(F.get(maps, F.instr(F.lit(letters), F.substring(piece, 2, 1)) - 1), piece), piece))
        return F.when(piece.startswith("&") & (F.length(piece) > 1), decoded).otherwise(piece)

    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(PIECE), F.lit(0)), read), "")


def _squeeze(x: Column) -> Column:
    """One blank between words, one line feed between lines, none at the ends."""
    x = F.regexp_replace(x, BLANKS, " ")
    x = F.regexp_replace(x, r" ?\n[ \n]*", "\n")
    return F.btrim(x, F.lit(" \n"))


def html_text(html: Column) -> Column:
    """Plain text of a page: comments and hidden parts go, block tags break lines, character references are read.

    ``>`` in quoted values does not end a tag, ``<`` before a blank or a digit begins none, and a tag that never
    ends stays as text. Names without a semicolon and numbers of more than nine digits stay as they are.
    """
    shown = F.regexp_replace(F.regexp_replace(html, COMMENT, ""), HIDDEN, "")
    shown = F.regexp_replace(shown, TITLE, "")
    return _squeeze(_unescape(F.regexp_replace(F.regexp_replace(shown, BREAK, "\n"), TAG, "")))


def _links(body: Column) -> Column:
    """Targets of a page's links in order, each once: references read, line ends and tabs out, blanks at the ends gone."""
    bare = F.transform(F.regexp_extract_all(body, F.lit(LINK), F.lit(1)), lambda x: F.trim(F.regexp_replace(_unescape(F.regexp_replace(x, "^[\"']|[\"']$", "")), "[\r\n\t]+", "")))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def _id(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def _sha(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


COLUMNS = ("page_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "payload_digest", "block")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record for each page (``page_id, url, html``); a null page has an empty body, a null url no target."""
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(head, body)
    made = pages.select("page_id", F.col("url").alias("target_uri"), body.alias("body"), block.alias("block"))
    return made.select(
        "page_id", F.lit("response").alias("warc_type"), _id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("target_uri", F.lit("")), F.sha2("block", 256)).alias("record_id"), F.lit(None).cast("string").alias("refers_to"), "target_uri",
        F.lit(date).alias("date"), F.lit("application/http;msgtype=response").alias("content_type"), F.octet_length("block").cast("long").alias("content_length"), _sha(F.col("block")).alias("block_digest"), _sha(F.col("body")).alias("payload_digest"), "block",
    )


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the responses among ``records``, be they made by :func:`responses` or read by :func:`read_files`.

    Each has ``refers_to`` = the response's record id, its target and date, its
    HTTP status line and headers (in the metadata block) and the digest of its
    payload as the source states it (else it is computed), next to digests of its own block; ``page_id`` comes along where
    there is one. Records of other types are passed over, and so are those that are not ``whole``. Repeated responses give repeated
    derivatives; a block without a blank line is taken as headers only, a null block as empty.
    """
    page = ["page_id"] if "page_id" in records.columns else []
    block = F.coalesce("block", F.lit(""))
    cut = F.instr(block, CRLF + CRLF)
    sound = F.col("warc_type") == "response"
    if "whole" in records.columns:
        sound = sound & F.col("whole")
    body = F.when(cut > 0, F.substring(block, cut + 4, F.length(block))).otherwise(F.lit(""))
    found = records.where(sound).select(
        *page, "record_id", "target_uri", "date", F.coalesce("payload_digest", _sha(body)).alias("payload_digest"),
        F.when(cut > 0, F.substring(block, F.lit(1), cut - 1)).otherwise(block).alias("head"), body.alias("body"),
    )
    title = F.replace(_squeeze(_unescape(F.regexp_extract("body", TITLE, 1))), F.lit("\n"), F.lit(" "))
    language = F.regexp_extract("body", LANGUAGE, 1)
    headers = F.regexp_replace("head", r"\r\n", "\r\nsource-header: ")
    fields = F.concat(
        F.lit("source-status: "), headers, F.lit(CRLF), F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit(CRLF),
        F.lit("title: "), title, F.lit(CRLF), F.lit("language: "), language, F.lit(CRLF),
        F.array_join(F.transform(_links(F.col("body")), lambda x: F.concat(F.lit("outlink: "), x, F.lit(CRLF))), ""),
    )
    made = found.select(*page, "record_id", "target_uri", "date", F.explode(F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), html_text(F.col("body")).alias("block")),
    )).alias("r"), "payload_digest").select(*page, "record_id", "target_uri", "date", "payload_digest", "r.*")
    own = _id(F.col("warc_type"), F.col("record_id"), F.sha2("block", 256))
    return made.select(*page, "warc_type", own.alias("new_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", "content_type", F.octet_length("block").cast("long").alias("content_length"), _sha(F.col("block")).alias("block_digest"), "payload_digest", "block").withColumnRenamed("new_id", "record_id")


def wire(records: DataFrame) -> DataFrame:
    """``records`` with ``headers`` and ``wire``: the record as it stands in a file, up to the two line ends that close it.

    Line ends in a header's value are percent-encoded, so no value can begin another header; null values have no header.
    """
    encoded = lambda value: F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), encoded(value), F.lit(CRLF))).otherwise(F.lit(""))
    headers = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Payload-Digest", F.when(F.col("warc_type") == "response", F.col("payload_digest"))), line("WARC-Source-Payload-Digest", F.when(F.col("warc_type") != "response", F.col("payload_digest"))),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    return records.withColumn("headers", headers).withColumn("wire", F.concat("headers", F.lit(CRLF), "block", F.lit(CRLF + CRLF)))


def read_wire(data: bytes) -> list[dict]:
    """Records of a WARC file's bytes: headers by lower-cased name, and ``block``."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(CRLF)
        if first != VERSION:
            raise ValueError(f"not a record at byte {at}")
        record: dict = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        size = int(record["content-length"])
        record["block"] = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it should")
        out.append(record)
        at = end + 8 + size
    return out


def write_files(records: DataFrame, path: str, compression: str = "none") -> None:
    """``records`` as WARC files in the folder ``path``, one a partition."""
    wire(records).select(F.concat("headers", F.lit(CRLF), "block", F.lit(CRLF)).alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(path)


def _rejoined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a split, in order; those that the version line within a block cut off are put back, as the record's length says."""
    seam = (VERSION + CRLF).encode()

    def lacks(piece: bytes) -> int:
        """Bytes that the record which begins with ``piece`` still needs, 0 if it is whole or has no length."""
        end = piece.find(b"\r\n\r\n")
        stated = _LENGTH.search(piece, 0, end + 2) if end >= 0 else None
        needs = int(stated[1]) + end + 8 - len(piece) if stated else 0
        return needs if 0 < needs <= most else 0

    def settled(held: list[bytes]) -> Iterator[bytes]:
        """Records of pieces that did not make up the one they began with."""
        at = 0
        while at < len(held):
            needs, upto = lacks(held[at]), at + 1
            while upto < len(held) and needs > 0:
                needs -= len(seam) + len(held[upto])
                upto += 1
            upto = at + 1 if needs else upto
            yield seam.join(held[at:upto])
            at = upto

    where, held, needs = None, [], 0
    for batch in batches:
        out: list[bytes] = []
        for piece, *at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != where:
                out += settled(held)
                where, held, needs = at, [], 0
            if held:
                held.append(piece)
                needs -= len(seam) + len(piece)
            else:
                held, needs = [piece], lacks(piece)
            if needs == 0:
                out.append(seam.join(held))
                held = []
            elif needs < 0:
                first, *rest = held
                out.append(first)
                out += settled(rest)
                held = []
        yield pa.record_batch([pa.array(out, pa.binary())], names=["piece"])
    yield pa.record_batch([pa.array(list(settled(held)), pa.binary())], names=["piece"])


def read_files(spark: SparkSession, path: str, most_bytes: int = 256 << 20) -> DataFrame:
    """Records of WARC files of UTF-8 blocks: ``warc_type, record_id, refers_to, target_uri, date, content_type, content_length, block_digest, payload_digest, block, whole``.

    Files are split at the version line, so large ones are read by many tasks; a block that holds the version line itself
    is put together again by its Content-Length, within its split and up to ``most_bytes``. A header
    that a record lacks is null. ``whole`` is false where a record's length is not the stated one:
    it is damaged, or was cut by the end of a split right at a version line inside. Record heads
    are read with names in any case; an empty folder gives no rows.
    """
    pieces = spark.read.option("lineSep", VERSION + CRLF).text(path).select(F.col("value").cast("binary").alias("piece"), "_metadata.file_path", "_metadata.file_block_start")
    joined = pieces.mapInArrow(lambda batches: _rejoined(batches, most_bytes), "piece binary").select(F.col("piece").cast("string").alias("value")).where(F.length("value") > 0)
    cut = F.instr("value", CRLF + CRLF)
    parts = joined.select(F.substring("value", F.lit(1), cut + 1).alias("head"), F.substring("value", cut + 4, F.length("value")).alias("rest")).where(F.col("head") != "")
    header = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    size = header("Content-Length").cast("long")
    return parts.select(
        header("WARC-Type").alias("warc_type"), header("WARC-Record-ID").alias("record_id"), header("WARC-Refers-To").alias("refers_to"), header("WARC-Target-URI").alias("target_uri"), header("WARC-Date").alias("date"), header("Content-Type").alias("content_type"),
        size.alias("content_length"), header("WARC-Block-Digest").alias("block_digest"), F.coalesce(header("WARC-Payload-Digest"), header("WARC-Source-Payload-Digest")).alias("payload_digest"),
        F.regexp_replace("rest", r"\r\n\r\n\z", "").alias("block"), F.coalesce((F.octet_length("rest") == size + 4) & F.endswith("rest", F.lit(CRLF + CRLF)), F.lit(False)).alias("whole"),
    )


def convert_files(spark: SparkSession, source: str, target: str, compression: str = "none") -> None:
    """WARC files in, WARC files of the derivatives of their responses out."""
    write_files(derive(read_files(spark, source)), target, compression)


def op9_warc(pages: DataFrame) -> DataFrame:
    """Derivatives of all ``pages`` with their headers; null pages and urls as in ``responses``, repeated pages give repeated records."""
    made = wire(derive(responses(pages)))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "payload_digest", "headers", "block")
