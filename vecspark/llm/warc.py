"""WARC derivatives: from each response record a metadata record and a plain-text conversion record.

Both refer to the response by its record id, carry its target URI and date, and have digests of their own; the metadata
record also holds the response's headers and digests as fields, so that no derivative loses its source. Records are
rows with their WARC headers and block; write_warc() and read_warc() put them in WARC/1.1 files with Spark's text
source, so that the commit protocol and any store that Spark writes to apply.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import stored
from ._text import pick, pieces

#: Record ids are made from this namespace and what a record is about, so that a rerun gives the same.
NAMESPACE = uuid.UUID("9d2f6b0a-54c1-4f0e-8c37-1b6f0f5f6a11")
DATE = "2024-01-01T00:00:00Z"
#: The header that holds a record's source_id in files.
KEY = "X-Source-Key"
RECORD = "source_id long, type string, record_id string, refers_to string, headers array<struct<name:string,value:string>>, block string"
#: The rest of a tag up to its >, which doesn't end it within a quoted value, or up to the end of the page. No quantifier
#: gives back what it has taken, so that a page is scanned in time in proportion to its length.
_REST = r"""((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)"""
_ANY = _REST.replace("((?:", "(?:(?:", 1)
_BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|head|body"
_MARKUP = re.compile(
    rf"<!--[\s\S]*?(?:-->|\Z)|<svg(?=[\s/]){_ANY}(?<=/>)"
    rf"|<(script|style|noscript|template|textarea|svg)(?=[\s/>]){_ANY}[\s\S]*?(?:</\1(?=[\s/>]){_ANY}|\Z)"
    rf"|<title(?=[\s/>]){_ANY}([\s\S]*?)(?:</title(?=[\s/>]){_ANY}|\Z)"
    rf"|<a(?=[\s/]){_REST}|<html(?=[\s/]){_REST}"
    rf"|</?({_BLOCKS}|html|title)(?=[\s/>]){_ANY}|</?[a-z]{_ANY}|<[!?][^>]*+(?:>|\Z)",
    re.I,
)
_LANG = re.compile(r"(?:^|[\s\"'])lang\s*+=\s*+[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"(?:^|[\s/\"'])href\s*+=", re.I)
#: Numbers that no character has, which html.unescape() may refuse to read.
_HUGE = re.compile(r"&#(?:[0-9]{10,}|x[0-9a-f]{10,});?", re.I)


def digest(block: bytes) -> str:
    """sha1: and the digest in base 32, as WARC files have it."""
    return f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"


def record_id(kind: str, *about: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(10).join([kind, *map(str, about)]))}>"


def one_line(value: str | None) -> str:
    """A header's value: white space, line feeds among it, as single blanks."""
    return " ".join((value or "").split())


def unescape(text: str) -> str:
    return html.unescape(_HUGE.sub("\ufffd", text))


def scan(page: str | None) -> tuple[str, str, str, int]:
    """What a page shows as text, its first title, its language, and the number of its links.

    Scripts, styles and comments go, block elements and titles part lines, entities are resolved, runs of blanks are one
    and empty lines go. A > in a quoted value ends no tag; what isn't closed reaches to the end.
    """
    title = language = None
    links = 0

    def markup(m: re.Match) -> str:
        nonlocal title, language, links
        kind = m.lastindex
        if kind is None:
            return " " if m[0].startswith("<!--") else ""
        if kind == 1:
            return " "
        if kind == 3:
            links += _LINK.search(m[3]) is not None
            return ""
        if kind == 2 and title is None:
            title = m[2]
        elif kind == 4 and language is None and (found := _LANG.search(m[4])):
            language = found[1]
        return "\n"

    shown = _MARKUP.sub(markup, " ".join((page or "").split()))
    lines = (" ".join(line.split()) for line in unescape(shown).split("\n"))
    return "\n".join(line for line in lines if line), one_line(unescape(title or "")), language or "", links


def plain_text(page: str | None) -> str:
    return scan(page)[0]


def response(source: int | None, url: str | None, page: str | None, date: str = DATE) -> tuple[list[tuple[str, str]], str]:
    """Headers and block of the response record of a page; a null page has an empty payload."""
    payload = page or ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload.encode())}\r\n\r\n"
    block = head + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", source, url, hashlib.sha256(payload.encode()).hexdigest())), ("WARC-Target-URI", one_line(url)), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload.encode())), ("WARC-Block-Digest", digest(block.encode())), ("Content-Length", str(len(block.encode())))]
    return headers + ([] if source is None else [(KEY, str(source))]), block


def derivatives(headers: list[tuple[str, str]], block: str) -> list[tuple[list[tuple[str, str]], str]]:
    """The metadata and the conversion record of a response record, as headers and block.

    Both have WARC-Refers-To, its target URI and date; the conversion's payload digest is that of its text. The metadata
    block has fields of what the page says about itself and of each source header.
    """
    own = dict(headers)
    source, uri, date = own.get("WARC-Record-ID", ""), own.get("WARC-Target-URI", ""), own.get("WARC-Date", DATE)
    payload = block.partition("\r\n\r\n")[2] if own.get("Content-Type", "").startswith("application/http") else block
    text, title, language, links = scan(payload)
    fields = [("title", title), ("language", language), ("outlinks", str(links)), ("text-bytes", str(len(text.encode()))), *((f"source-{k}", one_line(v)) for k, v in headers)]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields)
    conversion = record_id("conversion", source)
    linked = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    out = []
    for kind, number, content, more, body in (
        ("metadata", record_id("metadata", source), "application/warc-fields", [("WARC-Concurrent-To", conversion)], about),
        ("conversion", conversion, "text/plain; charset=utf-8", [("WARC-Payload-Digest", digest(text.encode())), ("WARC-Source-Payload-Digest", own.get("WARC-Payload-Digest", ""))], text),
    ):
        raw = body.encode()
        out.append(([("WARC-Type", kind), ("WARC-Record-ID", number), *linked, *more, ("Content-Type", content), ("WARC-Block-Digest", digest(raw)), ("Content-Length", str(len(raw))), *((KEY, own[KEY]) for _ in range(KEY in own))], body))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["source_id", "type", "record_id", "refers_to", "headers", "block"])


def _row(source: int | None, headers: list[tuple[str, str]], block: str) -> tuple:
    own = dict(headers)
    return source, own.get("WARC-Type"), own.get("WARC-Record-ID"), own.get("WARC-Refers-To"), [{"name": k, "value": v} for k, v in headers], block


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = DATE) -> DataFrame:
    """A response record (RECORD) for each row of pages; equal rows give records of equal ids, of which write_warc()
    writes one."""
    rows = pick(pages, **{key: "long", url: "string", page: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, page):
            yield _batch([_row(k, *response(k, u, p, date)) for k, u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    return rows.mapInArrow(run, RECORD)


def derive(records: DataFrame, keep: bool = False) -> DataFrame:
    """The derivatives of the response records in records (RECORD), a metadata and a conversion record each; with keep,
    the responses as well. Records of other types give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "block"):
            out = []
            for r in batch.to_pylist():
                if r["type"] == "response":
                    headers = [(h["name"], h["value"]) for h in r["headers"] or []]
                    out += [_row(r["source_id"], headers, r["block"] or "")] * keep
                    out += [_row(r["source_id"], *d) for d in derivatives(headers, r["block"] or "")]
            yield _batch(out)

    return records.select("source_id", "type", "record_id", "refers_to", "headers", "block").mapInArrow(run, RECORD)


_END = "\r\n\r\n"
#: Record ids that are sent to all executors.
FEW = 500_000
#: Between records; the type is each record's first header.
_NEXT = f"{_END}WARC/1.1\r\nWARC-Type: "


def _once(rows: DataFrame, by: Column, same: list[str]) -> DataFrame:
    """rows without those that repeat others in the columns same. Only by, which such rows share, is shuffled, and the
    rows for which it is there twice."""
    rows = rows.withColumn("_by", by)
    twice = stored(rows.groupBy("_by").count().where(F.col("count") > 1).select("_by"), "repeated")
    n = twice.count()
    if not n:
        return rows.drop("_by")
    twice = F.broadcast(twice) if n <= FEW else twice
    return rows.join(twice, "_by", "left_anti").unionByName(rows.join(twice, "_by", "left_semi").dropDuplicates(same)).drop("_by")


def distinct_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url and page of each different row, whose response records then have ids of their own."""
    rows = pick(pages, **{key: "long", url: "string", page: "string"})
    return _once(rows, F.xxhash64(key, url, page), [key, url, page])


def write_warc(records: DataFrame, path: str, once: bool = True) -> None:
    """Writes records as WARC/1.1 files: of equal ids one, unless once is off because there are none. A record whose block could be taken for the beginning of another one when it is
    read is an error: it can't be written so that read_warc() gives it back."""
    rest = F.concat(F.array_join(F.transform(F.filter("headers", lambda h: h["name"] != "WARC-Type"), lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\r\n"), F.lit(_END), F.coalesce("block", F.lit("")), F.lit("\r\n"))
    rest = F.when(F.contains(F.concat(rest, F.lit("\r\nWARC/1.1\r\n")), F.lit(f"{_NEXT}")), F.raise_error(F.lit("a block holds the beginning of a record"))).otherwise(rest)
    whole = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), "type", F.lit("\r\n"), rest)
    (_once(records, F.col("record_id"), ["record_id"]) if once else records).select(whole.alias("value")).write.option("lineSep", "\r\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records (RECORD) in path; blocks are cut to their Content-Length."""
    rows = spark.read.option("lineSep", _NEXT).text(path)
    value = F.concat(F.lit("WARC-Type: "), F.regexp_replace("value", r"^WARC/1\.1\r\nWARC-Type: ", ""))
    rows = rows.select(F.substring_index(value, _END, 1).alias("head"), value.alias("value"))
    pair = lambda x: F.struct(F.substring_index(x, ": ", 1).alias("name"), F.substr(x, F.instr(x, ": ") + 2).alias("value"))
    rows = rows.select(F.transform(F.split("head", "\r\n"), pair).alias("headers"), F.substr("value", F.length("head") + 5).cast("binary").alias("block"))
    named = lambda n: F.try_element_at(F.filter("headers", lambda h: h["name"] == n), F.lit(1))["value"]
    size = named("Content-Length").cast("int")
    block = F.when(F.octet_length("block") >= size, F.substring(F.col("block"), F.lit(1), size)).otherwise(F.raise_error(F.lit("a block is shorter than its Content-Length")))
    return rows.select(named(KEY).cast("long").alias("source_id"), named("WARC-Type").alias("type"), named("WARC-Record-ID").alias("record_id"), named("WARC-Refers-To").alias("refers_to"), "headers", block.cast("string").alias("block"))
