"""WARC archives: a writer in DataFrame functions and a salvage reader.

Writing: a record per page. Of the records with equal payloads of at least ``least`` bytes that with the
largest page id is a response, the others are revisits that name it; shorter payloads are all responses.
A record is one line of Spark's text writer, whose separator is the blank lines that end a WARC record:
so archives are committed like any Spark output, and a lost executor leaves no half files. Who is a
revisit is found on ids and digests alone, which are written once. If the revisits are few (counted: at most ``broadcast_ids``) they
are broadcast and html isn't shuffled at all; else it is, to meet them. Files hold about ``file_bytes`` each, from the measured mean size of a record.

Reading: ``read`` takes whole files, plain or of gzip members. A record is accepted if its version line,
header, length and closing blank lines are in order and its block digest, where given, holds. After a
failed check the reader looks for the next version line or gzip member, whichever comes first, reports the bytes in between
as a gap with the reason, and goes on. Records and gaps together cover each file exactly.

Edge cases: a null html is an empty payload; null urls and ids give empty header fields and come back as
null; line ends in urls are removed. Rows repeated whole are each written; of these with one id and
payload all are responses, as none of them has a smaller id. An empty table gives an empty archive and
no records. Other columns of the pages are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.llm.common import named, scratch_path, table, text_of, written

END = "\r\n\r\n"
VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
RECORDS = "file string, begin long, finish long, gap string, type string, record_id string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary"


def urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, date: str = "2000-01-01T00:00:00Z", broadcast_ids: int = 300_000) -> DataFrame:
    """A column ``record``: each record without its closing blank lines."""
    rows = pages.select(named(id_col).alias("id"), F.regexp_replace(F.coalesce(named(url_col), F.lit("")), r"[\r\n]", "").alias("url"), text_of(html_col).alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "n": F.octet_length("html")})
    long = written(rows.where(F.col("n") >= least).select("id", "digest"), "warc-digests")
    firsts = long.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    revisits = long.join(firsts, "digest").where("id < first").groupBy("id", "digest").agg(F.max("first").alias("first"))
    revisits = written(revisits, "warc-revisits")
    few = revisits.count() <= broadcast_ids  # some 100 bytes each
    rows = rows.join(F.broadcast(revisits) if few else revisits, ["id", "digest"], "left")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    again = F.col("first").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    field = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        field("WARC-Record-ID", urn(F.col("id"))),
        F.lit(f"\r\nWARC-Date: {date}"),
        field("WARC-Target-URI", F.col("url")),
        F.when(again, F.concat(field("WARC-Refers-To", urn(F.col("first"))), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        field("Content-Length", F.octet_length("block").cast("string")),
        F.lit(END),
    )
    return rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("record"))


def write(pages: DataFrame, path: str, html_col: str = "html", file_bytes: int = 16_000_000, **how) -> None:
    size = pages.agg(F.avg(F.octet_length(named(html_col))).alias("n")).first()["n"] or 0
    out = records(pages, html_col=html_col, **how).write
    out.option("lineSep", END).option("maxRecordsPerFile", int(max(1, file_bytes // (size + 600)))).text(path)


HEADER = re.compile(rb"([^\s:]+):[ \t]*(.*)")


def _one(data: bytes, at: int) -> tuple[dict, bytes, int] | str:
    """(headers, block, end) of the record that begins here, or what is wrong with it."""
    if not data.startswith(VERSION, at):
        return "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "header without end"
    lines = data[at:end].split(b"\r\n")
    fields = [HEADER.fullmatch(x) for x in lines[1:]]
    if None in fields:
        return "header line without name"
    head = {m[1].decode("latin-1").lower(): m[2].decode(errors="replace").strip() for m in fields}
    if not head.get("content-length", "").isdecimal():
        return "no length"
    if not head.get("warc-record-id") or not head.get("warc-type"):
        return "no record id or type"
    begin, finish = end + 4, end + 4 + int(head["content-length"])
    if finish > len(data):
        return "block beyond the end"
    if data[finish : finish + 4] != b"\r\n\r\n":
        return "no blank lines after the block"
    block = data[begin:finish]
    kind, _, digest = head.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and hashlib.sha1(block).hexdigest() != digest:  # noqa: S324  the format's digest
        return "wrong block digest"
    return head, block, finish + 4


def _plain(data: bytes, base: int = 0, end: int | None = None):
    """(begin, finish, headers, block) or (begin, finish, reason, None). base and end: of the member that data came from."""
    at, place = 0, (lambda b, e: (base, end)) if end is not None else (lambda b, e: (b, e))
    while at < len(data):
        found = _one(data, at)
        if isinstance(found, str):
            after = data.find(b"\n" + VERSION, at)
            after = len(data) if after < 0 else after + 1
            yield *place(at, after), found, None
            at = after
        else:
            yield *place(at, found[2]), found[0], found[1]
            at = found[2]


def _member(data: bytes, at: int) -> tuple[bytes, int] | str:
    unzip, out, step = zlib.decompressobj(31), [], 1 << 16
    try:
        for k in range(at, len(data), step):
            out.append(unzip.decompress(data[k : k + step]))
            if unzip.eof:
                return b"".join(out), min(len(data), k + step) - len(unzip.unused_data)
    except zlib.error as e:
        return f"bad gzip member: {e}"
    return "gzip member without end"


def _nexts(data: bytes):
    """A function from a place to the next one that a version line or a gzip member of records begins at; places only grow."""
    known = {VERSION: -1, MEMBER: -1}

    def version(at: int) -> int:
        found = data.find(b"\n" + VERSION, at)
        return len(data) if found < 0 else found + 1

    def member(at: int, end: int) -> int:
        while True:  # the magic bytes may also stand inside a member or a block: the next place has to be one that opens, and on records
            at = data.find(MEMBER, at, end)
            if at < 0:
                return end
            found = _member(data, at)
            if not isinstance(found, str) and VERSION in found[0]:
                return at
            at += 1

    def after(at: int) -> int:
        if known[VERSION] <= at:
            known[VERSION] = version(at)
        if known[MEMBER] <= at:
            known[MEMBER] = member(at + 1, known[VERSION])
        return min(known.values())

    return after


def salvage(data: bytes):
    """All that ``_plain`` gives for a file of plain records, gzip members or both."""
    at, after = 0, _nexts(data)
    while at < len(data):
        if data.startswith(MEMBER, at):
            found = _member(data, at)
            if not isinstance(found, str):
                yield from _plain(found[0], at, found[1])
                at = found[1]
                continue
        else:
            found = _one(data, at)
            if not isinstance(found, str):
                yield at, found[2], found[0], found[1]
                at = found[2]
                continue
        end = after(at)
        yield at, end, found, None
        at = end


def _payload(head: dict, block: bytes) -> tuple[int | None, bytes]:
    """(the payload's full length, what the record holds of it)."""
    if not head.get("content-type", "").startswith("application/http"):
        return len(block), block
    top, _, body = block.partition(b"\r\n\r\n")
    if head.get("warc-type") != "revisit":
        return len(body), body
    m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", top)
    return int(m[1]) if m else None, body


def _salvaged(with_payload: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in RECORDS.split(", ")]

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                out = []
                for begin, finish, head, block in salvage(content.as_py()):
                    if block is None:
                        out.append((path.as_py(), begin, finish, head, None, None, None, None, None, None, None))
                        continue
                    n, payload = _payload(head, block)
                    digest = hashlib.sha1(payload).hexdigest() if head.get("warc-type") != "revisit" else head.get("warc-payload-digest", "").rpartition(":")[2].lower()  # noqa: S324
                    out.append((path.as_py(), begin, finish, None, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-refers-to"), head.get("warc-target-uri") or None, n, digest, payload if with_payload else None))
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records (gap null) and quarantined byte gaps (gap: the reason) of the files below path."""
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORDS)
    return files.mapInArrow(_salvaged(with_payload), RECORDS)


def page_of(record_id: Column, kind: str = "long") -> Column:
    return F.nullif(F.regexp_extract(record_id, "^<urn:x-page:(.*)>$", 1), F.lit("")).cast(kind)


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    found = read(spark, path, with_payload=False).where(F.col("gap").isNull())
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to
FROM f
"""
