"""WARC archives: writing pages as request, response or revisit, and metadata records, reading archives
back, and assembling the records of one capture into one nested row.

Archives are written by Spark's text writer, whose line separator is the blank lines that end a
record, so every file is a plain (gzipped) WARC file in the shared folder. They are read as whole
files of bounded record count and parsed by Content-Length, streaming through the decompressor.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import cut_lineage, numbered

END = "\r\n\r\n"
LEAST_BYTES = 100  # payloads shorter than this are never revisits
RECORDS = 24_000  # of one archive file
RECORD_TYPE = (
    "record_id string, record_type string, concurrent_to array<string>, refers_to string, page_id long, target string, "
    "payload_bytes long, payload_digest string, payload binary, fields map<string,string>"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def urn(kind: str, page: Column, row: Column) -> Column:
    """Record ids that depend on the page and its row number alone."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("-")), row.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(kind: Column, own_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """Text of one record without its closing blank lines; headers that are null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), own_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def one_line(text: Column) -> Column:
    """A header value: line ends become spaces."""
    return F.regexp_replace(text, r"[\r\n]+", " ")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Writes three records per row below ``folder`` and returns it.

    Rows with equal payloads of LEAST_BYTES or more: that with the smallest id (of repeated rows, the
    first) is a response, the others are revisits that refer to it and carry no payload. Null html is an
    empty payload; a null id is written without one and comes after all others.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), one_line(F.col(url_col)).alias("url"), html.alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    rows = numbered(rows, ["page"], "row", F.col("digest"), F.col("url"))
    order = F.struct(F.col("page").isNull().alias("none"), F.col("page").alias("page"), F.col("row").alias("row"))
    held = rows.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    held = cut_lineage(held.where("n > 1").select("digest", "first"))
    rows = rows.join(held, "digest", "left")
    revisit = F.coalesce((F.col("first") != order) & (F.col("bytes") >= LEAST_BYTES), F.lit(False))
    page, row, url = F.col("page"), F.col("row"), F.coalesce("url", F.lit(""))
    request_id, response_id, metadata_id = (urn(k, page, row) for k in ("request", "response", "metadata"))
    name = [("X-Page-ID", page.cast("string")), ("WARC-Target-URI", F.col("url"))]
    payload = [("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("X-Payload-Length", F.col("bytes").cast("string"))]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    http = [("Content-Type", F.lit("application/http; msgtype=response"))]
    refers = [("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", urn("response", F.col("first.page"), F.col("first.row")))]
    records = F.array(
        record(F.lit("request"), request_id, [*name, ("WARC-Concurrent-To", response_id)], F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n\r\n"))),
        F.when(revisit, record(F.lit("revisit"), response_id, [*name, *payload, *refers, *http], head)).otherwise(
            record(F.lit("response"), response_id, [*name, *payload, *http], F.concat(head, F.col("html")))
        ),
        record(F.lit("metadata"), metadata_id, [*name, ("WARC-Concurrent-To", response_id)], F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit("\r\n"))),
    )
    writer = rows.select(F.explode(records).alias("value")).write
    writer.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)
    return folder


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict, list, bytes]]:
    """(headers, concurrent-to ids, block) of every record of one archive; holds one record at a time."""
    buffer = bytearray()
    ended = False

    def fill(n: int) -> None:
        nonlocal ended
        while len(buffer) < n and not ended:
            more = next(chunks, None)
            ended = more is None
            buffer.extend(more or b"")

    while True:
        at, seen = -1, 0
        while at < 0:
            at = buffer.find(b"\r\n\r\n", max(0, seen - 3))
            if at < 0:
                seen = len(buffer)
                fill(seen + 1)
                if len(buffer) == seen:
                    return
        lines = buffer[:at].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        pairs = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        headers = dict(pairs)
        size = int(headers.get("content-length", 0))
        fill(at + 4 + size + 4)
        yield headers, [v for k, v in pairs if k == "warc-concurrent-to"], bytes(buffer[at + 4 : at + 4 + size])
        del buffer[: at + 4 + size + 4]


def inflate(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Decompressed pieces of a file of one or many gzip members, or the plain bytes."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + step] for i in range(0, len(content), step))
        return
    while content:
        member, at = zlib.decompressobj(31), 0
        while not member.eof and at < len(content):
            yield member.decompress(content[at : at + step])
            at += step
        content = member.unused_data + content[at:]


def rows_of(content: bytes, payloads: bool) -> Iterator[tuple]:
    for headers, concurrent, block in parse(inflate(content)):
        kind, fields = headers.get("warc-type"), {}
        body = block
        if headers.get("content-type", "").startswith("application/http"):
            body = block.partition(b"\r\n\r\n")[2]
        if kind == "metadata":
            fields = dict(re.findall(r"([^:\r\n]+): *([^\r\n]*)", block.decode("utf-8", "replace")))
        size, digest = len(body), hashlib.sha256(body).hexdigest()
        if kind == "revisit":  # the payload lies with another record
            size = int(headers["x-payload-length"]) if "x-payload-length" in headers else None
            digest = headers.get("warc-payload-digest", "").partition(":")[2] or None
        page = headers.get("x-page-id")
        yield (
            headers.get("warc-record-id"), kind, concurrent, headers.get("warc-refers-to"), int(page) if page else None,
            headers.get("warc-target-uri"), size, digest, body if payloads else None, fields,
        )


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record (RECORD_TYPE). Sizes and digests are those of the payload read back, of
    revisits those their headers state. ``payloads`` keeps the payload bytes as well."""
    names = [x.split()[0] for x in RECORD_TYPE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                held = []
                for one in rows_of(content, payloads):
                    held.append(one)
                    if len(held) == (64 if payloads else 4096):
                        yield typed(held)
                        held = []
                yield typed(held)

    def typed(held: list) -> pd.DataFrame:
        out = pd.DataFrame(held, columns=names)
        return out.astype({"page_id": "Int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInPandas(run, RECORD_TYPE)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, page_id, target, main, requests, metadata, others).

    A capture is a response, revisit or resource record with all records joined to it by concurrent-to
    identifiers, whichever side names the other, directly or through one further record (a metadata
    record may name the request). Records that reach no such record make a capture of their own without
    ``main``. Records of equal ids all stay.
    """
    main = F.col("record_type").isin("response", "revisit", "resource")
    links = records.select("record_id", "record_type", F.explode("concurrent_to").alias("other"))
    mains = records.where(main).select(F.col("record_id").alias("capture")).distinct()
    named = links.where(~main).select("record_id", "other")
    named = named.union(links.where(main).select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    direct = named.join(mains, named["other"] == mains["capture"]).groupBy("record_id").agg(F.min("capture").alias("capture"))
    through = named.join(direct.withColumnRenamed("record_id", "via"), F.col("other") == F.col("via"))
    through = through.groupBy("record_id").agg(F.min("capture").alias("second"))
    own = records.select("*", main.alias("is_main"))
    own = own.join(direct, "record_id", "left").join(through, "record_id", "left")
    capture = F.when(F.col("is_main"), F.col("record_id")).otherwise(F.coalesce("capture", "second", "record_id"))
    body = F.struct(*[c for c in records.columns])
    kept = own.select(capture.alias("capture_id"), "is_main", "record_type", body.alias("record"))

    def those(which: Column) -> Column:
        return F.collect_list(F.when(which, F.col("record")))

    return kept.groupBy("capture_id").agg(
        F.first(F.when(F.col("is_main"), F.col("record")), ignorenulls=True).alias("main"),
        those(F.col("record_type") == "request").alias("requests"),
        those(F.col("record_type") == "metadata").alias("metadata"),
        those(~F.col("is_main") & ~F.coalesce(F.col("record_type"), F.lit("")).isin("request", "metadata")).alias("others"),
    )
