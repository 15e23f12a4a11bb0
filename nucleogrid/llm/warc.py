"""WARC records in a content-addressed archive.

Payload bytes stand once, under their verified SHA-256, in one table; the exact header bytes of
each record stand in another.  A record is rebuilt by joining the two.  Like the members of a
compressed WARC file each payload is a zstd frame of its own, made before payloads are moved.  Records of an equal
payload of at least ``least`` bytes are one response, that of the smallest page_id, and revisits
that refer to it; a revisit's block has HTTP headers only, as the format has it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .store import new_path, on_workers, release

CRLF = "\r\n"
HTML = "text/html; charset=UTF-8"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    """Tables of an archive: headers (page_id, payload_digest, header, http) and packed payloads (payload_digest, payload)."""

    headers: DataFrame
    packed: DataFrame

    @property
    def payloads(self) -> DataFrame:
        return self.packed.mapInArrow(_unpack, "payload_digest string, payload binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, binary, as zstd frames that name their content's size."""
    tool = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield _with_last(batch, [tool.compress(x) for x in batch.column(batch.num_columns - 1).to_pylist()])
    release()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdDecompressor()
    for batch in batches:
        yield _with_last(batch, [tool.decompress(x) for x in batch.column(batch.num_columns - 1).to_pylist()])
    release()


def _with_last(batch: pa.RecordBatch, values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.binary())], names=batch.schema.names)


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; what would end the line early is percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(name + ": "), safe, F.lit(CRLF)), F.lit(""))


def write(pages: DataFrame, least: int = 100, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Archives pages (page_id, url, html, ...): a record for each row.

    A null html is an empty payload, a null url has no target line.  Rows tied for the smallest
    page_id of a payload are responses all; of rows without a page_id, none is referred to.
    Repeated rows have a record each.  Payloads of any length are whole rows.  An empty table is an
    archive of no record.  Other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    on_workers(spark)
    path = new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    named = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("n"))

    one = named.select("payload_digest", "page_id", "n").groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("n").alias("size"))
    records = named.select("page_id", "url", "payload_digest", "n").join(one, "payload_digest")
    again = (F.col("n") >= least) & (F.col("page_id") > F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: " + HTML + CRLF + "Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    block = F.octet_length("http") + F.when(again, F.lit(0)).otherwise(F.col("n"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(again, PROFILE)),
        _line("WARC-Refers-To", F.when(again, _id(F.col("first")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
    )
    records.withColumn("http", http).select("page_id", "payload_digest", header.alias("header"), "http").write.option("compression", "zstd").parquet(f"{path}/headers")
    # each payload once; rows of a digest have the same bytes, of which each task sends one
    held = named.select("payload_digest", "payload").mapInArrow(_pack, "payload_digest string, payload binary")
    held.dropDuplicates(["payload_digest"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return Archive(spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads"))


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, record) of rows (page_id, kind, header, http, packed payload); a revisit has no payload of its own."""
    tool = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for page, kind, header, http, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == "response" and payload is None:
                raise ValueError(f"the payload of page {page} is missing")
            out.append(header.encode() + http.encode() + (tool.decompress(payload) if kind == "response" else b"") + b"\r\n\r\n")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["page_id", "record"])
    release()


def _rows(archive: Archive) -> DataFrame:
    """(page_id, kind, header, http, payload): payloads, still packed, go to responses only."""
    kind = F.regexp_extract("header", r"\AWARC/1\.1\r\nWARC-Type: ([a-z]+)\r\n", 1)
    headers = archive.headers.withColumn("kind", kind)
    responses = headers.filter("kind = 'response'").join(archive.packed, "payload_digest", "left")
    return responses.unionByName(headers.filter("kind <> 'response'"), allowMissingColumns=True).select("page_id", "kind", "header", "http", "payload")


def records(archive: Archive) -> DataFrame:
    """(page_id, record): the whole bytes of each record, its payload joined in by digest."""
    return _rows(archive).mapInArrow(_rebuilt, "page_id long, record binary")


def parsed(record: bytes) -> tuple[int | None, int, str, str, int | None, bool]:
    """page_id, payload bytes, payload digest, type, refers_to and whether its payload is there and intact, of a record's bytes."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(dict(line.split(": ", 1) for line in http.decode().split(CRLF)[1:])["Content-Length"])
    number = lambda name: None if (found := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) is None else int(found[1])
    whole = end == b"\r\n\r\n" and (len(payload) == size and hashlib.sha256(payload).hexdigest() == said if fields["WARC-Type"] == "response" else not payload)
    return number("WARC-Record-ID"), size, said, fields["WARC-Type"], number("WARC-Refers-To"), whole


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _rebuilt(batches):
        found = list(zip(*map(parsed, batch.column(1).to_pylist()), strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])


def read(archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, parsed from its rebuilt bytes.

    Every payload is measured and digested anew as it is read.  A record whose payload is missing
    or isn't what its header names ends the job with an error, as does a revisit of a payload
    that no response has.
    """
    found = _rows(archive).mapInArrow(_parsed, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")
    held = archive.packed.select("payload_digest", F.lit(True).alias("held"))
    rows = found.join(held, "payload_digest", "left")
    wrong = F.raise_error(F.concat(F.lit("payload of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" is not intact")))
    digest = F.when(F.col("intact") & F.col("held"), F.col("payload_digest")).otherwise(wrong)
    return rows.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
