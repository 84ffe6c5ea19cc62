"""WARC archives with revisit records: digests meet in a shuffle of headers, payloads are written once.

Writing: headers (id, digest, length) are grouped by digest, each later copy is joined to the
original, and the text writer emits the archives, whose record separator is WARC's own CRLF CRLF,
as gzip files. Reading: files are parsed as streams inside the tasks, one record in memory at a
time, and revisits are joined to responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_ROWS = 20_000
PARSED = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_digest string, " \
         "url string, payload string"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: five hexadecimal digits are four digits of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest, payload_bytes of headers, with refers_to: the original's page_id, NULL for a response.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the response (a row that
    repeats an id has the same role); smaller payloads are all responses. Rows with NULL page_id are
    responses and never originals. Only headers are shuffled; copies are reduced to one row per task.
    """
    sized = F.col("payload_bytes") >= min_bytes
    first = (headers.where(sized & F.col("page_id").isNotNull()).groupBy("digest")
             .agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return (headers.join(first, "digest", "left")
            .withColumn("refers_to", F.when(sized & (F.col("page_id") > F.col("original")), F.col("original")))
            .select("page_id", "digest", "payload_bytes", "refers_to"))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha1(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_archives(pages: DataFrame, path: str, as_of: str = "2024-01-01T00:00:00Z", min_bytes: int = 0,
                   record: str = "payload") -> None:
    """Write page_id, url and ``record`` (NULL: empty) as gzipped WARC files of at most FILE_ROWS records.

    Responses hold the payload behind an HTTP header, revisits only headers that name the original.
    Control characters and spaces of a URL are percent-encoded; a NULL URL is 'about:blank'.
    Repeated ids are each written, with different payloads too. An empty table writes no record.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("about:blank")).alias("url"),
                        F.coalesce(record, F.lit("")).alias("payload"))
    size = F.octet_length("payload").cast("long")
    headers = rows.select("page_id", payload_digest(F.col("payload")).alias("digest"), size.alias("payload_bytes"))
    revisits = resolve_revisits(headers, min_bytes).where("refers_to is not null") \
        .groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))
    # an id may come with several payloads, each with its own role
    joined = rows.withColumn("digest", payload_digest(F.col("payload"))).join(revisits, ["page_id", "digest"], "left")
    safe = F.regexp_replace(F.regexp_replace("url", r"[\r\n]+", "%0A"), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    size.cast("string"), F.lit(END))
    common = [F.lit(f"WARC-Date: {as_of}"), F.concat(F.lit("WARC-Target-URI: "), safe),
              F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
              F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
              F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))]
    revisit = F.concat_ws("\r\n", F.lit(VERSION), F.lit("WARC-Type: revisit"), *common,
                          F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), _record_id(
                              F.col("refers_to"), F.col("digest"))), F.lit("Content-Length: 0"))
    response = F.concat_ws("\r\n", F.lit(VERSION), F.lit("WARC-Type: response"), *common,
                           F.lit("Content-Type: application/http; msgtype=response"),
                           F.concat(F.lit("Content-Length: "), (F.length(http) + size).cast("string")))
    text = F.when(F.col("refers_to").isNotNull(), F.concat(revisit, F.lit(END))) \
        .otherwise(F.concat(response, F.lit(END), http, F.col("payload")))
    joined.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip") \
        .option("maxRecordsPerFile", FILE_ROWS).text(path)


def parse(stream: BinaryIO) -> Iterator[tuple]:
    """(page_id, type, payload bytes, digest, original's record id, url, payload) of the records of one file."""
    number = 0
    while line := stream.readline():
        if line != VERSION.encode() + b"\r\n":
            raise ValueError(f"record {number} does not start with the version")
        field = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"the file ends in the header of record {number}")
            name, value = line.decode("utf-8").removesuffix("\r\n").split(": ", 1)
            field[name] = value
        block = stream.read(int(field["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {number} does not end where its length says")
        digest, id_ = field["WARC-Payload-Digest"].removeprefix("sha1:"), field["X-Page-ID"].strip()
        payload = None
        if field["WARC-Type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4:]
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"the payload of record {number} is damaged")
        yield (int(id_) if id_ else None, field["WARC-Type"], None if payload is None else len(payload), digest,
               digest if payload is None else None, field["WARC-Target-URI"], payload)
        number += 1


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = [part.split()[0] for part in PARSED.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(arrays[:-1] + [arrays[-1].cast(pa.string())], names)

    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for record in parse(gzip.open(io.BytesIO(content.as_py()))):
                rows.append(record)
                held += record[2] or 0
                if held > 1 << 22 or len(rows) >= 5000:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives: page_id, record_type, payload_bytes, payload_digest, refers_digest, url, payload."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse_files, PARSED)


def resolve_archives(records: DataFrame) -> DataFrame:
    """Records with the length of the payload and, for revisits, the original's page_id in refers_to."""
    originals = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("refers_digest")).agg(
        F.min("page_id").alias("original"), F.min("payload_bytes").alias("original_bytes"))
    return (records.join(originals, "refers_digest", "left")
            .withColumn("payload_bytes", F.coalesce("payload_bytes", "original_bytes"))
            .withColumn("refers_to", F.col("original")).drop("refers_digest", "original", "original_bytes"))
