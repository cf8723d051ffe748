"""Operator 6: a content-addressed WARC archive.

Two tables in the archive's folder: ``headers`` keeps each record's exact
header with the key of its payload, ``payloads`` keeps each payload once under
its SHA-256. Reading joins them, checks every payload against its key, and
gives back the original records. Deduplication moves digests and ids only; a
payload shared by many pages is combined before the shuffle and never expanded.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import new_path, table

#: Payloads below this many bytes are always stored as responses.
MIN_BYTES = 0
#: The tables have no time of capture.
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
#: Files of more bytes are streamed, and records that are handed on together.
LARGEST = 1 << 28
PARSED = 64
# Fixed value: names of the record kinds and the profile of a revisit by equal payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four digits to the base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing for null; line breaks in a value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(name + ": "), safe, F.lit(CRLF)), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def headers(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """A row for each page: header (exact text up to the empty line) and payload_key.

    Among equal payloads of at least min_bytes bytes the smallest page_id is a response, the others refer to it. Rows
    that repeat that page_id are responses as well. Where all ids of a payload are null, all are responses.
    Null html counts as empty; null urls leave their line out.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", F.sha2(html, 256).alias("payload_key"), base32_sha1(html).alias("_sha1"), F.octet_length(html).alias("_bytes"))
    first = rows.groupBy("payload_key").agg(F.min("page_id").alias("_first"))
    revisit = (F.col("_bytes") >= min_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("_first")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("_bytes").cast("string"))),
    )
    return rows.join(first, "payload_key", "left").select(header.alias("header"), "payload_key")


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write the two tables of the archive under path. An empty table gives an archive without records."""
    pages = pages.select("page_id", "url", "html")
    html = F.coalesce(F.col("html"), F.lit(""))
    payloads = pages.select(F.sha2(html, 256).alias("payload_key"), html.alias("payload")).dropDuplicates(["payload_key"])
    payloads.write.parquet(f"{path}/payloads")
    headers(pages, min_bytes).write.parquet(f"{path}/headers")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, each checked against its key; a mismatch fails the job."""
    stored = spark.read.schema("payload_key string, payload string").parquet(f"{path}/payloads")
    right = F.sha2(F.col("payload"), 256) == F.col("payload_key")
    payload = F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_key"))))
    return stored.select("payload_key", payload.alias("payload"))


def _headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("header string, payload_key string").parquet(f"{path}/headers")


def _field(name: str, pattern: str = "([^\r\n]*)") -> Column:
    return F.regexp_extract("header", f"(?md)^{name}: {pattern}\r$", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to and the full payload's size and digest, from the archive alone."""
    kept = _payloads(spark, path).select("payload_key", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    return _headers(spark, path).join(kept, "payload_key").select(
        _field("WARC-Record-ID", "<urn:page:([^>]*)>").try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:([^>]*)>").try_cast("long").alias("refers_to"),
        F.nullif(_field("WARC-Target-URI"), F.lit("")).alias("url"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records, byte for byte: header, empty line, block, two line ends. A revisit's block is empty."""
    both = _headers(spark, path).join(_payloads(spark, path), "payload_key")
    block = F.when(_field("WARC-Type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    return both.select(F.concat("header", F.lit(CRLF), block, F.lit(CRLF + CRLF)).alias("record"))


def export_warc(spark: SparkSession, path: str, out: str, compression: str = "none") -> None:
    """The archive at path as plain WARC files under out, one for each partition."""
    whole = records(spark, path)
    body = F.substring(F.col("record"), F.lit(1), F.char_length("record") - 2)  # the writer adds the last line end
    whole.select(body.alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(out)


def _records(stream: BinaryIO, name: str) -> Iterator[tuple[str, bytes]]:
    """Header and payload of each record of a WARC stream, one at a time."""
    while line := stream.readline():
        header = []
        while line.strip():
            header.append(line)
            line = stream.readline()
        lengths = [x.split(b":", 1)[1] for x in header if x.lower().startswith(b"content-length:")]
        if header and not lengths:
            raise ValueError(f"a record without Content-Length in {name}")
        if header:
            size = int(lengths[0])
            payload = stream.read(size)
            if len(payload) < size:
                raise ValueError(f"a record of {name} is cut off")
            yield b"".join(header).decode("utf-8", "replace"), payload


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if content is None:
                from pyarrow import fs

                system, at = fs.FileSystem.from_uri("file://" + name[5:] if name.startswith("file:/") and not name.startswith("file://") else name)
                raw = system.open_input_stream(at, compression=None)
            else:
                raw = io.BytesIO(content)
            stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(raw) if content is None else raw
            found = _records(stream, name)
            while part := list(islice(found, PARSED)):
                columns = [pa.array([h for h, _ in part], pa.string()), pa.array([p for _, p in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["header", "payload"])


def import_warc(spark: SparkSession, out: str) -> DataFrame:
    """header and payload (binary) of each record in WARC files, plain or gzip by their names, by their Content-Length.

    Files up to LARGEST bytes come through Spark's reader; larger ones are streamed, record by record, by one task each.
    A payload may hold any bytes; bytes of a header that are not UTF-8 are replaced. A damaged file fails the job.
    """
    files = spark.read.format("binaryFile").load(out)
    small = files.where(F.col("length") <= LARGEST).select("path", "content")
    large = files.where(F.col("length") > LARGEST).select("path", F.lit(None).cast("binary").alias("content"))
    schema = "header string, payload binary"
    return small.mapInArrow(_parse, schema).union(large.repartition("path").mapInArrow(_parse, schema))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path)


_B32_SQL = f"translate(list_aggregate(list_transform(range(8), lambda i: to_base(CAST('0x' || substr(s, 1 + 5 * i, 5) AS BIGINT), 32, 4)), 'string_agg', ''), '{DIGITS32}', '{BASE32}')"
OP6_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       {_B32_SQL} AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to,
       url
FROM p JOIN f USING (h)
"""
