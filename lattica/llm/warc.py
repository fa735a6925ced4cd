"""WARC archives with revisits resolved by payload digest.

Only headers (digest, size, id) are shuffled to find originals: of records with one digest, the smallest id stays a
response and the others revisit it. Records are then written with fresh headers as WARC/1.1 files, each record a gzip
member of its own, through Spark's own writer, so any Hadoop file system and the commit protocol for lost tasks serve,
and are read back by Content-Length.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import shared_dir, small_batches

LEAST = 100
#: A file holds at most so many runs of members; a run ends with the member by which it reaches so many bytes.
FILE_RUNS, RUN_BYTES = 128, 4_000_000


def resolve_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest (lower-case hex SHA-256), record_type and refers_to.

    A null html is an empty payload. Payloads under `least` bytes are always responses, as are rows without a page_id.
    Rows that repeat a page_id with an equal payload are all responses where that id is the smallest. Other columns are
    dropped.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    heads = pages.select("page_id", "payload_bytes", "payload_digest").filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    originals = heads.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last")
    revisits = heads.join(originals, "payload_digest").filter("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    out = pages.join(revisits, ["page_id", "payload_digest"], "left")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def records(resolved: DataFrame) -> DataFrame:
    """One WARC/1.1 record a row, as text; a revisit has no block. Line ends in urls are taken out, a null url is left out."""
    page = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    own = F.col("record_type") == "response"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", page("page_id")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(own, F.lit("")).otherwise(F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", page("refers_to")))),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(own, F.col("payload_bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )
    return resolved.select(F.concat(head, F.when(own, F.col("html")).otherwise(F.lit("")), F.lit("\r\n")).alias("value"))


def member(record: bytes) -> bytes:
    """A record as one gzip member, without a time or a name."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of members without their last byte, which is 0: a member ends in its length, of which that is the high byte."""
    run = bytearray()

    def done() -> pa.RecordBatch:
        if run[-1]:  # 16 MB or more: an empty member follows
            run.extend(member(b""))
        out = pa.RecordBatch.from_arrays([pa.array([bytes(run[:-1])], pa.binary())], ["value"])
        run.clear()
        return out

    for batch in batches:
        for record in batch.column("value"):
            run += member(record.as_buffer().to_pybytes() + b"\r\n")
            if len(run) >= RUN_BYTES:
                yield done()
    if run:
        yield done()


def write_archives(resolved: DataFrame, path: str) -> None:
    """Files of gzip members, one a record, so that a reader may start at any of them; every record ends with two line ends.

    Spark's text writer writes the bytes as they are and, as its line separator, each run's last byte. A file's bytes
    are bounded by FILE_RUNS runs of RUN_BYTES, or of one larger record.
    """
    small_batches(resolved.sparkSession)
    runs = records(resolved).mapInArrow(_runs, "value binary").select(F.col("value").cast("string").alias("value"))
    runs.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", FILE_RUNS).text(path)


def parse_archive(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of a stream; one record is held at a time."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record where {first[:20]!r} stands")
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            head[name.decode().lower()] = value.strip().decode()
        yield head, stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head['warc-record-id']} does not end where it should")


def read_archives(spark: SparkSession, path: str, keep_block: bool = False) -> DataFrame:
    """The records under path: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, block.

    Digest and size of a response are computed anew from its block and must be those of its headers.
    """
    small_batches(spark)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", block binary" * keep_block
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(x: str) -> int | None:
        x = x.removeprefix("<urn:x-page:").rstrip(">")
        return int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                stream = pa.BufferReader(content.as_buffer())
                stream = gzip.GzipFile(fileobj=stream) if content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b" else stream
                rows = []
                for head, block in parse_archive(io.BufferedReader(stream)):
                    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"])
                    if head["warc-type"] == "response" and (size != len(block) or digest != hashlib.sha256(block).hexdigest()):
                        raise ValueError(f"damaged record {head['warc-record-id']}")
                    rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, head["warc-type"], number(head.get("warc-refers-to", "")), block))
                    if keep_block and len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*names, "block"])
                        rows = []
                if rows:
                    cols = list(zip(*rows, strict=True))[: None if keep_block else 6]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], [*names, "block"][: len(cols)])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/lattica/warc-{uuid.uuid4().hex}"
    write_archives(resolve_revisits(pages), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
  f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON f.digest = d.digest AND n >= 100
"""
