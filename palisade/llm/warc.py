"""WARC archives and revisit resolution.

Only headers (page id, payload digest, length) are shuffled by digest to find each payload's original; the
decisions then meet the pages once and archives are written in which a repeated payload is a revisit record with
a fresh header and no payload. Reading an archive back checks every payload against its digest and joins revisits
to the responses they refer to.

A record is `WARC/1.1`, headers, an empty line, the block, and two line ends; a file is a plain sequence of such
records, written by Spark's text writer with the record end as line separator. Files are bounded by bytes: pages of up to
FILE_BYTES / FILE_RECORDS bytes go FILE_RECORDS to a file, and longer ones as many to a file as the longest of them allows.

Nulls: a null html is an empty payload; a null url is written as urn:page:<id>. Rows that repeat a page_id are
records each; if several rows with a payload's largest page_id are there, each of them is a response. A null page_id is
written as an empty id and read back as null; it is the original of its payload only if no row with an id has it.
An empty table gives archives without records and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import materialize, prepare, shared_path, table

END = "\r\n"
#: Records and payload bytes in one file at most, but for a single longer page. A reader holds one file at a time.
FILE_RECORDS, FILE_BYTES = 2_000, 64 << 20
_FIELDS = "page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, target_uri string, payload binary"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload digest and length; no payload leaves its task."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))


def decide(pages: DataFrame, min_bytes: int) -> DataFrame:
    """The revisits: page_id, digest, and the page_id of the original response."""
    found = headers(pages).where(F.col("n_bytes") >= min_bytes)
    originals = found.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    # concat() hides the grouping's partitions: both sides are dealt anew and a hot digest's rows can be split among tasks.
    originals = originals.where("n > 1").select(F.concat("digest", F.lit("")).alias("digest"), "original")
    joined = found.join(originals, "digest")
    return joined.where(~F.col("page_id").eqNullSafe(F.col("original"))).select("page_id", "digest", "original").distinct()


def _record(date: str) -> F.Column:
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    html = F.coalesce(F.col("html"), F.lit(""))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", ""), F.concat(F.lit("urn:page:"), page))
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(html).cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, html))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("original").cast("string"), F.lit(">"))),
            ),
        ).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{END}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END + END),
        block,
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, date: str | None = None, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """Writes one record for each page under path; equal payloads of min_bytes or more are written once. The records' date
    is the time of writing unless one is given."""
    decided = materialize(decide(pages, min_bytes), "warc-revisits")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    size, small = F.coalesce(F.octet_length("html"), F.lit(0)), file_bytes // file_records
    longest = pages.agg(F.max(size)).first()[0] or 0

    def write(some: DataFrame, records: int, mode: str) -> None:
        keyed = some.select("page_id", "url", "html").withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
        both = keyed.join(decided, keyed["page_id"].eqNullSafe(decided["page_id"]) & (keyed["digest"] == decided["digest"]), "left").select(keyed["*"], decided["original"])
        both.select(_record(date).alias("value")).write.mode(mode).option("lineSep", END + END).option("maxRecordsPerFile", records).text(path)

    write(pages.where(size <= small) if longest > small else pages, file_records, "error")
    if longest > small:
        write(pages.where(size > small), max(1, file_bytes // longest), "append")


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    at = 0
    while at < len(archive):
        top = archive.find(b"\r\n\r\n", at)
        if top < 0 or not archive.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = archive[at:top].decode().split("\r\n")[1:]
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start = top + 4
        end = start + int(fields["content-length"])
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield fields, archive[start:end]
        at = end + 4


def _page(value: str) -> int | None:
    digits = value.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path, revisits resolved: with payload and length of the response they refer to as well."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FIELDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(content.as_buffer().to_pybytes()):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest")
                    refers = _page(fields["warc-refers-to"]) if revisit else None
                    rows.append((_page(fields["warc-record-id"]), fields["warc-type"], None if revisit else len(payload), digest, refers, fields["warc-target-uri"], None if revisit else payload))
                    held += len(payload)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(run, _FIELDS)


def resolve(records: DataFrame) -> DataFrame:
    """Gives each revisit the length of the response that it refers to, by payload digest and id; payloads stay where they are."""
    bare = records.drop("payload")
    revisits = bare.where("record_type = 'revisit'").drop("payload_bytes")
    originals = bare.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    originals = originals.withColumn("payload_digest", F.concat("payload_digest", F.lit("")))
    resolved = revisits.join(originals, ["refers_to", "payload_digest"], "left")
    return bare.where("record_type = 'response'").unionByName(resolved.select(bare.columns))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, min_bytes=1000)
    records = materialize(read_archives(spark, path).drop("payload"), "warc-records")
    return resolve(records.withColumn("payload", F.lit(None))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS original FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> original THEN original END AS refers_to
FROM g
"""
