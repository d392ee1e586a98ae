"""Content-addressed web archive: payloads once by digest, exact record headers, records by joins."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gapweave.llm.tables import map_batches, spread_join, store

#: Payloads shorter than this are never revisited.
REVISIT_BYTES = 100
#: Records that share one stored copy of a payload when they are read back.
RECORDS_PER_COPY = 1_000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"


@dataclass
class Archive:
    """headers: digest, copy, header (the exact bytes before the payload). payloads: digest, payload, records."""

    headers: DataFrame
    payloads: DataFrame


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> Archive:
    """An archive of one WARC record per row of pages (page_id, url, html).

    Payload: html in UTF-8, null as empty. Equal payloads are stored once, under their
    SHA-256; a second hash and the length must agree among rows of one digest, else the
    write fails. Of records with equal payloads of at least revisit_bytes, those with the
    smallest page_id are response records and the others revisit records that refer to it;
    shorter ones are all responses. A null page_id counts as larger than any other; if
    there is no other, its records are responses. Repeated rows give repeated records. Line
    breaks in an url are percent-encoded, a null url leaves its header out. Headers and
    payloads are Parquet tables in the shared folder.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    index = store(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes")))
    contents = store(
        rows.select("digest", "page_id", "payload", F.xxhash64("payload").alias("hash"), F.octet_length("payload").alias("bytes"))
        .groupBy("digest")
        .agg(
            F.first("payload").alias("payload"),
            F.min("page_id").alias("first_id"),
            F.count(F.lit(1)).alias("records"),
            F.assert_true(
                (F.min("hash") == F.max("hash")) & (F.min("bytes") == F.max("bytes")), F.lit("different payloads of one digest")
            ).alias("verified"),
        )
        .where(F.col("verified").isNull())  # keeps the check in the plan
        .drop("verified")
    )
    found = spread_join(index, contents.select("digest", "first_id", "records"), "digest")
    first, page = F.col("first_id"), F.col("page_id")
    revisit = (F.col("bytes") >= revisit_bytes) & first.isNotNull() & (page.isNull() | (page > first))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _id(page)),
        _field("WARC-Date", F.lit(DATE)),
        F.when(url.isNull(), "").otherwise(_field("WARC-Target-URI", url)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(_field("WARC-Refers-To", _id(first)), _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit(END),
    )
    copies = F.ceil(F.col("records") / RECORDS_PER_COPY)
    headers = store(found.select("digest", F.pmod(F.xxhash64("page_id"), copies).cast("long").alias("copy"), header.alias("header")))
    return Archive(headers, contents.select("digest", "payload", "records"))


def read(archive: Archive) -> DataFrame:
    """Every record again: header, payload (the full one, of revisits too) and what they say.

    Columns header, payload, page_id, payload_bytes, payload_digest, record_type, refers_to.
    Each header finds its payload by digest. The digest is computed anew from the payload
    and must equal the one in the header, as must a response's Content-Length; else the
    read fails. A payload that many records share is repeated for every RECORDS_PER_COPY of
    them, so no task gets all records of a popular payload.
    """
    copies = F.ceil(F.col("records") / RECORDS_PER_COPY).cast("long")
    payloads = archive.payloads.select("digest", "payload", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    joined = archive.headers.join(payloads, ["digest", "copy"], "left")
    field = lambda name: F.regexp_extract("header", rf"\n{re.escape(name)}: ([^\r\n]*)\r\n", 1)
    page = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    actual = F.sha2("payload", 256)
    parsed = joined.select(
        "header",
        "payload",
        page("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        actual.alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Digest").alias("_said"),
        field("Content-Length").cast("long").alias("_length"),
    )
    right = F.col("payload").isNotNull() & (F.col("_said") == F.concat(F.lit("sha256:"), F.col("payload_digest")))
    right &= F.col("_length") == F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))
    checked = parsed.withColumn("payload_digest", F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record does not match its payload"))))
    return checked.drop("_said", "_length")


def export(archive: Archive, folder: str) -> None:
    """Write the records as plain WARC files: header, payload unless a revisit, two line ends."""
    body = F.when(F.col("record_type") == "revisit", "").otherwise(F.col("payload"))
    read(archive).select(F.concat("header", body)).write.option("lineSep", END + END).text(folder)


def scan(spark, folder: str) -> DataFrame:
    """header and payload of the records in WARC files, cut by their Content-Length. A file is one task's work."""
    length = re.compile(rb"(?m)^Content-Length: (\d+)\r$")

    def parse(batch: pa.RecordBatch):
        for content in batch.column(0):
            data, at = content.as_buffer().to_pybytes(), 0
            headers, payloads = [], []
            while at < len(data):
                stop = data.index(b"\r\n\r\n", at) + 4
                size = int(length.search(data, at, stop)[1])
                headers.append(data[at:stop].decode())
                payloads.append(data[stop : stop + size].decode())
                at = stop + size + 4
            yield pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(payloads, pa.string())], names=["header", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return map_batches(files.select("content"), parse, "header string, payload string")
