"""WARC: payload digests, revisit resolution and deduplicated archives.

resolve() shuffles records by payload digest and makes all but one record of equal payloads revisits of it.
write() lays down WARC 1.1 records in gzip files with Spark's text writer: a response holds an HTTP header and the
payload, a revisit the HTTP header alone, with the profile for identical payloads and the record it refers to.
read() parses whole files by content length inside tasks, checks each response's digest against its header, and
follow() joins revisits to the responses that hold their payload.

Files are cut after so many records that the largest record could fill them with FILE_BYTES at most, which bounds
a reading task's memory. Equal payloads: the digest is counted with partial aggregation, and the join back is a
sort-merge join whose hot digests Spark splits.

Defined cases: a null payload is empty; a null url has no target header and reads as null; line ends in urls are
percent-encoded; repeated rows are records of their own, and of rows with equal largest id and payload each
is a response; an empty table gives an empty archive; payloads may hold anything UTF-8 can, WARC headers included.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILE_BYTES = 128 << 20
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, payload string, refers_to_record string"


def digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1, from groups of five hex digits, which are four in base 32."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(df: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload, payload_digest and payload_bytes of each row."""
    whole = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    return whole.withColumns({"payload_digest": digest(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})


def resolve(df: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds record_type and original: of equal payloads of `least_bytes` or more the one with the largest page_id is the response."""
    long = F.col("payload_bytes") >= least_bytes
    original = df.where(long).groupBy("payload_digest").agg(F.max("page_id").alias("original"))
    out = df.join(original, "payload_digest", "left")
    revisit = long & (F.col("page_id") < F.col("original"))
    return out.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "original": F.when(revisit, F.col("original"))})


def _name(page_id: Column, payload_digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", page_id.cast("string"), payload_digest))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def write(df: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Records with fresh headers, under path; df as from resolve()."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    plain = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _name(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", plain),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.when(revisit, line("WARC-Refers-To", _name(F.col("original"), F.col("payload_digest")))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    rows = df.withColumn("block", block).select(F.concat(head, F.lit("\r\n\r\n"), "block").alias("value"))
    largest = df.agg(F.max("payload_bytes")).first()[0] or 0
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, min(100_000, FILE_BYTES // (largest + 1000)))).text(path)


def parse(raw: bytes) -> Iterator[tuple]:
    """Each record of an archive's bytes, as RECORD."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start, size = end + 4, int(head["content-length"])
        http, _, payload = raw[start : start + size].partition(b"\r\n\r\n")
        at = start + size + 4
        sum_ = head["warc-payload-digest"].removeprefix("sha1:")
        kind = head["warc-type"]
        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != sum_:
            raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        url = head.get("warc-target-uri")
        url = url and url.replace("%0D", "\r").replace("%0A", "\n")
        page = head.get("x-page-id")
        yield page and int(page), url, kind, sum_, len(payload) if kind == "response" else length, payload.decode() if kind == "response" else None, head.get("warc-refers-to")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under path."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = []
                for record in parse(gzip.decompress(content)):
                    found.append(record)
                    if len(found) == 1000:
                        yield pd.DataFrame(found, columns=names)
                        found = []
                yield pd.DataFrame(found, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(rows, RECORD)


def follow(df: DataFrame) -> DataFrame:
    """Records as read, with refers_to: the page whose response holds a revisit's payload."""
    responses = df.where("record_type = 'response'").select("payload_digest", "page_id", _name(F.col("page_id"), F.col("payload_digest")).alias("refers_to_record")).distinct()
    responses = responses.select("refers_to_record", F.col("page_id").alias("refers_to"))
    return df.join(responses, "refers_to_record", "left")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    write(resolve(records(common.table(spark, sf_dir, "pages"))), path)
    found = common.stored(read(spark, path).drop("payload"), "records")
    return follow(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, from_hex(sha1(coalesce(html, ''))) AS raw, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate([list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * g + 1, 5))::BIGINT // [32768, 1024, 32, 1][d]) % 32)::INT + 1, 1) for d in [1, 2, 3, 4]], 'string_agg', '') for g in [0, 1, 2, 3, 4, 5, 6, 7]], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM b
"""
