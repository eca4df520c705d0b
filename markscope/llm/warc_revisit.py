"""WARC archives with revisit records in place of repeated payloads.

``mark_revisits`` shuffles headers only (id, digest, length) by payload digest, finds each digest's original and joins
the repeats to it.  ``write_archive`` then writes one record per row with fresh headers: the original as a full
response, each repeat as a revisit that names it.  ``read_archive`` parses archives by Content-Length, whatever
the payloads contain, and takes digest and length from the bytes it read; ``resolve`` joins revisits to the responses
they refer to.  Archives hold a number of records that makes about ``ARCHIVE_BYTES``, and never more than ``LIMIT_BYTES``: payloads
that could make one larger get an archive each.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope.llm.common import shared_path, ship, written

MIN_BYTES = 100
ARCHIVE_BYTES = 8 << 20
LIMIT_BYTES = 1 << 30
# Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BETWEEN = "\r\n\r\n"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(id, url, payload, digest, n_bytes, original, original_url)``; original is null for responses.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is the original; rows
    that repeat its id are responses too.  Null payloads are empty; a null id comes after all others (a group without
    any id: all responses).  Repeated rows stay; other columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))
    headers = rows.filter(F.col("n_bytes") >= min_bytes).select("id", "url", "digest")
    first = (headers.groupBy("digest").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("o"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select(F.col("digest").alias("d"), F.col("o.id").alias("original"), F.col("o.url").alias("original_url")))
    repeats = (headers.join(first, F.col("digest") == F.col("d")).filter("original is not null and not (id <=> original)")
               .select(F.col("id").alias("i"), "d", "original", "original_url").distinct())
    return (rows.join(repeats, F.expr("id <=> i and digest = d"), "left").drop("i", "d"))


def _record_id(id_: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws(":", id_.cast("string"), digest).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), *(x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                           for x in ([F.lit("-")] if k else []) + [F.substring(h, a, n)]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none for null, and no line breaks inside."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\\r\\n]", " "), F.lit("\r\n")), F.lit(""))


def write_archive(marked: DataFrame, path: str, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES,
                  limit_bytes: int = LIMIT_BYTES) -> None:
    """Write one record per row of ``mark_revisits``'s result, as gzip archives below ``path``."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    size, largest = (x or 0 for x in marked.agg(F.avg("n_bytes"), F.max("n_bytes")).first())
    per_file = max(1, int(archive_bytes // (size + 600)))
    fits = limit_bytes // per_file      # bytes of a payload of which as many make no archive too large
    again = F.col("original").isNotNull()
    http = F.concat(F.lit(HTTP_OK + "Content-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(VERSION + "\r\n"), _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(again, _record_id(F.col("original"), F.col("digest")))),
        _line("WARC-Refers-To-Target-URI", F.when(again, F.col("original_url"))),
        _line("WARC-Page-ID", F.col("id")), _line("WARC-Refers-To-Page-ID", F.col("original")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(http) + F.octet_length(body)), F.lit("\r\n"), http, body)

    def put(rows: DataFrame, mode: str, n: int) -> None:
        (rows.select(record.alias("value")).write.mode(mode).option("lineSep", BETWEEN).option("compression", "gzip")
         .option("maxRecordsPerFile", n).text(path))

    if largest <= fits:
        put(marked, "errorifexists", per_file)
    else:
        put(marked.filter(F.col("n_bytes") <= fits), "errorifexists", per_file)
        put(marked.filter(F.col("n_bytes") > fits), "append", 1)


def records(data: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """Headers (names in lower case) and the payload's place of each record of one archive."""
    at, n = 0, len(data)
    while at < n:
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start, stop = end + 4, end + 4 + int(head["content-length"])
        http = data.find(b"\r\n\r\n", start, stop)
        yield head, (http + 4 if http >= 0 else start), stop
        at = stop + len(BETWEEN)


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record: type, ids, digest and length of the payload that it carries (and the payload if asked)."""
    ship(spark)
    names = ["record_type", "record_id", "page_id", "url", "refers_to_record", "refers_to", "header_digest", "digest", "n_bytes"]
    kinds = [pa.string()] * 8 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                data, out, text = b.column(0)[k].as_py(), [], []
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                for h, i, j in records(data):
                    part = data[i:j]
                    out.append((h["warc-type"], h["warc-record-id"], h.get("warc-page-id"), h.get("warc-target-uri"), h.get("warc-refers-to"),
                                h.get("warc-refers-to-page-id"), h.get("warc-payload-digest", "").partition(":")[2],
                                hashlib.sha256(part).hexdigest(), j - i))
                    if payloads:
                        text.append(part)
                cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
                if payloads:
                    cols.append(pa.array(text, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names + ["payload"] * payloads)

    schema = ", ".join(f"{x} string" for x in names[:-1]) + ", n_bytes long" + (", payload binary" if payloads else "")
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def resolve(archive: DataFrame) -> DataFrame:
    """``(page_id, record_type, digest, n_bytes, refers_to)``: each revisit with the payload of its original response."""
    full = (archive.filter("record_type = 'response'").select(F.col("record_id").alias("r"), F.col("digest").alias("rd"), F.col("n_bytes").alias("rn"))
            .dropDuplicates(["r"]))
    # responses refer to nothing: they stay out of the join, where null keys would meet in one task
    own = archive.filter("refers_to_record is null").select("page_id", "record_type", "digest", "n_bytes", "refers_to")
    again = archive.filter("refers_to_record is not null").join(full, F.col("refers_to_record") == F.col("r"), "left").select(
        "page_id", "record_type", F.coalesce("rd", "digest").alias("digest"), F.coalesce("rn", "n_bytes").alias("n_bytes"), "refers_to")
    return own.union(again)


def deduplicate_archive(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES, date: str | None = None) -> None:
    """Rewrite archives of full responses (with page ids): repeats become revisits, headers are fresh."""
    rows = read_archive(spark, source, payloads=True).filter("record_type = 'response'").select(
        F.col("page_id").cast("long").alias("id"), "url", F.col("payload").cast("string").alias("payload"))
    write_archive(mark_revisits(rows, "id", "url", "payload", min_bytes), target, date)


def op10_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """Registered query: writes deduplicated archives of ``pages``, reads them back, returns every page's record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared_path(spark, "warc")
    write_archive(mark_revisits(pages, "page_id", "url", "html"), path)
    back = written(read_archive(spark, path), "warc-records")
    return resolve(back).select(F.col("page_id").cast("long").alias("page_id"), F.col("n_bytes").alias("payload_bytes"),
                                F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, min(page_id) AS o FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, p.h AS payload_digest,
       CASE WHEN o IS NULL OR o = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o <> page_id THEN o END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
"""
