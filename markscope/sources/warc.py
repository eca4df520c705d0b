"""WARC text sources (S1-S5, S7, T1) and the WARC form of a page table.

A crawl writes one WARC file per fetched page: record 1 is ``warcinfo``, record 2
the response (WARC headers, HTTP headers, then the HTML).  ``read_warc_dir`` reads such files whole
(``wholetext``), one row per file.  ``read_warc_records`` reads files of any number of records, as a batch or as a stream: the text
reader cuts them at the record starts (``lineSep``), so a large file is split by byte ranges and feeds many tasks, and
no row is larger than a record.  Records are taken apart with SQL string functions; no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope.functions import patterns as P

WARC_LINE = r"\nWARC/1\.0[^\n]*"
RECORD_START = "\nWARC/1.0"


def read_warc_dir(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``warc_name, value`` of all files of a folder; the file name minus its last 5 characters."""
    df = (spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
          .select(F.col("_metadata.file_name").alias("_file"), "value"))
    return df.select(F.expr("substr(_file, 1, length(_file) - 5)").alias("warc_name"), "value")


def _last_with_prefix(lines: Column, prefix: str) -> Column:
    hits = F.filter(lines, lambda x: x.startswith(prefix))
    return F.when(F.size(hits) > 0, F.substring(F.try_element_at(hits, F.lit(-1)), len(prefix) + 1, 1 << 30))


def read_warc_records(spark: SparkSession, path: str, glob: str = "*", stream: bool = False, max_files: int | None = None,
                      max_bytes: int = 8 << 30) -> DataFrame:
    """``warc_name, record`` of every response record of a folder's files, each of any number of records.

    A record starts at a line that starts with ``WARC/1.0`` (as the reference splits them), in files split by byte ranges.  The name is
    the file name minus its last 5 characters, ``#`` and the record's id (its hash if it has none: equal records of a file without ids
    share a name).  With ``stream``, a stream in batches of bounded size that takes each file once (T1).
    """
    reader = (spark.readStream if stream else spark.read).option("lineSep", RECORD_START).option("pathGlobFilter", glob)
    if stream:
        reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    text = F.regexp_replace(F.col("value"), "\r\n?", "\n")
    record = F.regexp_replace(text, "^[^\n]*", "")      # what is left of the line that the record starts with
    df = reader.text(path).select(F.col("_metadata.file_name").alias("_file"), record.alias("record"))
    head = F.concat(F.substring_index("record", "\n\n", 1), F.lit("\n"))
    rid = F.regexp_extract(head, "\nWARC-Record-ID: *([^\n]+)\n", 1)
    return df.filter(F.instr(head, "\nWARC-Type: response\n") > 0).select(
        F.concat(F.expr("substr(_file, 1, length(_file) - 5)"), F.lit("#"),
                 F.coalesce(F.nullif(rid, F.lit("")), F.hex(F.xxhash64("record")))).alias("warc_name"), "record")


def parse_warc(files: DataFrame) -> DataFrame:
    """The response record of each file (``warc_name, value``) -> page input columns; see ``parse_records``."""
    text = F.regexp_replace(F.col("value"), "\r\n?", "\n")
    record = F.coalesce(F.get(F.split(F.concat(F.lit("\n"), text), WARC_LINE), 2), F.lit(""))
    return parse_records(files.select("warc_name", record.alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """Response records (``warc_name, record``) -> page input columns.

    Output: ``warc, url, html, resource_type, http_code, content_type, server,
    not_html, location``.  Header lines before the first line starting with ``<``
    are the pre-header; the last match of each field wins; the body runs from that
    line on, each line ended by a newline, without the two WARC header lines.
    """
    staged = records.select("warc_name", F.split("record", "\n").alias("_lines"))
    lines = F.col("_lines")
    first_lt = F.array_position(F.transform(lines, lambda x: x.startswith("<")), True).cast("int")
    pre = F.when(first_lt > 0, F.slice(lines, 1, first_lt - 1)).otherwise(lines)
    body_lines = F.when(first_lt > 0, F.slice(lines, first_lt, 1 << 30)).otherwise(F.array())
    body_kept = F.filter(body_lines, lambda x: ~(x.startswith("WARC-Type: ") | x.startswith("WARC-Target-URI: ")))
    # readLine() drops the text after the last newline only when it is empty
    body_trimmed = F.when(F.try_element_at(body_kept, F.lit(-1)) == "", F.slice(body_kept, 1, F.size(body_kept) - 1)) \
        .otherwise(body_kept)
    html = F.when(F.size(body_trimmed) > 0, F.concat(F.array_join(body_trimmed, "\n"), F.lit("\n"))) \
        .otherwise(F.lit(""))
    ctypes = F.transform(F.filter(pre, lambda x: x.startswith("Content-Type: ")),
                         lambda x: F.substring(x, 15, 1 << 30))
    http_lines = F.filter(pre, lambda x: x.startswith("HTTP/"))
    locs = F.filter(lines, lambda x: x.startswith("Location: "))
    return staged.select(
        F.col("warc_name").alias("warc"),
        _last_with_prefix(lines, "WARC-Target-URI: ").alias("url"),
        html.alias("html"),
        _last_with_prefix(lines, "WARC-Type: ").alias("resource_type"),
        F.try_element_at(http_lines, F.lit(-1)).alias("http_code"),
        F.try_element_at(ctypes, F.lit(-1)).alias("content_type"),
        _last_with_prefix(pre, "Server: ").alias("server"),
        F.arrays_overlap(ctypes, F.array(*[F.lit(t) for t in P.NON_HTML_CONTENT_TYPES])).alias("not_html"),
        F.when(F.size(locs) > 0, F.substring(F.try_element_at(locs, F.lit(1)), 11, 1 << 30)).alias("location"),
    )


def warc_name(kind: str, page_id: Column) -> Column:
    return F.concat(F.lit(kind + "-"), F.lpad(page_id.cast("string"), 10, "0"))


def page_record_text(url: Column, html: Column, location: Column | None = None) -> Column:
    """The text of a two-record WARC file for one page (crawler layout)."""
    http = [F.lit("HTTP/1.1 200 OK\nServer: nginx\nContent-Type: text/html\n\n"), html, F.lit("\n")]
    if location is not None:
        http = [F.lit("HTTP/1.1 301 Moved Permanently\nLocation: "), location, F.lit("\n\n")]
    return F.concat(
        F.lit("WARC/1.0\nWARC-Type: warcinfo\n\nWARC/1.0\nWARC-Type: response\nWARC-Target-URI: "),
        url, F.lit("\nContent-Type: application/http; msgtype=response\n\n"), *http)


def warc_files_from_pages(pages: DataFrame) -> DataFrame:
    """WARC files (``warc_name, value``) for a page table, plus redirect records.

    Every page gets its response record.  Page k with ``k % 20 = 0`` also gets a
    redirect record from its URL to the URL of page k+1 (absolute ``Location``);
    ``k % 20 = 10`` one with a relative ``Location`` that resolves to no page.
    """
    p = pages.select("page_id", "url", "html")
    records = p.select(warc_name("page", F.col("page_id")).alias("warc_name"),
                       page_record_text(F.col("url"), F.col("html")).alias("value"))
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    red = (p.filter(F.pmod("page_id", F.lit(10)) == 0)
           .join(nxt, "page_id", "left")
           .select("page_id", "url",
                   F.when(F.pmod("page_id", F.lit(20)) == 0, F.col("next_url"))
                   .otherwise(F.concat(F.lit("/Moved//"), F.col("page_id").cast("string")))
                   .alias("location"))
           .filter(F.col("location").isNotNull()))
    redirects = red.select(warc_name("redir", F.col("page_id")).alias("warc_name"),
                           page_record_text(F.col("url"), F.lit(""), F.col("location")).alias("value"))
    return records.unionByName(redirects)


REDIRECT_SEP = "£££"


def read_redirect_file(spark: SparkSession, path: str) -> DataFrame:
    """A redirect map kept as text lines ``target£££origin``; other lines are skipped."""
    parts = F.split(F.col("value"), REDIRECT_SEP, -1)
    return (spark.read.text(path).select(parts.alias("p"))
            .filter(F.size("p") == 2)
            .select(F.col("p")[0].alias("target"), F.col("p")[1].alias("origin")))
