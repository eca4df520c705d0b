"""Per-page measures, status and the 26-column page results.

Page-level counters are computed from the page's own token arrays with
higher-order functions, so the page table never has to be re-grouped.
``page_results_one_pass`` (the registered query) carries those measures through
the lint aggregation on one page token and needs no join at all;
``page_results`` joins precomputed message totals (the batch job and WARC path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.functions import markup as M
from markscope.functions import patterns as P
from markscope.session import cached_expr, java_charsets_allowed

STATUS_ORDER = ["failed_not_html", "failed_no_bytes", "failed_parsing", "failed_validation", "ok"]


def _is_tag(name_list):
    return lambda t: M.tag_name(t).isin(*name_list)


def with_status(parsed: DataFrame, validator_charset: DataFrame | None = None) -> DataFrame:
    """Add ``charset`` and ``status`` (first failing test wins, in STATUS_ORDER).

    ``validator_charset`` (``page_id, encoding``, and ``forced`` if it has that, which is kept) comes from validator
    results; without it the lint operators are the validator, and the charset is the declared one
    (or UTF-8).  A page then fails validation only for a charset that the JVM can't encode.
    A page without any tag is text, not a failure; one whose URL has no scheme fails parsing.
    """
    df = parsed
    forced = []
    if validator_charset is not None:
        if "forced" in validator_charset.columns:
            forced = ["forced"]
        df = df.join(validator_charset.select("page_id", F.col("encoding").alias("_v_enc"),
                                              F.lit(True).alias("_validated"), *forced),
                     "page_id", "left")
    cols = cached_expr(("status", validator_charset is not None),
                       lambda: _status_columns(validator_charset is not None))
    return df.select(*parsed.columns, *forced, *cols)


def _status_columns(with_validator: bool):
    if with_validator:
        charset = F.lower(F.col("_v_enc"))
        validated = F.coalesce(F.col("_validated"), F.lit(False))
    else:
        charset = F.coalesce(F.col("declared_charset"), F.lit(P.DEFAULT_CHARSET))
        validated = F.lit(True)
    status = (F.when(F.col("not_html"), F.lit("failed_not_html"))
              .when(F.col("file_size") == 0, F.lit("failed_no_bytes"))
              .when(F.col("scheme").isNull(), F.lit("failed_parsing"))
              .when(~validated | ~F.coalesce(M.known_charset(charset), F.lit(False)), F.lit("failed_validation"))
              .otherwise(F.lit("ok")))
    return [charset.alias("charset"), status.alias("status")]


def page_measures(parsed: DataFrame, validator_charset: DataFrame | None = None) -> DataFrame:
    """Parsed pages -> status, counters, sizes and ratios; one row per page."""
    return page_measures_of_status(with_status(parsed, validator_charset))


def page_measures_of_status(df: DataFrame, keep_arrays: bool = False) -> DataFrame:
    """Counters, sizes and ratios of parsed pages that already carry ``charset`` and ``status``.

    ``keep_arrays`` keeps ``start_tags`` and ``end_tags`` for a later token pass.
    """
    dropped = ("comments", "text") if keep_arrays else ("start_tags", "end_tags", "comments", "text")
    keep = [c for c in df.columns if c not in dropped]
    stage1, stage2, stage3 = cached_expr("page_measures", _measure_columns)
    out = df.select(*keep, *stage1)
    with java_charsets_allowed(df.sparkSession):
        out = out.select(*keep, *[c for c in _STAGE1_NAMES if c not in ("text", "_comment_text")], *stage2)
    return out.select(*out.columns, *stage3)


_STAGE1_NAMES = ["num_elements", "num_links", "num_internal_links", "num_bookmarks", "num_images",
                 "num_comments", "text", "_comment_text"]


def _measure_columns():
    tags = F.col("start_tags")
    link_tags = F.filter(tags, _is_tag(["a", "area"]))
    hrefs = F.transform(link_tags, lambda t: F.coalesce(M.attr_lookup(t, "href"), F.lit("")))
    scheme = F.col("scheme")
    stage1 = [
        F.size(tags).cast("bigint").alias("num_elements"),
        F.size(hrefs).cast("bigint").alias("num_links"),
        F.size(F.filter(hrefs, lambda h: M.link_is_internal(h, scheme))).cast("bigint")
        .alias("num_internal_links"),
        F.size(F.filter(hrefs, lambda h: h.startswith("#"))).cast("bigint").alias("num_bookmarks"),
        F.size(F.filter(tags, _is_tag(["img"]))).cast("bigint").alias("num_images"),
        F.size("comments").cast("bigint").alias("num_comments"),
        F.col("text"),
        F.array_join("comments", "").alias("_comment_text"),
    ]
    cs = F.col("charset")
    stage2 = [
        (F.col("num_links") - F.col("num_internal_links")).alias("num_external_links"),
        M.byte_size(F.col("text"), cs).alias("text_size"),
        M.byte_size(F.col("_comment_text"), cs).alias("comments_size"),
    ]
    elements_size = F.col("file_size") - F.col("text_size")
    stage3 = [
        elements_size.alias("elements_size"),
        M.ratio(F.col("text_size"), elements_size).alias("text_to_elements"),
        M.ratio(elements_size, F.col("file_size")).alias("elements_to_size"),
        M.ratio(F.col("text_size"), F.col("file_size")).alias("text_to_size"),
        M.ratio(F.col("comments_size"), F.col("file_size")).alias("comments_to_size"),
    ]
    return stage1, stage2, stage3


RESULT_COLUMNS = [
    "warc", "url", "original_url", "num_elements", "doctype", "num_links", "num_internal_links",
    "num_bookmarks", "num_external_links", "num_images", "num_comments", "file_size", "text_size",
    "elements_size", "comments_size", "text_to_elements", "elements_to_size", "text_to_size",
    "comments_to_size", "num_errors", "num_warnings", "type", "http_code", "content_type",
    "server", "charset",
]


def page_results(measures: DataFrame, message_totals: DataFrame, keep_keys: bool = False) -> DataFrame:
    """The 26 result columns for pages with status ``ok``.

    ``message_totals`` is ``page_id, num_errors, num_warnings`` (F8).
    """
    ok = measures.filter(F.col("status") == "ok")
    joined = ok.join(message_totals, "page_id", "left")
    na = F.lit(P.NOT_AVAILABLE)
    cols = [
        F.col("warc"), F.col("url"),
        F.coalesce(F.col("original_url"), F.lit(P.NO_ORIGINAL_URL)).alias("original_url"),
        "num_elements", "doctype", "num_links", "num_internal_links", "num_bookmarks",
        "num_external_links", "num_images", "num_comments", "file_size", "text_size",
        "elements_size", "comments_size", "text_to_elements", "elements_to_size", "text_to_size",
        "comments_to_size",
        F.coalesce(F.col("num_errors"), F.lit(0)).cast("bigint").alias("num_errors"),
        F.coalesce(F.col("num_warnings"), F.lit(0)).cast("bigint").alias("num_warnings"),
        F.coalesce(F.col("resource_type"), na).alias("type"),
        F.coalesce(F.col("http_code"), na).alias("http_code"),
        F.coalesce(F.col("content_type"), na).alias("content_type"),
        F.coalesce(F.col("server"), na).alias("server"),
        F.coalesce(F.col("charset"), na).alias("charset"),
    ]
    if keep_keys:
        cols = ["page_id", "is_html5"] + cols
    return joined.select(*cols)


def page_results_one_pass(status_df: DataFrame) -> DataFrame:
    """P16 with lint as the validator, parsing each page once.

    The page's messages are counted inside its row; its measures ride as one struct on its ``page`` event, and both
    meet in one per-page aggregation of the small result.  No second parse, and no join of
    the page table with its message totals.
    """
    from markscope.operators import lint
    ok = status_df.filter(F.col("status") == "ok")
    m = page_measures_of_status(ok, keep_arrays=True)
    from_events = ["num_links", "num_internal_links", "num_bookmarks", "num_external_links",
                   "num_images", "num_errors", "num_warnings"]
    payload_cols = [c for c in RESULT_COLUMNS if c not in from_events]
    staged = m.select("page_id", "scheme", "start_tags", "end_tags", "declared_charset", "doctype",
                      _result_struct(payload_cols).alias("_res"))
    counts = lint.event_counts(staged, payload="_res", with_links=True)
    rows = lint.messages_from_counts(counts, keep_page=True)

    def total(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("bigint")

    rule, kind = F.col("rule"), F.col("kind")
    per_page = rows.groupBy("page_id").agg(
        F.max("payload").alias("r"),
        total(kind == "error").alias("num_errors"),
        total(kind == "warning").alias("num_warnings"),
        total(rule == "lnk_int").alias("num_internal_links"),
        total(rule == "lnk_ext").alias("num_external_links"),
        total(rule == "lnk_book").alias("num_bookmarks"),
        total(rule == "img").alias("num_images"))
    per_page = per_page.withColumn("num_links", F.col("num_internal_links") + F.col("num_external_links"))
    return per_page.select(*[F.col(f"r.{c}").alias(c) if c in payload_cols else F.col(c)
                             for c in RESULT_COLUMNS])


def _result_struct(names: list[str]):
    na = F.lit(P.NOT_AVAILABLE)
    src = {
        "original_url": F.coalesce(F.col("original_url"), F.lit(P.NO_ORIGINAL_URL)),
        "type": F.coalesce(F.col("resource_type"), na),
        "http_code": F.coalesce(F.col("http_code"), na),
        "content_type": F.coalesce(F.col("content_type"), na),
        "server": F.coalesce(F.col("server"), na),
        "charset": F.coalesce(F.col("charset"), na),
    }
    return F.struct(*[src.get(n, F.col(n)).alias(n) for n in names])
