"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables (``pages``) in full.  The names ending in ``_fixtures`` read
the same pages with one markup variation each (``read_varied_pages``: every page kept, the
variation exercises rules that plain pages never hit).  Column names equal those of the DuckDB oracle
in ``markscope.plans.oracle``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope.functions import markup as M
from markscope.operators import facts, lint, measures, messages, rollup
from markscope.sources.pages import read_pages, read_table, read_varied_pages

Query = Callable[[SparkSession, str], DataFrame]


def parsed_pages(spark: SparkSession, sf_dir: str, varied: bool = False) -> DataFrame:
    pages = read_varied_pages(spark, sf_dir) if varied else read_pages(spark, sf_dir)
    return facts.parse_pages(pages)


def status_pages(spark: SparkSession, sf_dir: str, varied: bool = False) -> DataFrame:
    return measures.with_status(parsed_pages(spark, sf_dir, varied))


def classified_messages(spark: SparkSession, sf_dir: str, varied: bool = False) -> DataFrame:
    """Lint messages of pages with status ok, classified with the lint catalogue."""
    ok = status_pages(spark, sf_dir, varied).filter(F.col("status") == "ok")
    msgs = lint.lint_messages(ok, ("is_html5",))
    return messages.classify_lint(msgs)


def message_totals(classified: DataFrame) -> DataFrame:
    """F8: errors and warnings per page."""
    return classified.groupBy("page_id").agg(
        F.sum(F.when(F.col("kind") == "error", F.col("n")).otherwise(0)).cast("bigint").alias("num_errors"),
        F.sum(F.when(F.col("kind") == "warning", F.col("n")).otherwise(0)).cast("bigint").alias("num_warnings"))


def all_events(spark: SparkSession, sf_dir: str, varied: bool = False) -> DataFrame:
    """Markup and message count events of the ok pages (one scan, see ``rollup.count_events``)."""
    return rollup.count_events(status_pages(spark, sf_dir, varied))


# --- P: projections ---------------------------------------------------------

def q_elements(spark, sf_dir):
    return facts.elements(parsed_pages(spark, sf_dir)).select("page_id", "pos", "tag")


def q_doctype(spark, sf_dir):
    return parsed_pages(spark, sf_dir).select("page_id", "doctype", "is_html5")


def q_html5_pages(spark, sf_dir, varied=False):
    return parsed_pages(spark, sf_dir, varied=varied).filter("is_html5").select("page_id", "url")


def q_page_text(spark, sf_dir):
    return parsed_pages(spark, sf_dir).select("page_id", "text")


def q_comments(spark, sf_dir):
    return facts.comments(parsed_pages(spark, sf_dir))


def q_page_sizes(spark, sf_dir):
    return measures.page_measures(parsed_pages(spark, sf_dir)).select(
        "page_id", "file_size", "text_size", "elements_size", "comments_size")


def q_page_ratios(spark, sf_dir):
    return measures.page_measures(parsed_pages(spark, sf_dir)).select(
        "page_id", "text_to_elements", "elements_to_size", "text_to_size", "comments_to_size")


def q_scrubbed_keys(spark, sf_dir):
    p = read_pages(spark, sf_dir)
    scrubbed = M.scrub(F.col("html"))
    return p.select("page_id", F.octet_length(scrubbed).cast("bigint").alias("scrubbed_bytes"),
                    (F.length("html") - F.length(scrubbed)).cast("bigint").alias("removed_chars"))


def q_attributes(spark, sf_dir, varied=False):
    return facts.attributes(parsed_pages(spark, sf_dir, varied=varied))


def q_links(spark, sf_dir, varied=False):
    return facts.links(parsed_pages(spark, sf_dir, varied=varied)).select(
        "page_id", "pos", "tag", "href", "is_internal", "is_bookmark", "protocol")


def q_images(spark, sf_dir, varied=False):
    return facts.images(parsed_pages(spark, sf_dir, varied=varied))


# --- F: aggregations ---------------------------------------------------------

def q_element_total(spark, sf_dir):
    return parsed_pages(spark, sf_dir).select(
        "page_id", F.size("start_tags").cast("bigint").alias("num_elements"))


def q_element_counts(spark, sf_dir):
    return facts.element_counts(parsed_pages(spark, sf_dir))


def q_attribute_counts(spark, sf_dir, varied=False):
    return facts.attribute_counts(parsed_pages(spark, sf_dir, varied=varied))


def q_link_counters(spark, sf_dir, varied=False):
    return measures.page_measures(parsed_pages(spark, sf_dir, varied=varied)).select(
        "page_id", "num_links", "num_internal_links", "num_bookmarks", "num_external_links")


def q_protocol_counts(spark, sf_dir, varied=False):
    return facts.protocol_counts(parsed_pages(spark, sf_dir, varied=varied))


def q_image_counts(spark, sf_dir, varied=False):
    return facts.image_counts(parsed_pages(spark, sf_dir, varied=varied))


def q_comment_stats(spark, sf_dir):
    return measures.page_measures(parsed_pages(spark, sf_dir)).select(
        "page_id", "num_comments", "comments_size")


def q_message_totals(spark, sf_dir, varied=False):
    return message_totals(classified_messages(spark, sf_dir, varied))


def q_message_counts(spark, sf_dir, varied=False):
    return (classified_messages(spark, sf_dir, varied).groupBy("page_id", "kind", "canonical")
            .agg(F.sum("n").cast("bigint").alias("n")))


def q_variable_counts(spark, sf_dir, varied=False):
    c = classified_messages(spark, sf_dir, varied).filter(F.col("variables") != "")
    return c.groupBy("page_id", "kind", "canonical", "variables").agg(F.sum("n").cast("bigint").alias("n"))


def q_totals_flat(spark, sf_dir, varied=False):
    t = rollup.totals(all_events(spark, sf_dir, varied))
    return t.filter((F.col("scope") == "all") & F.col("metric").isin(*rollup.FLAT_METRICS)) \
            .select("metric", "key", "n")


def q_totals_nested(spark, sf_dir, varied=False):
    t = rollup.totals(all_events(spark, sf_dir, varied))
    return t.filter((F.col("scope") == "all") & F.col("metric").isin(*rollup.NESTED_METRICS)) \
            .select("metric", "key", "subkey", "n")


def q_totals_html5(spark, sf_dir, varied=False):
    return rollup.totals(all_events(spark, sf_dir, varied)).filter(F.col("scope") == "html5")


def q_page_counts(spark, sf_dir, varied=False):
    return rollup.page_counts(all_events(spark, sf_dir, varied))


def q_run_funnel(spark, sf_dir, varied=False):
    return rollup.run_funnel(status_pages(spark, sf_dir, varied))


def q_distinct_stats(spark, sf_dir, varied=False):
    return rollup.distinct_stats(rollup.totals(all_events(spark, sf_dir, varied)))


def q_merge_counts(spark, sf_dir, varied=False):
    """F16: the totals of all metrics of the even and the odd page ids, merged."""
    from markscope import sinks
    from markscope.session import scratch_path
    events = sinks.materialize(all_events(spark, sf_dir, varied), scratch_path(spark, "events"))
    keys = ["metric", "key", "subkey"]
    half = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2))
    a, b = (events.filter(half == k).groupBy(*keys).agg(F.sum("n").alias("n")) for k in (0, 1))
    return rollup.merge_counts(a, b, keys)


def q_dedupe_urls(spark, sf_dir):
    return rollup.dedupe_urls(read_pages(spark, sf_dir)).select("page_id", "url")


# --- W / J / L / P16 ----------------------------------------------------------

def q_page_status(spark, sf_dir, varied=False):
    return status_pages(spark, sf_dir, varied).select("page_id", "status", "charset")


def q_lint_messages(spark, sf_dir, varied=False):
    return lint.lint_messages(parsed_pages(spark, sf_dir, varied=varied)).select(
        "page_id", "rule", "kind", "message_id", "message", "n")


def _lint_rule(*rules: str) -> Query:
    """One rule: only its own events are made."""
    def q(spark, sf_dir, varied=False):
        found = lint.lint_messages(parsed_pages(spark, sf_dir, varied=varied), rules=rules)
        return found.filter(F.col("rule").isin(*rules)).select("page_id", "rule", "kind", "message_id", "message", "n")
    return q


def q_message_kind(spark, sf_dir, varied=False):
    c = classified_messages(spark, sf_dir, varied)
    return c.groupBy("kind").agg(F.sum("n").cast("bigint").alias("n"))


def q_message_classes(spark, sf_dir, varied=False):
    return classified_messages(spark, sf_dir, varied).select(
        "page_id", "kind", "message", "canonical", "variables", "n")


def q_page_results(spark, sf_dir, varied=False):
    return measures.page_results_one_pass(status_pages(spark, sf_dir, varied))


def q_catalog(spark, sf_dir, varied=False):
    """The lint catalogue as a table, with how many messages of the corpus each entry classifies."""
    cat = messages.catalog_frame(spark, messages.lint_catalog())
    hits = (classified_messages(spark, sf_dir, varied)
            .groupBy(F.regexp_replace("canonical", "^(html5 error|warning html5) - ", "").alias("message"))
            .agg(F.sum("n").cast("bigint").alias("n")))
    return cat.join(hits, "message", "left").select(
        "family", "idx", "pattern", "message", "n_groups", F.coalesce("n", F.lit(0)).alias("n"))


# --- S / J / W on WARC text built from the page table ---------------------------

RESUME_AFTER = "page-0000000099"


def warc_records(spark, sf_dir):
    from markscope.sources.warc import parse_warc, warc_files_from_pages
    return parse_warc(warc_files_from_pages(read_pages(spark, sf_dir)))


def q_warc_records(spark, sf_dir):
    return warc_records(spark, sf_dir).select("warc", "url", "html", "location")


def q_warc_headers(spark, sf_dir):
    return warc_records(spark, sf_dir).select("warc", "resource_type", "url", "http_code",
                                              "content_type", "server", "not_html")


def q_warc_body(spark, sf_dir):
    return warc_records(spark, sf_dir).select(
        "warc", F.octet_length("html").cast("bigint").alias("body_bytes"),
        F.size(F.split("html", "\n")).cast("bigint").alias("body_lines"))


def q_redirect_map(spark, sf_dir):
    from markscope.operators.redirects import redirect_map
    return redirect_map(warc_records(spark, sf_dir))


def q_redirect_filter(spark, sf_dir):
    from markscope.operators.redirects import drop_redirect_records
    return drop_redirect_records(warc_records(spark, sf_dir)).select("warc", "url")


def q_redirect_join(spark, sf_dir):
    from markscope.operators.redirects import attach_original_url, drop_redirect_records, origins, redirect_map
    recs = warc_records(spark, sf_dir).select("warc", "url", "location")  # no body below any join
    pages = drop_redirect_records(recs).select("warc", "url", F.lit(None).cast("string").alias("original_url"))
    return attach_original_url(pages, origins(pages, redirect_map(recs))).select(
        "warc", "url", F.coalesce("original_url", F.lit("N.D.")).alias("original_url"))


def q_resume_batch(spark, sf_dir):
    from markscope.operators.redirects import resume_after
    return resume_after(warc_records(spark, sf_dir), RESUME_AFTER).select("warc", "url")


def q_warc_page_results(spark, sf_dir):
    """P16 on the WARC path: header columns and original URLs filled from the records."""
    from markscope import sinks
    from markscope.operators import redirects as R
    from markscope.session import scratch_path
    # parsed once into a written table; everything else is derived from it, on narrow rows
    parsed = measures.with_status(facts.parse_pages(R.page_input(warc_records(spark, sf_dir))))
    every = sinks.materialize(parsed, scratch_path(spark, "warc-pages"))
    page = R.drop_redirect_records(every)
    used = R.origins(page, R.redirect_map(every))
    results = measures.page_results_one_pass(page).withColumn(
        "original_url", F.nullif("original_url", F.lit("N.D.")))
    return R.attach_original_url(results, used).fillna("N.D.", ["original_url"])


# --- T: streaming ----------------------------------------------------------------

#: HTML in a file of a stream's input: a batch is read by as many tasks as it has files, at most, and HTML of one kind takes little disk.
STREAM_FILE_HTML = 1 << 20


def _stream(spark, sf_dir, starter, name, read=None):
    """Run a stream over the page table, dealt over several files, and read what it wrote.

    Files stay small and their number grows with the table, so that a batch keeps all cores busy; a batch is about a quarter of
    the table, from 2 MB up to the stream's own limit.
    """
    from markscope.session import scratch_path
    from markscope.streaming import streams
    files = scratch_path(spark, f"{name}-in")
    pages = read_table(spark, sf_dir, "pages")
    html = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    pages.repartition(max(4, -(-html // STREAM_FILE_HTML)), "page_id").write.parquet(files)
    written = spark.read.parquet(files).select("_metadata.file_path", "_metadata.file_size").distinct()
    size = written.agg(F.sum("file_size")).first()[0] or 0
    src = streams.page_stream(spark, files, max_bytes=min(max(2 << 20, size // 4), streams.BATCH_BYTES))
    path = streams.run_to_end(spark, starter, src, name)
    return read(spark, path) if read else spark.read.parquet(path)


def q_stream_counts(spark, sf_dir):
    from markscope.streaming import streams
    return _stream(spark, sf_dir, streams.append_page_counts, "stream-counts").drop("batch_id")


def q_stream_totals(spark, sf_dir):
    from markscope.streaming import streams
    return _stream(spark, sf_dir, streams.running_totals, "stream-totals", streams.read_totals)


def q_stream_dedupe(spark, sf_dir):
    from markscope.streaming import streams
    return _stream(spark, sf_dir, streams.dedupe_urls, "stream-dedupe", streams.read_winners)


# --- K / S7 / S8 / J4: files that Spark writes, read back ---------------------------

def q_redirect_file(spark, sf_dir):
    """The redirect map kept as text lines, read back."""
    from markscope import sinks
    from markscope.session import scratch_path
    from markscope.sources.warc import read_redirect_file
    path = scratch_path(spark, "redirect-file")
    sinks.write_redirects(q_redirect_map(spark, sf_dir), path, fmt="text")
    return read_redirect_file(spark, path)


def validator_files(spark, sf_dir, varied):
    """A validator's JSON results for every page, made from the lint messages (one object per page)."""
    from markscope.session import scratch_path
    parsed = parsed_pages(spark, sf_dir, varied)
    one = F.struct(F.col("message"), F.col("message_id").alias("messageid"),
                   F.when(F.col("kind") == "error", "error").otherwise("info").alias("type"),
                   F.when(F.col("kind") == "warning", "warning").alias("subtype"))
    found = (lint.lint_messages(parsed).select("page_id", F.array_repeat(one, F.col("n").cast("int")).alias("m"))
             .groupBy("page_id").agg(F.flatten(F.collect_list("m")).alias("messages")))  # one page's messages
    whole = parsed.select("page_id", "url", "declared_charset").join(found, "page_id", "left").select(
        F.to_json(F.struct("page_id", "url", (F.pmod("page_id", F.lit(7)) == 0).alias("forced"), "messages", F.struct(F.col("declared_charset").alias("encoding")).alias("source"))).alias("value"))
    path = scratch_path(spark, "validator")
    whole.write.text(path)
    return messages.read_validator_results(spark, path)


def q_validator_messages(spark, sf_dir, varied=False):
    """Messages of validator results, counted per page."""
    m = messages.validator_messages(validator_files(spark, sf_dir, varied))
    return m.groupBy("page_id", "kind", "message_id", "message").agg(F.sum("n").cast("bigint").alias("n"))


def q_validator_status(spark, sf_dir, varied=False):
    """Status with the validator's charset (none: the page fails validation)."""
    results = validator_files(spark, sf_dir, varied)
    return measures.with_status(parsed_pages(spark, sf_dir, varied), messages.validator_charsets(results)).select(
        "page_id", "status", "charset")


def batch_run(spark, sf_dir, runs=1):
    """The whole analysis of the page table into files, in one run or in appended ones."""
    from markscope.plans.batch import analyze_corpus
    from markscope.session import scratch_path
    path = scratch_path(spark, "batch-run")
    pages = read_table(spark, sf_dir, "pages")
    for k in range(runs):  # the runs' parts add up to the table
        part = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(runs)) == k) if runs > 1 else pages
        out = analyze_corpus(spark, path, pages=part, mode="append" if k else "overwrite")
    return out


def q_sink_results(spark, sf_dir):
    """K1: the results file, read back."""
    from markscope.operators.measures import RESULT_COLUMNS
    rows = spark.read.option("sep", "£").option("header", True).csv(batch_run(spark, sf_dir)["results"])
    return rows.select(*[F.col(c).cast("double") if "_to_" in c
                         else F.col(c).cast("bigint") if c.startswith("num_") or c.endswith("_size")
                         else F.col(c) for c in RESULT_COLUMNS])


def q_sink_counts(spark, sf_dir):
    """K2, K3: the count table, read back."""
    from markscope import sinks
    return sinks.read_counts(spark, batch_run(spark, sf_dir)["counts"]).select("page_id", "is_html5", "metric", "key", "subkey", "n")


def q_sink_totals(spark, sf_dir):
    """K4, K5: the totals, read back."""
    return spark.read.parquet(batch_run(spark, sf_dir)["totals"]).select("scope", "metric", "key", "subkey", "n")


def q_append_totals(spark, sf_dir):
    """K7: the totals of two appended runs over the two parts of the table."""
    return spark.read.parquet(batch_run(spark, sf_dir, runs=2)["totals"]).select("scope", "metric", "key", "subkey", "n")


def q_sink_stats(spark, sf_dir):
    """K6, K7: the statistics file after two appended runs."""
    rows = spark.read.option("header", True).csv(batch_run(spark, sf_dir, runs=2)["stats"])
    return rows.select("stat", F.col("value").cast("bigint").alias("value"))


QUERIES: dict[str, Query] = {
    "redirect_file": q_redirect_file,
    "validator_messages": q_validator_messages,
    "validator_status": q_validator_status,
    "sink_results": q_sink_results,
    "sink_counts": q_sink_counts,
    "sink_totals": q_sink_totals,
    "append_totals": q_append_totals,
    "sink_stats": q_sink_stats,
    "elements": q_elements,
    "element_total": q_element_total,
    "element_counts": q_element_counts,
    "doctype": q_doctype,
    "html5_pages": q_html5_pages,
    "page_text": q_page_text,
    "comments": q_comments,
    "comment_stats": q_comment_stats,
    "page_sizes": q_page_sizes,
    "page_ratios": q_page_ratios,
    "scrubbed_keys": q_scrubbed_keys,
    "attributes": q_attributes,
    "attribute_counts": q_attribute_counts,
    "links": q_links,
    "link_counters": q_link_counters,
    "protocol_counts": q_protocol_counts,
    "images": q_images,
    "image_counts": q_image_counts,
    "page_status": q_page_status,
    "lint_messages": q_lint_messages,
    "lint_duplicate_id": _lint_rule("duplicate_id"),
    "lint_duplicate_attr": _lint_rule("duplicate_attr"),
    "lint_required_attr": _lint_rule("required_attr"),
    "lint_obsolete_element": _lint_rule("obsolete_element", "obsolete_element_css"),
    "lint_obsolete_attr": _lint_rule("obsolete_attr"),
    "lint_unclosed": _lint_rule("unclosed"),
    "lint_stray_end": _lint_rule("stray_end"),
    "lint_dangling_ref": _lint_rule("dangling_ref"),
    "lint_usemap": _lint_rule("usemap"),
    "lint_charset": _lint_rule("charset"),
    "lint_doctype": _lint_rule("doctype"),
    "lint_redundant_role": _lint_rule("redundant_role"),
    "message_kind": q_message_kind,
    "message_classes": q_message_classes,
    "message_totals": q_message_totals,
    "message_counts": q_message_counts,
    "variable_counts": q_variable_counts,
    "page_results": q_page_results,
    "page_counts": q_page_counts,
    "totals_flat": q_totals_flat,
    "totals_nested": q_totals_nested,
    "totals_html5": q_totals_html5,
    "run_funnel": q_run_funnel,
    "distinct_stats": q_distinct_stats,
    "merge_counts": q_merge_counts,
    "dedupe_urls": q_dedupe_urls,
    "catalog": q_catalog,
    "warc_records": q_warc_records,
    "warc_headers": q_warc_headers,
    "warc_body": q_warc_body,
    "redirect_map": q_redirect_map,
    "redirect_filter": q_redirect_filter,
    "redirect_join": q_redirect_join,
    "resume_batch": q_resume_batch,
    "warc_page_results": q_warc_page_results,
    "stream_counts": q_stream_counts,
    "stream_totals": q_stream_totals,
    "stream_dedupe": q_stream_dedupe,
}

#: Rules that plain pages hardly hit answer a second time for the pages with markup variations
#: (``sources.pages.VARIANTS``), under the name with ``_fixtures``.
VARIED = [
    "validator_messages",
    "validator_status",
    "attribute_counts",
    "attributes",
    "catalog",
    "distinct_stats",
    "html5_pages",
    "image_counts",
    "images",
    "link_counters",
    "links",
    "lint_charset",
    "lint_dangling_ref",
    "lint_doctype",
    "lint_duplicate_attr",
    "lint_duplicate_id",
    "lint_messages",
    "lint_obsolete_attr",
    "lint_obsolete_element",
    "lint_redundant_role",
    "lint_required_attr",
    "lint_stray_end",
    "lint_unclosed",
    "lint_usemap",
    "merge_counts",
    "message_classes",
    "message_counts",
    "message_kind",
    "message_totals",
    "page_counts",
    "page_results",
    "page_status",
    "protocol_counts",
    "run_funnel",
    "totals_flat",
    "totals_html5",
    "totals_nested",
    "variable_counts",
]
QUERIES.update({f"{name}_fixtures": functools.partial(QUERIES[name], varied=True) for name in VARIED})
