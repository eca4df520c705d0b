"""More registered queries: catalogues as files, text by element, WARC folders and streams, mergeable statistics.

As in ``plans.queries``: each query reads the driver's tables in full, and the code that prepares its input
(files that a crawl, a validator or an earlier run would have left) does none of the job's work.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from markscope import sinks
from markscope.functions import markup as M
from markscope.operators import facts, lint, measures, messages, rollup
from markscope.operators.element_text import element_text
from markscope.plans.queries import Query, all_events, parsed_pages, status_pages, validator_files
from markscope.session import scratch_path
from markscope.sources import warc
from markscope.sources.pages import read_pages, read_varied_pages
from markscope.streaming import streams

# --- S6, J3: a catalogue in two text files ---------------------------------------


def catalog_lines(spark, sf_dir):
    """Input: catalogue lines ``(section, t, word, pattern, message)`` from the corpus's element and attribute names.

    For each lint template: a line for each name of even length, lines without a group, lines for any name, and last
    a line for each name of odd length, which the lines before it shadow.
    """
    names = F.concat(F.array("tag"), F.transform(M.attr_tokens("raw"), M.attr_name))
    words = (facts.element_rows(parsed_pages(spark, sf_dir, varied=True)).select(F.explode(names).alias("word"))
             .filter("word <> ''").distinct())
    word = F.col("word")
    escaped = F.regexp_replace(word, r"([^a-zA-Z0-9])", r"\\$1")

    def line(section, t, name, first, rest):
        entry = messages.template_entries("", [lint.LINT_RULES[t][2]])[0]
        parts = entry.pattern.split("(.*)")
        pattern = [F.lit(parts[0])]
        for k, part in enumerate(parts[1:]):
            pattern += [first if k == 0 else F.lit(rest), F.lit(part)]
        return F.struct(F.lit(section).alias("section"), F.lit(t).alias("t"), name.alias("word"), F.concat(*pattern).alias("pattern"),
                        F.concat(F.lit(f"{section} "), name, F.lit(f" {entry.message}")).alias("message"))

    rules = range(len(lint.LINT_RULES))
    one = F.concat(F.lit("("), escaped, F.lit(")"))
    named = words.select(F.explode(F.array(*[F.struct(F.when(F.length(word) % 2 == 0, line(0, t, word, one, "(.*)?")).otherwise(line(3, t, word, one, "(.*)?")).alias("l"))
                                             for t in rules])).alias("x")).select("x.l.*")
    none = F.lit("")
    general = spark.range(1).select(F.explode(F.array(*[line(1, t, none, F.lit(".*"), ".*") for t in rules],
                                                      *[line(2, t, none, F.lit("(.*)?"), "(.*)?") for t in rules])).alias("l")).select("l.*")
    return named.unionByName(general)


def catalog_files(spark, sf_dir):
    """Input: the lines as two files, in the same order."""
    path = scratch_path(spark, "catalog")
    lines = sinks.materialize(catalog_lines(spark, sf_dir), f"{path}/lines")    # a catalogue is a small table: one file each
    for name in ("pattern", "message"):
        lines.repartition(1).sortWithinPartitions("section", "t", "word").select(name).write.text(f"{path}/{name}")
    return f"{path}/pattern", f"{path}/message"


def q_catalog_files(spark, sf_dir):
    """The two files paired by line number, groups counted."""
    return messages.read_catalog_files(spark, "html5", *catalog_files(spark, sf_dir))


def q_message_classes_catalog(spark, sf_dir):
    """J3 with that catalogue, for both families: lint messages of the varied pages, every second page's as general ones."""
    files = catalog_files(spark, sf_dir)
    catalog = messages.read_catalog_files(spark, "html5", *files).unionByName(messages.read_catalog_files(spark, "general", *files))
    found = lint.lint_messages(status_pages(spark, sf_dir, varied=True).filter("status = 'ok'")).withColumn(
        "message_id", F.when(F.pmod("page_id", F.lit(2)) == 0, F.col("message_id")).otherwise(F.col("rule")))
    found = sinks.materialize(found.select("page_id", "kind", "message_id", "message", "n"), scratch_path(spark, "lint-messages"))
    return messages.classify(found, catalog)


# --- P7: text by element ----------------------------------------------------------

def q_element_text(spark, sf_dir, varied=False):
    """The own text of each element."""
    return element_text((read_varied_pages if varied else read_pages)(spark, sf_dir))


# --- S1, S3, T1: folders of WARC files --------------------------------------------------

def warc_folder(spark, sf_dir, files=3):
    """Input: the pages' WARC records in a few files, one record after the other."""
    rows = warc.warc_files_from_pages(read_pages(spark, sf_dir))
    path = scratch_path(spark, "warc-folder")
    # the writer ends each row with a line end, which the record has itself
    rows.select(F.expr("substr(value, 1, length(value) - 1)").alias("value")).repartition(files, F.xxhash64("value")).write.text(path)
    return path


def q_warc_scan(spark, sf_dir):
    """All response records of the folder."""
    records = warc.parse_records(warc.read_warc_records(spark, warc_folder(spark, sf_dir)))
    return records.select("url", "html", "resource_type", "http_code", "content_type", "server", "not_html", "location")


def q_stream_warc_counts(spark, sf_dir):
    """Counts of the folder's pages by a stream in batches of 32 MB, then again with what is new (nothing)."""
    folder, out = warc_folder(spark, sf_dir), scratch_path(spark, "stream-warc")
    for _ in range(2):
        streams.append_page_counts(streams.warc_stream(spark, folder, max_bytes=32 << 20), f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/counts").groupBy("is_html5", "metric", "key", "subkey").agg(F.sum("n").cast("bigint").alias("n"))


# --- F14 to F16, W8, K5 ---------------------------------------------------------------------

def q_distinct_stats_sketch(spark, sf_dir, varied=False):
    """F15 for large corpora: sketches of two appended runs, merged."""
    path = scratch_path(spark, "sketches")
    status = status_pages(spark, sf_dir, varied)
    for k in (0, 1):
        part = status.filter(F.pmod(F.xxhash64("page_id"), F.lit(2)) == k)
        sinks.write_sketches(rollup.distinct_sketches(rollup.count_events(part)), path, mode="append" if k else "overwrite", batch=k)
    return rollup.sketch_stats(spark.read.parquet(path))


def q_merge_count_maps(spark, sf_dir, varied=False):
    """F16 on map columns: a page's counts of element names and of attribute names, added up by name."""
    parsed = parsed_pages(spark, sf_dir, varied)
    names = F.flatten(F.transform("start_tags", lambda t: F.array_distinct(F.transform(M.attr_tokens(t), M.attr_name))))
    staged = parsed.select("page_id", F.array_sort(F.transform("start_tags", M.tag_name)).alias("_tags"), F.array_sort(names).alias("_names"))
    merged = rollup.merge_count_maps(F.map_from_entries(M.count_runs("_tags")), F.map_from_entries(M.count_runs("_names")))
    return staged.select("page_id", F.explode(merged).alias("key", "n"))


def q_metric_pages(spark, sf_dir, varied=False):
    """A page has no row for a metric that it has nothing of; pages with rows, by metric."""
    return rollup.page_counts(all_events(spark, sf_dir, varied)).groupBy("metric").agg(
        F.count_distinct("page_id").alias("pages"), F.min("n").alias("least"))


def q_run_funnel_validator(spark, sf_dir, varied=False):
    """F14 with a validator's results: without an encoding a page fails, and forced answers are counted."""
    results = validator_files(spark, sf_dir, varied)
    status = measures.with_status(parsed_pages(spark, sf_dir, varied), messages.validator_charsets(results))
    return rollup.run_funnel(status)


def q_totals_of_key(spark, sf_dir):
    """K5: the nested totals of the element ``a``, read from the clustered totals table."""
    path = scratch_path(spark, "totals")
    sinks.write_totals(rollup.totals(all_events(spark, sf_dir)), path)
    return sinks.read_totals(spark, path).filter("metric = 'attributes' AND key = 'a'").select("scope", "subkey", "n")


QUERIES: dict[str, Query] = {
    "warc_scan": q_warc_scan,
    "stream_warc_counts": q_stream_warc_counts,
    "distinct_stats_sketch": q_distinct_stats_sketch,
    "distinct_stats_sketch_fixtures": functools.partial(q_distinct_stats_sketch, varied=True),
    "merge_count_maps": q_merge_count_maps,
    "metric_pages": q_metric_pages,
    "run_funnel_validator": q_run_funnel_validator,
    "totals_of_key": q_totals_of_key,
    "element_text": q_element_text,
    "element_text_fixtures": functools.partial(q_element_text, varied=True),
    "catalog_files": q_catalog_files,
    "message_classes_catalog": q_message_classes_catalog,
}
