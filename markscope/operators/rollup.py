"""Per-page counts and corpus totals.

The long count table ``(page_id, is_html5, metric, key, subkey, n)`` replaces the
reference's ``name£keyxN`` text cells.  Markup metrics come from one pass over
the start tags: each tag emits its (metric, key, subkey) events, which are counted
with a partial (map-side) aggregation, so a page's thousands of ``p`` tags become
one row before the shuffle.  ``count_events`` runs them in the same per-page
aggregation as the lint events, so one scan yields every metric.  Totals aggregate
by ``(scope, metric, key, subkey)``; their shuffle carries one row per distinct key
and map task, whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscope.functions import markup as M
from markscope.session import cached_expr

FLAT_METRICS = ["elements", "protocols", "images", "errors", "warnings"]
NESTED_METRICS = ["attributes", "error_variables", "warning_variables"]


EVENT_FIELDS = ("metric", "key", "subkey")


def _ev(metric: str, key: Column, subkey: Column | None = None, fields=EVENT_FIELDS) -> Column:
    return F.struct(F.lit(metric).alias(fields[0]), key.alias(fields[1]),
                    (subkey if subkey is not None else F.lit("")).alias(fields[2]))


def tag_metric_events(tag: Column, vals: Column, names: Column, scheme: Column,
                      fields=EVENT_FIELDS, with_elements: bool = True) -> Column:
    """array<struct<metric, key, subkey>> of one start tag for the markup metrics.

    Entries of rules that do not apply are null; callers drop them after the explode
    with a plain filter (a higher-order filter here would push the whole array
    expression out of generated code).
    """
    attrs = F.transform(F.array_distinct(names), lambda a: _ev("attributes", tag, a, fields))
    href = F.coalesce(M.value_in(vals, names, "href"), F.lit(""))
    src = M.value_in(vals, names, "src")
    per_tag = [
        F.when(tag.isin("a", "area"), _ev("protocols", M.link_protocol(href, scheme), None, fields)),
        F.when(tag == "img", _ev("images", M.image_format(src), None, fields)),
    ]
    if with_elements:
        per_tag.insert(0, _ev("elements", tag, None, fields))
    return F.concat(F.array(*per_tag), attrs)


def markup_events(ok_pages: DataFrame) -> DataFrame:
    """One row per (page, metric, key, subkey) occurrence for the markup metrics.

    Start tags are exploded first; tag name, attribute tokens and names are then
    computed once per tag in generated code, and the events of a tag exploded.
    """
    tags = (ok_pages.select("page_id", "is_html5", "scheme", F.explode("start_tags").alias("raw"))
            .withColumn("_tag", M.tag_name("raw"))
            .withColumn("_toks", M.attr_tokens("raw")))
    tags = tags.withColumn("_names", F.transform("_toks", M.attr_name)).withColumn("_vals", M.attr_values(F.col("raw"), F.col("_toks")))
    events = cached_expr("markup_events", lambda: F.explode(
        tag_metric_events(F.col("_tag"), F.col("_vals"), F.col("_names"), F.col("scheme"))).alias("e"))
    return tags.select("page_id", "is_html5", events).filter(F.col("e").isNotNull()).select(
        "page_id", "is_html5", "e.metric", "e.key", "e.subkey", F.lit(1).cast("bigint").alias("n"))


def events_from_rows(rows: DataFrame) -> DataFrame:
    """Count events from classified rows of ``lint.messages_from_counts(..., keep_markup=True)``.

    One narrow explode: a markup row gives its own count; a message gives its class
    and, with variables, its (class, variables) pair.
    """
    kind, canon, var = F.col("kind"), F.col("canonical"), F.col("variables")
    is_markup = F.col("rule") == "markup"
    ev = F.array(
        F.when(is_markup, F.struct(F.col("metric"), F.col("mkey").alias("key"),
                                   F.col("msubkey").alias("subkey"))),
        F.when(~is_markup, F.struct(F.concat(kind, F.lit("s")).alias("metric"), canon.alias("key"),
                                    F.lit("").alias("subkey"))),
        F.when(~is_markup & var.isNotNull() & (var != ""),
               F.struct(F.concat(kind, F.lit("_variables")).alias("metric"), canon.alias("key"),
                        var.alias("subkey"))))
    return (rows.select("page_id", "is_html5", "n", F.explode(ev).alias("e"))
            .filter(F.col("e").isNotNull())
            .select("page_id", "is_html5", "e.metric", "e.key", "e.subkey", "n"))


def message_events(classified: DataFrame) -> DataFrame:
    """Errors / warnings by class, and by (class, variables) when there are variables.

    Both metrics come out of one explode, so the messages are computed once.
    """
    kind, canon, var = F.col("kind"), F.col("canonical"), F.col("variables")
    both = F.array(
        F.struct(F.concat(kind, F.lit("s")).alias("metric"), canon.alias("key"),
                 F.lit("").alias("subkey")),
        F.when(var.isNotNull() & (var != ""),
               F.struct(F.concat(kind, F.lit("_variables")).alias("metric"), canon.alias("key"),
                        var.alias("subkey"))))
    return (classified.select("page_id", "is_html5", "n", F.explode(both).alias("e"))
            .filter(F.col("e").isNotNull())
            .select("page_id", "is_html5", "e.metric", "e.key", "e.subkey", "n"))


def page_counts(events: DataFrame) -> DataFrame:
    """K2/K3 content: ``page_id, is_html5, metric, key, subkey, n`` summed per page."""
    return (events.groupBy("page_id", "is_html5", "metric", "key", "subkey")
            .agg(F.sum("n").cast("bigint").alias("n")))


def totals(events_or_counts: DataFrame) -> DataFrame:
    """``scope, metric, key, subkey, n`` for scope 'all' and the 'html5' subset."""
    scopes = F.array(F.lit("all"), F.when(F.col("is_html5"), F.lit("html5")))
    return (events_or_counts.select(F.explode(scopes).alias("scope"), "metric", "key", "subkey", "n")
            .filter(F.col("scope").isNotNull())
            .groupBy("scope", "metric", "key", "subkey")
            .agg(F.sum("n").cast("bigint").alias("n")))


def merge_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """F16: sum two count tables by key (map union of the reference)."""
    return a.unionByName(b).groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n"))


def merge_count_maps(a: Column, b: Column) -> Column:
    """F16 on map columns: ``map<string,bigint>`` + ``map<string,bigint>``."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def run_funnel(status_df: DataFrame) -> DataFrame:
    """``stat, value`` rows of the run statistics, from a page table with ``status``."""
    s = F.col("status")
    forced = F.col("forced") if "forced" in status_df.columns else F.lit(False)
    agg = status_df.agg(
        F.count(F.lit(1)).alias("records_seen"),
        F.count_if(s == "failed_not_html").alias("excluded_not_html"),
        F.count_if(s == "failed_no_bytes").alias("excluded_no_bytes"),
        F.count_if(s == "failed_validation").alias("excluded_validation"),
        F.count_if(s == "failed_parsing").alias("excluded_parsing"),
        F.count_if(s == "ok").alias("successful"),
        F.count_if((s == "ok") & F.coalesce(forced, F.lit(False))).alias("forced"),
    )
    names = ["records_seen", "excluded_not_html", "excluded_no_bytes", "excluded_validation",
             "excluded_parsing", "successful", "forced"]
    stack = "stack({}, {}) as (stat, value)".format(
        len(names), ", ".join(f"'{n}', cast({n} as bigint)" for n in names))
    return agg.selectExpr(stack)


def distinct_stats(totals_df: DataFrame) -> DataFrame:
    """number of different errors, warnings and elements over the corpus."""
    t = totals_df.filter((F.col("scope") == "all") & F.col("metric").isin("errors", "warnings", "elements"))
    agg = t.agg(*[F.count_if(F.col("metric") == m).cast("bigint").alias(m)
                  for m in ("errors", "warnings", "elements")])
    return agg.selectExpr("stack(3, 'different_errors', errors, 'different_warnings', warnings, "
                          "'different_elements', elements) as (stat, value)")


SKETCH_BITS = 14
#: Two standard errors of a sketch's estimate, as a share (1.04 / sqrt(2 ** SKETCH_BITS) each).
SKETCH_ERROR = 2 * 1.04 / 2 ** (SKETCH_BITS / 2)


def distinct_sketches(events_or_counts: DataFrame) -> DataFrame:
    """F15 for large corpora: ``metric, sketch``, a HyperLogLog sketch of each metric's keys.

    A sketch has a fixed size whatever the corpus, so runs keep theirs and readers merge them: no run's keys are
    counted again.
    """
    rows = events_or_counts.filter(F.col("metric").isin("errors", "warnings", "elements"))
    return rows.groupBy("metric").agg(F.hll_sketch_agg("key", F.lit(SKETCH_BITS)).alias("sketch"))


def sketch_stats(sketches: DataFrame) -> DataFrame:
    """The statistics of ``distinct_stats`` from sketches of any number of runs (estimates, see ``SKETCH_ERROR``)."""
    merged = sketches.groupBy("metric").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("value"))
    names = F.array(*[F.lit(m) for m in ("errors", "warnings", "elements")])
    row = merged.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))     # three entries at most
    return row.select(F.explode(names).alias("metric"), "m").select(
        F.concat(F.lit("different_"), "metric").alias("stat"), F.coalesce(F.try_element_at("m", F.col("metric")), F.lit(0)).cast("bigint").alias("value"))


def dedupe_urls(pages: DataFrame, order_col: str = "warc") -> DataFrame:
    """keep one page per URL, the first by ``order_col``; pages without a URL share one.

    The winner per URL is found with a partially aggregated ``min`` (a URL held by a
    third of all records is collapsed map-side), then pages are semi-joined on the
    winner's own (url, key) pair, which is unique, so the join has no hot key.
    """
    winners = pages.groupBy(F.col("url").alias("_url")).agg(F.min(order_col).alias("_first"))
    same = F.col("url").eqNullSafe(F.col("_url")) & (F.col(order_col) == F.col("_first"))
    return pages.join(winners, same, "left_semi")


def count_events(status_df: DataFrame) -> DataFrame:
    """All count events (markup and messages) of the ok pages: one scan, one event aggregation.

    The plan is linear (no branch that would parse the pages twice): aggregated
    events -> lint candidates and markup rows -> classification -> count events.
    """
    from markscope.operators import lint, messages
    ok = status_df.filter(F.col("status") == "ok")
    counts = lint.event_counts(ok, ("is_html5",), with_markup=True)
    rows = messages.classify_lint(lint.messages_from_counts(counts, ("is_html5",), keep_markup=True))
    return events_from_rows(rows)
