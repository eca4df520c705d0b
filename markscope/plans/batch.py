"""The whole analysis of a corpus as one batch job (the reference's fresh/resumed run).

Pages are parsed once into a written ``page`` table (token arrays, sizes, status;
no raw HTML) in the output folder; every report is then derived from that table,
so the HTML is read and tokenised a single time however many outputs follow.
Writing the table also cuts the lineage: a lost executor recomputes from it, not
from the raw crawl.

Outputs under ``out_dir``: ``page`` (parsed pages), ``results`` (K1, CSV ``£``,
HTML5 twin as partition), ``counts`` (K2/K3), ``totals`` (K4/K5), ``stats`` (K6), ``sketches`` (F15, one
small file a run, merged by ``rollup.sketch_stats``)
and ``redirects`` (K8, WARC input only).  ``mode="append"`` adds a batch to the first three and to the
redirects; totals and statistics are then rebuilt from all batches, so two runs over parts of a
corpus end in the totals of one run over the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope import sinks
from markscope.functions import patterns as P
from markscope.operators import facts, lint, measures, messages, redirects, rollup
from markscope.session import scratch_path
from markscope.sources import warc
from markscope.sources.pages import normalize_pages


def analyze_corpus(spark: SparkSession, out_dir: str, *, pages: DataFrame | None = None,
                   warc_dir: str | None = None, last_file: str | None = None,
                   catalog: DataFrame | None = None, validator: DataFrame | None = None,
                   mode: str = "overwrite") -> dict[str, str]:
    """Run the full analysis; returns the output paths.

    ``pages``: a page table (``page_id, url, html``); or ``warc_dir``: WARC files,
    optionally resumed after ``last_file``.  ``validator``: validator results (S8);
    without them the lint operators are the validator.  ``catalog``: a message
    catalogue of any size (``messages.read_catalog_files``; default: the lint catalogue).
    """
    out = {k: f"{out_dir.rstrip('/')}/{k}" for k in ("page", "results", "counts", "totals", "stats", "sketches")}
    if warc_dir is not None:
        files = warc.read_warc_dir(spark, warc_dir)
        page_in = redirects.page_input(redirects.resume_after(warc.parse_warc(files), last_file))
        out["redirects"] = f"{out_dir.rstrip('/')}/redirects"
    elif pages is not None:
        page_in = normalize_pages(pages)
    else:
        raise ValueError("give pages or warc_dir")

    v_charset = messages.validator_charsets(validator) if validator is not None else None
    parsed = measures.with_status(facts.parse_pages(page_in), v_charset)
    batch = sinks.next_batch(spark, out["page"]) if mode == "append" else 0
    page = sinks.materialize(parsed, out["page"], mode, batch)
    used = None
    if warc_dir is not None:
        # all from the written table: no HTML is read again or shuffled
        sinks.write_redirects(redirects.redirect_map(page), out["redirects"], mode, batch=batch)
        page = redirects.drop_redirect_records(page)
        used = redirects.origins(page, sinks.read_redirects(spark, out["redirects"]))

    ok = page.filter(F.col("status") == "ok")
    if validator is not None:
        raw = messages.validator_messages(validator).join(ok.select("page_id", "is_html5"), "page_id")
        raw = sinks.materialize(raw, scratch_path(spark, "messages"))
        cat = catalog if catalog is not None else messages.catalog_frame(spark, messages.lint_catalog())
        msgs = messages.classify(raw, cat)
        events = rollup.markup_events(ok).unionByName(rollup.message_events(msgs))
    else:
        counts = lint.event_counts(ok, ("is_html5",), with_markup=True)
        rows = lint.messages_from_counts(counts, ("is_html5",), keep_markup=True)
        rows = (messages.classify_lint(rows) if catalog is None
                else messages.classify(sinks.materialize(rows, scratch_path(spark, "messages")), catalog))
        events = rollup.events_from_rows(rows)

    sinks.write_counts(rollup.page_counts(events), out["counts"], mode, batch)
    all_counts = sinks.read_counts(spark, out["counts"])
    sinks.write_totals(rollup.totals(all_counts), out["totals"])

    mine = all_counts.filter(F.col("batch") == batch)
    sinks.write_sketches(rollup.distinct_sketches(mine), out["sketches"], mode, batch)

    msg_totals = (all_counts.filter((F.col("batch") == batch) & F.col("metric").isin("errors", "warnings"))
                  .groupBy("page_id")
                  .agg(F.sum(F.when(F.col("metric") == "errors", F.col("n")).otherwise(0))
                       .cast("bigint").alias("num_errors"),
                       F.sum(F.when(F.col("metric") == "warnings", F.col("n")).otherwise(0))
                       .cast("bigint").alias("num_warnings")))
    results = measures.page_results(measures.page_measures_of_status(page), msg_totals, keep_keys=True)
    if used is not None:
        results = redirects.attach_original_url(results.withColumn(
            "original_url", F.nullif("original_url", F.lit(P.NO_ORIGINAL_URL))), used)
        results = results.fillna(P.NO_ORIGINAL_URL, ["original_url"])
    sinks.write_page_results(results, out["results"], mode, batch=batch)
    all_pages = sinks.read_batches(parsed, out["page"])
    if warc_dir is not None:
        all_pages = redirects.drop_redirect_records(all_pages)
    stats = rollup.run_funnel(all_pages).unionByName(rollup.distinct_stats(sinks.read_totals(spark, out["totals"])))
    sinks.write_run_stats(stats, out["stats"])
    return out
