"""Registered queries against the DuckDB oracle, and properties of the results."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from markscope.plans.registry import ORACLE, QUERIES
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"

FAST = ["element_counts", "doctype", "page_text", "page_sizes", "attributes", "links", "images",
        "lint_messages", "message_classes", "page_results", "totals_flat", "totals_html5", "run_funnel",
        "warc_records", "redirect_join", "element_text", "warc_scan", "message_classes_catalog", "merge_count_maps", "totals_of_key"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_equal(spark, name):
    problems, _ = compare(spark, name, SF, E.queries()[name], E.oracle_sql()[name])
    assert problems == []


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


def test_element_counts_sum_to_total(spark):
    q = E.queries()
    total = q["element_total"](spark, SF).agg(F.sum("num_elements")).first()[0]
    assert q["element_counts"](spark, SF).agg(F.sum("n")).first()[0] == total


def test_links_split_and_merge_properties(spark):
    q = E.queries()
    lc = q["link_counters"](spark, SF)
    assert lc.filter("num_links != num_internal_links + num_external_links").count() == 0
    assert lc.filter("num_bookmarks > num_internal_links").count() == 0
    merged = {(r.metric, r.key): r.n for r in q["merge_counts"](spark, SF).filter("subkey = ''").collect()}
    flat = {(r.metric, r.key): r.n for r in q["totals_flat"](spark, SF).collect()}
    assert merged == flat


def test_stream_totals_equal_batch(spark):
    q = E.queries()
    stream = {(r.scope, r.metric, r.key, r.subkey): r.n for r in q["stream_totals"](spark, SF).collect()}
    from markscope.operators import rollup
    from markscope.plans import queries as Q
    ok = Q.status_pages(spark, SF, varied=False).filter(F.col("status") == "ok")
    batch = {(r.scope, r.metric, r.key, r.subkey): r.n for r in rollup.totals(rollup.count_events(ok)).collect()}
    assert stream == batch


def test_each_message_in_one_class(spark):
    c = E.queries()["message_classes"](spark, SF)
    assert c.filter(F.col("canonical").isNull()).count() == 0


@pytest.mark.parametrize("name", ["element_counts", "attribute_counts", "protocol_counts", "image_counts", "lint_messages", "message_classes"])
def test_page_counts_need_no_exchange(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("name,exchanges", [("totals_flat", 1), ("page_counts", 1), ("page_results", 1)])
def test_one_exchange_for_what_is_added_up(spark, name, exchanges):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == exchanges


def test_a_page_of_very_many_tags(spark, pages_df):
    from markscope.operators import facts, lint
    n = 30_000
    html = "<!DOCTYPE html><meta charset=utf-8>" + "".join(f'<p id="x{k % 100}" for="y{k}" class=c>' for k in range(n)) + "<u>" * n + "</u>" * (n - 5)
    got = lint.lint_messages(facts.parse_pages(pages_df([(1, "http://a/", html)])))
    rows = {(r.rule, r.n): r.message for r in got.filter("rule <> 'dangling_ref'").collect()}
    assert rows[("unclosed", 5)] == "Unclosed element u." and got.filter("rule = 'duplicate_id'").count() == 100
    assert got.filter("rule = 'dangling_ref'").count() == n and got.filter("rule = 'duplicate_id' AND n = 299").count() == 100


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("sf,pages", [("sf0.001", 50), ("sf0.01", 250), ("sf0.1", 2500)])
def test_scale_invariants(spark, sf, pages):
    d = f"/root/testdata/{sf}"
    q = E.queries()
    assert q["element_total"](spark, d).count() == pages
    assert q["page_results"](spark, d).count() == pages
    funnel = dict((r.stat, r.value) for r in q["run_funnel"](spark, d).collect())
    assert funnel["records_seen"] == pages and funnel["successful"] == pages


@pytest.mark.parametrize("name", ["lint_messages", "message_classes", "totals_flat", "page_counts",
                                  "page_results", "element_counts"])
def test_tokeniser_runs_once_per_page(spark, name):
    """A filter on status must not be pushed into the parse (the tokeniser would run twice)."""
    from markscope.functions import patterns as P
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(P.SCAN_MARKUP_JVM) <= 2  # the scan and, as its input, the tag list
    assert plan.count(f", {P.TAG_JVM}, 0)") == 1
