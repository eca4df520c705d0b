"""Skewed inputs give whole, exact results; a stream resumes after the files it has seen."""

import os
import re
from collections import Counter

from pyspark.sql import functions as F

from markscope.operators import facts, lint, rollup
from markscope.streaming import streams


def _brute_tags(html: str) -> Counter:
    return Counter(m.lower() for m in re.findall(r"<([a-zA-Z][a-zA-Z0-9]*)[^>]*>", html))


def test_hot_page_and_hot_key(spark, pages_df):
    # one page holds about a third of all elements; the tag "p" is hot everywhere
    hot = "<html><body>" + "<p>x" * 30000 + "</body></html>"
    rows = [(0, "http://hot.example/", hot)] + \
           [(i, f"http://p{i}.example/", "<div><p>a</p><b>b</b><i id='x'></i></div>" * 300) for i in range(1, 101)]
    parsed = facts.parse_pages(pages_df(rows))
    got = {(r.page_id, r.tag): r.n for r in facts.elements(parsed).groupBy("page_id", "tag")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {(pid, t): n for pid, _, html in rows for t, n in _brute_tags(html).items()}
    assert got == want
    # lint on the hot page: 30000 unclosed-free p (optional end tag), no stray
    msgs = {(r.page_id, r.message): r.n for r in lint.lint_messages(parsed).collect()}
    assert (1, "Duplicate ID x.") in msgs and msgs[(1, "Duplicate ID x.")] == 299
    assert not any(pid == 0 for pid, _ in msgs if _ .startswith("Unclosed"))
    st = parsed.withColumn("status", F.lit("ok"))
    totals = {(r.metric, r.key): r.n for r in rollup.totals(rollup.markup_events(st))
              .filter("scope = 'all'").collect()}
    assert totals[("elements", "p")] == 30000 + 100 * 300


def test_hot_url_dedupe(spark, pages_df):
    rows = [(i, "http://same.example/" if i % 3 == 0 else f"http://u{i}.example/", "<p>x</p>")
            for i in range(300)]
    df = pages_df(rows)
    kept = rollup.dedupe_urls(df).select("page_id", "url").collect()
    assert len(kept) == 201
    first_same = min((str(i) for i in range(0, 300, 3)))
    assert [r.page_id for r in kept if r.url == "http://same.example/"] == [int(first_same)]


def _write_pages(src, path, lo, hi):
    import pyarrow as pa
    import pyarrow.parquet as pq
    pdf = src.filter((F.col("page_id") >= lo) & (F.col("page_id") < hi)).toPandas()
    pq.write_table(pa.Table.from_pandas(pdf, preserve_index=False), path)


def test_stream_resumes_after_seen_files(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    d = str(tmp_path / "in")
    os.makedirs(d)
    _write_pages(src, os.path.join(d, "pages-0.parquet"), 0, 20)
    _write_pages(src, os.path.join(d, "pages-1.parquet"), 20, 35)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream = streams.page_stream(spark, d, glob="pages-*.parquet", max_files=1)
    streams.append_page_counts(stream, out, ckpt).awaitTermination()
    first = spark.read.parquet(out)
    assert sorted(r.batch_id for r in first.select("batch_id").distinct().collect()) == [0, 1]
    assert first.select("page_id").distinct().count() == 35
    _write_pages(src, os.path.join(d, "pages-2.parquet"), 35, 1000)
    stream = streams.page_stream(spark, d, glob="pages-*.parquet", max_files=1)
    streams.append_page_counts(stream, out, ckpt).awaitTermination()
    after = spark.read.parquet(out)
    assert sorted(r.batch_id for r in after.select("batch_id").distinct().collect()) == [0, 1, 2]
    assert after.filter("batch_id = 2").select("page_id").distinct().count() == 15
    assert after.select("page_id").distinct().count() == 50


def test_null_urls_share_one_page(spark, pages_df):
    rows = [(1, None, "<p>"), (2, None, "<p>"), (3, "http://x/", "<p>")]
    assert sorted(r.page_id for r in rollup.dedupe_urls(pages_df(rows)).collect()) == [1, 3]
