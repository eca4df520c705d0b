"""Runs that add up: levelled totals, seen URLs, sketches, clustered totals, WARC folders read in splits and as a stream."""

import os
import random

import pytest
from pyspark.sql import functions as F

from markscope import sinks
from markscope.operators import redirects, rollup
from markscope.sources import warc
from markscope.streaming import streams


def _totals(spark, k):
    return spark.createDataFrame([("all", "elements", "p", "", k + 1), ("all", "elements", f"t{k % 5}", "", 1)], streams.TOTALS_SCHEMA)


def _read(spark, out):
    return {r.key: r.n for r in streams.read_totals(spark, out).collect()}


def _want(n):
    return {"p": n * (n + 1) // 2} | {f"t{i}": len(range(i, n, 5)) for i in range(min(n, 5))}


def test_runs_are_merged_by_level(spark, tmp_path):
    out = str(tmp_path / "totals")
    for k in range(50):
        streams.append_run(_totals(spark, k).coalesce(1), out, k)
        live = streams.live_runs(spark, out)
        assert live[0][0] == 0 and live[-1][1] == k and all(a[1] + 1 == b[0] for a, b in zip(live, live[1:]))
    assert live == [(0, 15), (16, 31), (32, 47), (48, 48), (49, 49)]
    assert _read(spark, out) == _want(50)


def test_crash_between_steps_neither_loses_nor_doubles(spark, tmp_path):
    out = str(tmp_path / "totals")
    for k in range(7):
        streams.append_run(_totals(spark, k), out, k)
    # batch 7 was written, then the job died before its runs were merged
    wide = streams.FAN
    try:
        streams.FAN = 1 << 40
        streams.append_run(_totals(spark, 7), out, 7)
    finally:
        streams.FAN = wide
    assert streams.live_runs(spark, out)[-1] == (7, 7) and _read(spark, out) == _want(8)
    streams.append_run(_totals(spark, 7), out, 7)        # the stream runs the batch again
    assert streams.live_runs(spark, out) == [(0, 3), (4, 7)] and _read(spark, out) == _want(8)
    streams.append_run(_totals(spark, 6), out, 6)        # a batch that is merged already: its own run is covered
    assert _read(spark, out) == _want(8)


def _pages(spark, path, rows, schema="page_id long, url string, html string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_smallest_page_wins_in_any_order(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, f"http://a/{i % 40}" if i % 11 else None, "<p>x") for i in range(200)]
    rnd.shuffle(rows)
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k in range(0, 200, 50):      # one run for each file: state is taken up again
        _pages(spark, src, rows[k:k + 50])
        streams.dedupe_urls(streams.page_stream(spark, src, max_files=1), out, ckpt).awaitTermination()
    want = {}
    for i, url, _ in rows:
        want[url] = min(want.get(url, str(i)), str(i))      # the first by name, as text
    got = streams.read_winners(spark, out).collect()
    assert {r.url: str(r.page_id) for r in got} == want and len(got) == len(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_winners_by_period_and_state_that_goes(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "page_id long, url string, html string, day int"
    def start():
        raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        rows = raw.selectExpr("page_id", "CAST(page_id AS string) AS warc", "url", "timestamp_seconds(day * 86400) AS crawled")
        q = streams.dedupe_urls(rows, out, ckpt, crawl_time="crawled", within="10 days", delay="1 day")
        q.awaitTermination()
        return q
    _pages(spark, src, [(5, "u", "", 1), (3, "u", "", 2), (9, "v", "", 2)], schema)
    start()
    _pages(spark, src, [(4, "u", "", 25), (8, "v", "", 40)], schema)
    start()
    _pages(spark, src, [(1, "u", "", 3)], schema)             # too late: its period is gone
    q = start()
    got = sorted((r.url, r.page_id) for r in streams.read_winners(spark, out).collect())
    assert got == [("u", 3), ("u", 4), ("v", 8), ("v", 9)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_sketches_merge_within_their_error(spark, tmp_path):
    path = str(tmp_path / "s")
    n = 300_000
    for k, (lo, hi) in enumerate([(0, 200_000), (100_000, n)]):
        keys = spark.range(lo, hi).select(F.lit("elements").alias("metric"), F.concat(F.lit("k"), "id").alias("key"))
        few = spark.range(7 + k).select(F.lit("errors").alias("metric"), F.col("id").cast("string").alias("key"))
        sinks.write_sketches(rollup.distinct_sketches(keys.unionByName(few)), path, "append" if k else "overwrite", k)
    sinks.write_sketches(rollup.distinct_sketches(few), path, "append", 1 + 1)
    got = {r.stat: r.value for r in rollup.sketch_stats(spark.read.parquet(path)).collect()}
    assert got["different_errors"] == 8 and got["different_warnings"] == 0
    assert abs(got["different_elements"] / n - 1) < rollup.SKETCH_ERROR


def test_totals_are_clustered_by_key(spark, tmp_path):
    path = str(tmp_path / "totals")
    rows = spark.range(60_000).select(F.lit("all").alias("scope"), F.lit("attributes").alias("metric"), F.concat(F.lit("tag"), F.col("id") % 3000).alias("key"),
                                      F.concat(F.lit("a"), F.col("id").cast("string")).alias("subkey"), F.col("id").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")    # small data would be put into one file
    try:
        sinks.write_totals(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    table = sinks.read_totals(spark, path)
    files = table.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("lo").collect()
    assert len(files) >= 4 and all(a.hi <= b.lo for a, b in zip(files, files[1:]))
    holds = table.groupBy("key").agg(F.count_distinct("_metadata.file_path").alias("n"))
    assert holds.filter("n > 1").count() < len(files) and holds.filter("n > 2").count() == 0
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,tag7)]" in table.filter("key = 'tag7'")._jdf.queryExecution().toString()


@pytest.fixture()
def warc_files(spark, tmp_path):
    """2,500 records in one file, then some more in a second one with CRLF, ids and odd records."""
    d = str(tmp_path / "crawl")
    os.makedirs(d)
    one = "".join(f"WARC/1.0\nWARC-Type: warcinfo\n\nWARC/1.0\nWARC-Type: response\nWARC-Target-URI: http://a/{k}\n\nHTTP/1.1 200 OK\nServer: s\nContent-Type: text/html\n\n"
                  f"<p>page {k}</p>\n{'é' * (k % 50)}\n\n" for k in range(2500))
    with open(os.path.join(d, "one.warc"), "w", encoding="utf-8") as f:
        f.write(one)
    return d


def test_one_large_file_is_read_in_splits(spark, warc_files):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        records = warc.parse_records(warc.read_warc_records(spark, warc_files))
        assert records.rdd.getNumPartitions() >= 6
        got = {r.url: r for r in records.collect()}
        assert records.count() == 2500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(got) == {f"http://a/{k}" for k in range(2500)} and len({r.warc for r in got.values()}) == 2500
    for k in (0, 1, 49, 1234, 2499):
        r = got[f"http://a/{k}"]
        assert (r.http_code, r.server, r.content_type, r.html.rstrip("\n")) == ("HTTP/1.1 200 OK", "s", "text/html", (f"<p>page {k}</p>\n" + "é" * (k % 50)).rstrip("\n"))
        assert r.warc.startswith("one#")


def test_odd_records(spark, tmp_path):
    d = str(tmp_path)
    with open(os.path.join(d, "b.warc"), "w", newline="") as f:
        f.write("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://b/\r\n\r\nHTTP/1.1 301 Moved\r\nLocation: http://c/\r\n\r\n\r\n"
                "WARC/1.0\r\nWARC-Type: request\r\n\r\nGET / HTTP/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n")
    open(os.path.join(d, "empty.warc"), "w").close()
    got = warc.parse_records(warc.read_warc_records(spark, d)).collect()
    assert sorted((r.url or "", r.location or "", r.html) for r in got) == [("", "", ""), ("http://b/", "http://c/", "")]
    assert "b#<urn:x>" in {r.warc for r in got}
    assert warc.read_warc_records(spark, d, glob="empty*").count() == 0
    assert redirects.drop_redirect_records(warc.parse_records(warc.read_warc_records(spark, d))).count() == 1


def test_stream_takes_only_new_files(spark, warc_files, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        q = (streams.warc_stream(spark, warc_files, max_files=1).select("url", "html").writeStream.format("parquet").outputMode("append")
             .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(out)

    assert run().count() == 2500
    with open(os.path.join(warc_files, "two.warc"), "w") as f:
        f.write("WARC/1.0\nWARC-Type: response\nWARC-Target-URI: http://new/\n\nHTTP/1.1 200 OK\n\n<p>new\n")
    again = run()
    assert again.count() == 2501 and again.filter("url = 'http://new/'").first().html == "<p>new\n"
    assert run().count() == 2501


def test_stream_input_is_many_files_in_few_batches(spark, tmp_path):
    from markscope.plans import queries as Q
    text = F.expr("concat_ws('', transform(sequence(1, 1024), i -> sha2(concat(id, ' ', i), 256)))")     # 64 KB that hardly compress
    spark.range(512).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), text.alias("html")).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    seen = []

    def starter(pages, out, checkpoint):
        def write_batch(batch, batch_id):
            files = batch.select("page_id", F.input_file_name().alias("f"))
            seen.append((files.select("f").distinct().count(), {r.page_id for r in files.collect()}))
        return pages.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    Q._stream(spark, str(tmp_path), starter, "stream-files", read=lambda *_: None)
    assert sum(n for n, _ in seen) >= 8 and max(n for n, _ in seen) > 1 and len(seen) <= 8
    assert sorted(i for _, ids in seen for i in ids) == list(range(512))
