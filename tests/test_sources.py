"""WARC parsing, redirects, resume, sinks."""

import os

from pyspark.sql import functions as F

from markscope import sinks
from markscope.operators import redirects
from markscope.sources import warc

WARC_TEXT = ("WARC/1.0\r\nWARC-Type: warcinfo\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n"
             "WARC-Target-URI: http://a.example/\r\nContent-Type: application/http; msgtype=response\r\n\r\n"
             "HTTP/1.1 200 OK\r\nServer: nginx\r\nContent-Type: text/html\r\n\r\n"
             "<!DOCTYPE html>\r\n<html><body><p id=\"x\">hi</p></body></html>\r\n")


def test_warc_file_round_trip(spark, tmp_path):
    d = str(tmp_path)
    with open(os.path.join(d, "page-1.warc"), "w", newline="") as f:
        f.write(WARC_TEXT)
    with open(os.path.join(d, "pdf-2.warc"), "w", newline="") as f:
        f.write(WARC_TEXT.replace("Content-Type: text/html", "Content-Type: application/pdf"))
    recs = {r.warc: r for r in warc.parse_warc(warc.read_warc_dir(spark, d)).collect()}
    r = recs["page-1"]
    assert (r.resource_type, r.url, r.content_type, r.http_code, r.server) == \
        ("response", "http://a.example/", "text/html", "HTTP/1.1 200 OK", "nginx")
    assert r.html == '<!DOCTYPE html>\n<html><body><p id="x">hi</p></body></html>\n'
    assert r.not_html is False and recs["pdf-2"].not_html is True


def test_redirect_resolution(spark):
    rows = [("http://a.example/", "/New"), ("http://a.example/p", "/x"),
            ("http://a.example/", "http://B.example/"), ("http://a.example/", "//cdn.example/x")]
    df = spark.createDataFrame(rows, "o string, l string")
    got = [r[0] for r in df.select(redirects.resolve_target(F.col("o"), F.col("l"))).collect()]
    assert got == ["http://a.example/new", "http://a.example/p/x", "http://B.example/",
                   "http://a.example/cdn.example/x"]


def test_redirect_last_wins_and_used_once(spark):
    recs = spark.createDataFrame(
        [("r1", "http://o1/", "http://t/"), ("r2", "http://o2/", "http://t/"),
         ("p1", "http://t/", None), ("p2", "http://t/", None)], "warc string, url string, location string")
    m = redirects.redirect_map(recs).collect()
    assert [(r.target, r.origin) for r in m] == [("http://t/", "http://o2/")]
    pages = redirects.drop_redirect_records(recs).withColumn("original_url", F.lit(None).cast("string"))
    got = dict(redirects.attach_original_url(pages, redirects.origins(pages, redirects.redirect_map(recs)))
               .select("warc", "original_url").collect())
    assert got == {"p1": "http://o2/", "p2": None}
    assert [r.warc for r in redirects.resume_after(recs, "p2").collect()] == ["r1", "r2"]


def test_sinks_round_trip(spark, tmp_path):
    from markscope.plans import queries as Q
    sf = "/root/testdata/sf0.001"
    res = Q.measures.page_results(Q.measures.page_measures(Q.parsed_pages(spark, sf)),
                                  Q.message_totals(Q.classified_messages(spark, sf)), keep_keys=True)
    out = os.path.join(str(tmp_path), "results")
    sinks.write_page_results(res, out)
    back = spark.read.option("sep", "£").option("header", True).csv(out)
    assert back.count() == 50 and len(back.columns) == 27
    tot = os.path.join(str(tmp_path), "totals")
    sinks.write_totals(Q.rollup.totals(Q.all_events(spark, sf)), tot)
    assert spark.read.parquet(tot).filter("scope = 'all' AND metric = 'elements' AND key = 'p'").count() == 1


def test_analyze_corpus_batch_job(spark, tmp_path):
    from markscope.plans.batch import analyze_corpus
    from markscope.plans import queries as Q
    sf = "/root/testdata/sf0.001"
    out = analyze_corpus(spark, str(tmp_path), pages=spark.read.parquet(f"{sf}/pages.parquet"))
    results = spark.read.option("sep", "£").option("header", True).csv(out["results"])
    assert results.count() == 50
    totals = {(r.metric, r.key, r.subkey): r.n
              for r in spark.read.parquet(out["totals"]).filter("scope = 'all'").collect()}
    expect = {(r.metric, r.key, ""): r.n for r in Q.QUERIES["totals_flat"](spark, sf).collect()}
    # the batch job runs on the plain pages; totals_flat on the varied ones: compare elements only
    plain_el = {k: v for k, v in totals.items() if k[0] == "elements"}
    assert sum(plain_el.values()) == spark.read.parquet(out["page"]).selectExpr("sum(size(start_tags))").first()[0]
    assert set(expect) & set(totals)
    stats = dict(spark.read.option("header", True).csv(out["stats"]).collect())
    assert stats["records_seen"] == "50" and stats["successful"] == "50"


def test_analyze_corpus_from_warc(spark, tmp_path):
    from markscope.plans.batch import analyze_corpus
    d = str(tmp_path / "warc")
    os.makedirs(d)
    with open(os.path.join(d, "page-1.warc"), "w", newline="") as f:
        f.write(WARC_TEXT)
    redirect = WARC_TEXT.replace("http://a.example/", "http://old.example/").split("HTTP/1.1")[0] + \
        "HTTP/1.1 301 Moved\r\nLocation: http://a.example/\r\n\r\n"
    with open(os.path.join(d, "redir-0.warc"), "w", newline="") as f:
        f.write(redirect)
    out = analyze_corpus(spark, str(tmp_path / "out"), warc_dir=d)
    res = spark.read.option("sep", "£").option("header", True).csv(out["results"]).collect()
    assert [(r.warc, r.original_url, r.type, r.server) for r in res] == \
        [("page-1", "http://old.example/", "response", "nginx")]


def test_redirect_text_file_round_trip(spark, tmp_path):
    red = spark.createDataFrame([("http://t/", "http://o/"), ("http://u/", "http://p/")], "target string, origin string")
    out = str(tmp_path / "red")
    sinks.write_redirects(red, out, fmt="text")
    extra = str(tmp_path / "red" / "junk.txt")
    with open(extra, "w") as f:
        f.write("no separator here\na£££b£££c\n")
    back = sorted(tuple(r) for r in warc.read_redirect_file(spark, out).collect())
    assert back == [("http://t/", "http://o/"), ("http://u/", "http://p/")]


def test_merge_count_maps(spark):
    from markscope.operators import rollup
    df = spark.createDataFrame([({"p": 2, "a": 1}, {"p": 3, "b": 4})], "x map<string,bigint>, y map<string,bigint>")
    got = df.select(rollup.merge_count_maps(F.col("x"), F.col("y")).alias("m")).first().m
    assert got == {"p": 5, "a": 1, "b": 4}


def test_analyze_corpus_with_validator_results(spark, tmp_path):
    import json
    from markscope.operators import messages
    from markscope.plans.batch import analyze_corpus
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>y</p>"),
                                   (3, "http://c/", "<p>z</p>")], "page_id bigint, url string, html string")
    vpath = str(tmp_path / "v.json")
    recs = [{"page_id": 1, "url": "http://a/", "source": {"encoding": "utf-8"},
             "messages": [{"message": "Stray end tag P.", "messageid": "html5", "type": "error"},
                          {"message": "Stray end tag Q.", "messageid": "html5", "type": "error"},
                          {"message": "Bad value 1 for x.", "messageid": "77", "type": "info",
                           "subtype": "warning"}]},
            {"page_id": 2, "url": "http://b/", "source": {"encoding": "utf-8"}, "messages": []}]
    with open(vpath, "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs) + "\n")
    cat = messages.catalog_frame(spark, [
        *messages.entries_from_lines("html5", ["Stray end tag (.*)?."], ["Stray end tag X."]),
        *messages.entries_from_lines("general", ["bad value (.*) for (.*)\\."], ["Bad value X for Y."])])
    out = analyze_corpus(spark, str(tmp_path / "out"), pages=pages,
                         validator=messages.read_validator_results(spark, vpath), catalog=cat)
    res = {r.warc: (r.num_errors, r.num_warnings) for r in
           spark.read.option("sep", "£").option("header", True).csv(out["results"]).collect()}
    assert res == {"1": ("2", "1"), "2": ("0", "0")}          # page 3 has no validator result
    stats = dict(spark.read.option("header", True).csv(out["stats"]).collect())
    assert stats["excluded_validation"] == "1" and stats["successful"] == "2"
    tot = {(r.metric, r.key, r.subkey): r.n for r in spark.read.parquet(out["totals"])
           .filter("scope = 'all' AND metric LIKE '%error%' OR metric LIKE 'warning%'").collect()}
    assert tot[("errors", "html5 error - stray end tag x.", "")] == 2
    assert tot[("error_variables", "html5 error - stray end tag x.", "p")] == 1
    assert tot[("warnings", "warning - 77 - bad value x for y.", "")] == 1
    assert tot[("warning_variables", "warning - 77 - bad value x for y.", "1 | x")] == 1


def test_append_run_equals_one_run(spark, tmp_path):
    """Batches {1, 2} then {3}: one row per key in the totals, one funnel, all pages kept; a rerun adds nothing."""
    from markscope.plans.batch import analyze_corpus
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>y</p><b>z</b>"), (3, "http://c/", "<p id=a><i id=a>z</i></p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    two, one = str(tmp_path / "two"), str(tmp_path / "one")
    analyze_corpus(spark, two, pages=df.filter("page_id < 3"))
    out = analyze_corpus(spark, two, pages=df.filter("page_id = 3"), mode="append")
    want = analyze_corpus(spark, one, pages=df)
    cols = ["scope", "metric", "key", "subkey", "n"]
    read = lambda o: sorted(tuple(r) for r in spark.read.parquet(o["totals"]).select(cols).collect())
    assert read(out) == read(want) and ("all", "elements", "p", "", 3) in read(out)
    stats = lambda o: sorted(tuple(r) for r in spark.read.option("header", True).csv(o["stats"]).collect())
    assert stats(out) == stats(want)
    assert spark.read.parquet(out["page"]).count() == 3
    assert spark.read.option("sep", "£").option("header", True).csv(out["results"]).count() == 3


def test_resumed_warc_run_keeps_redirects(spark, tmp_path):
    """The redirect is in the first run's files, its target in the second's; a later one for the same target wins."""
    from markscope.plans.batch import analyze_corpus
    d = str(tmp_path / "warc")
    os.makedirs(d)

    def put(name, text):
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(text)
    head = WARC_TEXT.split("HTTP/1.1")[0]
    put("a-redir.warc", head.replace("http://a.example/", "http://old.example/") + "HTTP/1.1 301 Moved\r\nLocation: http://a.example/\r\n\r\n")
    out = analyze_corpus(spark, str(tmp_path / "out"), warc_dir=d)
    put("b-page.data", WARC_TEXT)
    put("c-redir.warc", head.replace("http://a.example/", "http://new.example/") + "HTTP/1.1 301 Moved\r\nLocation: http://a.example/\r\n\r\n")
    out = analyze_corpus(spark, str(tmp_path / "out"), warc_dir=d, last_file="a-redir", mode="append")
    res = spark.read.option("sep", "£").option("header", True).csv(out["results"]).collect()
    assert [(r.warc, r.original_url) for r in res] == [("b-page", "http://new.example/")]


def test_no_html_in_any_exchange(spark):
    """Joins and groups of the WARC path shuffle narrow rows only."""
    from markscope.plans import queries as Q
    for name in ("redirect_join", "warc_page_results"):
        plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "html#" not in "".join(x for x in plan.splitlines() if "SortMergeJoin" in x)
