"""Differential test: the Java (Spark) and RE2 (DuckDB) spellings tokenise alike.

Random markup-like strings are parsed by both engines; start tags, end tags,
comments, text, doctype and attribute tokens must be equal.
"""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from markscope.functions import markup as M
from markscope.operators import facts
from markscope.plans import oracle

PIECES = ["<", ">", "</", "<!--", "-->", '"', "'", "=", "/", " ", "\n", "\t", "a", "p", "b", "img",
          "script", "style", "SCRIPT", "<title>", "</title>", "<textarea", "o:p", "my-tag", "&#", "&#x41;", "&#8217;", "&eacute;", "<!", "?", "!DOCTYPE html", "<!doctype  html >", "href", "src", "x", "é",
          "&amp;", "&lt;", "&nbsp;", "id", "<?xml?>", "<br/>", "<a href=x>", "<p class='c'>",
          '<img src="a.png" alt="">', "</p>", "</script>", "</style >", " ", "\r"]


def _corpus(n=400, seed=7):
    rng = random.Random(seed)
    return [(i, "http://a.example/", "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))))
            for i in range(n)]


def test_spark_and_duckdb_tokenise_alike(spark, pages_df):
    rows = _corpus()
    parsed = facts.parse_pages(pages_df(rows)).select(
        "page_id", "start_tags", "end_tags", "comments", "text", "doctype",
        F.transform("start_tags", M.attr_tokens).alias("attr_tokens"))
    got = {r.page_id: (list(r.start_tags), list(r.end_tags), list(r.comments), r.text, r.doctype,
                       [list(a) for a in r.attr_tokens]) for r in parsed.collect()}
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    sql = ("WITH " + oracle.base_ctes(False) +
           f"\nSELECT page_id, start_tags, end_tags, comments, text, doctype, "
           f"list_transform(start_tags, lambda r: {oracle.attr_tokens('r')}) AS attr_tokens FROM parsed0")
    want = {r[0]: (list(r[1]), list(r[2]), list(r[3]), r[4], r[5], [list(a) for a in r[6]])
            for r in con.sql(sql).fetchall()}
    assert set(got) == set(want)
    bad = [k for k in got if got[k] != want[k]]
    assert not bad, (bad[:3], [(got[k], want[k]) for k in bad[:2]])


URL_PIECES = ["http", "https", ":", "//", "/", ".", "#", "?", "&", "a", "b", "x.example", " ", "mailto:",
              "javascript:", "PNG", ".png", ".php", ".htm", ".html", "=", "1", "é", "\n", "{", "^", "'",
              "verylongext", "HTTP", "..", "-", "+"]


def test_link_and_image_rules_alike(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["http", "https", "HTTP"]),
             "".join(rng.choice(URL_PIECES) for _ in range(rng.randint(0, 8)))) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, scheme string, s string")
    h, sc = F.col("s"), F.col("scheme")
    got = {r.id: (r.i, r.p, r.f) for r in df.select(
        "id", M.link_is_internal(h, sc).alias("i"), M.link_protocol(h, sc).alias("p"),
        M.image_format(h).alias("f")).collect()}
    con = duckdb.connect()
    con.register("t", pd.DataFrame(rows, columns=["id", "scheme", "s"]))
    sql = (f"SELECT id, {oracle.link_internal('s', 'scheme')}, {oracle.link_protocol('s', 'scheme')}, "
           f"{oracle.image_format('s')} FROM t")
    want = {r[0]: (r[1], r[2], r[3]) for r in con.sql(sql).fetchall()}
    bad = [(rows[k][1], rows[k][2], got[k], want[k]) for k in got if got[k] != want[k]]
    assert not bad, bad[:5]
