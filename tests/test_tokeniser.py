"""The tokeniser against answers worked out by hand from the HTML rules (no shared pattern)."""

import pytest
from pyspark.sql import functions as F

from markscope.functions import markup as M
from markscope.operators import facts, lint

# html, element names, end tags, comments, text
CASES = [
    ("<my-widget data-x=1>a</my-widget>", ["my-widget"], ["my-widget"], [], "a"),
    ("<o:p>x</o:p><font-face>", ["o:p", "font-face"], ["o:p"], [], "x"),
    ('<script>var s="<!--";</script><p>a</p><p>b</p><!-- c --><p>d</p>', ["script", "p", "p", "p"], ["p", "p", "p"], [" c "], "abd"),
    ("<script><!--\nx<b>\n//--></script><i>y</i>", ["script", "i"], ["i"], [], "y"),
    ('<p title="</i>">x</p>', ["p"], ["p"], [], "x"),
    ('<p title="<!-- no -->">x</p>', ["p"], ["p"], [], "x"),
    ("<title>a <b> c</title><textarea><i></textarea>", ["title", "textarea"], [], [], "a <b> c<i>"),
    ("<STYLE>p{}</STYLE ><p>x", ["style", "p"], [], [], "x"),
    ("a<!-- open <p>x", [], [], [" open <p>x"], "a"),
    ("<p>a</p><script>never closed <b>", ["p", "script"], ["p"], [], "a"),
    ("<br/><img src=a/b>x", ["br", "img"], [], [], "x"),
    ("1 < 2 <p>3", ["p"], [], [], "1 < 23"),
    ("caf&eacute; &#8217; &#x27; &amp;lt; &nope; &#0; &copy", [], [], [], "café ’ ' &lt; &nope; � &copy"),
    ("<!DOCTYPE html><?php x ?>t", [], [], [], "t"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_by_hand(spark, pages_df, case):
    html, names, ends, comments, text = CASES[case]
    r = facts.parse_pages(pages_df([(1, "http://a.example/", html)])).select(
        F.transform("start_tags", M.tag_name).alias("names"), "end_tags", "comments", "text").first()
    assert (list(r["names"]), list(r["end_tags"]), list(r["comments"]), r["text"]) == (names, ends, comments, text)


def test_attributes_and_messages(spark, pages_df):
    df = facts.parse_pages(pages_df([(1, "http://a.example/", "<my-widget data-x=1><font-face>"), (2, "http://a.example/", '<p title="</i>">x</p>'),
                                     (3, "http://a.example/", "<p a='&lt;&amp;lt;' b=\"&#65;&#x1F600;\">"), (4, "http://a.example/", "<title>a <b></title><textarea><i></textarea>")]))
    got = {(r.page_id, r.tag, r.attr, r.value) for r in facts.attributes(df).collect()}
    assert got == {(1, "my-widget", "data-x", "1"), (2, "p", "title", "</i>"), (3, "p", "a", "<&lt;"), (3, "p", "b", "A\U0001F600")}
    msgs = {(r.page_id, r.message) for r in lint.lint_messages(df).collect()}
    assert not any("font" in m and "obsolete" in m or "tray" in m for _, m in msgs)
    assert not any(p == 4 and "nclosed" in m for p, m in msgs)


def test_hostile_lengths(spark, pages_df):
    rows = [(1, "u:x", "<" + "a" * 100_000), (2, "u:x", "<p " + "x=\"" * 50_000), (3, "u:x", "<!--" * 50_000), (4, "u:x", "<script>" + "<b>" * 50_000),
            (5, "u:x", "&" * 30_000), (6, "u:x", "<p>" * 50_000)]
    n = {r.page_id: r.n for r in facts.parse_pages(pages_df(rows)).select("page_id", F.size("start_tags").alias("n"), F.length("text").alias("t")).collect()}
    assert n[6] == 50_000 and n[4] == 1 and n[1] == 0
