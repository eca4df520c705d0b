"""Text by element, against answers worked out by hand."""

import time

import pytest

from markscope.operators.element_text import element_text

CASES = [
    ("<div>a<p>b</p>c</div>", [(0, "div", "ac"), (1, "p", "b")]),
    ("<div> a <b>x</b> c\n</div>", [(0, "div", "a c"), (1, "b", "x")]),
    ("<p>a<br>b</p>", [(0, "p", "a b")]),
    ("<ul><li>1<li>2</ul>3", [(-1, "", "3"), (1, "li", "1"), (2, "li", "2")]),
    ("<i>a<b>c</i>d</b>e", [(-1, "", "de"), (0, "i", "a"), (1, "b", "c")]),
    ("<p>a</q>b</p>", [(0, "p", "ab")]),
    ("x<img src=a>y", [(-1, "", "xy")]),
    ("<title>a <b> c</title><p>d</p>", [(0, "title", "a <b> c"), (1, "p", "d")]),
    ("<p>a<script>var s='<b>'</script>b</p>", [(0, "p", "ab")]),
    ("<p>a<!-- <i> -->b &amp; c</p>", [(0, "p", "ab & c")]),
    ("<p>1 < 2 & 3</P >z", [(-1, "", "z"), (0, "p", "1 < 2 & 3")]),
    ("<p>   </p>", []),
    (None, []),
    ("", []),
]


@pytest.mark.parametrize("batch", [0])
def test_by_hand(spark, pages_df, batch):
    rows = [(i, "http://a/", html) for i, (html, _) in enumerate(CASES)]
    got = element_text(pages_df(rows)).collect()
    for i, (html, want) in enumerate(CASES):
        assert sorted((r.pos, r.tag, r.own_text) for r in got if r.page_id == i) == want, html


def test_many_and_deep_tags(spark, pages_df):
    n = 100_000
    rows = [(1, "u:x", "<p>a</p>" * n), (2, "u:x", "<b>" * n + "x" + "</b>" * n), (3, "u:x", "<i>" * n + "</u>" * n + "y"), (4, "u:x", "a" * n + "<" * n)]
    t = time.time()
    got = element_text(pages_df(rows)).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in got} == {1: n, 2: 1, 3: 1, 4: 1}
    assert time.time() - t < 60
