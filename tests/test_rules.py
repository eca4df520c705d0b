"""Scalar rule fixtures (link, image, doctype, sizes, status, tokens)."""

from pyspark.sql import functions as F

from markscope.functions import markup as M
from markscope.operators import facts, measures


def _eval(spark, exprs, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*exprs).collect()]


LINK_CASES = [
    ("http", "http://other.example/", True, False, "http"),
    ("http", "https://a.example/", True, False, "http"),
    ("https", "http://a.example/", False, False, "http"),
    ("http", "/x", True, False, "http"),
    ("http", "./x", True, False, "http"),
    ("http", "../x", True, False, "http"),
    ("http", "#top", True, True, "http"),
    ("http", "page.html", False, False, "n/a"),
    ("http", "", False, False, "n/a"),
    ("http", "MAILTO:a@b.example", False, False, "mailto"),
    ("http", "javascript:void(0)", False, False, "javascript"),
    ("http", "javascript:f('a b')", False, False, "n/a"),
    ("http", "mailto:", False, False, "n/a"),
    ("https", "//cdn.example/x", True, False, "https"),
]


def test_link_rule(spark):
    rows = [(s, h) for s, h, *_ in LINK_CASES]
    h, s = F.col("href"), F.col("scheme")
    got = _eval(spark, [M.link_is_internal(h, s), h.startswith("#") & M.link_is_internal(h, s),
                        M.link_protocol(h, s)], rows, "scheme string, href string")
    assert got == [tuple(c[2:]) for c in LINK_CASES]


IMAGE_CASES = [
    ("", "empty"), ("a/b.PNG", ".png"), ("b.jpg?w=3", ".jpg"), ("b.gif&x=1", ".gif"),
    ("b.html", "hyperlink"), ("b.htm", ".htm"), ("http://x.example/img", "hyperlink"),
    (".png", "n/a"), ("noext", "n/a"), ("b.x", "n/a"), ("b.verylong", "hyperlink"),
    ("pic.php?id=3", "hyperlink"),
]


def test_image_rule(spark):
    got = _eval(spark, [M.image_format(F.col("src"))], [(s,) for s, _ in IMAGE_CASES], "src string")
    assert [g[0] for g in got] == [c[1] for c in IMAGE_CASES]
    assert _eval(spark, [M.image_format(F.col("src"))], [(None,)], "src string") == [("empty",)]


def test_sizes_and_charsets(spark, pages_df):
    html = "<p>é</p><!-- c -->"
    parsed = facts.parse_pages(pages_df([(1, "http://a.example/", html)]))
    row = parsed.select("file_size", "text", "comments").first()
    assert row.file_size == 19 and row.text == "é" and row.comments == [" c "]
    cases = [("é", "UTF-8"), ("é", "ISO-8859-1"), ("é", "koi8-r"), ("é\U0001F600", "UTF-16LE"),
             ("é\U0001F600", "UTF-16"), ("", "UTF-16"), ("é\U0001F600", "UTF-32"), ("Жа", "windows-1251"),
             ("中é", "gb2312"), ("あa", "Shift_JIS"), ("한", "euc-kr"), ("中", "GBK"), ("x", "no-such-charset"), ("x", None)]
    from markscope.session import java_charsets_allowed
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    with java_charsets_allowed(spark):
        plan = [M.byte_size(F.col("t"), F.col("c"))]
        got = _eval(spark, plan, cases, "t string, c string")
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before
    # worked out by hand; a character that the charset lacks counts as "?"
    assert [g[0] for g in got] == [2, 1, 1, 6, 8, 0, 8, 2, 4, 3, 2, 2, None, None]


def test_status_order(spark, pages_df):
    rows = [(1, "http://a.example/", "<p>x</p>"), (2, "http://a.example/", ""),
            (3, "not a url", "<p>x</p>"), (4, "http://a.example/", "no tags at all"),
            (5, "http://a.example/", '<meta charset="koi8-r"><p>x</p>'), (6, "http://a.example/", '<meta charset="gb2312"><p>x</p>'),
            (7, "http://a.example/", '<meta charset="no-such-charset"><p>x</p>'), (8, "http://a.example/", None)]
    st = measures.with_status(facts.parse_pages(pages_df(rows)))
    got = dict(st.select("page_id", "status").collect())
    assert got == {1: "ok", 2: "failed_no_bytes", 3: "failed_parsing", 4: "ok", 5: "ok", 6: "ok",
                   7: "failed_validation", 8: "failed_no_bytes"}


def test_doctype_and_html5(spark, pages_df):
    rows = [(1, "http://a/", "<!DOCTYPE  HTML ><p>"), (2, "http://a/", "<p>none</p>"),
            (3, "http://a/", '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0//EN"><p>')]
    got = {r.page_id: (r.doctype, r.is_html5) for r in facts.parse_pages(pages_df(rows)).collect()}
    assert got[1] == ("<!doctype html>", True)
    assert got[2] == ("This document does not declare its DOCTYPE", False)
    assert got[3][1] is False and got[3][0].startswith("<!doctype html public")


def test_tokens_skip_comments_and_script(spark, pages_df):
    html = '<div><!-- <b> --><script>var t="</p><i>";</script><a href="x>y" title=\'q\'>t</a></div>'
    parsed = facts.parse_pages(pages_df([(1, "http://a/", html)]))
    tags = [r.tag for r in facts.elements(parsed).orderBy("pos").collect()]
    assert tags == ["div", "script", "a"]
    attrs = {(r.attr, r.value) for r in facts.attributes(parsed).collect()}
    assert attrs == {("href", "x>y"), ("title", "q")}
    assert parsed.first().end_tags == ["a", "div"]


def test_duplicate_attribute_counts_once(spark, pages_df):
    parsed = facts.parse_pages(pages_df([(1, "http://a/", '<p align="left" ALIGN="right">x</p>')]))
    rows = facts.attributes(parsed).collect()
    assert [(r.attr, r.value) for r in rows] == [("align", "left")]


def test_tokenizer_survives_huge_and_unterminated_tags(spark, pages_df):
    huge = "<a " + "x" * 50000 + ">"
    unterminated = '<a title="' + "y" * 50000
    many = "<p " + " ".join(f'a{i}="v"' for i in range(20000)) + ">"
    parsed = facts.parse_pages(pages_df([(1, "http://a/", huge), (2, "http://a/", unterminated),
                                         (3, "http://a/", many)]))
    got = dict(parsed.select("page_id", F.size("start_tags")).collect())
    assert got == {1: 1, 2: 0, 3: 1}


def test_text_entities_and_blanks(spark, pages_df):
    html = "<p>a &amp;lt; b</p>\n<p>  c\t\td  </p><style>x{}</style>&copy;"
    parsed = facts.parse_pages(pages_df([(1, "http://a/", html)]))
    assert parsed.first().text == "a &lt; bc d©"


def test_scrub_removes_line_breaks(spark):
    got = _eval(spark, [M.scrub(F.col("s"))], [("a\r\nb\u0085c d e\u0000f",)], "s string")
    assert got == [("abcdef",)]
