"""Lint rules, catalogue classification (incl. shadowing), validator results."""

import json
import os

from pyspark.sql import functions as F

from markscope.operators import facts, lint, messages


def _lint(pages_df, html):
    parsed = facts.parse_pages(pages_df([(1, "http://a/", html)]))
    return sorted((r.message, r.n) for r in lint.lint_messages(parsed).collect())


def test_lint_fixtures(spark, pages_df):
    base = '<!DOCTYPE html><meta charset="utf-8">'
    assert ("Duplicate ID a.", 1) in _lint(pages_df, base + '<p id="a"><i id="a">x</i></p>')
    assert ("Element img is missing required attribute alt.", 1) in _lint(pages_df, base + '<img src="x.png">')
    assert ("The center element is obsolete. Use CSS instead.", 1) in _lint(pages_df, base + "<center>x</center>")
    assert ("The align attribute on the p element is obsolete. Use CSS instead.", 1) in \
        _lint(pages_df, base + '<p align="left">x</p>')
    assert ("Unclosed element b.", 1) in _lint(pages_df, base + "<p><b>x</p>")
    assert ("Stray end tag i.", 1) in _lint(pages_df, base + "<p>x</p></i>")
    got = _lint(pages_df, '<img src="a.png" alt="" usemap="#m"><label for="nope">x</label>')
    assert ("The character encoding was not declared. Proceeding using windows-1252.", 1) in got
    assert ("Start tag seen without seeing a doctype first. Expected <!DOCTYPE html>.", 1) in got
    assert any(m.startswith("The hash-name reference in attribute usemap referred to m,") for m, _ in got)
    assert any(m.startswith("The for attribute referenced nope,") for m, _ in got)
    clean = _lint(pages_df, base + '<map name="m"></map><img src="a" alt="" usemap="#m"><b id="x"></b>'
                                   '<label for="x">y</label>')
    assert clean == []


def _classify(spark, rows, catalogs):
    """Classes in the order of ``rows``; ``catalogs`` holds entries by family, or a catalogue table."""
    if isinstance(catalogs, dict):
        catalogs = messages.catalog_frame(spark, [e for entries in catalogs.values() for e in entries])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, message_id string, message string")
    got = messages.classify(df, catalogs).orderBy("i").collect()
    assert len(got) == len(rows)
    return [(r.canonical, r.variables) for r in got]


def test_classification_first_match_and_shadowing(spark):
    # a generic entry before a specific one wins (as in the reference's catalogue order)
    cat = messages.entries_from_lines("html5", ["End tag (.*)?.", "Stray end tag (.*)?.", "Duplicate ID (.*)?."],
                                      ["End tag X.", "Stray end tag X.", "Duplicate ID X."])
    got = _classify(spark, [("error", "html5", "Duplicate ID top."), ("error", "html5", "Stray end tag p."),
                            ("error", "html5", "nothing matches this"),
                            ("warning", "html5", "Duplicate ID Q.")], {"html5": cat})
    assert got[0] == ("html5 error - duplicate id x.", "top")
    assert got[1] == ("html5 error - end tag x.", "p")
    assert got[2] == ("html5 error - nothing matches this", None)
    assert got[3] == ("warning html5 - duplicate id x.", "q")


def test_general_family_and_groupless(spark):
    cat = messages.entries_from_lines("general", ['there is no attribute (.*)?', "start tag was here"],
                                      ["there is no attribute X", "start tag was here"])
    got = _classify(spark, [("error", "108", 'there is no attribute "FOO"'),
                            ("error", "65", "start tag was here")], {"general": cat})
    assert got[0] == ("error - 108 - there is no attribute x", '"foo"')
    assert got[1] == ("error - 65 - start tag was here", None)


def test_lint_catalogue_classifies_every_rule(spark):
    cat = messages.lint_catalog()
    assert len(cat) == len(lint.LINT_RULES)
    got = _classify(spark, [("error", "html5", "Element img is missing required attribute alt.")],
                    {"html5": cat})
    assert got == [("html5 error - element x is missing required attribute y.", "img | alt")]


def test_validator_results_json(spark, tmp_path):
    rec = {"page_id": 7, "url": "http://a/", "forced": False,
           "messages": [{"lastLine": 1, "lastColumn": 2, "message": "Duplicate ID a.", "messageid": "html5",
                         "type": "error"},
                        {"message": "Consider x.", "messageid": "html5", "type": "info", "subtype": "warning"},
                        {"message": "ignored", "messageid": "html5", "type": "info"}],
           "source": {"encoding": "utf-8", "type": "text/html"}}
    path = os.path.join(str(tmp_path), "v.json")
    with open(path, "w") as f:
        f.write(json.dumps(rec) + "\n")
    res = messages.read_validator_results(spark, path)
    msgs = messages.validator_messages(res).orderBy("kind").collect()
    assert [(m.kind, m.message) for m in msgs] == [("error", "Duplicate ID a."), ("warning", "Consider x.")]
    assert messages.validator_charsets(res).first().encoding == "utf-8"
    assert messages.validator_messages(res).filter(F.col("last_line") == 1).count() == 1


def test_validator_join_sets_status_and_charset(spark, pages_df):
    from markscope.operators import measures
    parsed = facts.parse_pages(pages_df([(1, "http://a/", "<p>x</p>"), (2, "http://a/", "<p>y</p>"),
                                         (3, "http://a/", "<p>z</p>")]))
    v = spark.createDataFrame([(1, "UTF-8"), (3, "koi8-r")], "page_id bigint, encoding string")
    got = {r.page_id: (r.status, r.charset) for r in measures.with_status(parsed, v).collect()}
    assert got == {1: ("ok", "utf-8"), 2: ("failed_validation", None), 3: ("ok", "koi8-r")}


def test_catalog_from_files(spark, tmp_path):
    pats = os.path.join(str(tmp_path), "p.txt")
    msgs = os.path.join(str(tmp_path), "m.txt")
    with open(pats, "w") as f:
        f.write("Bad value (.*)? for attribute (.*)?.\nno group here\n")
    with open(msgs, "w") as f:
        f.write("Bad value X for attribute Y.\nNo group here\n")
    cat = messages.read_catalog_files(spark, "general", pats, msgs)
    assert [(e.idx, e.pattern, e.message, e.n_groups) for e in cat.orderBy("idx").collect()] == [
        (0, "bad value (.*)? for attribute (.*)?.", "bad value x for attribute y.", 2), (1, "no group here", "no group here", 0)]
    got = _classify(spark, [("warning", "42", "Bad value FOO for attribute href.")], cat)
    assert got == [("warning - 42 - bad value x for attribute y.", "foo | href")]


def test_multi_valued_references(spark, pages_df):
    base = '<!DOCTYPE html><meta charset="utf-8">'
    got = _lint(pages_df, base + '<th id="h1">a</th><td headers="h1  h2" aria-describedby="h1">x</td>')
    assert got == [("The headers attribute referenced h2, but there is no element with an id attribute "
                    "with that value.", 1)]


def test_large_catalogue_first_match(spark):
    n = 3000
    pats = [f"rule {i} on (.*) at (.*)\\." for i in range(n)] + ["rule (.*) on (.*)"]
    msgs = [f"Rule {i} on X at Y." for i in range(n)] + ["Rule X on Y"]
    cat = messages.entries_from_lines("html5", pats, msgs)
    got = _classify(spark, [("error", "html5", f"Rule {n - 1} on Foo at Bar."),
                            ("error", "html5", "Rule 7 on A at B."),
                            ("warning", "html5", "Rule zz on Q")], {"html5": cat})
    assert got[0] == (f"html5 error - rule {n - 1} on x at y.", "foo | bar")
    assert got[1] == ("html5 error - rule 7 on x at y.", "a | b")
    assert got[2] == ("warning html5 - rule x on y", "zz | q")


ODD_PATTERNS = ["(.*)", "(a)", "ab(c|d)", "x(.*)y|long alternative (z)", "[abc](d)e*fgh", "colou?r of (.*)", "so+ long (.)", "a{2,3}b(c)", "(?i)FLAG(s)",
                "\\x41bcdef(g)", "(?:no|group) at all", "(?<name>named) group here", "dot.in the (middle)", "^anchored (.*)$", "esc\\(aped\\) (paren)",
                "nested ((deep) group) end", "[a[bc]de]fgh (i)", "class with [)(] paren (x)", "\\d+ digits of (.*)", "lazy (.*?) end of it", "plus (a)+ then more text",
                "quoted \\Q(.*)\\E literal (x)"]


def test_literals_stand_in_every_match(spark):
    rows = [(i, p) for i, p in enumerate(ODD_PATTERNS)]
    got = {r.p: (r.lit, r.n) for r in spark.createDataFrame(rows, "i int, p string").select(
        "p", messages.required_literal(F.col("p")).alias("lit"), messages.n_groups(F.col("p")).alias("n")).collect()}
    assert [got[p][1] for p in ODD_PATTERNS] == [1, 1, 1, 2, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 2, 1, 1, 1, 1, 1, 1]
    texts = ["abc", "abd", "long alternative z", "x12y", "bdefgh", "bdfgh", "color of ink", "colour of ink", "soooo long x", "aabc", "flags", "Abcdefg", "group at all",
             "a named group here", "dot in the middle", "anchored x", "esc(aped) paren", "nested deep group end", "bfgh i", "class with ( paren x", "77 digits of pi",
             "lazy x end of it", "plus aaa then more text", "quoted (.*) literal x"]
    hits = spark.createDataFrame([(t,) for t in texts], "t string").join(spark.createDataFrame(rows, "i int, p string"), F.expr("t RLIKE p")).collect()
    assert {r.i for r in hits} == set(range(len(ODD_PATTERNS)))
    assert all(got[r.p][0] in r.t for r in hits)
    assert got["dot.in the (middle)"][0] == "in the " and got["plus (a)+ then more text"][0] == " then more text"
    assert all(got[p][0] == "" for p in ("(.*)", "x(.*)y|long alternative (z)", "(?i)FLAG(s)", "[a[bc]de]fgh (i)", "\\x41bcdef(g)"))


def test_odd_catalogue_equals_a_plain_scan(spark):
    pats = [p.lower() for p in ODD_PATTERNS if "Q" not in p]        # a quote is no quote in lower case
    cat = spark.createDataFrame([("html5", i, p, f"c{i}") for i, p in enumerate(reversed(pats))], "family string, idx int, pattern string, message string")
    cat = cat.withColumn("n_groups", messages.n_groups(F.col("pattern")))
    texts = ["abc", "xyzzy", "Colour of Ink", "", "a{2,3}b(c)", "esc(aped) paren", None, "long alternative z and more", "é" * 500 + " dot-in the middle", "abc", "x" * 2000]
    live = [(r.idx, r.pattern, r.message) for r in cat.filter("n_groups > 0").orderBy("idx").collect()]
    tests = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {}
    for idx, p, m in reversed(live):
        for r in tests.filter(F.lower("t").rlike(p)).collect():
            want[r.i] = m
    got = _classify(spark, [("error", "html5", t) for t in texts], cat)
    assert [c and c.removeprefix("html5 error - ") for c, _ in got] == [want.get(i, t) for i, t in enumerate(texts)]
