"""P7 by element: the own text of each element.

A page is cut into tokens in document order (tags, elements with a plain body, comments, text) by one regex scan in the JVM,
which also names the tags and decodes the text.  Which element a run of text belongs to depends on all open
elements before it, which no built-in expression can follow without copying its state at every token; so one linear
walk over the token arrays keeps a stack (``mapInArrow``: no shuffle, a batch of pages at a time).

An end tag closes the nearest open element of its name and all that are open inside it; without one it closes nothing. Void elements
hold no text.  An element's own text is that of its runs joined, with blanks collapsed; a ``br`` between them is a blank.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.functions import markup as M
from markscope.functions import patterns as P


def tokens(pages: DataFrame) -> DataFrame:
    """``page_id, kind, name, body``: parallel arrays of a page's tokens.

    kind: ``s`` start tag, ``e`` end tag, ``r`` element with a plain body, ``t`` text, ``o`` anything else.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    cut = pages.select("page_id", F.regexp_extract_all(html, F.lit(P.SCAN_TOKENS_JVM), 0).alias("t"))

    def kind(t):
        name = F.lower(F.regexp_extract(t, P.TAG_NAME, 1))
        return F.when(~t.startswith("<") | (t == "<"), "t").when(t.startswith("</"), "e").when(t.startswith("<!") | t.startswith("<?"), "o").when(
            name.isin(*P.RAW_TEXT_ELEMENTS), "r").when(name == "", "t").otherwise("s")

    def name(t):
        return F.when(t.startswith("</"), F.lower(F.regexp_extract(t, P.END_TAG_NAME, 1))).when(t.startswith("<"), M.tag_name(t)).otherwise("")

    def body(t, k):
        raw = F.translate(F.regexp_replace(t, P.SCAN_TEXT_JVM, P.TEXT_REPL_JVM), P.BREAK, "")
        return F.when(k == "t", t).when(k == "r", raw).otherwise("")

    named = cut.select("page_id", "t", F.transform("t", kind).alias("kind"), F.transform("t", name).alias("name"))
    bodies = F.zip_with("t", "kind", body)
    return named.select("page_id", "kind", "name", bodies.alias("body"))


def element_text(pages: DataFrame) -> DataFrame:
    """``page_id, pos, tag, own_text`` of the elements that have text; ``pos`` counts start tags from 0.

    Text outside all elements belongs to position -1 with an empty tag.  A null page has no tokens.
    """
    void = set(P.VOID_ELEMENTS)

    def walk(kinds, names, bodies):
        """(positions, tags, raw texts) of the elements with text."""
        texts: dict[int, list[str]] = {}
        tag_of = {-1: ""}
        stack: list[tuple[int, str]] = []
        open_names: dict[str, int] = {}
        pos = -1
        for kind, name, body in zip(kinds, names, bodies):
            owner = stack[-1][0] if stack else -1
            if kind == "t":
                texts.setdefault(owner, []).append(body)
            elif kind == "s":
                pos += 1
                tag_of[pos] = name
                if name == "br":
                    texts.setdefault(owner, []).append(" ")
                if name not in void:
                    stack.append((pos, name))
                    open_names[name] = open_names.get(name, 0) + 1
            elif kind == "r":
                pos += 1
                tag_of[pos] = name
                if body:
                    texts[pos] = [body]
            elif kind == "e" and open_names.get(name):
                while True:
                    _, top = stack.pop()
                    open_names[top] -= 1
                    if top == name:
                        break
        at = sorted(texts)
        return at, [tag_of[p] for p in at], ["".join(texts[p]) for p in at]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            # a few pages at a time, whatever the batch
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = [walk(k or [], n or [], t or []) for k, n, t in zip(*(part.column(c).to_pylist() for c in (1, 2, 3)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.string())),
                     pa.array([f[2] for f in found], pa.list_(pa.string()))], ["page_id", "pos", "tag", "text"])

    rows = tokens(pages).mapInArrow(run, "page_id long, pos array<long>, tag array<string>, text array<string>")
    one = rows.select("page_id", F.explode(F.arrays_zip("pos", "tag", "text")).alias("x"))
    text = F.trim(F.regexp_replace(M.decode_entities(F.col("x.text")), P.BLANKS, " "))
    return one.select("page_id", F.col("x.pos").alias("pos"), F.col("x.tag").alias("tag"), text.alias("own_text")).filter("own_text <> ''")
