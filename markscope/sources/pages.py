"""Page tables (``page_id, url, html``) as normalised page input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope.session import cached_expr


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def normalize_pages(df: DataFrame) -> DataFrame:
    """A columnar page table -> the page input of ``parse_pages``.

    WARC-only facts (record type, HTTP line, server, content type) are null here
    and printed as ``NA`` by the result sink, as the reference does for a record
    without them.
    """
    cols = set(df.columns)

    def opt(name: str, dtype: str = "string"):
        return F.col(name) if name in cols else F.lit(None).cast(dtype)

    extra = [F.col("location")] if "location" in cols else []
    return df.select(
        *extra,
        F.col("page_id").cast("bigint").alias("page_id"),
        (F.col("warc") if "warc" in cols else F.col("page_id").cast("string")).alias("warc"),
        F.col("url"),
        F.col("html"),
        opt("original_url").alias("original_url"),
        opt("resource_type").alias("resource_type"),
        opt("http_code").alias("http_code"),
        opt("content_type").alias("content_type"),
        opt("server").alias("server"),
        F.coalesce(opt("not_html", "boolean"), F.lit(False)).alias("not_html"),
    )


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_pages(read_table(spark, sf_dir, "pages"))


# Markup variations applied to a page table so that rules without hits on plain
# pages (images, ids, external links, obsolete markup, charsets...) get input.  Every page
# is kept; page_id mod N_VARIANTS only picks which one variation a page receives.
# Each entry: (variant, [(find, replace), ...]) applied in order with replace().
VARIANTS = [
    (1, [('href="/', 'href="https://x.example/')]),
    (2, [('<div class="ad">', '<div class="ad"><img src="a.PNG?x=1">')]),
    (3, [('<div class="ad">', '<div class="ad"><img src="pic" alt="" usemap="#m">')]),
    (4, [("<h1>", '<h1 id="h"><i id="h"></i><label for="nope">x</label>')]),
    (5, [("</article>", "</article></i>")]),
    (6, [("<article>", "<center>")]),
    (7, [("<p>", '<p align="left" align="left">')]),
    (8, [('<meta charset="utf-8">', "")]),
    (9, [('href="/', 'href="mailto:'),
         ("</nav>", '<a>x</a><a href="#top">y</a></nav>'),
         ("<nav>", '<nav role="navigation">')]),
    (10, [('<meta charset="utf-8">', '<meta charset="windows-1251">')]),
    (11, [('<meta charset="utf-8">', '<meta charset="no-such-charset">')]),
    (12, [("<!DOCTYPE html>", "")]),
    (13, [("<article>", '<article><my-widget data-x="1">x</my-widget><o:p>y</o:p><font-face>'),
          ("</article>", '<script>var s="<!-- <b>";</script><textarea><i></textarea></article>')]),
    (14, [("<p>", '<p title="</i><!-- no --> &eacute; &#8217;">caf&eacute; &#x27;&amp;lt; '),
          ("</nav>", "<!-- a <b> --></nav>")]),
    (15, [('<meta charset="utf-8">', '<meta charset="UTF-16">')]),
]
N_VARIANTS = 16


def vary_markup(pages: DataFrame) -> DataFrame:
    """The same pages with one deterministic markup variation each (see VARIANTS)."""
    def build():
        variant = F.pmod(F.col("page_id"), F.lit(N_VARIANTS))
        html = F.col("html")
        out = html
        for v, edits in reversed(VARIANTS):
            edited = html
            for find, repl in edits:
                edited = F.replace(edited, F.lit(find), F.lit(repl))
            out = F.when(variant == v, edited).otherwise(out)
        return out

    return pages.withColumn("html", cached_expr("vary_markup", build))


def read_varied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_pages(vary_markup(read_table(spark, sf_dir, "pages")))
