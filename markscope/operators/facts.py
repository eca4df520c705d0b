"""Page parsing and the exploded fact tables.

``parse_pages`` runs the tokeniser once per page and keeps only arrays and
sizes; the raw ``html`` column is dropped right after, so no later stage carries
it.  Fact tables are ``posexplode`` of those arrays: narrow, no shuffle, and every
row of a page stays in the partition that read the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscope.functions import markup as M
from markscope.session import cached_expr

# Columns of the normalised page input (sources produce these).
PAGE_INPUT_COLUMNS = ["page_id", "warc", "url", "html", "original_url", "resource_type",
                      "http_code", "content_type", "server", "not_html"]


def parse_pages(pages: DataFrame) -> DataFrame:
    """Page input -> one row per page with token arrays, text, doctype and sizes.

    Output columns: the page input without ``html``, plus ``scheme, doctype,
    is_html5, declared_charset, file_size, start_tags, end_tags, comments, text``.
    """
    carry = [c for c in pages.columns if c != "html"]
    stage1, core, rest = cached_expr("parse_pages", _parse_columns)
    # The fields a status filter reads leave through a one-row generator: a filter on
    # status then stays above it.  Pushed into the projection instead, Catalyst
    # would inline the tokeniser into the filter and run every regex twice.  The
    # other fields stay plain columns, so queries that do not use them prune them.
    staged = pages.select(*carry, *stage1)
    one = F.explode(F.array(F.struct(*core))).alias("_p")
    rest_names = ["end_tags", "comments", "text"]
    out = staged.select(*carry, *rest, one)
    return out.select(*carry, *[F.col(f"_p.{n}").alias(n) for n in _CORE_NAMES], *rest_names,
                      M.is_html5(F.col("_p.doctype")).alias("is_html5"))


_CORE_NAMES = ["scheme", "doctype", "declared_charset", "file_size", "start_tags"]


def _parse_columns():
    html = F.coalesce(F.col("html"), F.lit(""))
    markup = M.markup_only(html)
    stage1 = [html.alias("_html"), markup.alias("_markup"), M.tags(markup).alias("_tags")]
    core = [
        M.url_scheme("url").alias("scheme"),
        M.doctype("_markup").alias("doctype"),
        M.declared_charset("_markup").alias("declared_charset"),
        F.octet_length("_html").cast("bigint").alias("file_size"),
        M.start_tags("_tags").alias("start_tags"),
    ]
    rest = [
        M.end_tag_names("_tags").alias("end_tags"),
        M.comment_texts("_html").alias("comments"),
        M.page_text("_html").alias("text"),
    ]
    return stage1, core, rest


def element_rows(parsed: DataFrame, context: tuple[str, ...] = ()) -> DataFrame:
    """One row per start tag: ``page_id, pos, tag, raw`` (+ page context columns)."""
    return (parsed
            .select("page_id", *context, F.posexplode("start_tags").alias("pos", "raw"))
            .withColumn("pos", F.col("pos").cast("bigint"))
            .withColumn("tag", M.tag_name("raw")))


def elements(parsed: DataFrame) -> DataFrame:
    return element_rows(parsed).select("page_id", "pos", "tag", "raw")


def attribute_rows(element_df: DataFrame) -> DataFrame:
    """Every attribute token of every start tag, with ``is_first`` for the first of a name.

    ``page_id, pos, tag, apos, attr, value, is_first`` (+ context columns carried).
    """
    carry = [c for c in element_df.columns if c not in ("raw",)]
    with_tokens = element_df.select(*carry, "raw", M.attr_tokens("raw").alias("_tokens"))
    bound = with_tokens.select(*carry, F.transform("_tokens", M.attr_name).alias("_names"),
                               M.attr_values(F.col("raw"), F.col("_tokens")).alias("_values"))
    exploded = bound.select(*carry, "_names", "_values", F.posexplode("_names").alias("apos", "attr"))
    return exploded.select(
        *carry, "apos", "attr", F.get("_values", F.col("apos")).alias("value"),
        (F.array_position("_names", F.col("attr")) == F.col("apos") + 1).alias("is_first"))


def attributes(parsed: DataFrame) -> DataFrame:
    """Attributes of start tags; a repeated attribute counts once (the first)."""
    rows = attribute_rows(element_rows(parsed))
    return rows.filter("is_first").select("page_id", "pos", "tag", "attr", "value")


def link_rows(parsed: DataFrame, context: tuple[str, ...] = ()) -> DataFrame:
    """``a`` and ``area`` start tags with their class."""
    el = element_rows(parsed, ("scheme",) + tuple(c for c in context if c != "scheme"))
    links = el.filter(F.col("tag").isin("a", "area"))
    href = F.coalesce(M.attr_lookup(F.col("raw"), "href"), F.lit(""))
    scheme = F.col("scheme")
    return links.select(
        "page_id", *[c for c in context if c != "scheme"], "pos", "tag", href.alias("href"),
        M.link_is_internal(href, scheme).alias("is_internal"),
        href.startswith("#").alias("is_bookmark"),
        M.link_protocol(href, scheme).alias("protocol"))


def links(parsed: DataFrame) -> DataFrame:
    return link_rows(parsed)


def image_rows(parsed: DataFrame, context: tuple[str, ...] = ()) -> DataFrame:
    """P5: ``img`` start tags with their format class."""
    el = element_rows(parsed, context).filter(F.col("tag") == "img")
    src = M.attr_lookup(F.col("raw"), "src")
    return el.select("page_id", *context, "pos", F.coalesce(src, F.lit("")).alias("src"),
                     M.image_format(src).alias("format"))


def images(parsed: DataFrame) -> DataFrame:
    return image_rows(parsed)


def comments(parsed: DataFrame) -> DataFrame:
    """One row per comment with its content."""
    return (parsed.select("page_id", F.posexplode("comments").alias("pos", "content"))
            .withColumn("pos", F.col("pos").cast("bigint")))


def _runs(parsed: DataFrame, items: Column, fields: list[str]) -> DataFrame:
    """Per page, how often each item occurs: sorted inside the row and counted by run lengths, so nothing is shuffled."""
    counted = (parsed.select("page_id", items.alias("_items")).withColumn("_items", F.sort_array("_items"))
               .select("page_id", F.explode(M.count_runs("_items")).alias("c")))
    item = [F.col("c.item").alias(fields[0])] if len(fields) == 1 else [F.col(f"c.item.{f}").alias(f) for f in fields]
    return counted.select("page_id", *item, F.col("c.n").alias("n"))


def element_counts(parsed: DataFrame) -> DataFrame:
    """``page_id, tag, n`` from the page's own token array.  A row of the page table is a page."""
    return _runs(parsed, F.transform("start_tags", M.tag_name), ["tag"])


def attribute_counts(parsed: DataFrame) -> DataFrame:
    """``page_id, tag, attr, n``; an attribute that a tag repeats counts once."""
    def of_tag(raw):
        names = F.array_distinct(F.transform(M.attr_tokens(raw), M.attr_name))
        return F.element_at(F.transform(F.array(M.tag_name(raw)), lambda tag: F.transform(
            names, lambda a: F.struct(tag.alias("tag"), a.alias("attr")))), 1)
    return _runs(parsed, F.flatten(F.transform("start_tags", of_tag)), ["tag", "attr"])


def protocol_counts(parsed: DataFrame) -> DataFrame:
    """``page_id, protocol, n`` of the page's links."""
    links = F.filter("start_tags", lambda t: M.tag_name(t).isin("a", "area"))
    hrefs = F.transform(links, lambda t: F.coalesce(M.attr_lookup(t, "href"), F.lit("")))
    staged = parsed.select("page_id", "scheme", hrefs.alias("_hrefs"))
    return _runs(staged, F.transform("_hrefs", lambda h: M.link_protocol(h, F.col("scheme"))), ["protocol"])


def image_counts(parsed: DataFrame) -> DataFrame:
    """``page_id, format, n`` of the page's images."""
    images = F.filter("start_tags", lambda t: M.tag_name(t) == "img")
    staged = parsed.select("page_id", F.transform(images, lambda t: M.attr_lookup(t, "src")).alias("_src"))
    return _runs(staged, F.transform("_src", M.image_format), ["format"])


__all__ = ["parse_pages", "element_counts", "attribute_counts", "protocol_counts", "image_counts", "element_rows", "elements", "attribute_rows", "attributes",
           "link_rows", "links", "image_rows", "images", "comments",
           "PAGE_INPUT_COLUMNS"]
