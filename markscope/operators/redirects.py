"""Redirects (J1, J2, P13, W5) and batch resume.

A redirect record carries an origin URL and a ``Location``.  The map keeps one
origin per target (the later file wins); the page whose URL is the target gets
the origin as its original URL, and each redirect is used once: only the first
page by file name with that URL receives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_target(origin, location):
    """A target not starting with 'h' is made absolute against the origin, lower-cased."""
    rel = F.regexp_replace(location, "/{2,}", "/")
    joined = (F.when(origin.endswith("/") & rel.startswith("/"),
                     F.concat(origin, F.substring(rel, 2, 1 << 30)))
              .otherwise(F.concat(origin, rel)))
    return F.when(location.startswith("h"), location).otherwise(F.lower(joined))


def redirect_map(records: DataFrame) -> DataFrame:
    """``target, origin`` from records with both a URL and a Location; last file wins.

    ``max_by`` is a partial aggregate, so a target named by many records is
    collapsed map-side before the shuffle.
    """
    r = records.filter(F.col("url").isNotNull() & F.col("location").isNotNull())
    r = r.select("warc", resolve_target(F.col("url"), F.col("location")).alias("target"),
                 F.col("url").alias("origin"))
    return r.groupBy("target").agg(F.max_by("origin", "warc").alias("origin"))


def drop_redirect_records(records: DataFrame) -> DataFrame:
    """The page set is the records without a Location."""
    return records.filter(F.col("location").isNull() | F.col("url").isNull())


def origins(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """``url, warc, origin`` for the first page (by ``warc``) of each URL that is a target.

    The first page per URL comes from a partial ``min`` aggregate (no window over a possibly hot
    URL).  ``redirects`` may name a target more than once (a map kept over several runs): the
    largest origin is taken, so a page is never doubled.
    """
    first = pages.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("warc").alias("warc"))
    one = redirects.groupBy("target").agg(F.max("origin").alias("origin"))
    return first.join(one, first["url"] == one["target"], "inner").select("url", "warc", "origin")


def attach_original_url(rows: DataFrame, used: DataFrame) -> DataFrame:
    """Set ``original_url`` of ``rows`` (one per page, with ``url, warc``) from ``origins``.

    Give it narrow rows (results, not pages): the join shuffles them by ``(url, warc)``, a unique
    pair, so it has no hot key; AQE broadcasts the small side when its measured size allows.
    """
    o = used.select(F.col("url").alias("_url"), F.col("warc").alias("_warc"), F.col("origin").alias("_origin"))
    out = rows.join(o, (F.col("url") == F.col("_url")) & (F.col("warc") == F.col("_warc")), "left")
    return out.select(*[F.coalesce(F.col("_origin"), F.col("original_url")).alias("original_url")
                        if c == "original_url" else F.col(c) for c in rows.columns])


def resume_after(records: DataFrame, last_name: str | None) -> DataFrame:
    """Skip files up to and including ``last_name`` (name order)."""
    return records if last_name is None else records.filter(F.col("warc") > F.lit(last_name))


def page_input(records: DataFrame) -> DataFrame:
    """WARC records -> normalised page input that still knows each record's ``location``."""
    from markscope.sources.pages import normalize_pages
    return normalize_pages(records.withColumn("page_id", F.xxhash64("warc")))
