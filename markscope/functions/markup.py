"""Column -> Column builders for the markup of a page.

All of them are built-in Spark SQL expressions (regexp_*, higher-order array
functions), so they run inside whole-stage code generation and never leave the
JVM.  They work on one page row at a time and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markscope.functions import patterns as P
from markscope.session import cached_expr, java_charsets


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scrub(c: Column | str) -> Column:
    """Remove the line-breaking characters from a key (CR LF NEL LS PS NUL)."""
    return F.translate(_col(c), P.LINE_BREAK_CHARS, "")


def markup_only(html: Column | str) -> Column:
    """HTML in one left-to-right scan: without comments and without the bodies (and end tags) of
    elements that hold plain text, so what looks like markup in there, or in an attribute, never counts."""
    return F.regexp_replace(_col(html), P.SCAN_MARKUP_JVM, P.MARKUP_REPL_JVM)


def tags(markup: Column | str) -> Column:
    """array<string>: start and end tags in document order."""
    return F.regexp_extract_all(_col(markup), F.lit(P.TAG_JVM), 0)


def start_tags(tags_col: Column | str) -> Column:
    """array<string>: the whole start tags in document order."""
    return F.filter(_col(tags_col), lambda t: ~t.startswith("</"))


def end_tag_names(tags_col: Column | str) -> Column:
    """array<string>: lower-cased names of the end tags."""
    ends = F.filter(_col(tags_col), lambda t: t.startswith("</"))
    return F.transform(ends, lambda t: F.lower(F.regexp_extract(t, P.END_TAG_NAME, 1)))


def comment_texts(html: Column | str) -> Column:
    """array<string>: the content of every comment."""
    found = F.filter(F.regexp_extract_all(_col(html), F.lit(P.SCAN_JVM), 0), lambda t: t.startswith("<!--"))
    texts = F.transform(found, lambda t: F.regexp_replace(F.substring(t, 5, 1 << 30), P.COMMENT_END, ""))
    return F.when(F.instr(_col(html), "<!--") > 0, texts).otherwise(F.array().cast("array<string>"))


def tag_name(raw: Column | str) -> Column:
    """Lower-cased element name of a start tag."""
    return scrub(F.lower(F.regexp_extract(_col(raw), P.TAG_NAME, 1)))


def attr_tokens(raw: Column | str) -> Column:
    """array<string>: ``name[=value]`` tokens of one start tag, in source order."""
    tag = _col(raw)
    body = F.regexp_replace(tag, P.TAG_NAME, "")
    # a tag without blank or slash is a name alone: no regex is run for it
    bare = F.length(F.translate(tag, P.WS_CHARS + "/", "")) == F.length(tag)
    return F.when(bare, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(body, F.lit(P.ATTR_JVM), 0))


def attr_name(token: Column) -> Column:
    """Lower-cased name of an attribute token (what stands before blanks and ``=``)."""
    return scrub(F.lower(F.rtrim(F.substring_index(token, "=", 1), F.lit(P.WS_CHARS))))


def raw_value(token: Column) -> Column:
    """Value of an attribute token as written, without quotes; null when it has no ``=``."""
    after = F.ltrim(F.substring(token, F.instr(token, "=") + 1, F.length(token)), F.lit(P.WS_CHARS))
    value = F.element_at(F.transform(F.array(after), lambda x: F.when(
        x.startswith('"') | x.startswith("'"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)), 1)
    return F.when(F.instr(token, "=") > 0, value)


def attr_values(raw: Column, tokens: Column) -> Column:
    """array<string>: decoded values of a start tag's tokens; null for those without ``=``.

    Bind this to a column once for each tag and look values up with ``value_in``.  Entities are only looked for in tags that
    hold an ``&``.
    """
    values = F.transform(tokens, raw_value)
    return F.when(F.instr(raw, "&") > 0, F.transform(values, decode_entities)).otherwise(values)


def _entity_map() -> Column:
    """Name to characters as one literal (a map built entry by entry would weigh on every plan)."""
    pairs = "\x02".join(f"{k}\x03{v}" for k, v in P.ENTITIES.items())
    return F.call_function("str_to_map", F.lit(pairs), F.lit("\x02"), F.lit("\x03"))


def decode_entities(c: Column) -> Column:
    """Decode named and numeric entities once, left to right; text without '&' is returned untouched."""
    named = cached_expr("entities", _entity_map)

    def decoded(x: Column, found: Column) -> Column:
        number = F.when(found.rlike("^#[0-9]"), F.substring(found, 2, 20).cast("bigint")) \
            .when(found.startswith("#"), F.conv(F.substring(found, 3, 20), 16, 10).cast("bigint"))
        char = F.element_at(F.transform(F.array(number), lambda n: (
            F.when(n.isNull(), F.try_element_at(named, found))
            .when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
            .otherwise(F.lit(P.REPLACEMENT_CHAR)))), 1)
        return F.coalesce(F.concat(char, F.substring(x, F.length(found) + 2, 1 << 30)), F.concat(F.lit("&"), x))

    def piece(x: Column, i: Column) -> Column:
        # the one-entry arrays bind a value once: lambdas have no common subexpressions
        rest = F.element_at(F.transform(F.array(F.regexp_extract(x, P.ENTITY, 1)), lambda found: decoded(x, found)), 1)
        return F.when(i == 0, x).otherwise(rest)

    return F.when(F.instr(c, "&") > 0, F.array_join(F.transform(F.split(c, "&", -1), piece), "")).otherwise(c)


def attr_lookup(raw: Column, name: str) -> Column:
    """Value of the first attribute called ``name`` of a start tag; null if absent."""
    tokens = attr_tokens(raw)
    found = F.filter(tokens, lambda t: attr_name(t) == name)
    values = F.transform(F.slice(found, 1, 1), raw_value)
    return F.get(F.transform(values, decode_entities), F.lit(0))


def page_text(html: Column | str) -> Column:
    """Text of all elements, script/style excluded, blanks collapsed, pieces joined."""
    pieces = F.split(F.regexp_replace(_col(html), P.SCAN_TEXT_JVM, P.TEXT_REPL_JVM), P.BREAK, -1)
    cleaned = F.transform(
        pieces, lambda x: F.trim(F.regexp_replace(decode_entities(x), P.BLANKS, " ")))
    return F.array_join(F.filter(cleaned, lambda x: x != ""), "")


def doctype(stripped: Column | str) -> Column:
    """First DOCTYPE, lower-cased, blanks collapsed; the fixed text when there is none."""
    found = F.regexp_extract(_col(stripped), P.DOCTYPE, 0)
    norm = F.regexp_replace(F.regexp_replace(F.lower(found), P.BLANKS, " "), " >$", ">")
    return F.when(found == "", F.lit(P.NO_DOCTYPE)).otherwise(norm)


def declared_charset(stripped: Column | str) -> Column:
    found = F.lower(F.regexp_extract(_col(stripped), P.META_CHARSET, 1))
    return F.when(found != "", found)


def url_scheme(url: Column | str) -> Column:
    """Scheme of the page URL as written (case kept); null when the URL does not parse."""
    u = _col(url)
    return F.when(u.rlike(P.URI_WITH_SCHEME), F.regexp_extract(u, P.URL_SCHEME, 1))


def byte_size(text: Column, charset: Column) -> Column:
    """Bytes of ``text`` encoded in ``charset``, any that the JVM can encode; null for others.

    Characters that the charset lacks count as its replacement.  Use it in plans built within
    ``session.java_charsets_allowed``.
    """
    cs = F.lower(charset)
    return (F.when(cs.isin(*P.UTF8_CHARSETS), F.octet_length(text))
            .when(known_charset(charset), F.octet_length(F.call_function("encode", text, cs)))
            .cast("bigint"))


def known_charset(charset: Column) -> Column:
    """Whether the JVM can encode text in a charset of that name (any case)."""
    return F.lower(charset).isin(*java_charsets())


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, null where the reference would print Infinity or NaN."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


# --- scalar rules ----------------------------------------------------------

def link_is_internal(href: Column, scheme: Column) -> Column:
    """Same scheme prefix, or a relative start '.', '/', '#'."""
    same = F.coalesce(href.startswith(scheme), F.lit(False))
    rel = href.startswith(".") | href.startswith("/") | href.startswith("#")
    return same | rel


def link_protocol(href: Column, scheme: Column) -> Column:
    """Internal links take the page scheme as written; others their own, lower-cased."""
    external = (F.when(href.rlike(P.URI_WITH_SCHEME), F.regexp_extract(href, P.URI_PREFIX, 1))
                .otherwise(F.lit("n/a")))
    return F.when(link_is_internal(href, scheme), scheme).otherwise(scrub(F.lower(external)))


def image_format(src: Column) -> Column:
    """Format class of an image source (rule table in the README)."""
    s = F.coalesce(src, F.lit(""))
    suffix = F.regexp_extract(s, P.LAST_DOT_SUFFIX, 0)            # from the last '.' on
    last_dot = F.length(s) - F.length(suffix)                      # 0-based index of that '.'
    t0 = F.lower(suffix)
    q = F.instr(t0, "?")
    t1 = F.when(q > 1, F.substring_index(t0, "?", 1)).otherwise(t0)
    a = F.instr(t1, "&")
    t2 = F.when(a > 1, F.substring_index(t1, "&", 1)).otherwise(t1)
    cls = (F.when(s == "", F.lit("empty"))
           .when((suffix == "") | (last_dot <= 0), F.lit("n/a"))
           .when((F.length(t2) > 6) | (F.instr(t2, "/") > 0) | t2.isin(*P.IMAGE_LINK_SUFFIXES),
                 F.lit("hyperlink"))
           .when((F.length(t2) <= 2) | ~t2.startswith("."), F.lit("n/a"))
           .otherwise(t2))
    return scrub(F.lower(F.regexp_replace(cls, P.EDGE_CONTROLS, "")))


def is_html5(doctype_col: Column) -> Column:
    return F.lower(doctype_col) == P.HTML5_DOCTYPE


def value_in(values: Column, names: Column, name: str | Column) -> Column:
    """Value of the first attribute ``name``, given a tag's value and name arrays; null if it has none."""
    wanted = F.lit(name) if isinstance(name, str) else name
    return F.get(values, F.array_position(names, wanted).cast("int") - 1)


def count_runs(sorted_col: str, with_start: bool = False) -> Column:
    """array<struct<item, n>>: how often each item of a sorted array column occurs, in one pass over the array.

    With ``with_start`` also each run's first position (from 0) as ``start``.
    """
    items = F.col(sorted_col)
    size = F.size(items)
    at = F.filter(F.transform(items, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(items, i - 1)), i)), lambda i: i.isNotNull())
    # the next run's start ends a run: pair each start with the one after it
    pairs = F.arrays_zip(at.alias("a"), F.concat(F.slice(at, 2, 1 << 30), F.array(size)).alias("b"))
    pairs = F.slice(pairs, F.lit(1), F.size(at))    # an empty array has no run

    def run(p):
        fields = [F.get(items, p["a"]).alias("item"), (p["b"] - p["a"]).cast("bigint").alias("n")]
        return F.struct(*fields, *([p["a"].alias("start")] if with_start else []))
    return F.transform(pairs, run)
