"""DuckDB SQL for every registered query that SQL can express.

Written independently of the Spark plans: lint rules are per-rule GROUP BY /
anti-join queries here, where Spark runs them as one event aggregation.  Only the
regular expressions and fixed value lists are shared (``patterns.py``, RE2 spelling).
DuckDB 2 syntax: ``lambda x: ...``, ``regexp_replace(.., 'g')``, ``\\1`` references.
"""

from __future__ import annotations

from markscope.functions import patterns as P
from markscope.operators.lint import EXPECTED_DOCTYPE, FALLBACK_CHARSET, JS_TYPES, LINT_RULES
from markscope.operators.messages import lint_catalog
from markscope.plans.queries import VARIED
from markscope.sources.pages import N_VARIANTS, VARIANTS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def scrub(x: str) -> str:
    return f"regexp_replace({x}, '[\\r\\n\\x{{85}}\\x{{2028}}\\x{{2029}}\\x{{0}}]', '', 'g')"


ENTITY_MAP = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in P.ENTITIES.items()) + "}"


def decode(x: str) -> str:
    """Entities decoded once, left to right, piece by piece after each '&'."""
    found = f"regexp_extract(p, {lit(P.ENTITY)}, 1)"
    number = (f"(CASE WHEN regexp_matches({found}, '^#[0-9]') THEN CAST(substring({found}, 2) AS BIGINT) "
              f"WHEN starts_with({found}, '#') THEN CAST('0x' || substring({found}, 3) AS BIGINT) END)")
    valid = f"({number} > 0 AND {number} <= 1114111 AND {number} NOT BETWEEN 55296 AND 57343)"
    char = (f"(CASE WHEN {number} IS NULL THEN {ENTITY_MAP}[{found}] "
            f"WHEN {valid} THEN chr(CAST({number} AS INTEGER)) ELSE {lit(P.REPLACEMENT_CHAR)} END)")
    piece = f"coalesce({char} || substring(p, length({found}) + 2), '&' || p)"
    return (f"(CASE WHEN instr({x}, '&') > 0 THEN string_split({x}, '&')[1] || "
            f"array_to_string(list_transform(string_split({x}, '&')[2:], lambda p: {piece}), '') ELSE {x} END)")


def tag_name(raw: str) -> str:
    return scrub(f"lower(regexp_extract({raw}, {lit(P.TAG_NAME)}, 1))")


def attr_tokens(raw: str) -> str:
    return f"regexp_extract_all(regexp_replace({raw}, {lit(P.TAG_NAME)}, ''), {lit(P.ATTR_RE2)}, 0)"


def attr_name(t: str) -> str:
    return scrub(f"lower(regexp_extract({t}, {lit(P.ATTR_NAME)}, 1))")


def attr_value(t: str) -> str:
    return decode(
        f"(CASE WHEN regexp_matches({t}, {lit(P.ATTR_HAS_DQ)}) THEN regexp_extract({t}, {lit(P.ATTR_DQ)}, 1) "
        f"WHEN regexp_matches({t}, {lit(P.ATTR_HAS_SQ)}) THEN regexp_extract({t}, {lit(P.ATTR_SQ)}, 1) "
        f"WHEN instr({t}, '=') > 0 THEN regexp_extract({t}, {lit(P.ATTR_BARE)}, 1) END)")


def value_in(vals: str, names: str, name: str) -> str:
    """Value of the first attribute of that name, from the tag's decoded values."""
    return f"{vals}[list_position({names}, {lit(name)})]"


def link_internal(h: str, s: str) -> str:
    return (f"(coalesce(starts_with({h}, {s}), false) OR starts_with({h}, '.') "
            f"OR starts_with({h}, '/') OR starts_with({h}, '#'))")


def link_protocol(h: str, s: str) -> str:
    ext = (f"CASE WHEN regexp_matches({h}, {lit(P.URI_WITH_SCHEME)}) "
           f"THEN regexp_extract({h}, {lit(P.URI_PREFIX)}, 1) ELSE 'n/a' END")
    return f"(CASE WHEN {link_internal(h, s)} THEN {s} ELSE {scrub(f'lower({ext})')} END)"


def image_format(src: str) -> str:
    s = f"coalesce({src}, '')"
    suf = f"regexp_extract({s}, {lit(P.LAST_DOT_SUFFIX)}, 0)"
    t0 = f"lower({suf})"
    t1 = f"(CASE WHEN instr({t0}, '?') > 1 THEN split_part({t0}, '?', 1) ELSE {t0} END)"
    t2 = f"(CASE WHEN instr({t1}, '&') > 1 THEN split_part({t1}, '&', 1) ELSE {t1} END)"
    cls = (f"(CASE WHEN {s} = '' THEN 'empty' "
           f"WHEN {suf} = '' OR length({s}) - length({suf}) <= 0 THEN 'n/a' "
           f"WHEN length({t2}) > 6 OR instr({t2}, '/') > 0 OR {t2} IN {in_list(P.IMAGE_LINK_SUFFIXES)} "
           f"THEN 'hyperlink' "
           f"WHEN length({t2}) <= 2 OR NOT starts_with({t2}, '.') THEN 'n/a' ELSE {t2} END)")
    return scrub(f"lower(regexp_replace({cls}, {lit(P.EDGE_CONTROLS)}, '', 'g'))")


def byte_size(text: str, cs: str) -> str:
    units = f"(length({text}) + length(regexp_replace({text}, {lit(P.SUPPLEMENTARY)}, '', 'g')))"
    return (f"CAST(CASE WHEN lower({cs}) IN {in_list(P.UTF8_CHARSETS)} THEN strlen({text}) "
            f"WHEN lower({cs}) IN {in_list(P.SINGLE_BYTE_CHARSETS)} THEN length({text}) "
            f"WHEN lower({cs}) IN {in_list(P.UTF16_CHARSETS)} THEN {units} * 2 "
            f"WHEN lower({cs}) IN {in_list(P.UTF16_BOM_CHARSETS)} THEN "
            f"CASE WHEN length({text}) > 0 THEN {units} * 2 + 2 ELSE 0 END "
            f"WHEN lower({cs}) IN {in_list(P.UTF32_CHARSETS)} THEN length({text}) * 4 END AS BIGINT)")


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def varied_html() -> str:
    out = "html"
    cases = []
    for v, edits in VARIANTS:
        e = "html"
        for find, repl in edits:
            e = f"replace({e}, {lit(find)}, {lit(repl)})"
        cases.append(f"WHEN {v} THEN {e}")
    return f"CASE page_id % {N_VARIANTS} {' '.join(cases)} ELSE {out} END"


def base_ctes(varied: bool, source: str = "pages") -> str:
    html = varied_html() if varied else "html"
    known = in_list(P.UTF8_CHARSETS + P.SINGLE_BYTE_CHARSETS + P.UTF16_CHARSETS + P.UTF16_BOM_CHARSETS
                    + P.UTF32_CHARSETS)
    doc_found = f"regexp_extract(markup, {lit(P.DOCTYPE)}, 0)"
    text = (f"array_to_string(list_filter(list_transform(string_split(regexp_replace(html, {lit(P.SCAN_TEXT_RE2)}, "
            f"{lit(P.TEXT_REPL_RE2)}, 'g'), {lit(P.BREAK)}), "
            f"lambda x: trim(regexp_replace({decode('x')}, {lit(P.BLANKS)}, ' ', 'g'), ' ')), lambda x: x <> ''), '')")
    return f"""
src AS (SELECT page_id, url, coalesce({html}, '') AS html FROM {source}),
staged AS (
  SELECT page_id, url, html,
         regexp_replace(html, {lit(P.SCAN_MARKUP_RE2)}, {lit(P.MARKUP_REPL_RE2)}, 'g') AS markup
  FROM src),
staged_tags AS (SELECT *, regexp_extract_all(markup, {lit(P.TAG_RE2)}, 0) AS tags FROM staged),
parsed0 AS (
  SELECT page_id, url, html,
         CASE WHEN regexp_matches(url, {lit(P.URI_WITH_SCHEME)}) THEN regexp_extract(url, {lit(P.URL_SCHEME)}, 1) END AS scheme,
         CASE WHEN {doc_found} = '' THEN {lit(P.NO_DOCTYPE)}
              ELSE regexp_replace(regexp_replace(lower({doc_found}), {lit(P.BLANKS)}, ' ', 'g'), ' >$', '>') END AS doctype,
         nullif(lower(regexp_extract(markup, {lit(P.META_CHARSET)}, 1)), '') AS declared_charset,
         CAST(strlen(html) AS BIGINT) AS file_size,
         list_filter(tags, lambda x: NOT starts_with(x, '</')) AS start_tags,
         list_transform(list_filter(tags, lambda x: starts_with(x, '</')),
                        lambda x: lower(regexp_extract(x, {lit(P.END_TAG_NAME)}, 1))) AS end_tags,
         list_transform(list_filter(regexp_extract_all(html, {lit(P.SCAN_RE2)}, 0), lambda x: starts_with(x, '<!--')),
                        lambda x: regexp_replace(substring(x, 5), {lit(P.COMMENT_END)}, '')) AS comments,
         {text} AS text
  FROM staged_tags),
parsed AS (
  SELECT *, lower(doctype) = {lit(P.HTML5_DOCTYPE)} AS is_html5,
         coalesce(declared_charset, {lit(P.DEFAULT_CHARSET)}) AS charset,
         CASE WHEN file_size = 0 THEN 'failed_no_bytes'
              WHEN scheme IS NULL THEN 'failed_parsing'
              WHEN NOT (lower(coalesce(declared_charset, {lit(P.DEFAULT_CHARSET)})) IN {known}) THEN 'failed_validation'
              ELSE 'ok' END AS status
  FROM parsed0),
el0 AS (
  SELECT page_id, scheme, is_html5, status, unnest(start_tags) AS raw,
         unnest(generate_series(0, len(start_tags) - 1)) AS pos
  FROM parsed),
el1 AS (SELECT *, {tag_name('raw')} AS tag, {attr_tokens('raw')} AS toks FROM el0),
el AS (SELECT *, list_transform(toks, lambda t: {attr_name('t')}) AS names,
              list_transform(toks, lambda t: {attr_value('t')}) AS vals FROM el1),
at1 AS (SELECT page_id, is_html5, status, pos, tag, names, unnest(names) AS attr, unnest(vals) AS value,
               unnest(generate_series(0, len(toks) - 1)) AS apos FROM el),
attrs AS (SELECT page_id, is_html5, status, pos, tag, apos, attr, value,
                 list_position(names, attr) = apos + 1 AS is_first FROM at1),
links AS (
  SELECT page_id, is_html5, status, pos, tag, href,
         {link_internal('href', 'scheme')} AS is_internal,
         starts_with(href, '#') AS is_bookmark,
         {link_protocol('href', 'scheme')} AS protocol
  FROM (SELECT *, coalesce({value_in('vals', 'names', 'href')}, '') AS href
        FROM el WHERE tag IN ('a', 'area'))),
images AS (
  SELECT page_id, is_html5, status, pos, coalesce(src, '') AS src, {image_format('src')} AS format
  FROM (SELECT *, {value_in('vals', 'names', 'src')} AS src FROM el WHERE tag = 'img')),
measures AS (
  SELECT p.*,
         CAST(len(start_tags) AS BIGINT) AS num_elements,
         CAST(coalesce(l.num_links, 0) AS BIGINT) AS num_links,
         CAST(coalesce(l.num_internal_links, 0) AS BIGINT) AS num_internal_links,
         CAST(coalesce(l.num_bookmarks, 0) AS BIGINT) AS num_bookmarks,
         CAST(coalesce(l.num_links, 0) - coalesce(l.num_internal_links, 0) AS BIGINT) AS num_external_links,
         CAST(coalesce(i.num_images, 0) AS BIGINT) AS num_images,
         CAST(len(comments) AS BIGINT) AS num_comments,
         {byte_size('text', 'charset')} AS text_size,
         {byte_size("array_to_string(comments, '')", 'charset')} AS comments_size
  FROM parsed p
  LEFT JOIN (SELECT page_id, count(*) AS num_links, count(*) FILTER (WHERE is_internal) AS num_internal_links,
                    count(*) FILTER (WHERE is_bookmark) AS num_bookmarks FROM links GROUP BY page_id) l
    ON p.page_id = l.page_id
  LEFT JOIN (SELECT page_id, count(*) AS num_images FROM images GROUP BY page_id) i
    ON p.page_id = i.page_id),
measures2 AS (
  SELECT *, file_size - text_size AS elements_size FROM measures),
ratios AS (
  SELECT *, {ratio('text_size', 'elements_size')} AS text_to_elements,
            {ratio('elements_size', 'file_size')} AS elements_to_size,
            {ratio('text_size', 'file_size')} AS text_to_size,
            {ratio('comments_size', 'file_size')} AS comments_to_size
  FROM measures2)"""


def lint_cte() -> str:
    kind = {r: k for r, k, _ in LINT_RULES}
    tpl = {r: t for r, _, t in LINT_RULES}

    def msg(rule, *parts):
        pieces = tpl[rule].split("{")
        out = [lit(pieces[0])]
        for piece in pieces[1:]:
            idx, rest = piece.split("}", 1)
            out.append(parts[int(idx)])
            if rest:
                out.append(lit(rest))
        return "(" + " || ".join(out) + ")"

    req = ", ".join(f"({lit(t)}, {lit(a)})" for t, a in P.REQUIRED_ATTRIBUTES)
    obs = ", ".join(f"({lit(t)}, {lit(r) if r else 'NULL'})" for t, r in P.OBSOLETE_ELEMENTS)
    oattr = ", ".join(f"({lit(t)}, {lit(a)})" for t, a in P.OBSOLETE_ATTRIBUTES)
    roles = ", ".join(f"({lit(t)}, {lit(r)})" for t, r in P.IMPLICIT_ROLES)
    refattr_list = "[" + ", ".join(lit(a) for a in P.ID_REFERENCE_ATTRIBUTES) + "]"
    no_unclosed = in_list(P.VOID_ELEMENTS + P.OPTIONAL_END_ELEMENTS + P.RAW_TEXT_ELEMENTS)
    no_stray = in_list(P.VOID_ELEMENTS + P.RAW_TEXT_ELEMENTS)
    ids = (f"SELECT DISTINCT page_id, {value_in('vals', 'names', 'id')} AS v FROM el "
           f"WHERE {value_in('vals', 'names', 'id')} <> ''")
    parts = [
        f"""SELECT page_id, 'duplicate_id' AS rule, {msg('duplicate_id', 'v')} AS message, count(*) - 1 AS n
            FROM (SELECT page_id, {value_in('vals', 'names', 'id')} AS v FROM el)
            WHERE v <> '' GROUP BY page_id, v HAVING count(*) > 1""",
        f"""SELECT page_id, 'duplicate_attr', {msg('duplicate_attr', 'attr')}, count(*)
            FROM attrs WHERE NOT is_first GROUP BY ALL""",
        f"""SELECT page_id, 'required_attr', {msg('required_attr', 'r.t', 'r.a')}, count(*)
            FROM el JOIN (VALUES {req}) r(t, a) ON el.tag = r.t
            WHERE NOT list_contains(el.names, r.a) GROUP BY ALL""",
        f"""SELECT page_id, CASE WHEN r.rep IS NULL THEN 'obsolete_element_css' ELSE 'obsolete_element' END,
                   CASE WHEN r.rep IS NULL THEN {msg('obsolete_element_css', 'r.t')}
                        ELSE {msg('obsolete_element', 'r.t', 'r.rep')} END, count(*)
            FROM el JOIN (VALUES {obs}) r(t, rep) ON el.tag = r.t GROUP BY ALL""",
        f"""SELECT page_id, 'obsolete_attr', {msg('obsolete_attr', 'r.a', 'r.t')}, count(*)
            FROM el JOIN (VALUES {oattr}) r(t, a) ON el.tag = r.t
            WHERE list_contains(el.names, r.a) GROUP BY ALL""",
        f"""SELECT page_id, 'redundant_role', {msg('redundant_role', 'r.role', 'r.t')}, count(*)
            FROM el JOIN (VALUES {roles}) r(t, role) ON el.tag = r.t
            WHERE lower(trim({value_in('vals', 'names', 'role')}, ' ')) = r.role GROUP BY ALL""",
        f"""SELECT page_id, 'script_type', {msg('script_type')}, count(*)
            FROM el WHERE tag = 'script' AND lower(trim({value_in('vals', 'names', 'type')}, ' ')) IN {in_list(JS_TYPES)}
            GROUP BY ALL""",
        f"""SELECT page_id, CASE WHEN d > 0 THEN 'unclosed' ELSE 'stray_end' END,
                   CASE WHEN d > 0 THEN {msg('unclosed', 'tag')} ELSE {msg('stray_end', 'tag')} END, abs(d)
            FROM (SELECT coalesce(s.page_id, e.page_id) AS page_id, coalesce(s.tag, e.tag) AS tag,
                         coalesce(s.n, 0) - coalesce(e.n, 0) AS d
                  FROM (SELECT page_id, tag, count(*) AS n FROM el GROUP BY ALL) s
                  FULL OUTER JOIN (SELECT page_id, tag, count(*) AS n
                                   FROM (SELECT page_id, unnest(end_tags) AS tag FROM parsed) GROUP BY ALL) e
                    ON s.page_id = e.page_id AND s.tag = e.tag)
            WHERE (d > 0 AND tag NOT IN {no_unclosed}) OR (d < 0 AND tag NOT IN {no_stray})""",
        f"""SELECT page_id, 'dangling_ref', {msg('dangling_ref', 'a', 'v')}, count(*)
            FROM (SELECT page_id, a, unnest(list_filter(regexp_split_to_array(coalesce(val, ''), {lit(P.BLANKS)}),
                                                   lambda x: x <> '')) AS v
                  FROM (SELECT el.page_id, r.a,
                               el.vals[list_position(el.names, r.a)] AS val
                        FROM el, unnest({refattr_list}) AS r(a))) refs
            WHERE NOT EXISTS (SELECT 1 FROM ({ids}) i WHERE i.page_id = refs.page_id AND i.v = refs.v)
            GROUP BY ALL""",
        f"""SELECT page_id, 'usemap', {msg('usemap', 'v')}, count(*)
            FROM (SELECT page_id, substring(um, 2) AS v
                  FROM (SELECT page_id, {value_in('vals', 'names', 'usemap')} AS um FROM el)
                  WHERE starts_with(um, '#')) u
            WHERE NOT EXISTS (SELECT 1 FROM el m WHERE m.tag = 'map' AND m.page_id = u.page_id
                              AND {value_in('m.vals', 'm.names', 'name')} = u.v)
            GROUP BY ALL""",
        f"""SELECT page_id, 'charset', {msg('charset', lit(FALLBACK_CHARSET))}, 1
            FROM parsed WHERE declared_charset IS NULL""",
        f"""SELECT page_id, 'doctype', {msg('doctype', lit(EXPECTED_DOCTYPE))}, 1
            FROM parsed WHERE doctype = {lit(P.NO_DOCTYPE)}""",
    ]
    kinds = " ".join(f"WHEN {lit(r)} THEN {lit(k)}" for r, k in kind.items())
    body = "\n  UNION ALL\n".join(f"({p})" for p in parts)
    return f""",
lint0 AS (
  {body}),
lint AS (
  SELECT l.page_id AS page_id, rule, CASE rule {kinds} END AS kind, 'html5' AS message_id,
         message, CAST(n AS BIGINT) AS n, p.is_html5 AS is_html5, p.status AS status
  FROM (SELECT page_id, rule, message, sum(n) AS n FROM lint0 GROUP BY ALL) l
  JOIN parsed p ON l.page_id = p.page_id)"""


def classify_cte() -> str:
    live = [e for e in lint_catalog() if e.n_groups > 0]
    lm = "lower(message)"
    idx = "coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches({lm}, {lit(e.pattern)}) THEN {e.idx} END" for e in live) + ")"
    canon = "CASE idx " + " ".join(f"WHEN {e.idx} THEN {lit(e.message)}" for e in live) + " END"
    var_cases = []
    for e in live:
        groups = ", ".join(scrub(f"regexp_extract({lm}, {lit(e.pattern)}, {g})")
                           for g in range(1, e.n_groups + 1))
        var_cases.append(f"WHEN {e.idx} THEN lower(concat_ws(' | ', {groups}))")
    var = "CASE idx " + " ".join(var_cases) + " END"
    body = f"CASE WHEN idx IS NOT NULL THEN {canon} ELSE {scrub('message')} END"
    label = (f"CASE WHEN kind = 'error' AND message_id = 'html5' THEN 'html5 error - ' || ({body}) "
             f"WHEN kind = 'error' THEN 'error - ' || message_id || ' - ' || ({body}) "
             f"WHEN message_id = 'html5' THEN 'warning html5 - ' || ({body}) "
             f"ELSE 'warning - ' || message_id || ' - ' || ({body}) END")
    return f""",
cls0 AS (SELECT *, {idx} AS idx FROM lint WHERE status = 'ok'),
classified AS (SELECT page_id, is_html5, kind, message_id, message, n,
                      {label} AS canonical,
                      CASE WHEN idx IS NOT NULL THEN {var} END AS variables
               FROM cls0),
msg_totals AS (
  SELECT page_id, CAST(sum(CASE WHEN kind = 'error' THEN n ELSE 0 END) AS BIGINT) AS num_errors,
         CAST(sum(CASE WHEN kind = 'warning' THEN n ELSE 0 END) AS BIGINT) AS num_warnings
  FROM classified GROUP BY page_id),
events AS (
  SELECT page_id, is_html5, 'elements' AS metric, tag AS key, '' AS subkey, 1 AS n FROM el WHERE status = 'ok'
  UNION ALL
  SELECT page_id, is_html5, 'attributes', tag, attr, 1 FROM attrs WHERE status = 'ok' AND is_first
  UNION ALL
  SELECT page_id, is_html5, 'protocols', protocol, '', 1 FROM links WHERE status = 'ok'
  UNION ALL
  SELECT page_id, is_html5, 'images', format, '', 1 FROM images WHERE status = 'ok'
  UNION ALL
  SELECT page_id, is_html5, kind || 's', canonical, '', n FROM classified
  UNION ALL
  SELECT page_id, is_html5, kind || '_variables', canonical, variables, n FROM classified
  WHERE variables IS NOT NULL AND variables <> ''),
totals AS (
  SELECT scope, metric, key, subkey, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT 'all' AS scope, * FROM events UNION ALL SELECT 'html5', * FROM events WHERE is_html5)
  GROUP BY ALL)"""


def with_ctes(varied: bool, select: str, lint: bool = False, classified: bool = False, more: str = "") -> str:
    ctes = base_ctes(varied)
    if lint or classified:
        ctes += lint_cte()
    if classified:
        ctes += classify_cte()
    return f"WITH {ctes}{more}\n{select}"


# A page table has no HTTP headers and no validator's word: nothing is not HTML, nothing is forced.
_FUNNEL = """
        SELECT stat, CAST(value AS BIGINT) AS value FROM (
          SELECT 'records_seen' AS stat, count(*) AS value FROM parsed
          UNION ALL SELECT 'excluded_not_html', 0
          UNION ALL SELECT 'excluded_no_bytes', count(*) FILTER (WHERE status = 'failed_no_bytes') FROM parsed
          UNION ALL SELECT 'excluded_validation', count(*) FILTER (WHERE status = 'failed_validation') FROM parsed
          UNION ALL SELECT 'excluded_parsing', count(*) FILTER (WHERE status = 'failed_parsing') FROM parsed
          UNION ALL SELECT 'successful', count(*) FILTER (WHERE status = 'ok') FROM parsed
          UNION ALL SELECT 'forced', 0)"""
_DISTINCT = """
        SELECT 'different_' || m.metric AS stat, CAST(count(t.key) AS BIGINT) AS value
        FROM (SELECT 'errors' AS metric UNION ALL SELECT 'warnings' UNION ALL SELECT 'elements') m
        LEFT JOIN (SELECT metric, key FROM totals WHERE scope = 'all') t ON m.metric = t.metric
        GROUP BY m.metric"""

ORACLE: dict[str, str] = {
    "elements": with_ctes(False, "SELECT page_id, pos, tag FROM el"),
    "element_total": with_ctes(False, "SELECT page_id, CAST(len(start_tags) AS BIGINT) AS num_elements FROM parsed"),
    "element_counts": with_ctes(False, "SELECT page_id, tag, count(*) AS n FROM el GROUP BY page_id, tag"),
    "doctype": with_ctes(False, "SELECT page_id, doctype, is_html5 FROM parsed"),
    "html5_pages": with_ctes(True, "SELECT page_id, url FROM parsed WHERE is_html5"),
    "page_text": with_ctes(False, "SELECT page_id, text FROM parsed"),
    "comments": with_ctes(False, "SELECT page_id, unnest(generate_series(0, len(comments) - 1)) AS pos, "
                                 "unnest(comments) AS content FROM parsed"),
    "comment_stats": with_ctes(False, "SELECT page_id, num_comments, comments_size FROM measures"),
    "page_sizes": with_ctes(False, "SELECT page_id, file_size, text_size, elements_size, comments_size FROM ratios"),
    "page_ratios": with_ctes(False, "SELECT page_id, text_to_elements, elements_to_size, text_to_size, "
                                    "comments_to_size FROM ratios"),
    "scrubbed_keys": f"SELECT page_id, CAST(strlen({scrub('html')}) AS BIGINT) AS scrubbed_bytes, "
                     f"CAST(length(html) - length({scrub('html')}) AS BIGINT) AS removed_chars FROM pages",
    "attributes": with_ctes(True, "SELECT page_id, pos, tag, attr, value FROM attrs WHERE is_first"),
    "attribute_counts": with_ctes(True, "SELECT page_id, tag, attr, count(*) AS n FROM attrs WHERE is_first "
                                        "GROUP BY ALL"),
    "links": with_ctes(True, "SELECT page_id, pos, tag, href, is_internal, is_bookmark, protocol FROM links"),
    "link_counters": with_ctes(True, "SELECT page_id, num_links, num_internal_links, num_bookmarks, "
                                     "num_external_links FROM measures"),
    "protocol_counts": with_ctes(True, "SELECT page_id, protocol, count(*) AS n FROM links GROUP BY ALL"),
    "images": with_ctes(True, "SELECT page_id, pos, src, format FROM images"),
    "image_counts": with_ctes(True, "SELECT page_id, format, count(*) AS n FROM images GROUP BY ALL"),
    "page_status": with_ctes(True, "SELECT page_id, status, charset FROM parsed"),
    "lint_messages": with_ctes(True, "SELECT page_id, rule, kind, message_id, message, n FROM lint", lint=True),
    "message_kind": with_ctes(True, "SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM classified GROUP BY kind",
                              classified=True),
    "message_classes": with_ctes(True, "SELECT page_id, kind, message, canonical, variables, n FROM classified",
                                 classified=True),
    "message_totals": with_ctes(True, "SELECT page_id, num_errors, num_warnings FROM msg_totals", classified=True),
    "message_counts": with_ctes(True, "SELECT page_id, kind, canonical, CAST(sum(n) AS BIGINT) AS n "
                                      "FROM classified GROUP BY ALL", classified=True),
    "variable_counts": with_ctes(True, "SELECT page_id, kind, canonical, variables, CAST(sum(n) AS BIGINT) AS n "
                                       "FROM classified WHERE variables <> '' GROUP BY ALL", classified=True),
    "page_results": with_ctes(True, f"""
        SELECT CAST(r.page_id AS VARCHAR) AS warc, url, {lit(P.NO_ORIGINAL_URL)} AS original_url, num_elements,
               doctype, num_links, num_internal_links, num_bookmarks, num_external_links, num_images,
               num_comments, file_size, text_size, elements_size, comments_size, text_to_elements,
               elements_to_size, text_to_size, comments_to_size,
               CAST(coalesce(num_errors, 0) AS BIGINT) AS num_errors,
               CAST(coalesce(num_warnings, 0) AS BIGINT) AS num_warnings,
               'NA' AS type, 'NA' AS http_code, 'NA' AS content_type, 'NA' AS server, charset
        FROM ratios r LEFT JOIN msg_totals m ON r.page_id = m.page_id WHERE status = 'ok'""",
                              classified=True),
    "page_counts": with_ctes(True, "SELECT page_id, is_html5, metric, key, subkey, CAST(sum(n) AS BIGINT) AS n "
                                   "FROM events GROUP BY ALL", classified=True),
    "totals_flat": with_ctes(True, "SELECT metric, key, n FROM totals WHERE scope = 'all' AND metric IN "
                                   "('elements', 'protocols', 'images', 'errors', 'warnings')", classified=True),
    "totals_nested": with_ctes(True, "SELECT metric, key, subkey, n FROM totals WHERE scope = 'all' AND metric IN "
                                     "('attributes', 'error_variables', 'warning_variables')", classified=True),
    "totals_html5": with_ctes(True, "SELECT scope, metric, key, subkey, n FROM totals WHERE scope = 'html5'",
                              classified=True),
    "run_funnel": with_ctes(True, _FUNNEL),
    "distinct_stats": with_ctes(True, _DISTINCT, classified=True),
    "merge_counts": with_ctes(True, "SELECT metric, key, subkey, CAST(sum(n) AS BIGINT) AS n FROM events GROUP BY ALL", classified=True),
    "dedupe_urls": """
        SELECT page_id, url FROM pages p
        WHERE CAST(page_id AS VARCHAR) = (SELECT min(CAST(page_id AS VARCHAR)) FROM pages q WHERE q.url = p.url)""",
}

_LINT_SUBSETS = {
    "lint_duplicate_id": ["duplicate_id"],
    "lint_duplicate_attr": ["duplicate_attr"],
    "lint_required_attr": ["required_attr"],
    "lint_obsolete_element": ["obsolete_element", "obsolete_element_css"],
    "lint_obsolete_attr": ["obsolete_attr"],
    "lint_unclosed": ["unclosed"],
    "lint_stray_end": ["stray_end"],
    "lint_dangling_ref": ["dangling_ref"],
    "lint_usemap": ["usemap"],
    "lint_charset": ["charset"],
    "lint_doctype": ["doctype"],
    "lint_redundant_role": ["redundant_role"],
}
for _name, _rules in _LINT_SUBSETS.items():
    ORACLE[_name] = with_ctes(True, f"SELECT page_id, rule, kind, message_id, message, n FROM lint "
                                    f"WHERE rule IN {in_list(_rules)}", lint=True)


# --- WARC text built from pages, parsed back -----------------------------------

def _warc_text(url: str, html: str, location: str | None = None) -> str:
    head = lit("WARC/1.0\nWARC-Type: warcinfo\n\nWARC/1.0\nWARC-Type: response\nWARC-Target-URI: ")
    mid = lit("\nContent-Type: application/http; msgtype=response\n\n")
    if location is None:
        return (f"{head} || {url} || {mid} || "
                f"{lit(chr(10).join(['HTTP/1.1 200 OK', 'Server: nginx', 'Content-Type: text/html', '', '']))}"
                f" || {html} || {lit(chr(10))}")
    return (f"{head} || {url} || {mid} || {lit('HTTP/1.1 301 Moved Permanently' + chr(10) + 'Location: ')}"
            f" || {location} || {lit(chr(10) * 2)}")


def _last(lines: str, prefix: str) -> str:
    hits = f"list_filter({lines}, lambda x: starts_with(x, {lit(prefix)}))"
    return f"(CASE WHEN len({hits}) > 0 THEN substring({hits}[-1], {len(prefix) + 1}) END)"


WARC_CTES = f"""
files AS (
  SELECT 'page-' || lpad(CAST(page_id AS VARCHAR), 10, '0') AS warc_name,
         {_warc_text('url', 'html')} AS value FROM pages
  UNION ALL
  SELECT 'redir-' || lpad(CAST(a.page_id AS VARCHAR), 10, '0'),
         {_warc_text('a.url', "''", "CASE WHEN a.page_id % 20 = 0 THEN b.url ELSE '/Moved//' || CAST(a.page_id AS VARCHAR) END")}
  FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1
  WHERE a.page_id % 10 = 0 AND (a.page_id % 20 <> 0 OR b.url IS NOT NULL)),
wlines AS (
  SELECT warc_name,
         string_split(coalesce(string_split_regex(chr(10) || regexp_replace(value, '\r\n?', chr(10), 'g'),
                                                  {lit(r"\nWARC/1\.0[^\n]*")})[3], ''), chr(10)) AS lines
  FROM files),
wpos AS (
  SELECT *, list_position(list_transform(lines, lambda x: starts_with(x, '<')), true) AS first_lt FROM wlines),
wparts AS (
  SELECT *, CASE WHEN first_lt IS NOT NULL THEN lines[1:first_lt - 1] ELSE lines END AS pre,
         list_filter(CASE WHEN first_lt IS NOT NULL THEN lines[first_lt:] ELSE [] END,
                     lambda x: NOT (starts_with(x, 'WARC-Type: ') OR starts_with(x, 'WARC-Target-URI: '))) AS body
  FROM wpos),
wbody AS (
  SELECT *, CASE WHEN body[-1] = '' THEN body[1:len(body) - 1] ELSE body END AS body2 FROM wparts),
records AS (
  SELECT warc_name AS warc, {_last('lines', 'WARC-Target-URI: ')} AS url,
         CASE WHEN len(body2) > 0 THEN array_to_string(body2, chr(10)) || chr(10) ELSE '' END AS html,
         {_last('lines', 'WARC-Type: ')} AS resource_type,
         list_filter(pre, lambda x: starts_with(x, 'HTTP/'))[-1] AS http_code,
         list_transform(list_filter(pre, lambda x: starts_with(x, 'Content-Type: ')), lambda x: substring(x, 15))[-1]
           AS content_type,
         {_last('pre', 'Server: ')} AS server,
         list_has_any(list_transform(list_filter(pre, lambda x: starts_with(x, 'Content-Type: ')),
                                     lambda x: substring(x, 15)), {('[' + ', '.join(lit(t) for t in P.NON_HTML_CONTENT_TYPES) + ']')})
           AS not_html,
         substring(list_filter(lines, lambda x: starts_with(x, 'Location: '))[1], 11) AS location
  FROM wbody),
rmap AS (
  SELECT target, arg_max(origin, warc) AS origin FROM (
    SELECT warc, url AS origin,
           CASE WHEN starts_with(location, 'h') THEN location
                ELSE lower(CASE WHEN ends_with(url, '/') AND starts_with(regexp_replace(location, '/{{2,}}', '/', 'g'), '/')
                                THEN url || substring(regexp_replace(location, '/{{2,}}', '/', 'g'), 2)
                                ELSE url || regexp_replace(location, '/{{2,}}', '/', 'g') END) END AS target
    FROM records WHERE url IS NOT NULL AND location IS NOT NULL) GROUP BY target),
wpages AS (SELECT * FROM records WHERE location IS NULL OR url IS NULL),
joined AS (
  SELECT p.warc, p.url, coalesce(r.origin, 'N.D.') AS original_url
  FROM wpages p
  LEFT JOIN (SELECT url, min(warc) AS warc FROM wpages WHERE url IS NOT NULL GROUP BY url) f
    ON p.url = f.url AND p.warc = f.warc
  LEFT JOIN rmap r ON f.url = r.target)"""


def _warc(select: str) -> str:
    return f"WITH {WARC_CTES}\n{select}"


ORACLE.update({
    "warc_records": _warc("SELECT warc, url, html, location FROM records"),
    "warc_headers": _warc("SELECT warc, resource_type, url, http_code, content_type, server, not_html FROM records"),
    "warc_body": _warc("SELECT warc, CAST(strlen(html) AS BIGINT) AS body_bytes, "
                       "CAST(len(string_split(html, chr(10))) AS BIGINT) AS body_lines FROM records"),
    "redirect_map": _warc("SELECT target, origin FROM rmap"),
    "redirect_filter": _warc("SELECT warc, url FROM wpages"),
    "redirect_join": _warc("SELECT warc, url, original_url FROM joined"),
    "resume_batch": _warc("SELECT warc, url FROM records WHERE warc > 'page-0000000099'"),
})

# Streams over the plain page table: final state equals the batch answer.
ORACLE.update({
    "stream_counts": with_ctes(False, "SELECT page_id, is_html5, metric, key, subkey, CAST(sum(n) AS BIGINT) AS n "
                                      "FROM events GROUP BY ALL", classified=True),
    "stream_totals": with_ctes(False, "SELECT scope, metric, key, subkey, n FROM totals", classified=True),
    "stream_dedupe": "SELECT arg_min(page_id, CAST(page_id AS VARCHAR)) AS page_id, url FROM pages GROUP BY url",
})

# P16 on the WARC path: the records (redirect records dropped) are the pages, keyed by file name.
ORACLE["warc_page_results"] = (
    "WITH " + WARC_CTES + ",\nwsrc AS (SELECT warc AS page_id, url, html FROM wpages),"
    + base_ctes(False, "wsrc") + lint_cte() + classify_cte() + f"""
SELECT r.page_id AS warc, r.url, j.original_url, num_elements, doctype, num_links, num_internal_links,
       num_bookmarks, num_external_links, num_images, num_comments, file_size, text_size, elements_size,
       comments_size, text_to_elements, elements_to_size, text_to_size, comments_to_size,
       CAST(coalesce(num_errors, 0) AS BIGINT) AS num_errors,
       CAST(coalesce(num_warnings, 0) AS BIGINT) AS num_warnings,
       coalesce(w.resource_type, 'NA') AS type, coalesce(w.http_code, 'NA') AS http_code,
       coalesce(w.content_type, 'NA') AS content_type, coalesce(w.server, 'NA') AS server, r.charset
FROM ratios r
JOIN wpages w ON w.warc = r.page_id
JOIN joined j ON j.warc = r.page_id
LEFT JOIN msg_totals m ON r.page_id = m.page_id
WHERE r.status = 'ok' AND NOT coalesce(w.not_html, false)""")


def _catalog_sql() -> str:
    rows = ", ".join(f"({lit(e.family)}, {e.idx}, {lit(e.pattern)}, {lit(e.message)}, {e.n_groups})"
                     for e in lint_catalog())
    return with_ctes(True, f"""
SELECT c.family, CAST(c.idx AS INTEGER) AS idx, c.pattern, c.message, CAST(c.n_groups AS INTEGER) AS n_groups,
       CAST(coalesce(h.n, 0) AS BIGINT) AS n
FROM (VALUES {rows}) c(family, idx, pattern, message, n_groups)
LEFT JOIN (SELECT regexp_replace(canonical, '^(html5 error|warning html5) - ', '') AS message, sum(n) AS n
           FROM classified GROUP BY 1) h ON c.message = h.message""", classified=True)


ORACLE["catalog"] = _catalog_sql()

# Files written and read back hold what the queries return.
ORACLE.update({
    "redirect_file": ORACLE["redirect_map"],
    "validator_messages": with_ctes(True, "SELECT page_id, kind, message_id, message, n FROM lint", lint=True),
    "validator_status": with_ctes(True, """
        SELECT page_id, CASE WHEN status = 'ok' AND declared_charset IS NULL THEN 'failed_validation' ELSE status END AS status,
               declared_charset AS charset FROM parsed"""),
    "sink_results": ORACLE["page_results"].replace(varied_html(), "html"),
    "sink_counts": ORACLE["page_counts"].replace(varied_html(), "html"),
    "sink_totals": with_ctes(False, "SELECT scope, metric, key, subkey, n FROM totals", classified=True),
    "append_totals": with_ctes(False, "SELECT scope, metric, key, subkey, n FROM totals", classified=True),
    "sink_stats": with_ctes(False, f"SELECT * FROM ({_FUNNEL}) UNION ALL SELECT * FROM ({_DISTINCT})", classified=True),
})

# A varied query answers twice: for the pages as they are, and for their variations.
for _name in VARIED:
    ORACLE[f"{_name}_fixtures"] = ORACLE[_name]
    ORACLE[_name] = ORACLE[_name].replace(varied_html(), "html")
