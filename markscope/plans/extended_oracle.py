"""DuckDB SQL of the queries in ``plans.extended``, written independently of their Spark plans."""

from __future__ import annotations

from markscope.functions import patterns as P
from markscope.operators.lint import LINT_RULES
from markscope.plans import oracle
from markscope.plans.oracle import WARC_CTES, base_ctes, classify_cte, decode, in_list, lint_cte, lit, scrub, varied_html, with_ctes


# --- the generated catalogue --------------------------------------------------------

def _catalog_ctes() -> str:
    """``cat(idx, pattern, message, n_groups)``: sections 0 to 3, each template; see ``extended.catalog_lines``."""
    rows = []
    for t, (_, _, template) in enumerate(LINT_RULES):
        n = sum(f"{{{k}}}" in template for k in range(3))
        text = template.lower()
        body = "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)
        named = template.lower()
        for k, name in enumerate("xyz"):
            body = body.replace(f"\\{{{k}\\}}", f"<{k}>")
            named = named.replace(f"{{{k}}}", name)
        pattern = lit(body).replace("<0>", "' || p || '")
        for k in (1, 2):
            pattern = pattern.replace(f"<{k}>", "' || r || '")
        rows.append(f"SELECT s AS section, {t} AS t, word, {pattern} AS pattern, s || ' ' || word || {lit(' ' + named)} AS message, "
                    f"CASE WHEN s = 1 THEN 0 ELSE {n} END AS n_groups FROM filled")
    return f""",
words AS (SELECT tag AS word FROM el WHERE tag <> '' UNION SELECT attr FROM attrs WHERE attr <> ''),
filled AS (
  SELECT CASE WHEN length(word) % 2 = 0 THEN 0 ELSE 3 END AS s, word,
         '(' || regexp_replace(word, '([^a-zA-Z0-9])', '\\\\\\1', 'g') || ')' AS p, '(.*)?' AS r FROM words
  UNION ALL VALUES (1, '', '.*', '.*'), (2, '', '(.*)?', '(.*)?')),
lines AS ({" UNION ALL ".join(rows)}),
cat AS (SELECT CAST(row_number() OVER (ORDER BY section, t, word) - 1 AS INTEGER) AS idx, pattern, message, n_groups FROM lines)"""


def _classes_sql() -> str:
    groups = [scrub(f"regexp_extract(lm, pattern, {k})") for k in (1, 2, 3)]
    variables = "CASE n_groups " + " ".join(f"WHEN {n} THEN lower({" || ' | ' || ".join(groups[:n])})" for n in (1, 2, 3)) + " END"
    return with_ctes(True, f"""
SELECT m.page_id, m.kind, m.message_id, m.message, m.n,
       CASE WHEN m.kind = 'error' AND m.message_id = 'html5' THEN 'html5 error - '
            WHEN m.kind = 'error' THEN 'error - ' || m.message_id || ' - '
            WHEN m.message_id = 'html5' THEN 'warning html5 - '
            ELSE 'warning - ' || m.message_id || ' - ' END || coalesce(b.message, {scrub('m.message')}) AS canonical,
       b.variables
FROM (SELECT page_id, kind, CASE WHEN page_id % 2 = 0 THEN message_id ELSE rule END AS message_id, message, n FROM lint WHERE status = 'ok') m
LEFT JOIN (SELECT text, message, {variables} AS variables
           FROM (SELECT d.text, lower(d.text) AS lm, cat.* FROM (SELECT DISTINCT message AS text FROM lint) d
                 JOIN cat ON n_groups > 0 AND regexp_matches(lower(d.text), cat.pattern)
                 QUALIFY row_number() OVER (PARTITION BY d.text ORDER BY cat.idx) = 1)) b ON b.text = m.message""", lint=True, more=_catalog_ctes())


# --- text by element: the stack as a list, one token a step ------------------------------

def _element_text_sql(varied: bool) -> str:
    name = f"regexp_extract(t, {lit(P.TAG_NAME)}, 1)"
    body = f"replace(regexp_replace(t, {lit(P.SCAN_TEXT_RE2)}, {lit(P.TEXT_REPL_RE2)}, 'g'), {lit(P.BREAK)}, '')"
    html = varied_html() if varied else "html"
    return f"""
WITH RECURSIVE cut AS (
  SELECT page_id, unnest(ts) AS t, unnest(generate_series(1, len(ts))) AS i
  FROM (SELECT page_id, regexp_extract_all(coalesce({html}, ''), {lit(P.SCAN_TOKENS_RE2)}, 0) AS ts FROM pages)),
named AS (
  SELECT page_id, i, t, CASE WHEN NOT starts_with(t, '<') OR t = '<' THEN 't' WHEN starts_with(t, '</') THEN 'e'
         WHEN starts_with(t, '<!') OR starts_with(t, '<?') THEN 'o' WHEN lower({name}) IN {in_list(P.RAW_TEXT_ELEMENTS)} THEN 'r'
         WHEN {name} = '' THEN 't' ELSE 's' END AS kind,
         CASE WHEN starts_with(t, '</') THEN lower(regexp_extract(t, {lit(P.END_TAG_NAME)}, 1)) ELSE {scrub(f'lower({name})')} END AS name
  FROM cut),
tok AS (
  SELECT page_id, i, kind, name, count(*) FILTER (WHERE kind IN ('s', 'r')) OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos,
         CASE WHEN kind = 't' THEN t WHEN kind = 'r' THEN {body} WHEN kind = 's' AND name = 'br' THEN ' ' ELSE '' END AS body
  FROM named),
walk AS (
  SELECT page_id, 0::BIGINT AS i, []::STRUCT(p BIGINT, n VARCHAR)[] AS stack, NULL::BIGINT AS owner, '' AS body, 0::BIGINT AS seq FROM pages
  UNION ALL
  SELECT w.page_id, k.i,
         CASE WHEN k.kind = 's' AND k.name NOT IN {in_list(P.VOID_ELEMENTS)} THEN list_append(stack, {{'p': k.pos, 'n': k.name}})
              WHEN k.kind = 'e' AND list_contains(list_transform(stack, lambda x: x.n), k.name)
              THEN stack[1:len(stack) - list_position(list_reverse(list_transform(stack, lambda x: x.n)), k.name)]
              ELSE stack END,
         CASE WHEN k.kind = 'r' THEN k.pos ELSE coalesce(stack[-1].p, -1) END, k.body, k.i
  FROM walk w JOIN tok k ON k.page_id = w.page_id AND k.i = w.i + 1),
owned AS (SELECT page_id, owner, string_agg(body, '' ORDER BY seq) AS body FROM walk WHERE owner IS NOT NULL GROUP BY page_id, owner)
SELECT o.page_id, o.owner AS pos, coalesce(k.name, '') AS tag, trim(regexp_replace({decode('o.body')}, {lit(P.BLANKS)}, ' ', 'g'), ' ') AS own_text
FROM owned o LEFT JOIN tok k ON k.page_id = o.page_id AND k.pos = o.owner AND k.kind IN ('s', 'r')
WHERE trim(regexp_replace({decode('o.body')}, {lit(P.BLANKS)}, ' ', 'g'), ' ') <> ''"""


def _warc_events(select: str) -> str:
    """Over the events of the WARC pages (redirect records dropped)."""
    return ("WITH " + WARC_CTES + ",\nwsrc AS (SELECT warc AS page_id, url, html FROM wpages)," + base_ctes(False, "wsrc")
            + lint_cte() + classify_cte() + "\n" + select)


_FORCED_FUNNEL = """
SELECT stat, CAST(value AS BIGINT) AS value FROM (
  SELECT 'records_seen' AS stat, count(*) AS value FROM s
  UNION ALL SELECT 'excluded_not_html', 0
  UNION ALL SELECT 'excluded_no_bytes', count(*) FILTER (WHERE st = 'failed_no_bytes') FROM s
  UNION ALL SELECT 'excluded_validation', count(*) FILTER (WHERE st = 'failed_validation') FROM s
  UNION ALL SELECT 'excluded_parsing', count(*) FILTER (WHERE st = 'failed_parsing') FROM s
  UNION ALL SELECT 'successful', count(*) FILTER (WHERE st = 'ok') FROM s
  UNION ALL SELECT 'forced', count(*) FILTER (WHERE st = 'ok' AND page_id % 7 = 0) FROM s)"""
_S = ", s AS (SELECT page_id, CASE WHEN status = 'ok' AND declared_charset IS NULL THEN 'failed_validation' ELSE status END AS st FROM parsed)"

ORACLE: dict[str, str] = {
    "warc_scan": f"WITH {WARC_CTES} SELECT url, html, resource_type, http_code, content_type, server, not_html, location FROM records",
    "stream_warc_counts": _warc_events("SELECT is_html5, metric, key, subkey, CAST(sum(n) AS BIGINT) AS n FROM events GROUP BY ALL"),
    "distinct_stats_sketch": oracle.ORACLE["distinct_stats"],
    "distinct_stats_sketch_fixtures": oracle.ORACLE["distinct_stats_fixtures"],
    "merge_count_maps": with_ctes(False, "SELECT page_id, key, count(*) AS n FROM (SELECT page_id, tag AS key FROM el "
                                         "UNION ALL SELECT page_id, attr FROM attrs WHERE is_first) GROUP BY ALL"),
    "metric_pages": with_ctes(False, "SELECT metric, count(DISTINCT page_id) AS pages, min(n)::BIGINT AS least FROM (SELECT page_id, metric, key, subkey, "
                                     "sum(n) AS n FROM events GROUP BY ALL) GROUP BY metric", classified=True),
    "run_funnel_validator": with_ctes(False, _FORCED_FUNNEL, more=_S),
    "totals_of_key": with_ctes(False, "SELECT scope, subkey, n FROM totals WHERE metric = 'attributes' AND key = 'a'", classified=True),
    "element_text": _element_text_sql(False),
    "element_text_fixtures": _element_text_sql(True),
    "catalog_files": with_ctes(True, "SELECT 'html5' AS family, idx, pattern, message, CAST(n_groups AS INTEGER) AS n_groups FROM cat",
                               more=_catalog_ctes()),
    "message_classes_catalog": _classes_sql(),
}
