"""Markup lint (L1-L13): the validator service re-aimed as Spark operators.

One pass: every token of a page (start tag, end tag, page-level finding) becomes
a few small events ``(ns, key, sub)`` in the page's own row; they are sorted and counted there by run lengths, so
messages need no shuffle; a narrow step turns the counts into
messages.  Rules that compare two sets inside a page (ids against references,
map names against usemaps, start against end tags) meet in the same group.

Output: ``page_id, (page keys), rule, kind, message_id, message, n`` where ``n``
is the number of occurrences of that message on the page.  A row of the page table is a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscope.functions import markup as M
from markscope.functions import patterns as P
from markscope.session import cached_expr

# Fixed values (must equal the reference for equal results): message templates of the lint rules, in the
# wording of the HTML validator.  {0}, {1} are the variable parts.
LINT_RULES = [
    # (rule, kind, template)
    ("duplicate_id", "error", "Duplicate ID {0}."),
    ("duplicate_attr", "error", "Duplicate attribute {0}."),
    ("required_attr", "error", "Element {0} is missing required attribute {1}."),
    ("obsolete_element_css", "error", "The {0} element is obsolete. Use CSS instead."),
    ("obsolete_element", "error", "The {0} element is obsolete. Use the {1} element instead."),
    ("obsolete_attr", "error", "The {0} attribute on the {1} element is obsolete. Use CSS instead."),
    ("unclosed", "error", "Unclosed element {0}."),
    ("stray_end", "error", "Stray end tag {0}."),
    ("dangling_ref", "error",
     "The {0} attribute referenced {1}, but there is no element with an id attribute with that value."),
    ("usemap", "error",
     "The hash-name reference in attribute usemap referred to {0}, but there is no map element "
     "with a name attribute with that value."),
    ("charset", "error", "The character encoding was not declared. Proceeding using {0}."),
    ("doctype", "error", "Start tag seen without seeing a doctype first. Expected {0}."),
    ("redundant_role", "warning", "The {0} role is unnecessary for element {1}."),
    ("script_type", "warning", "The type attribute is unnecessary for JavaScript resources."),
]
RULE_KIND = {r: k for r, k, _ in LINT_RULES}
TEMPLATE = {r: t for r, _, t in LINT_RULES}
FALLBACK_CHARSET = "windows-1252"
EXPECTED_DOCTYPE = "<!DOCTYPE html>"
JS_TYPES = ["text/javascript", "application/javascript"]

_EVENT = "struct<ns:string,key:string,sub:string>"


def render(rule: str, *parts: Column | str) -> Column:
    """The message text of ``rule`` with its variable parts filled in."""
    pieces = TEMPLATE[rule].split("{")
    out: list[Column] = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        idx, rest = piece.split("}", 1)
        part = parts[int(idx)]
        out.append(F.lit(part) if isinstance(part, str) else part)
        if rest:
            out.append(F.lit(rest))
    return F.concat(*out)


EVENT_ARRAY = "array<struct<ns:string,key:string,sub:string>>"


def _event(ns: Column | str, key: Column, sub: Column | str = "") -> Column:
    ns_c = F.lit(ns) if isinstance(ns, str) else ns
    sub_c = F.lit(sub) if isinstance(sub, str) else sub
    return F.struct(ns_c.alias("ns"), key.cast("string").alias("key"), sub_c.alias("sub"))


def _tag_rule_maps():
    """Literal maps from tag name to its tag-specific rules (one lookup per tag)."""
    def by_tag(pairs):
        out: dict[str, list[str]] = {}
        for tag, val in pairs:
            out.setdefault(tag, []).append(val)
        return out

    def str_map(d):
        return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])

    def list_map(d):
        return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])

    obsolete = {t: (("obsolete_element_css", TEMPLATE["obsolete_element_css"].format(t)) if r is None
                    else ("obsolete_element", TEMPLATE["obsolete_element"].format(t, r)))
                for t, r in P.OBSOLETE_ELEMENTS}
    return (list_map(by_tag(P.REQUIRED_ATTRIBUTES)),
            str_map({t: ns for t, (ns, _) in obsolete.items()}),
            str_map({t: msg for t, (_, msg) in obsolete.items()}),
            list_map(by_tag(P.OBSOLETE_ATTRIBUTES)),
            str_map(dict(P.IMPLICIT_ROLES)))


def _wants(rules: tuple[str, ...] | None, *of: str) -> bool:
    return rules is None or bool(set(rules) & set(of))


def _start_tag_events(tag: Column, vals: Column, names: Column, rules: tuple[str, ...] | None = None) -> Column:
    """array<event> for one start tag, from its (materialised) name, attribute values and names.

    With ``rules``, only the events that these rules need.
    """

    def val(name: str) -> Column:
        return M.value_in(vals, names, name)

    required, obs_ns, obs_msg, obs_attrs, implicit_role = _tag_rule_maps()
    empty = F.array().cast("array<string>")
    missing = F.filter(F.coalesce(required[tag], empty), lambda a: ~F.array_contains(names, a))
    present = F.filter(F.coalesce(obs_attrs[tag], empty), lambda a: F.array_contains(names, a))
    role = F.lower(F.trim(val("role")))
    stype = F.lower(F.trim(val("type")))
    id_val = val("id")
    usemap = val("usemap")
    map_name = val("name")
    single = [e for e, of in (
        (_event("tag", tag, "start"), ("unclosed", "stray_end")),
        (F.when(obs_ns[tag].isNotNull(), _event(obs_ns[tag], obs_msg[tag])), ("obsolete_element", "obsolete_element_css")),
        (F.when(implicit_role[tag] == role,
                _event("redundant_role", render("redundant_role", role, tag))), ("redundant_role",)),
        (F.when((tag == "script") & stype.isin(*JS_TYPES), _event("script_type", render("script_type"))), ("script_type",)),
        (F.when(id_val.isNotNull() & (id_val != ""), _event("id", id_val, "id")), ("duplicate_id", "dangling_ref")),
        (F.when(usemap.startswith("#"), _event("map", F.substring(usemap, 2, 1 << 30), "usemap")), ("usemap",)),
        (F.when((tag == "map") & map_name.isNotNull(), _event("map", map_name, "name")), ("usemap",)),
    ) if _wants(rules, *of)]
    req = F.transform(missing, lambda a: _event("required_attr", render("required_attr", tag, a)))
    obs = F.transform(present, lambda a: _event("obsolete_attr", render("obsolete_attr", a, tag)))
    dups = F.transform(names, lambda n, i: F.when(
        F.array_position(names, n) < i + 1,
        _event("duplicate_attr", render("duplicate_attr", n))))
    lists = [e for e, of in ((req, "required_attr"), (obs, "obsolete_attr"), (dups, "duplicate_attr"),
                             (_reference_events(vals, names), "dangling_ref")) if _wants(rules, of)]
    parts = ([F.array(*single)] if single else []) + lists
    return F.concat(*parts) if parts else F.array().cast(EVENT_ARRAY)


def _reference_events(vals: Column, names: Column) -> Column:
    """One ``id`` event per space-separated id named by a reference attribute.

    Only the reference attributes the tag actually has are looked at (usually none).
    """
    present = F.filter(F.array_distinct(names), lambda n: n.isin(*P.ID_REFERENCE_ATTRIBUTES))

    def ids_of(a: Column) -> Column:
        value = M.value_in(vals, names, a)
        ids = F.filter(F.split(F.coalesce(value, F.lit("")), P.BLANKS), lambda x: x != "")
        return F.transform(ids, lambda x: _event("id", x, a))

    return F.flatten(F.transform(present, ids_of))


def _link_events(tag: Column, vals: Column, names: Column, scheme: Column) -> Column:
    """Page counters as events: 'int'/'ext' per a/area link, 'book' per bookmark, one per img."""
    href = F.coalesce(M.value_in(vals, names, "href"), F.lit(""))
    is_link = tag.isin("a", "area")
    return F.array(
        F.when(is_link, _event("lnk", F.lit(""),
                               F.when(M.link_is_internal(href, scheme), "int").otherwise("ext"))),
        F.when(is_link & href.startswith("#"), _event("lnk", F.lit(""), "book")),
        F.when(tag == "img", _event("img", F.lit(""))))


MARKUP_METRICS = ["elements", "attributes", "protocols", "images"]


def event_counts(parsed: DataFrame, page_keys: tuple[str, ...] = (),
                 with_markup: bool = False, payload: str | None = None,
                 with_links: bool = False, rules: tuple[str, ...] | None = None) -> DataFrame:
    """A page's events counted per ``(ns, key, gsub)``, one row each (+ page keys), without a shuffle.

    ``gsub`` is the subkey of a markup metric and empty for lint events, whose
    ``sub`` values become fixed-width conditional counts instead.  All events of a page are in its own row: they are
    sorted and counted there by run lengths, and the runs of one ``(ns, key, gsub)`` meet as a slice of the runs.
    """
    from markscope.operators.rollup import tag_metric_events
    ptype = parsed.schema[payload].dataType if payload else None

    def tag_events(b):
        tag, vals, names = b["tag"], b["vals"], b["names"]
        out = _start_tag_events(tag, vals, names, rules)
        if with_markup:
            # no "elements" event: the lint's own (tag, start) events count the same thing
            out = F.concat(out, tag_metric_events(tag, vals, names, F.col("scheme"), ("ns", "key", "sub"), with_elements=False))
        if with_links:
            out = F.concat(out, _link_events(tag, vals, names, F.col("scheme")))
        return out

    def bind(raw):
        toks = F.transform(F.array(M.attr_tokens(raw)), lambda t: F.struct(
            M.tag_name(raw).alias("tag"), F.transform(t, M.attr_name).alias("names"), M.attr_values(raw, t).alias("vals")))
        return F.get(toks, F.lit(0))

    def build_events():
        page = [F.when(F.col("declared_charset").isNull(), _event("charset", render("charset", FALLBACK_CHARSET))),
                F.when(F.col("doctype") == P.NO_DOCTYPE, _event("doctype", render("doctype", EXPECTED_DOCTYPE)))]
        if payload:
            page.append(_event("page", F.lit("")))
        ends = F.transform("end_tags", lambda x: _event("tag", x, "end"))
        every = F.concat(F.flatten(F.transform("_tags", tag_events)), ends, F.array(*page))
        return F.sort_array(F.filter(every, lambda e: e.isNotNull())).alias("_events")

    carry = [F.col(c) for c in ("page_id", *page_keys)] + ([F.col(payload).alias("_payload")] if payload else [])
    need = [c for c in ("scheme", "end_tags", "declared_charset", "doctype") if c in parsed.columns and c not in page_keys]
    bound = parsed.select(*carry, *need, F.transform("start_tags", bind).alias("_tags"))
    names = ["page_id", *page_keys] + (["_payload"] if payload else [])
    runs = bound.select(*names, cached_expr(("page_events", with_markup, with_links, payload is not None, rules), build_events))
    runs = runs.select(*names, cached_expr("page_runs", lambda: M.count_runs("_events").alias("_runs")))

    def build_groups():
        def key(r):
            sub = F.when(r["item"]["ns"].isin(*MARKUP_METRICS), r["item"]["sub"]).otherwise(F.lit(""))
            return F.struct(r["item"]["ns"].alias("ns"), r["item"]["key"].alias("key"), sub.alias("gsub"))
        keyed = F.transform("_runs", key)
        return keyed.alias("_keys")

    staged = runs.select(*names, "_runs", cached_expr("run_keys", build_groups))
    groups = staged.select(*names, "_runs", F.explode(cached_expr("run_groups", lambda: M.count_runs("_keys", with_start=True))).alias("g"))

    def build_counts():
        mine = F.slice("_runs", F.col("g.start") + 1, F.col("g.n").cast("int"))
        return [F.col("g.item.ns").alias("ns"), F.col("g.item.key").alias("key"), F.col("g.item.gsub").alias("gsub"), mine.alias("_mine")]

    def count_of(ns: str, sub: str) -> Column:
        found = F.get(F.filter("_mine", lambda r: r["item"]["sub"] == sub), F.lit(0))["n"]
        return F.when(F.col("ns") == ns, F.coalesce(found, F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))

    def build_out():
        one = F.get("_mine", F.lit(0))["n"]
        cols = [F.when(F.size("_mine") == 1, one).otherwise(F.aggregate("_mine", F.lit(0).cast("bigint"), lambda a, r: a + r["n"])).alias("n"),
                *(count_of(ns, sub).alias(name) for name, ns, sub in (("n_start", "tag", "start"), ("n_end", "tag", "end"), ("n_id", "id", "id"),
                                                                      ("n_usemap", "map", "usemap"), ("n_name", "map", "name")))]
        cols += [count_of("id", a).alias(f"ref_{i}") for i, a in enumerate(P.ID_REFERENCE_ATTRIBUTES)]
        if with_links:
            cols += [count_of("lnk", x).alias(f"n_{x}") for x in ("int", "ext", "book")]
        return cols

    sliced = groups.select(*names, *cached_expr("run_slices", build_counts))
    out = sliced.select(*names, "ns", "key", "gsub", *cached_expr(("run_counts", with_links), build_out))
    return out.withColumnRenamed("_payload", "payload") if payload else out


def lint_messages(parsed: DataFrame, page_keys: tuple[str, ...] = (),
                  rules: tuple[str, ...] | None = None) -> DataFrame:
    """Messages of all lint rules: ``page_id, *page_keys, rule, kind, message_id, message, n``.

    With ``rules``, messages of these are whole (others may be there in part: filter on ``rule``).
    """
    return messages_from_counts(event_counts(parsed, page_keys, rules=rules), page_keys)


def messages_from_counts(c: DataFrame, page_keys: tuple[str, ...] = (),
                         keep_markup: bool = False, keep_page: bool = False) -> DataFrame:
    """Lint messages from aggregated events.

    Each aggregated group yields at most a few ``(rule, n, arg)`` candidates; the
    message text is rendered once, after the explode, by one CASE over the rule.
    Markup metric rows yield nothing, or with ``keep_markup`` one row with
    ``rule = 'markup'`` and ``metric, key, subkey`` set (message columns null).
    """
    links = keep_page and "n_int" in c.columns
    explode, cols = cached_expr(("lint_messages", keep_markup, keep_page, links),
                                lambda: _message_columns(keep_markup, keep_page, links))
    extra = ["payload"] if keep_page else []
    msgs = c.select("page_id", *page_keys, "key", "ns", *extra, explode).filter(F.col("m").isNotNull())
    if keep_page:
        cols = cols + [F.when(F.col("m.rule") == "page", F.col("payload")).alias("payload")]
    return msgs.select("page_id", *page_keys, *cols)


def _message_columns(keep_markup: bool, keep_page: bool = False, links: bool = False):
    """(explode of the candidates, output columns) of ``messages_from_counts``."""
    ns, key, n = F.col("ns"), F.col("key"), F.col("n")
    diff = F.col("n_start") - F.col("n_end")
    no_unclosed = P.VOID_ELEMENTS + P.OPTIONAL_END_ELEMENTS + P.RAW_TEXT_ELEMENTS
    no_stray = P.VOID_ELEMENTS + P.RAW_TEXT_ELEMENTS
    grouped = ("duplicate_id", "unclosed", "stray_end", "dangling_ref", "usemap")
    direct = [r for r, _, _ in LINT_RULES if r not in grouped]

    def cand(rule: Column | str, count: Column, arg: Column | str = "") -> Column:
        r = F.lit(rule) if isinstance(rule, str) else rule
        a = F.lit(arg) if isinstance(arg, str) else arg
        return F.struct(r.alias("rule"), count.cast("bigint").alias("n"), a.alias("arg"))

    candidates = [
        F.when(ns.isin(*direct), cand(ns, n)),
        F.when((ns == "tag") & (diff > 0) & ~key.isin(*no_unclosed), cand("unclosed", diff)),
        F.when((ns == "tag") & (diff < 0) & ~key.isin(*no_stray), cand("stray_end", -diff)),
        F.when((ns == "id") & (F.col("n_id") > 1), cand("duplicate_id", F.col("n_id") - 1)),
        F.when((ns == "map") & (F.col("n_name") == 0) & (F.col("n_usemap") > 0),
               cand("usemap", F.col("n_usemap"))),
    ]
    for i, a in enumerate(P.ID_REFERENCE_ATTRIBUTES):
        refs = F.col(f"ref_{i}")
        candidates.append(F.when((ns == "id") & (F.col("n_id") == 0) & (refs > 0),
                                 cand("dangling_ref", refs, a)))
    if keep_markup:
        candidates.append(F.when(ns.isin(*MARKUP_METRICS), cand("markup", n, F.col("gsub"))))
        candidates.append(F.when((ns == "tag") & (F.col("n_start") > 0),
                                 cand("markup", F.col("n_start"), F.col("gsub"))))
    if keep_page:
        candidates.append(F.when(ns == "page", cand("page", F.lit(0))))
    if links:
        candidates += [F.when(ns == "lnk", cand(f"lnk_{x}", F.col(f"n_{x}"))) for x in ("int", "ext", "book")]
        candidates.append(F.when(ns == "img", cand("img", n)))
    explode = F.explode(F.array(*candidates)).alias("m")
    rule, arg = F.col("m.rule"), F.col("m.arg")
    text = (F.when(rule == "unclosed", render("unclosed", key))
            .when(rule == "stray_end", render("stray_end", key))
            .when(rule == "duplicate_id", render("duplicate_id", key))
            .when(rule == "usemap", render("usemap", key))
            .when(rule == "dangling_ref", render("dangling_ref", arg, key))
            .otherwise(key))
    kind = F.create_map(*[x for r, k, _ in LINT_RULES for x in (F.lit(r), F.lit(k))])
    is_msg = ~rule.isin("markup", "page", "lnk_int", "lnk_ext", "lnk_book", "img")
    cols = [rule.alias("rule"),
            F.when(is_msg, kind[rule]).alias("kind"),
            F.when(is_msg, F.lit("html5")).alias("message_id"),
            F.when(is_msg, text).alias("message"),
            F.col("m.n").alias("n")]
    if keep_markup:
        metric = F.when(F.col("ns") == "tag", F.lit("elements")).otherwise(F.col("ns"))
        cols += [F.when(~is_msg, metric).alias("metric"), F.when(~is_msg, key).alias("mkey"),
                 F.when(~is_msg, arg).alias("msubkey")]
    return explode, cols
