"""Message classification (S6, W7, J3) and per-page message aggregates.

A catalogue is an ordered table of ``(family, idx, pattern, message, n_groups)``; a message is
put in the class of the first pattern (lowest index) that is *found* in its
lower-cased text and has at least one group; the groups, joined by `` | ``,
are its variables.  Patterns without a group never match.

``classify`` is one plan for any number of patterns.  Every pattern has a *required literal*, a run of
characters that stands in each text it is found in; one short piece of that run, the rarest in the
catalogue, is the pattern's index key.  Distinct messages are cut into pieces of the same lengths and joined
with the patterns on the piece (an equi-join); only these candidates are tested by regex, the smallest index wins, and
the class goes back to the message rows.

``classify_lint`` sorts the messages of our own lint rules, whose templates are fixed in the code: the few
patterns are literals of one expression next to the message, with no join and no second use of the rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscope.functions import markup as M
from markscope.session import cached_expr

HTML5_FAMILY = "html5"
GENERAL_FAMILY = "general"


@dataclass(frozen=True)
class CatalogEntry:
    family: str
    idx: int
    pattern: str
    message: str
    n_groups: int


def _n_groups(pattern: str) -> int:
    try:
        return re.compile(pattern).groups
    except re.error:
        return 0


def _escape(text: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in text)


def entries_from_lines(family: str, patterns: list[str], messages: list[str]) -> list[CatalogEntry]:
    """Pair line i of the patterns with line i of the messages; both lower-cased."""
    out = []
    for i, (p, m) in enumerate(zip(patterns, messages)):
        p, m = p.lower(), m.lower()
        out.append(CatalogEntry(family, i, p, m, _n_groups(p)))
    return out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, line)`` of a text file, lower-cased; the empty piece after the last line end is no line."""
    whole = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n", -1).alias("l"))
    lines = F.when(F.element_at("l", -1) == "", F.slice("l", F.lit(1), F.size("l") - 1)).otherwise(F.col("l"))
    return whole.select(F.posexplode(lines).alias("idx", "line")).withColumn("line", F.lower("line"))


def read_catalog_files(spark: SparkSession, family: str, patterns_path: str, messages_path: str) -> DataFrame:
    """A catalogue kept as two text files, line i of the patterns paired with line i of the messages.

    Both are lower-cased, as the messages are before they are tested.  Lines without a partner are left out.
    """
    pats = _lines(spark, patterns_path).withColumnRenamed("line", "pattern")
    msgs = _lines(spark, messages_path).withColumnRenamed("line", "message")
    return pats.join(msgs, "idx").select(F.lit(family).alias("family"), "idx", "pattern", "message", n_groups(F.col("pattern")).alias("n_groups"))


# an escaped character or a quoted run, then a character class: neither opens a group
_ESCAPED = r"\\Q.*?\\E|\\."
_CLASS = r"\[\^?\]?[^\]]*\]"
_GROUP = r"\((?!\?)|\(\?<[a-zA-Z]"
GAP = "\x01"


def n_groups(pattern: Column) -> Column:
    """Capturing groups of a pattern by the rules of java.util.regex."""
    plain = F.regexp_replace(F.regexp_replace(pattern, _ESCAPED, "x"), _CLASS, "x")
    return F.size(F.regexp_extract_all(plain, F.lit(_GROUP), F.lit(0)))


def required_literal(pattern: Column) -> Column:
    """The longest run of characters that stands in every text in which the pattern is found; '' if none is sure.

    Groups, classes, escapes and quantified characters become gaps; a pattern with alternatives, with flags or escapes that
    change what its characters mean, with nested classes, or with parentheses left over has no sure run.
    """
    x = F.regexp_replace(pattern, _ESCAPED, GAP)
    nested = x.rlike(r"\[[^\]]*\[")
    x = F.regexp_replace(x, _CLASS, GAP)
    unsure = (F.instr(x, "|") > 0) | x.rlike(r"\(\?[a-zA-Z]") | pattern.rlike(r"\\[xupPkcN0-9]") | nested
    for _ in range(6):      # innermost groups first
        x = F.regexp_replace(x, r"\([^()]*\)", GAP)
    unsure = unsure | x.rlike(r"[()]")
    # a character (or a gap) that may be missing or repeated, then all that is no character of its own
    x = F.regexp_replace(x, r"(?s).(?:[*?]|\{[^}]*\})[+?]?", GAP)
    x = F.regexp_replace(x, r"[.^$+\[\]{}\\]", GAP)
    pieces = F.split(x, GAP, -1)
    longest = F.element_at(F.array_sort(F.transform(pieces, lambda p: F.struct((-F.length(p)).alias("k"), p.alias("p")))), 1)["p"]
    return F.when(unsure, F.lit("")).otherwise(longest)


#: Lengths of index pieces: a pattern uses the greatest that its literal has; 0 stands for a pattern without one.
PIECES = [12, 6, 3, 1, 0]


def _cut(text: Column, size: Column | int) -> Column:
    """array<string>: the distinct pieces of ``size`` characters of a text (one empty piece for size 0)."""
    n = F.lit(size) if isinstance(size, int) else size
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    pieces = F.array_distinct(F.transform(at, lambda i: F.substring(text, i, n)))
    return F.when(n == 0, F.array(F.lit(""))).when(F.length(text) >= n, pieces).otherwise(F.array().cast("array<string>"))


def index_catalog(catalog: DataFrame) -> DataFrame:
    """The catalogue's live patterns with their index key ``(size, piece)``: the piece that fewest of its literals hold."""
    live = catalog.filter(F.col("n_groups") > 0).withColumn("_literal", required_literal(F.col("pattern")))
    size = F.coalesce(*[F.when(F.length("_literal") >= k, F.lit(k)) for k in PIECES])
    pieces = live.withColumn("size", size).select("family", "idx", "size", F.explode(_cut(F.col("_literal"), F.col("size"))).alias("piece"))
    held = pieces.groupBy("size", "piece").agg(F.count("*").alias("held"))
    rarest = pieces.join(held, ["size", "piece"]).groupBy("family", "idx").agg(
        F.min_by(F.struct("size", "piece"), F.struct("held", "size", "piece")).alias("key"))
    return live.join(rarest, ["family", "idx"]).select("family", "idx", "pattern", "message", "n_groups", "key.size", "key.piece")


def first_matches(distinct: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(family, message, class, variables)`` of the distinct ``(family, message)`` that a pattern is found in."""
    index = index_catalog(catalog)
    sizes = index.select("family", "size").distinct()       # of PIECES, those that are in use
    cut = distinct.select("family", F.col("message").alias("_text"), F.lower("message").alias("_lower")).join(sizes, "family")
    cut = cut.withColumn("piece", F.explode(_cut(F.col("_lower"), F.col("size"))))
    hit = cut.join(index, ["family", "size", "piece"]).filter("_lower RLIKE pattern")
    best = hit.groupBy("family", "_text").agg(F.min(F.struct("idx", "pattern", F.col("message").alias("class"), "n_groups")).alias("b"))
    lm = F.lower("_text")
    groups = F.transform(F.sequence(F.lit(1), F.col("b.n_groups")),
                         lambda g: M.scrub(F.call_function("regexp_extract", lm, F.col("b.pattern"), g)))
    return best.select("family", F.col("_text").alias("message"), F.col("b.class").alias("class"),
                       F.lower(F.array_join(groups, " | ")).alias("variables"))


def _label(kind: Column, message_id: Column, body: Column) -> Column:
    """The class label (fixed formats)."""
    is_h5 = message_id == HTML5_FAMILY
    return (F.when((kind == "error") & is_h5, F.concat(F.lit("html5 error - "), body))
            .when(kind == "error", F.concat(F.lit("error - "), message_id, F.lit(" - "), body))
            .when(is_h5, F.concat(F.lit("warning html5 - "), body))
            .otherwise(F.concat(F.lit("warning - "), message_id, F.lit(" - "), body)))


def classify(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``canonical`` (the class label) and ``variables`` to each message, for a catalogue of any size.

    ``message_id = 'html5'`` uses the html5 family, any other id the general one.
    Labels: ``html5 error - c``, ``error - <id> - c``, ``warning html5 - c``,
    ``warning - <id> - c``; an unmatched message keeps its own (scrubbed) text.  The rows are used twice (their distinct messages are
    classified, and the classes joined back), so give a table that is written, not a long plan.
    """
    family = F.when(F.col("message_id") == HTML5_FAMILY, F.lit(HTML5_FAMILY)).otherwise(F.lit(GENERAL_FAMILY))
    rows = messages.withColumn("_family", family)
    found = first_matches(rows.select(F.col("_family").alias("family"), "message").filter("message IS NOT NULL").distinct(), catalog)
    found = found.select(F.col("family").alias("_family"), "message", F.col("class").alias("_class"), "variables")
    # a message that a third of all rows carry is a hot key of this join: adaptive execution splits it
    joined = rows.join(found, ["_family", "message"], "left")
    body = F.coalesce("_class", M.scrub(F.col("message")))
    return joined.select(*messages.columns, _label(F.col("kind"), F.col("message_id"), body).alias("canonical"), "variables")


def template_entries(family: str, templates: list[str]) -> list[CatalogEntry]:
    """A catalogue generated from message templates with ``{0}``, ``{1}`` places.

    Literal parts are escaped, each place becomes a greedy group ``(.*)``, and the
    canonical message names the places X, Y, Z.
    """
    names = "XYZUVW"
    pats, msgs = [], []
    for t in templates:
        parts = re.split(r"\{(\d)\}", t)
        pat, msg = "", ""
        for k, part in enumerate(parts):
            if k % 2 == 0:
                pat += _escape(part)
                msg += part
            else:
                pat += "(.*)"
                msg += names[int(part)]
        pats.append(pat)
        msgs.append(msg)
    return entries_from_lines(family, pats, msgs)


def lint_catalog() -> list[CatalogEntry]:
    """Our catalogue for the lint rules (family html5), in rule order."""
    from markscope.operators.lint import LINT_RULES
    return template_entries(HTML5_FAMILY, [t for _, _, t in LINT_RULES])


def catalog_frame(spark: SparkSession, entries: list[CatalogEntry]) -> DataFrame:
    schema = "family string, idx int, pattern string, message string, n_groups int"
    return spark.createDataFrame([(e.family, e.idx, e.pattern, e.message, e.n_groups)
                                  for e in entries], schema)


def _canonical_and_variables(lm: Column, idx: Column, entries: list[CatalogEntry]):
    """(canonical, variables) of the entry ``idx``, read off literal arrays by index."""
    by_idx = {e.idx: e for e in entries}
    size = max(by_idx) + 1
    messages_arr = F.array(*[F.lit(by_idx[i].message if i in by_idx else None).cast("string") for i in range(size)])
    patterns_arr = F.array(*[F.lit(by_idx[i].pattern if i in by_idx else "") for i in range(size)])
    groups_arr = F.array(*[F.lit(by_idx[i].n_groups if i in by_idx else 0) for i in range(size)])
    at = idx + 1
    pattern = F.element_at(patterns_arr, at)
    groups = F.transform(F.sequence(F.lit(1), F.element_at(groups_arr, at)),
                         lambda g: M.scrub(F.call_function("regexp_extract", lm, pattern, g)))
    return F.element_at(messages_arr, at), F.lower(F.array_join(groups, " | "))


def classify_lint(found: DataFrame) -> DataFrame:
    """J3 for the messages of our own lint rules: ``canonical`` and ``variables`` by the lint catalogue, next to the row.

    The first-match index is computed once into a column, then the label and the variables are read off it.
    """
    def index():
        lm = F.lower("message")
        live = [e for e in lint_catalog() if e.n_groups > 0]
        return F.when(F.col("message_id") == HTML5_FAMILY, F.coalesce(*[F.when(lm.rlike(e.pattern), F.lit(e.idx)) for e in live]))

    def labels():
        canon, variables = _canonical_and_variables(F.lower("message"), F.col("_idx"), [e for e in lint_catalog() if e.n_groups > 0])
        hit = F.col("_idx").isNotNull()
        body = F.when(hit, canon).otherwise(M.scrub(F.col("message")))
        return _label(F.col("kind"), F.col("message_id"), body), F.when(hit, variables)

    label, variables = cached_expr("lint_classes", labels)
    return found.withColumn("_idx", cached_expr("lint_index", index)).select(
        *found.columns, label.alias("canonical"), variables.alias("variables"))


# --- validator results (S8, W7) -------------------------------------------

VALIDATOR_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("forced", T.BooleanType()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("lastLine", T.IntegerType()),
        T.StructField("lastColumn", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("messageid", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("subtype", T.StringType()),
    ]))),
    T.StructField("source", T.StructType([
        T.StructField("encoding", T.StringType()),
        T.StructField("type", T.StringType()),
    ])),
])


def read_validator_results(spark: SparkSession, path: str) -> DataFrame:
    """JSON validator results, one object per line, with an explicit schema."""
    return spark.read.schema(VALIDATOR_SCHEMA).json(path)


def validator_messages(results: DataFrame) -> DataFrame:
    """Explode messages; ``type = 'error'`` is an error, else ``subtype = 'warning'``."""
    m = results.select("page_id", F.explode("messages").alias("m"))
    kind = (F.when(F.col("m.type") == "error", F.lit("error"))
            .when(F.col("m.subtype") == "warning", F.lit("warning")))
    return (m.select("page_id", kind.alias("kind"), F.col("m.messageid").alias("message_id"),
                     F.col("m.message").alias("message"),
                     F.col("m.lastLine").alias("last_line"), F.col("m.lastColumn").alias("last_column"))
            .filter(F.col("kind").isNotNull())
            .withColumn("n", F.lit(1).cast("bigint")))


def validator_charsets(results: DataFrame) -> DataFrame:
    """``page_id, encoding, forced`` of each result."""
    return results.select("page_id", F.col("source.encoding").alias("encoding"), "forced")
