"""Regular expressions and fixed value lists.

Every pattern exists in two spellings when the engines need it:

* ``*_JVM``: Java regex, used by Spark.  Loops over tag bodies are possessive so
  a tag of 50,000 bare characters or an unterminated quote cannot make the
  backtracking matcher recurse per character (stack overflow) or run for ever.
* ``*_RE2``: the same language for RE2 (DuckDB, the oracle).  RE2 is linear and
  has no possessive quantifiers; never use this spelling in Spark.

Both spellings match the same strings: the alternatives of every loop start with
disjoint characters, so possessive and backtracking matching take the same path.
Whitespace is spelled ``[ \\t\\n\\f\\r]`` because ``\\s`` differs between the two
engines (Java also takes vertical tab).
"""

from html.entities import html5 as _html5_entities

WS = r"[ \t\n\f\r]"
WS_CHARS = " \t\n\f\r"

# --- tokens ---------------------------------------------------------------
# A tag name runs to a blank, "/" or ">"; attributes follow a blank or "/".
NAME = r"[a-zA-Z][^ \t\n\f\r/>]*"
TAG_REST_JVM = r"""(?:[ \t\n\f\r/](?:[^>"']++|"[^"]*+"|'[^']*+')*+)?+>"""
TAG_REST_RE2 = r"""(?:[ \t\n\f\r/](?:[^>"']|"[^"]*"|'[^']*')*)?>"""
START_TAG_JVM = "<" + NAME + "+" + TAG_REST_JVM
START_TAG_RE2 = "<" + NAME + TAG_REST_RE2
END_TAG = r"</[a-zA-Z][^>]*>"
END_TAG_NAME = "^</(" + NAME + ")"
TAG_NAME = "^<(" + NAME + ")"
DECLARATION = r"<![^>]*>|<\?[^>]*>"
# A comment that is never closed runs to the end of the page; so does the body of an element below.
COMMENT = r"(?s:<!--.*?(?:-->|\z))"
COMMENT_END = r"-->\z"
# Elements whose body is text up to their end tag, markup or not: script and style hold data,
# the others hold page text.
DATA_ELEMENTS = ["script", "style"]
PLAIN_TEXT_ELEMENTS = ["title", "textarea", "xmp", "iframe", "noframes"]


def _raw_element(name: str, rest: str, keep: str) -> str:
    """An element with a plain body; ``keep`` says whether its start tag or its body is a group."""
    start, body = f"<(?i:{name}){rest}", "(?s:.*?)"
    start = f"({start})" if keep == "start" else start
    body = f"({body})" if keep == "body" else body
    return rf"{start}{body}(?:</(?i:{name})(?:[ \t\n\f\r/][^>]*)?>|\z)"


def _scan(start_tag: str, rest: str, keep: str) -> str:
    """One left-to-right scan over everything that is not text.

    keep = "start": groups are the start tags of plain-body elements, then any other token.
    keep = "body": groups are the bodies of the plain-text elements.
    keep = "": no groups.
    """
    raw = [_raw_element(n, rest, "" if keep == "body" else keep) for n in DATA_ELEMENTS]
    raw += [_raw_element(n, rest, keep) for n in PLAIN_TEXT_ELEMENTS]
    other = f"{start_tag}|{END_TAG}|{DECLARATION}"
    return "|".join([COMMENT, *raw, f"({other})" if keep == "start" else other])


SCAN_MARKUP_JVM = _scan(START_TAG_JVM, TAG_REST_JVM, "start")
SCAN_MARKUP_RE2 = _scan(START_TAG_RE2, TAG_REST_RE2, "start")
SCAN_TEXT_JVM = _scan(START_TAG_JVM, TAG_REST_JVM, "body")
SCAN_TEXT_RE2 = _scan(START_TAG_RE2, TAG_REST_RE2, "body")
SCAN_JVM = _scan(START_TAG_JVM, TAG_REST_JVM, "")
SCAN_RE2 = _scan(START_TAG_RE2, TAG_REST_RE2, "")
# all of a page: the scan's tokens and the text between them
SCAN_TOKENS_JVM = SCAN_JVM + "|[^<]++|<"
SCAN_TOKENS_RE2 = SCAN_RE2 + "|[^<]+|<"
_N_MARKUP = len(DATA_ELEMENTS) + len(PLAIN_TEXT_ELEMENTS) + 1
MARKUP_REPL_JVM = "".join(f"${k}" for k in range(1, _N_MARKUP + 1))
MARKUP_REPL_RE2 = "".join(rf"\{k}" for k in range(1, _N_MARKUP + 1))
# stands between two runs of text; no page text holds it
BREAK = "\x01"
TEXT_REPL_JVM = BREAK + "".join(f"${k}{BREAK}" for k in range(1, len(PLAIN_TEXT_ELEMENTS) + 1))
TEXT_REPL_RE2 = BREAK + "".join(rf"\{k}{BREAK}" for k in range(1, len(PLAIN_TEXT_ELEMENTS) + 1))

# attribute token inside a start tag, after its "<name" prefix: name[=value]
ATTR_JVM = (r"""[^ \t\n\f\r"'>/=]++(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+"""
            r"""(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r"'>]*+))?+""")
ATTR_RE2 = (r"""[^ \t\n\f\r"'>/=]+(?:[ \t\n\f\r]*=[ \t\n\f\r]*"""
            r"""(?:"[^"]*"|'[^']*'|[^ \t\n\f\r"'>]*))?""")
ATTR_NAME = r"""^([^ \t\n\f\r"'>/=]+)"""
ATTR_DQ = r'''=[ \t\n\f\r]*"([^"]*)"'''
ATTR_SQ = r"""=[ \t\n\f\r]*'([^']*)'"""
ATTR_BARE = r"""=[ \t\n\f\r]*(.*)$"""
ATTR_HAS_DQ = r'''^[^=]*=[ \t\n\f\r]*"'''
ATTR_HAS_SQ = r"""^[^=]*=[ \t\n\f\r]*'"""

# start and end tags of the scanned markup, in order
TAG_JVM = START_TAG_JVM + "|" + END_TAG
TAG_RE2 = START_TAG_RE2 + "|" + END_TAG

DOCTYPE = r"(?i)<!doctype[^>]*>"
META_CHARSET = r"""(?i)<meta[^>]*charset[ \t\n\f\r]*=[ \t\n\f\r]*["']?([a-zA-Z0-9_:.-]+)"""
BLANKS = r"[ \t\n\f\r]+"
EDGE_CONTROLS = r"^[\x00-\x20]+|[\x00-\x20]+$"

# --- URIs -------------------------------------------------------------------
URL_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
# a string java.net.URI accepts with a scheme: scheme ":" then no blank or excluded character
URI_WITH_SCHEME = r'''^[A-Za-z][A-Za-z0-9+.-]*:[^ \t\n\f\r"<>\\^`{|}]+\z'''
URI_PREFIX = r"^([^:]+):"
LAST_DOT_SUFFIX = r"\.[^.]*\z"

# --- fixed values (must equal the reference for equal results) -------------
# Content types whose pages are skipped as not HTML.
NON_HTML_CONTENT_TYPES = [
    "audio/mpeg",
    "application/x-shockwave-flash",
    "video/mpeg",
    "application/pdf",
    "application/msword",
]
# Characters removed from keys before they are stored: CR, LF, NEL, PS, NUL,
# and LS (U+2028; the reference names U+0228 by a slip, see README).
LINE_BREAK_CHARS = "\r\n\u0085\u2028\u2029\u0000"
# Image "formats" that are taken as links.
IMAGE_LINK_SUFFIXES = [".php", ".html", ".asp", ".cgi", ".com", ".gov"]
# Text written when a page declares no DOCTYPE.
NO_DOCTYPE = "This document does not declare its DOCTYPE"
HTML5_DOCTYPE = "<!doctype html>"
NO_ORIGINAL_URL = "N.D."
NOT_AVAILABLE = "NA"

# --- fixed values of our own ----------------------------------------------
# Named entities decoded in page text and attribute values: all that end in ";".
ENTITIES = {k[:-1]: v for k, v in sorted(_html5_entities.items()) if k.endswith(";")}
# an entity after its "&": decimal, hexadecimal or named
ENTITY = r"^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[a-zA-Z][a-zA-Z0-9]*);"
REPLACEMENT_CHAR = "\ufffd"

# Charset families by name: the first is sized without encoding; the oracle sizes all of them by arithmetic.
# Spark itself sizes any charset that the JVM can encode (``markup.byte_size``).
UTF8_CHARSETS = ["utf-8", "utf8"]
SINGLE_BYTE_CHARSETS = (["iso-8859-1", "latin1", "us-ascii", "ascii", "koi8-r", "koi8-u"]
                        + [f"iso-8859-{k}" for k in (2, 3, 4, 5, 6, 7, 8, 9, 13, 15)]
                        + [f"windows-{k}" for k in range(1250, 1259)])
UTF16_CHARSETS = ["utf-16le", "utf-16be"]          # 2 bytes per UTF-16 code unit
UTF16_BOM_CHARSETS = ["utf-16"]                    # the same plus a 2-byte byte order mark
UTF32_CHARSETS = ["utf-32", "utf-32le", "utf-32be"]  # 4 bytes per code point, no mark
SUPPLEMENTARY = r"[^\x{10000}-\x{10FFFF}]"       # removing these leaves the non-BMP characters
DEFAULT_CHARSET = "utf-8"

# HTML elements without end tag, with optional end tag, and with raw text.
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
                 "source", "track", "wbr", "basefont", "bgsound", "frame", "keygen", "param"]
OPTIONAL_END_ELEMENTS = ["html", "head", "body", "p", "li", "dt", "dd", "option", "optgroup",
                         "tr", "td", "th", "thead", "tbody", "tfoot", "colgroup", "caption",
                         "rb", "rt", "rtc", "rp"]
RAW_TEXT_ELEMENTS = DATA_ELEMENTS + PLAIN_TEXT_ELEMENTS

# Obsolete elements: (element, replacement element or None for "Use CSS instead.").
OBSOLETE_ELEMENTS = [
    ("basefont", None), ("big", None), ("blink", None), ("center", None), ("font", None),
    ("marquee", None), ("strike", None), ("tt", None),
    ("acronym", "abbr"), ("dir", "ul"), ("listing", "pre"), ("xmp", "pre"),
]
# Obsolete presentational attributes: (element, attribute).
OBSOLETE_ATTRIBUTES = [
    ("p", "align"), ("div", "align"), ("h1", "align"), ("h2", "align"), ("h3", "align"),
    ("h4", "align"), ("h5", "align"), ("h6", "align"), ("img", "align"), ("img", "border"),
    ("table", "align"), ("table", "bgcolor"), ("td", "bgcolor"), ("tr", "bgcolor"),
    ("body", "bgcolor"), ("body", "background"), ("br", "clear"), ("hr", "align"),
    ("hr", "size"), ("hr", "width"),
]
# Required attributes: (element, attribute).
REQUIRED_ATTRIBUTES = [
    ("img", "src"), ("img", "alt"), ("map", "name"), ("bdo", "dir"), ("optgroup", "label"),
]
# Attributes holding id references (space separated).
ID_REFERENCE_ATTRIBUTES = ["for", "headers", "aria-labelledby", "aria-describedby",
                           "aria-controls", "aria-owns", "list"]
# Implicit ARIA roles: (element, role) pairs whose explicit role is redundant.
IMPLICIT_ROLES = [
    ("nav", "navigation"), ("main", "main"), ("article", "article"), ("ul", "list"),
    ("ol", "list"), ("li", "listitem"), ("button", "button"), ("aside", "complementary"),
]
