"""String scalars (all JVM-side Column expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by a "trim space" in the reference (ASCII whitespace incl.
# vertical tab, NEL, NBSP and the Unicode space separators).
WHITESPACE = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
# The same set as a Java regex character class body.
WS_CLASS = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c) -> Column:
    """Both-side whitespace trim (Spark's ``trim`` only strips spaces)."""
    return F.btrim(col_(c), F.lit(WHITESPACE))


def drop_suffix(c, suffix: str) -> Column:
    """Remove one trailing ``suffix`` if present."""
    c = col_(c)
    return F.when(c.endswith(suffix), c.substr(F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def drop_prefix(c, prefix: str) -> Column:
    """Remove one leading ``prefix`` if present."""
    c = col_(c)
    return F.when(c.startswith(prefix), c.substr(F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def trim_chars(c, chars: str) -> Column:
    """Remove every leading and trailing character from the set ``chars``."""
    return F.btrim(col_(c), F.lit(chars))


# F1
def normalize_route_path(p) -> Column:
    p = col_(p)
    return F.when(p == "", F.lit("/")).when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


# F2
def join_route_paths(prefix, route) -> Column:
    prefix, route = col_(prefix), col_(route)
    p = drop_suffix(prefix, "/")
    r = drop_prefix(route, "/")
    return (
        F.when(prefix == "", normalize_route_path(route))
        .when((route == "") | (route == "/"), normalize_route_path(prefix))
        .when(p == "", normalize_route_path(r))
        .otherwise(normalize_route_path(F.concat(p, F.lit("/"), r)))
    )


# F3
def join_attribute_paths(prefix, suffix) -> Column:
    p, s = trim_space(prefix), trim_space(suffix)
    return (
        F.when((p == "") & (s == ""), F.lit("/"))
        .when(p == "", normalize_route_path(s))
        .when(s == "", normalize_route_path(p))
        .otherwise(join_route_paths(p, s))
    )


# F4
def route_group_prefix(path) -> Column:
    n = normalize_route_path(col_(path))
    t = trim_chars(n, "/")
    return F.when((n == "/") | (t == ""), F.lit("/")).otherwise(F.concat(F.lit("/"), F.split(t, "/").getItem(0)))


# F5
_REQ_NAME = r"^([^<>!=~\[ ]*)"


def split_requirement(line) -> tuple[Column, Column]:
    """Split a requirement at the first of ``< > ! = ~ [`` or space -> (name, version)."""
    line = col_(line)
    head = F.regexp_extract(line, _REQ_NAME, 1)
    rest = line.substr(F.length(head) + 1, F.greatest(F.length(line) - F.length(head), F.lit(0)))
    return trim_space(head), trim_space(rest)


# a run of plain characters, escapes and closed quoted strings, followed by '#'.
_COMMENT_PREFIX = r"""(?s)^(?:[^\\'"#]|\\.|'(?:[^\\']|\\.)*+'|"(?:[^\\"]|\\.)*+")*+(?=#)"""


def strip_inline_comment(line) -> Column:
    """Cut a ``#`` comment that is outside quotes (backslash escapes honoured)."""
    line = col_(line)
    prefix = F.regexp_extract(line, _COMMENT_PREFIX, 0)
    # most lines hold no '#': the pattern, which walks all of a line, is for the others
    return F.when(~line.contains("#"), trim_space(line)).when(prefix != "", trim_space(prefix)).when(line.startswith("#"), F.lit("")).otherwise(trim_space(line))


# F7
def normalize_openapi_path(p) -> Column:
    p = F.replace(F.replace(trim_space(p), F.lit("{"), F.lit(":")), F.lit("}"), F.lit(""))
    return normalize_route_path(p)


# F8
def normalize_next_segments(p) -> Column:
    def seg(s):
        return (
            F.when(s.startswith("[...") & s.endswith("]"),
                   F.concat(F.lit(":"), drop_suffix(drop_prefix(s, "[..."), "]"), F.lit("*")))
            .when(s.startswith("[[...") & s.endswith("]]"),
                  F.concat(F.lit(":"), drop_suffix(drop_prefix(s, "[[..."), "]]"), F.lit("*")))
            .when(s.startswith("[") & s.endswith("]"), F.concat(F.lit(":"), drop_suffix(drop_prefix(s, "["), "]")))
            .otherwise(s)
        )
    return normalize_route_path(F.array_join(F.transform(F.split(col_(p), "/"), seg), "/"))


# F9
def short_class_name(v) -> Column:
    return F.substring_index(col_(v), "\\", -1)


# F10
def spring_controller_name(cls, method) -> Column:
    c, m = trim_space(cls), trim_space(method)
    return (
        F.when((c == "") & (m == ""), F.lit("handler"))
        .when(c == "", m)
        .when(m == "", c)
        .otherwise(F.concat(c, F.lit("#"), m))
    )


# F15
def mermaid_id(v) -> Column:
    r = F.regexp_replace(col_(v), r"[^A-Za-z0-9]", "_")
    return F.when(r == "", F.lit("G_root")).otherwise(r)


def mermaid_label(v) -> Column:
    return F.replace(col_(v), F.lit('"'), F.lit("'"))


# F16
def list_text(arr) -> Column:
    arr = col_(arr)
    return F.when(F.coalesce(F.size(arr), F.lit(0)) <= 0, F.lit("n/a")).otherwise(F.array_join(arr, ", "))


# F17
def display_project_name(name, path) -> Column:
    base = F.element_at(F.split(trim_space(path), "/"), -1)
    return (
        F.when(trim_space(name) != "", col_(name))
        .when(F.coalesce(base, F.lit("")).isin("", ".", "/"), F.lit("Project"))
        .otherwise(base)
    )


def quoted_tokens(c) -> Column:
    """All ``"..."`` or ``'...'`` tokens with their quotes removed (D10, R5 helper)."""
    toks = F.regexp_extract_all(col_(c), F.lit(r"\"[^\"]+\"|'[^']+'"), F.lit(0))
    return F.transform(toks, lambda t: t.substr(F.lit(2), F.length(t) - 2))
