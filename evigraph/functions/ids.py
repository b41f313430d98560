"""Semantic identifiers, paths and slugs as Column functions.

Digests are SHA-256 over NUL-joined text, 24 hex characters. ``concat_ws`` skips nulls, so
every part is coalesced to '' first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions.text import strip


def digest(*parts: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def namespace(identifier: Column) -> Column:
    return F.substring_index(identifier, ":", 1)


def local_part(identifier: Column) -> Column:
    return F.substring(identifier, F.length(namespace(identifier)) + 2, F.length(identifier))


def is_valid_id(identifier: Column) -> Column:
    """``namespace:local`` of at most 1024 characters without white space or control characters."""
    return F.coalesce((F.length(identifier) <= 1024) & identifier.rlike(r"^[A-Za-z][A-Za-z0-9._-]*:[^\s\p{Cntrl}]+$"), F.lit(False))


def edge_id(kind: Column, src: Column, dst: Column) -> Column:
    return F.concat(F.lit("edge:"), F.lower(kind), F.lit(":"), digest(kind, src, dst))


def normalize_path(path: Column) -> Column:
    """Origin, query and fragment outside braces, variable patterns and spare slashes removed.

    Balanced braces up to depth three; anything deeper, unbalanced or with white space is null.
    """
    p = strip(path)
    for _ in range(2):
        p = F.regexp_replace(p, r"(\{[^{}]*)\{[^{}]*\}", "$1")
    p = F.regexp_replace(p, r"\{\s*([^{}:\s]+)\s*(?::[^{}]*)?\}", "{$1}")
    p = F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    p = F.regexp_replace(p, r"[?#].*$", "")
    p = F.regexp_replace(F.concat(F.lit("/"), p), r"/+", "/")
    p = F.regexp_replace(p, r"(.)/$", "$1")
    balanced = F.length(F.regexp_replace(p, r"[^{]", "")) == F.length(F.regexp_replace(p, r"[^}]", ""))
    return F.when(balanced & ~p.rlike(r"\s") & ~p.rlike(r"\{[^}]*\{"), p)


def match_key(path: Column) -> Column:
    """Path in which one variable is like another."""
    return F.regexp_replace(path, r"\{[^}]*\}", "{}")


def endpoint_id(method: Column, path: Column) -> Column:
    return F.concat(F.lit("endpoint:"), F.upper(strip(method)), F.lit(":"), normalize_path(path))


def screen_id(route: Column) -> Column:
    return F.concat(F.lit("screen:"), normalize_path(route))


def ui_route(url: Column) -> Column:
    """Origin removed, ``:x`` and numeric segments as variables."""
    p = F.regexp_replace(F.regexp_replace(strip(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    p = F.regexp_replace(p, r"/:([A-Za-z_][A-Za-z0-9_]*)", "/{$1}")
    p = F.regexp_replace(F.regexp_replace(p, r"/[0-9]+/", "/{id}/"), r"/[0-9]+/", "/{id}/")
    p = F.regexp_replace(p, r"/[0-9]+$", "/{id}")
    return F.when(p == "", "/").otherwise(p)


def server_route(path: Column) -> Column:
    """Numeric and UUID segments as ``{id}``."""
    p = F.concat(path, F.lit("/"))
    for _ in range(2):
        p = F.regexp_replace(p, r"/(?:[0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})/", "/{id}/")
    return F.regexp_replace(p, r"/$", "")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def template_matches(left: Column, right: Column) -> Column:
    """Segment-wise match of two segment arrays; a ``{slot}`` matches anything."""
    slot = lambda s: s.startswith("{") & s.endswith("}")
    same = F.zip_with(left, right, lambda a, b: (a == b) | slot(a) | slot(b))
    return (F.size(left) == F.size(right)) & F.forall(same, lambda x: x)


def database_identifier(name: Column) -> Column:
    """Quoted names as they are without quotes, others in lower case."""
    n = strip(name)
    return F.when(n.rlike('^".*"$'), F.regexp_replace(n, '^"|"$', "")).otherwise(F.lower(n))


def table_id(schema: Column, table: Column) -> Column:
    return F.concat(F.lit("table:"), database_identifier(schema), F.lit("."), database_identifier(table))


def java_name(name: Column) -> Column:
    """``$`` as ``.``; null unless every segment is a Java identifier."""
    n = F.translate(strip(name), "$", ".")
    return F.when(n.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$"), n)


def simple_name(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, ".", -1), "$", -1)


# Directory of a node type's pages.
PAGE_DIRECTORIES = {
    "E2E_FLOW": "e2e", "SCREEN": "screens", "SCREEN_STATE": "screens", "UI_ENTRY": "screens", "UI_ACTION": "screens",
    "SCREENSHOT": "screens", "HTTP_ENDPOINT": "endpoints", "HTTP_CLIENT_CALL": "endpoints", "OPENAPI_OPERATION": "endpoints",
    "REQUEST_SCHEMA": "endpoints", "RESPONSE_SCHEMA": "endpoints", "JAVA_CLASS": "symbols", "JAVA_METHOD": "symbols",
    "CONTROLLER": "symbols", "APPLICATION_SERVICE": "symbols", "DOMA_DAO": "daos", "DOMA_DAO_METHOD": "daos",
    "SQL_STATEMENT": "sql", "DB_SCHEMA": "tables", "DB_TABLE": "tables", "DB_COLUMN": "tables", "DB_VIEW": "tables",
    "DB_MATERIALIZED_VIEW": "tables", "DB_FUNCTION": "tables", "DB_TRIGGER": "tables", "DB_POLICY": "tables",
    "TRACE": "traces", "SPAN": "traces", "CUSTOM_HTML_SECTION": "custom",
}


def page_slug(identifier: Column) -> Column:
    """Readable part of at most 70 characters and ten digits of the digest."""
    readable = F.regexp_replace(F.regexp_replace(F.lower(identifier), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    short = F.regexp_replace(F.substring(readable, 1, 70), r"-$", "")
    return F.concat(F.when(short == "", "item").otherwise(short), F.lit("-"), F.substring(F.sha2(identifier, 256), 1, 10))


def page_path(node_type: Column, identifier: Column) -> Column:
    from evigraph.schema import coded

    return F.concat(coded(node_type, PAGE_DIRECTORIES, "other"), F.lit("/"), page_slug(identifier), F.lit(".html"))


def signature(text: str) -> str:
    """``name(Type,Type)`` of a member: parameter names, ``final``, annotations and blanks dropped."""
    text = text.strip()
    if "(" not in text or not text.endswith(")"):
        return re.sub(r"\s+", "", text)
    name, _, inside = text.partition("(")
    parts, depth, word = [], 0, ""
    for c in inside[:-1]:
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth == 0:
            parts.append(word)
            word = ""
        else:
            word += c
    if word.strip():
        parts.append(word)
    return f"{name.strip().split()[-1]}({','.join(map(_parameter_type, parts))})"


def _parameter_type(text: str) -> str:
    text = re.sub(r"@[\w.]+(?:\([^()]*\))?\s*", "", text).strip()
    text = re.sub(r"^(?:final\s+)+", "", text)
    m = re.match(r"^(.*[\w>\]?.])\s+[A-Za-z_$][\w$]*((?:\[\])*)$", text)
    return re.sub(r"\s+", "", m[1] + m[2] if m else text)


def percent_encode(text: str) -> str:
    """UTF-8 bytes outside letters, digits and ``-_.~`` as ``%XX``."""
    return "".join(chr(b) if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "-_.~") else f"%{b:02X}" for b in text.encode())


def arity(signature_text: str) -> int:
    """Number of parameters of a member signature, aware of generics and arrays."""
    inside = signature_text.partition("(")[2].rpartition(")")[0]
    if not inside.strip():
        return 0
    depth, n = 0, 1
    for c in inside:
        depth += (c in "<([") - (c in ">)]")
        n += c == "," and depth == 0
    return n


@F.pandas_udf(T.StringType())
def signature_of(members: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for m in members:
        yield m.map(lambda t: None if t is None else signature(t))


@F.pandas_udf(T.StringType())
def percent_encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: None if x is None else percent_encode(x))


@F.pandas_udf(T.IntegerType())
def arity_of(members: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for m in members:
        yield m.map(lambda t: None if t is None else arity(t))
