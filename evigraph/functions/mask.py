"""Masking, redaction, sanitizing and link extraction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys (letters and digits, lower case) whose values are replaced, and fragments that betray one.
SECRET_KEYS = ("password", "passwd", "pwd", "secret", "token", "authorization", "cookie", "setcookie", "apikey", "accesskey", "privatekey", "credential", "sessionid")
SECRET_FRAGMENTS = ("password", "secret", "token", "credential", "apikey", "authorization")
REPLACEMENT = "[MASKED]"


def mask_key_values(attrs: Column, exact: Sequence[str] = SECRET_KEYS, fragments: Sequence[str] = SECRET_FRAGMENTS) -> Column:
    """Values of secret keys in a map replaced; keys compare by letters and digits."""
    bare = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")

    def secret(k: Column) -> Column:
        hit = bare(k).isin(*exact)
        for f in fragments:
            hit = hit | bare(k).contains(f)
        return hit

    return F.transform_values(attrs, lambda k, v: F.when(secret(k), F.lit(REPLACEMENT)).otherwise(v))


def mask_sql_columns(sql: Column, trim: bool = True) -> Column:
    """Literals as ``?`` inside the JVM: strings, dollar quotes and free numbers.

    Quoted identifiers are consumed whole, so that nothing inside them is taken for a literal.
    The lexer :func:`mask_sql` covers escape strings with backslashes as well.
    """
    s = F.regexp_replace(sql, r"(\"(?:[^\"]|\"\")*\")|[eE]?'(?:[^']|'')*'|\$([A-Za-z_]*)\$.*?\$\2\$", "$1\u0001")
    s = F.regexp_replace(F.regexp_replace(s, r"(\"(?:[^\"]|\"\")*\")\u0001", "$1"), "\u0001", "?")
    s = F.regexp_replace(s, r"(\"(?:[^\"]|\"\")*\")|(^|[^\w$.\"])([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![\w\"])", "$1$2\u0002$3\u0003")
    s = F.regexp_replace(F.regexp_replace(s, "\u0002[0-9][^\u0003]*\u0003", "?"), "[\u0002\u0003]", "")
    return F.trim(s) if trim else s


def mask_sql(text: str, trim: bool = True) -> str:
    """Literal mask by a lexer: strings, escape strings, dollar quotes and free numbers become ``?``."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            end = i + 1
            while end < n and not (text[end] == '"' and text[end + 1 : end + 2] != '"'):
                end += 2 if text[end] == '"' else 1
            out.append(text[i : end + 1])
            i = end + 1
        elif c == "'" or (c in "eE" and text[i + 1 : i + 2] == "'" and not (i and (text[i - 1].isalnum() or text[i - 1] == "_"))):
            escapes = c != "'"
            end = i + (2 if escapes else 1)
            while end < n:
                if escapes and text[end] == "\\":
                    end += 2
                elif text[end] == "'" and text[end + 1 : end + 2] == "'":
                    end += 2
                elif text[end] == "'":
                    break
                else:
                    end += 1
            out.append("?")
            i = end + 1
        elif c == "$" and (close := _dollar_quote(text, i)):
            out.append("?")
            i = close
        elif c.isdigit() and not (i and (text[i - 1].isalnum() or text[i - 1] in "_$")):
            end = i
            while end < n and (text[end].isdigit() or text[end] == "."):
                end += 1
            if end < n and text[end] in "eE":
                k = end + 1 + (text[end + 1 : end + 2] in ("+", "-"))
                if k < n and text[k].isdigit():
                    end = k
                    while end < n and text[end].isdigit():
                        end += 1
            out.append("?")
            i = end
        else:
            out.append(c)
            i += 1
    masked = "".join(out)
    return masked.strip() if trim else masked


def _dollar_quote(text: str, at: int) -> int:
    """End of a dollar-quoted string that opens at ``at``, 0 if none does."""
    end = text.find("$", at + 1)
    tag = text[at : end + 1]
    if end < 0 or not (tag == "$$" or (tag[1:-1].isidentifier())):
        return 0
    close = text.find(tag, end + 1)
    return close + len(tag) if close >= 0 else 0


@F.pandas_udf(T.StringType())
def masked_sql(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: None if x is None else mask_sql(x))


def normalize_sql(sql: Column) -> Column:
    """White space, case and blanks round ``( ) , ; =`` made alike; trailing semicolons dropped."""
    s = F.lower(F.regexp_replace(F.trim(sql), r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*([(),;=])\s*", "$1"), r";+$", ""))


def redact_paths(text: Column) -> Column:
    """Local Unix and Windows paths as ``[path]``."""
    t = F.regexp_replace(text, r"(^|[\s\"'(=])/(?:home|Users|tmp|var|opt|root|private|workspace|mnt)/[^\s\"')]*", "$1[path]")
    return F.regexp_replace(t, r"(^|[\s\"'(=])[A-Za-z]:\\[^\s\"')]*", "$1[path]")


# What counts as a secret in published text.
SECRET_PATTERNS = {
    "BEARER": r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}",
    "PRIVATE_KEY": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "CLOUD_KEY": r"\bAKIA[0-9A-Z]{16}\b",
    "PASSWORD": r"(?i)\b(?:password|passwd|pwd|secret)\s*[:=]\s*[^\s\"']{6,}",
}


def secret_kinds(text: Column) -> Column:
    """Kinds of secrets in a text, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SECRET_PATTERNS.items()])))


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


_DANGER = r"(?i)<\s*/?\s*(?:script|iframe|object|embed|form|base|meta|link|svg|math)\b|\son[a-z]+\s*=|javascript\s*:|srcdoc\s*="


def sanitize_html(html: Column) -> Column:
    """Scripts, handlers, active containers and styles removed; null if danger is left after decoding entities."""
    h = F.regexp_replace(html, r"(?is)<(script|style|iframe|object|embed|svg|math)\b.*?</\1\s*>", "")
    h = F.regexp_replace(h, r"(?i)</?(?:script|style|iframe|object|embed|form|base|meta|link|svg|math)\b[^>]*>", "")
    h = F.regexp_replace(h, r"(?i)\s(?:on[a-z]+|srcdoc|style)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    h = F.regexp_replace(h, r"(?i)(href|src)\s*=\s*([\"']?)\s*javascript:[^\"'\s>]*", "$1=$2#")
    decoded = h
    for a, b in (("&colon;", ":"), ("&#58;", ":"), ("&#x3a;", ":"), ("&Tab;", ""), ("&NewLine;", ""), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(a), F.lit(b))
    return F.when(~decoded.rlike(_DANGER.replace("script|iframe", "script|iframe")), h)


def links_of(html: Column) -> Column:
    """Targets of href and src attributes, external ones and anchors left out."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)(?:href|src)\s*=\s*[\"']([^\"']*)[\"']"), 1)
    internal = F.filter(found, lambda u: (u != "") & ~u.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//|#)"))
    return F.array_distinct(F.transform(internal, lambda u: F.regexp_replace(u, r"[?#].*$", "")))


def id_references(html: Column, attribute: str = "data-ref") -> Column:
    """Stable ids that custom HTML refers to."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf"{attribute}\s*=\s*[\"']([^\"']+)[\"']"), 1))


def assertions_of(html: Column, attribute: str = "data-assert") -> Column:
    """(id, field, value) claims written as ``id|field=value``."""
    raw = F.regexp_extract_all(html, F.lit(rf"{attribute}\s*=\s*[\"']([^\"'|]+\|[^\"'=]+=[^\"']*)[\"']"), 1)

    def one(c: Column) -> Column:
        claim = F.substring_index(c, "|", -1)
        return F.struct(F.substring_index(c, "|", 1).alias("id"), F.substring_index(claim, "=", 1).alias("field"), F.expr("''").alias("_"), F.regexp_replace(claim, "^[^=]*=", "").alias("value"))

    return F.transform(raw, one)


# Attributes of spans, resources and events that may be kept.
SPAN_KEYS = (
    "code.function", "code.function.name", "code.lineno", "code.namespace", "db.name", "db.namespace", "db.operation",
    "db.operation.name", "db.query.text", "db.statement", "db.system", "db.system.name", "error.type", "http.method",
    "http.request.method", "http.response.status_code", "http.route", "http.status_code", "messaging.destination.name",
    "messaging.operation", "messaging.system", "server.address", "url.path", "url.scheme",
)
RESOURCE_KEYS = ("deployment.environment", "service.name", "service.namespace", "service.version", "telemetry.sdk.language", "telemetry.sdk.name", "telemetry.sdk.version")
EVENT_KEYS = ("exception.escaped", "exception.type")


def keep_keys(attrs: Column, allowed: Sequence[str], own_prefix: str = "app.") -> Column:
    """A map reduced to allowed keys and the application's own namespace."""
    return F.map_filter(attrs, lambda k, v: k.isin(*allowed) | k.startswith(own_prefix))
