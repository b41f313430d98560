"""Codes, classifications and small decoders as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.text import strip
from evigraph.schema import coded

# HTTP status names.
HTTP_STATUS = {
    "CONTINUE": 100, "SWITCHING_PROTOCOLS": 101, "PROCESSING": 102, "EARLY_HINTS": 103, "OK": 200, "CREATED": 201,
    "ACCEPTED": 202, "NON_AUTHORITATIVE_INFORMATION": 203, "NO_CONTENT": 204, "RESET_CONTENT": 205, "PARTIAL_CONTENT": 206,
    "MULTI_STATUS": 207, "ALREADY_REPORTED": 208, "IM_USED": 226, "MULTIPLE_CHOICES": 300, "MOVED_PERMANENTLY": 301,
    "FOUND": 302, "SEE_OTHER": 303, "NOT_MODIFIED": 304, "TEMPORARY_REDIRECT": 307, "PERMANENT_REDIRECT": 308,
    "BAD_REQUEST": 400, "UNAUTHORIZED": 401, "PAYMENT_REQUIRED": 402, "FORBIDDEN": 403, "NOT_FOUND": 404,
    "METHOD_NOT_ALLOWED": 405, "NOT_ACCEPTABLE": 406, "PROXY_AUTHENTICATION_REQUIRED": 407, "REQUEST_TIMEOUT": 408,
    "CONFLICT": 409, "GONE": 410, "LENGTH_REQUIRED": 411, "PRECONDITION_FAILED": 412, "PAYLOAD_TOO_LARGE": 413,
    "URI_TOO_LONG": 414, "UNSUPPORTED_MEDIA_TYPE": 415, "REQUESTED_RANGE_NOT_SATISFIABLE": 416, "EXPECTATION_FAILED": 417,
    "I_AM_A_TEAPOT": 418, "UNPROCESSABLE_ENTITY": 422, "LOCKED": 423, "FAILED_DEPENDENCY": 424, "TOO_EARLY": 425,
    "UPGRADE_REQUIRED": 426, "PRECONDITION_REQUIRED": 428, "TOO_MANY_REQUESTS": 429, "REQUEST_HEADER_FIELDS_TOO_LARGE": 431,
    "UNAVAILABLE_FOR_LEGAL_REASONS": 451, "INTERNAL_SERVER_ERROR": 500, "NOT_IMPLEMENTED": 501, "BAD_GATEWAY": 502,
    "SERVICE_UNAVAILABLE": 503, "GATEWAY_TIMEOUT": 504, "HTTP_VERSION_NOT_SUPPORTED": 505, "VARIANT_ALSO_NEGOTIATES": 506,
    "INSUFFICIENT_STORAGE": 507, "LOOP_DETECTED": 508, "BANDWIDTH_LIMIT_EXCEEDED": 509, "NOT_EXTENDED": 510,
    "NETWORK_AUTHENTICATION_REQUIRED": 511,
}


def http_status(status: Column) -> Column:
    """Names, ``_VALUE`` suffixes and qualified constants as codes; ``5XX``, ``default``, UNSPECIFIED."""
    v = F.regexp_replace(F.upper(F.substring_index(strip(F.coalesce(status, F.lit(""))), ".", -1)), "_VALUE$", "")
    names = F.create_map(*[F.lit(x) for k, c in HTTP_STATUS.items() for x in (k, str(c))])
    return (
        F.when(strip(F.coalesce(status, F.lit(""))) == "", "UNSPECIFIED")
        .when(v.rlike("^[1-5]([0-9]{2}|XX)$"), v)
        .when(v == "DEFAULT", "default")
        .otherwise(F.coalesce(F.try_element_at(names, v), v))
    )


def is_success(status: Column) -> Column:
    n = http_status(status)
    return (F.length(n) == 3) & n.startswith("2")


def span_kind(kind: Column) -> Column:
    """Kind by number or name, ``SPAN_KIND_`` prefix or not."""
    k = F.regexp_replace(F.upper(strip(F.coalesce(kind, F.lit("")))), "^SPAN_KIND_", "")
    # The numbers of span kinds.
    by_number = {"0": "UNSPECIFIED", "1": "INTERNAL", "2": "SERVER", "3": "CLIENT", "4": "PRODUCER", "5": "CONSUMER"}
    return F.coalesce(coded(k, by_number), F.when(k.isin(*by_number.values()), k), F.lit("UNSPECIFIED"))


def span_status(code: Column) -> Column:
    c = F.regexp_replace(F.upper(strip(F.coalesce(code, F.lit("")))), "^STATUS_CODE_", "")
    return F.when(c.isin("1", "OK"), "OK").when(c.isin("2", "ERROR"), "ERROR").otherwise("UNSET")


def span_boundary(kind: Column, attrs: Column, name: Column, layer_key: str = "app.layer") -> Column:
    """Architectural boundary of a span by ordered rules over its attributes.

    ``layer_key`` is the attribute with which an application names the layer itself.
    """
    value = lambda k: F.coalesce(F.try_element_at(attrs, F.lit(k)), F.lit(""))
    has = lambda *ks: F.arrays_overlap(F.map_keys(attrs), F.array(*[F.lit(k) for k in ks]))
    layer, space = F.lower(value(layer_key)), value("code.namespace")
    symbol = F.lower(F.concat(space, F.lit(" "), F.coalesce(name, F.lit(""))))
    named = (
        F.when(layer == "controller", "CONTROLLER")
        .when(layer.isin("service", "application_service", "application-service"), "APPLICATION_SERVICE")
        .when(layer.isin("usecase", "use_case", "use-case"), "USE_CASE")
        .when(layer.isin("dao", "doma", "doma_dao", "doma-dao"), "DOMA_DAO")
        .when(layer.isin("jdbc", "database"), "JDBC")
        .when(layer == "r2dbc", "R2DBC")
        .otherwise("OTHER")
    )
    return (
        F.when(strip(layer) != "", named)
        .when(has("db.system", "db.system.name", "db.namespace", "db.query.text", "db.statement"), F.when(F.lower(space).contains("r2dbc"), "R2DBC").otherwise("JDBC"))
        .when(has("messaging.system", "messaging.operation", "messaging.destination.name"), "MESSAGE")
        .when((kind == "SERVER") & has("http.route", "http.request.method", "http.method", "url.path"), "HTTP_SERVER")
        .when((kind == "CLIENT") & has("http.request.method", "http.method", "server.address", "url.full"), "EXTERNAL_HTTP_CLIENT")
        .when(kind.isin("PRODUCER", "CONSUMER"), "ASYNC")
        .when(symbol.contains("controller"), "CONTROLLER")
        .when(symbol.contains("dao"), "DOMA_DAO")
        .when(symbol.contains("service") | symbol.contains("usecase"), "APPLICATION_SERVICE")
        .otherwise("OTHER")
    )


def change_category(path: Column, workspace: str = "graphdocs") -> Column:
    """Category of a changed file by ordered rules; ``workspace`` is the tool's own folder and config name."""
    p = F.lower(F.regexp_replace(F.translate(strip(path), "\\", "/"), r"^(?:\./)+", ""))
    ends = lambda *xs: p.rlike("(?:" + "|".join(x.replace(".", r"\.") for x in xs) + ")$")
    return (
        F.when(p.startswith(f"{workspace}/snapshots/ui/"), "UI_CAPTURE")
        .when(p.startswith(f"{workspace}/traces/"), "RUNTIME_CAPTURE")
        .when(p.startswith(f"{workspace}/snapshots/db/"), "DATABASE_CAPTURE")
        .when(p.startswith(f"{workspace}/snapshots/runtime/") | p.startswith(f"{workspace}/snapshots/spring/"), "SPRING_CAPTURE")
        .when(p.rlike(rf"(?:^|/){workspace}\.ya?ml$") | ends("build.gradle.kts", "settings.gradle.kts") | (p == "gradle/libs.versions.toml"), "CONFIGURATION")
        .when(p.contains("/db/migration/") | p.contains("/migrations/"), "MIGRATION")
        .when(ends(".sql"), "SQL")
        .when(ends(".java"), "JAVA")
        .when(ends("openapi.json", "openapi.yaml", "openapi.yml"), "OPENAPI")
        .when(p.contains(f"{workspace}/custom/") & ends(".html", ".css"), "CUSTOM_HTML")
        .when(p.contains("scenario") & ends(".yaml", ".yml", ".spec.ts", ".test.ts"), "PLAYWRIGHT_SCENARIO")
        .when(p.contains("fixture") | p.contains("__mocks__"), "FIXTURE")
        .when(ends(".ts", ".tsx", ".js", ".jsx", ".vue", ".svelte", ".css", ".html"), "FRONTEND")
        .otherwise("UNKNOWN")
    )


def repository_relative(path: Column) -> Column:
    return (strip(path) != "") & ~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:[/\\]") & ~path.rlike(r"(?:^|/)\.\.(?:/|$)")


def change_type(letter: Column) -> Column:
    """Type of a name-status line by its first letter."""
    return coded(F.substring(letter, 1, 1), {"A": "ADDED", "M": "MODIFIED", "D": "DELETED", "R": "RENAMED", "C": "ADDED", "T": "MODIFIED"}, "MODIFIED")


def relation_kind(code: Column) -> Column:
    return coded(code, {"r": "TABLE", "p": "PARTITIONED_TABLE", "v": "VIEW", "m": "MATERIALIZED_VIEW", "f": "FOREIGN_TABLE"})


def constraint_type(code: Column) -> Column:
    return coded(code, {"p": "PRIMARY_KEY", "f": "FOREIGN_KEY", "u": "UNIQUE", "c": "CHECK", "x": "EXCLUDE", "t": "TRIGGER"})


def policy_command(code: Column) -> Column:
    return coded(code, {"r": "SELECT", "a": "INSERT", "w": "UPDATE", "d": "DELETE", "*": "ALL"}, "ALL")


def catalog_bool(value: Column) -> Column:
    v = F.lower(strip(value.cast("string")))
    return F.when(v.isin("t", "true", "1", "yes", "on"), True).when(v.isin("f", "false", "0", "no", "off"), False)


def compatible_type(name: Column) -> Column:
    """Simple type name with wrappers of responses and publishers removed."""
    n = F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", "")
    for _ in range(2):
        n = F.regexp_replace(n, r"^(?:[\w.]*\.)?(?:Mono|Flux|ResponseEntity|Optional|CompletableFuture)<(.*)>$", "$1")
    return F.regexp_replace(n, r"\b(?:[a-z_][\w]*\.)+", "")


def first_sentence(text: Column) -> Column:
    return strip(F.regexp_extract(text, r"(?s)^[^.。]*[.。]?", 0))


def action_locator(kind: Column, role: Column, name: Column, label: Column) -> Column:
    """Readable place of an action: label, else role and name, else its kind."""
    there = lambda c: F.coalesce(strip(c), F.lit("")) != ""
    return (
        F.when(there(label), F.concat(F.lit("label="), strip(label)))
        .when(there(role), F.concat(F.lit("role="), strip(role), F.when(there(name), F.concat(F.lit(" name="), strip(name))).otherwise("")))
        .when(there(name), strip(name))
        .otherwise(F.coalesce(kind, F.lit("")))
    )


def symbol_type(simple: Column, annotations: Column) -> Column:
    """Node type of a class by its annotations and name."""
    has = lambda *xs: F.arrays_overlap(annotations, F.array(*[F.lit(x) for x in xs]))
    return (
        F.when(has("Controller", "RestController"), "CONTROLLER")
        .when(has("Service", "ApplicationService") | F.lower(simple).rlike("(service|usecase)$"), "APPLICATION_SERVICE")
        .otherwise("JAVA_CLASS")
    )


def nano_instant(nanos: Column) -> Column:
    """Epoch nanoseconds in text to a timestamp in microseconds; invalid is the epoch."""
    return F.timestamp_micros(F.coalesce(F.floor(F.try_divide(nanos.try_cast("bigint"), F.lit(1000))).try_cast("bigint"), F.lit(0).cast("bigint")))


def span_duration(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), end - start)


def trace_hex(value: Column) -> Column:
    return F.regexp_replace(F.lower(strip(value)), "^0x", "")
