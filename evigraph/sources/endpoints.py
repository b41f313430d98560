"""Endpoint declarations from OpenAPI documents, route mappings and sources; their reconciliation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.codes import compatible_type, http_status, is_success
from evigraph.functions.ids import match_key, normalize_path
from evigraph.functions.text import precedence
from evigraph.schema import SOURCE_ORDER

DECLARATIONS = (
    "http_method string, path string, controller_class string, handler_method string, consumes array<string>, produces array<string>, "
    "parameters array<struct<name:string,location:string,java_type:string,required:boolean>>, request_body_type string, "
    "responses array<struct<status:string,type:string,media_type:string>>, operation_id string, summary string, description string, source string"
)
_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def resolve_ref(document: dict, node: object, seen: frozenset[str] = frozenset()) -> object:
    """The object behind a local ``$ref``; a cycle or a lost target stays as it is."""
    while isinstance(node, dict) and isinstance(node.get("$ref"), str) and node["$ref"].startswith("#/"):
        ref = node["$ref"]
        if ref in seen:
            return node
        seen |= {ref}
        at: object = document
        for part in ref[2:].split("/"):
            key = part.replace("~1", "/").replace("~0", "~")
            at = at.get(key) if isinstance(at, dict) else None
        if at is None:
            return node
        node = at
    return node


def schema_type(document: dict, schema: object, seen: frozenset[str] = frozenset()) -> str:
    """Short text of a schema: reference name, alternatives, array, type and format."""
    if not isinstance(schema, dict):
        return ""
    if isinstance(schema.get("$ref"), str):
        return schema["$ref"].rsplit("/", 1)[-1]
    for word, joint in (("oneOf", "|"), ("anyOf", "|"), ("allOf", "&")):
        if isinstance(schema.get(word), list):
            return joint.join(schema_type(document, s, seen) for s in schema[word])
    if schema.get("type") == "array":
        return f"array<{schema_type(document, schema.get('items'), seen)}>"
    kind = schema.get("type") or ("object" if "properties" in schema else "")
    return f"{kind}({schema['format']})" if schema.get("format") else str(kind)


# Schema keywords that restrict a value.
VALIDATIONS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "multipleOf", "enum")


def validations(schema: object) -> list[str]:
    return [f"{k}={json.dumps(schema[k])}" for k in VALIDATIONS if isinstance(schema, dict) and k in schema]


def openapi_rows(text: str) -> list[tuple]:
    """Declarations of an OpenAPI 3 document in JSON; unreadable text gives none."""
    try:
        doc = json.loads(text)
    except (ValueError, RecursionError):
        return []
    out = []
    for path, item in (doc.get("paths") or {}).items() if isinstance(doc, dict) else ():
        item = resolve_ref(doc, item)
        for method in _METHODS:
            op = item.get(method) if isinstance(item, dict) else None
            if not isinstance(op, dict):
                continue
            parameters = [resolve_ref(doc, p) for p in [*(item.get("parameters") or []), *(op.get("parameters") or [])]]
            params = [{"name": p.get("name"), "location": str(p.get("in", "")).upper(), "java_type": schema_type(doc, p.get("schema")), "required": bool(p.get("required"))} for p in parameters if isinstance(p, dict)]
            body = resolve_ref(doc, op.get("requestBody") or {})
            content = body.get("content") or {} if isinstance(body, dict) else {}
            responses = []
            for status, r in (op.get("responses") or {}).items():
                r = resolve_ref(doc, r)
                media = r.get("content") or {} if isinstance(r, dict) else {}
                responses += [{"status": str(status), "type": schema_type(doc, (m or {}).get("schema")), "media_type": k} for k, m in media.items()] or [{"status": str(status), "type": "", "media_type": ""}]
            produces = sorted({r["media_type"] for r in responses if r["media_type"]})
            body_type = next((schema_type(doc, (m or {}).get("schema")) for m in content.values()), None)
            out.append((method.upper(), path, None, None, sorted(content), produces, params, body_type, responses, op.get("operationId"), op.get("summary"), op.get("description"), "OPENAPI"))
    return out


def mapping_rows(text: str) -> list[tuple]:
    """Declarations in a route-mappings snapshot: every object with handler details and a request condition, at any depth."""
    try:
        todo = [json.loads(text)]
    except (ValueError, RecursionError):
        return []
    out = []
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(reversed(node))
        elif isinstance(node, dict):
            details = node.get("details")
            cond = details.get("requestMappingConditions") if isinstance(details, dict) else None
            if isinstance(cond, dict):
                handler = details.get("handlerMethod") or {}
                media = lambda k: [x.get("mediaType") for x in cond.get(k) or [] if isinstance(x, dict) and not x.get("negated")]
                for path in cond.get("patterns") or []:
                    for method in cond.get("methods") or [""]:
                        out.append((method, path, handler.get("className"), handler.get("name"), media("consumes"), media("produces"), [], None, [], None, None, None, "ACTUATOR"))
            todo.extend(reversed([v for v in node.values() if isinstance(v, dict | list)]))
    return out


def declarations(texts: DataFrame, reader: str) -> DataFrame:
    """Declarations of (text) rows; ``reader`` is 'openapi' or 'mappings'."""
    read = {"openapi": openapi_rows, "mappings": mapping_rows}[reader]
    names = [c.strip().split(" ")[0] for c in "http_method,path,controller_class,handler_method,consumes,produces,parameters,request_body_type,responses,operation_id,summary,description,source".split(",")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for t in b["text"] for r in read(t)], columns=names)

    return texts.where(F.col("text").isNotNull()).select("text").mapInPandas(parse, DECLARATIONS)


def reconcile(decls: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per (keys, method, path with ``{}``): first by source, unions, conflicts.

    ``decls``: keys, http_method, path, the declaration fields and ``order_id`` as a last
    tie-break. Disjoint success statuses of the source and of OpenAPI are a conflict, and so
    are body types that differ after unwrapping.
    """
    d = decls.withColumns({
        "http_method": F.upper(F.trim("http_method")), "match_key": match_key(normalize_path(F.col("path"))), "src": F.upper(F.trim("source")),
        "order": F.struct(precedence(F.col("source"), SOURCE_ORDER).alias("p"), (-F.col("order_id")).alias("o")),
    }).where("match_key is not null and http_method is not null")
    there = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col("order"))
    first = lambda c: F.max_by(c, there(c)).alias(c)
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(c), F.array()))))).alias(c)
    statuses = F.array_distinct(F.transform(F.coalesce("responses", F.array()), lambda r: http_status(r["status"])))
    ok = lambda s: F.array_distinct(F.flatten(F.collect_set(F.when(F.col("src") == s, F.filter(statuses, is_success)))))
    body = F.filter(F.collect_set(F.nullif(compatible_type(F.col("request_body_type")), F.lit(""))), lambda x: x.isNotNull())
    grouped = d.groupBy(*keys, "http_method", "match_key").agg(
        F.max_by("path", "order").alias("path"), first("controller_class"), first("handler_method"), first("request_body_type"), first("operation_id"), first("summary"), first("description"),
        united("consumes"), united("produces"), F.max(F.size(F.coalesce("parameters", F.array()))).alias("parameter_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(statuses)))).alias("statuses"), F.array_sort(F.collect_set("src")).alias("sources"),
        ok("JAVA_SOURCE").alias("__java"), ok("OPENAPI").alias("__api"), body.alias("__body"),
    )
    apart = (F.size("__java") > 0) & (F.size("__api") > 0) & ~F.arrays_overlap("__java", "__api")
    return grouped.withColumn(
        "conflicts", F.array_compact(F.array(F.when(apart, F.lit("responses")), F.when(F.size("__body") > 1, F.lit("requestBodyType"))))
    ).drop("__java", "__api", "__body")


def error_responses(endpoints: DataFrame, handlers: DataFrame) -> DataFrame:
    """(endpoint_id, status, types, handlers): responses of the error handlers that apply to each endpoint, by status.

    ``endpoints``: endpoint_id, controller; ``handlers``: handler_id, controller (null: advice for all
    controllers), status, type. Advice for all is summed by status first and travels as one row, the
    handlers of a controller meet its endpoints by key.
    """
    status = http_status(F.col("status")).alias("status")
    by = lambda *k: handlers.groupBy(*k, status).agg(F.collect_set("type").alias("t"), F.collect_set("handler_id").alias("h"))
    general = handlers.where("controller is null").groupBy(status).agg(F.collect_set("type").alias("t"), F.collect_set("handler_id").alias("h"))
    shared = general.agg(F.collect_list(F.struct("status", "t", "h")).alias("__all")).withColumn("__one", F.lit(1))  # as many entries as there are statuses
    everywhere = endpoints.select("endpoint_id", F.lit(1).alias("__one")).join(F.broadcast(shared), "__one").select("endpoint_id", F.inline("__all"))
    own = endpoints.where("controller is not null").join(by("controller").where("controller is not null"), "controller").select("endpoint_id", "status", "t", "h")
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return everywhere.unionByName(own).groupBy("endpoint_id", "status").agg(flat("t").alias("types"), flat("h").alias("handlers"))
