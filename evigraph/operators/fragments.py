"""Adapter mappings: source records to node and edge rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.ids import digest, edge_id
from evigraph.functions.mask import EVENT_KEYS, RESOURCE_KEYS, SPAN_KEYS, keep_keys, normalize_sql, redact_paths
from evigraph.operators.resolve import contained_sql, unique_match


def with_edge_ids(edges: DataFrame) -> DataFrame:
    return edges.where("src is not null and dst is not null").distinct().withColumn("id", edge_id(F.col("type"), F.col("src"), F.col("dst")))


def runtime_fragment(spans: DataFrame, labels: DataFrame, own_prefix: str = "app.") -> tuple[DataFrame, DataFrame]:
    """TRACE and SPAN nodes under stable labels; CONTAINS and CALLS edges.

    Only allowed attributes are kept and local paths in them are withheld. ``labels`` is the
    result of ``spanforest.span_labels``.
    """
    s = spans.join(labels, ["trace_id", "span_id"]).withColumn("span", F.concat(F.lit("span:"), "label"))
    flow = F.coalesce(F.try_element_at("attrs", F.lit(own_prefix + "flow.id")), F.col("trace_id"))
    trace = F.concat(F.lit("trace:"), digest(flow))
    safe = F.transform_values(keep_keys(F.col("attrs"), SPAN_KEYS, own_prefix), lambda k, v: redact_paths(v))
    events = F.transform("events", lambda e: F.struct(e["name"].alias("name"), keep_keys(e["attrs"], EVENT_KEYS, own_prefix).alias("attrs")))
    nodes = s.select(F.col("span").alias("id"), F.lit("SPAN").alias("type"), F.col("name").alias("display_name"), safe.alias("attrs"), keep_keys(F.col("resource"), RESOURCE_KEYS, own_prefix).alias("resource"), F.to_json(events).alias("events"))
    traces = s.select(trace.alias("id"), F.lit("TRACE").alias("type"), flow.alias("display_name"), F.create_map().cast("map<string,string>").alias("attrs"), F.create_map().cast("map<string,string>").alias("resource"), F.lit("[]").alias("events"))
    contains = s.select(F.lit("CONTAINS").alias("type"), trace.alias("src"), F.col("span").alias("dst"))
    parent = s.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("span").alias("src"))
    calls = s.select("trace_id", "parent_span_id", F.col("span").alias("dst")).join(parent, ["trace_id", "parent_span_id"]).select(F.lit("CALLS").alias("type"), "src", "dst")
    return nodes.unionByName(traces.dropDuplicates(["id"])), with_edge_ids(contains.unionByName(calls))


def endpoint_fragment(reconciled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """HTTP_ENDPOINT, schemas and operations of reconciled endpoints."""
    e = reconciled.withColumns({"ep": F.concat(F.lit("endpoint:"), "http_method", F.lit(":"), "match_key"), "body": F.nullif(F.trim("request_body_type"), F.lit("")), "op": F.nullif(F.trim("operation_id"), F.lit(""))})
    body, op = F.concat(F.lit("request-schema:"), "body"), F.concat(F.lit("operation:"), "op")
    node = lambda i, k, n: e.select(i.alias("id"), F.lit(k).alias("type"), n.alias("display_name"))
    nodes = node(F.col("ep"), "HTTP_ENDPOINT", F.concat_ws(" ", "http_method", "path")).unionByName(node(body, "REQUEST_SCHEMA", F.col("body"))).unionByName(node(op, "OPENAPI_OPERATION", F.col("op")))
    edge = lambda k, dst: e.select(F.lit(k).alias("type"), F.col("ep").alias("src"), dst.alias("dst"))
    return nodes.where("id is not null").groupBy("id", "type").agg(F.min("display_name").alias("display_name")), with_edge_ids(edge("ACCEPTS", body).unionByName(edge("MATCHES_OPERATION", op)))


def route_edges(reconciled: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ROUTES_TO edges from endpoints to handlers (class, member), ambiguous ones as warnings.

    ``methods``: id, owner, member.
    """
    e = reconciled.select(F.concat(F.lit("endpoint:"), "http_method", F.lit(":"), "match_key").alias("src"), F.col("controller_class").alias("owner"), F.col("handler_method").alias("member"))
    made, warned = unique_match(e.join(methods, ["owner", "member"]), ["src"], "id")
    return with_edge_ids(made.select(F.lit("ROUTES_TO").alias("type"), "src", F.col("id").alias("dst"))), warned


def observed_crud(spans: DataFrame, statements: DataFrame, crud: DataFrame) -> DataFrame:
    """CRUD edges that a trace confirms: spans, traces and whether any ran directly.

    ``spans``: span_id, trace_id, sql, direct; ``statements``: statement_id, sql; ``crud``: edges
    whose ``src`` is a statement. A span that fits several statements confirms none.
    """
    s = spans.withColumn("sql", normalize_sql(F.col("sql")))
    q = statements.withColumn("sql", normalize_sql(F.col("sql")))
    pairs, _ = unique_match(contained_sql(s, q), ["span_id"], "statement_id")
    hit = pairs.join(spans.select("span_id", "trace_id", "direct"), "span_id").join(crud, F.col("statement_id") == F.col("src"))
    return hit.groupBy("type", "src", "dst").agg(F.count_distinct("span_id").alias("spans"), F.array_sort(F.collect_set("trace_id")).alias("traces"), F.bool_or("direct").alias("direct"))


def ambiguity_nodes(warnings: DataFrame, left: str) -> DataFrame:
    """Warnings of ambiguous matches attached to their nodes."""
    return warnings.select(F.col(left).alias("id"), F.array(F.concat(F.lit("ambiguous: "), F.col("candidates").cast("string"), F.lit(" candidates"))).alias("warnings"))
