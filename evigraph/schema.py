"""Closed vocabularies and record types of the evidence graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed enumerations, in their order.
NODE_TYPES = (
    "E2E_FLOW", "UI_ENTRY", "SCREEN", "SCREEN_STATE", "UI_ACTION", "SCREENSHOT", "HTTP_CLIENT_CALL", "HTTP_ENDPOINT",
    "OPENAPI_OPERATION", "REQUEST_SCHEMA", "RESPONSE_SCHEMA", "JAVA_CLASS", "JAVA_METHOD", "CONTROLLER",
    "APPLICATION_SERVICE", "DOMA_DAO", "DOMA_DAO_METHOD", "SQL_STATEMENT", "DB_SCHEMA", "DB_TABLE", "DB_COLUMN",
    "DB_VIEW", "DB_MATERIALIZED_VIEW", "DB_FUNCTION", "DB_TRIGGER", "DB_POLICY", "TRACE", "SPAN", "CUSTOM_HTML_SECTION",
)
EDGE_TYPES = (
    "HAS_STATE", "NAVIGATES_TO", "TRANSITIONS_TO", "PERFORMED_ON", "CAPTURED_AS", "STARTS_AT", "CALLS_HTTP",
    "MATCHES_OPERATION", "ACCEPTS", "RETURNS", "ROUTES_TO", "CALLS", "CALLED_BY", "EXECUTES", "EXECUTES_SQL", "CREATES",
    "READS", "UPDATES", "DELETES", "FK_TO", "FIRES_TRIGGER", "CALLS_FUNCTION", "OBSERVED_IN", "DOCUMENTED_BY",
    "DECLARED_BY", "INFERRED_FROM", "IMPACTS", "USED_BY", "REFERENCES", "CONTAINS",
)
EVIDENCE_TYPES = (
    "RUNTIME_OBSERVATION", "SPRING_MAPPING", "OPENAPI", "SOURCE_CODE", "JAVADOC", "DOMA_MAPPING", "SQL_STATIC_ANALYSIS",
    "DATABASE_INTROSPECTION", "PLAYWRIGHT_OBSERVATION", "AGENT_INFERENCE", "HUMAN_INPUT",
)
CONFIDENCES = ("OBSERVED", "DECLARED", "INFERRED", "HUMAN_REVIEWED", "CONFLICTED", "STALE", "UNKNOWN")
REVIEW_STATES = ("UNREVIEWED", "AGENT_REVIEWED", "NEEDS_REVIEW", "HUMAN_REVIEWED", "APPROVED", "REJECTED")

# Authority of an evidence type as technical fact and as design intent.
FACT_RANKS = {
    "RUNTIME_OBSERVATION": 700, "PLAYWRIGHT_OBSERVATION": 700, "SPRING_MAPPING": 600, "DATABASE_INTROSPECTION": 550,
    "OPENAPI": 500, "SOURCE_CODE": 400, "JAVADOC": 400, "DOMA_MAPPING": 400, "SQL_STATIC_ANALYSIS": 400,
    "HUMAN_INPUT": 300, "AGENT_INFERENCE": 100,
}
INTENT_RANKS = {"HUMAN_INPUT": 700, "JAVADOC": 500, "SOURCE_CODE": 400, "AGENT_INFERENCE": 100}
INTENT_OTHER = 200
# Strength of a confidence among evidence.
CONFIDENCE_RANKS = {"HUMAN_REVIEWED": 600, "OBSERVED": 500, "DECLARED": 400, "INFERRED": 300, "UNKNOWN": 0, "STALE": -100, "CONFLICTED": -200}
# The confidence that an evidence type fixes.
TYPE_CONFIDENCE = {
    "RUNTIME_OBSERVATION": "OBSERVED", "PLAYWRIGHT_OBSERVATION": "OBSERVED", "SPRING_MAPPING": "DECLARED",
    "OPENAPI": "DECLARED", "DATABASE_INTROSPECTION": "DECLARED", "HUMAN_INPUT": "HUMAN_REVIEWED",
}
# Node types of the three projections.
UI_TYPES = ("E2E_FLOW", "UI_ENTRY", "SCREEN", "SCREEN_STATE", "UI_ACTION", "SCREENSHOT", "HTTP_CLIENT_CALL")
RUNTIME_TYPES = ("TRACE", "SPAN")
SCHEMA_TYPES = ("DB_SCHEMA", "DB_TABLE", "DB_COLUMN", "DB_VIEW", "DB_MATERIALIZED_VIEW", "DB_FUNCTION", "DB_TRIGGER", "DB_POLICY")

NODE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("display_name", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])
EDGE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()), T.StructField("description", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])
EVIDENCE = T.StructType([
    T.StructField(n, T.StringType()) for n in ("id", "type", "scope", "source", "description", "target_commit")
] + [T.StructField("observed_at", T.TimestampType()), T.StructField("adapter", T.StringType()), T.StructField("confidence", T.StringType())])


def coded(value: Column, table: dict[str, object], other: object = None) -> Column:
    """``table[value]``, ``other`` for anything else; the table is one folded literal, so ``value`` is evaluated once."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)
    return found if other is None else F.coalesce(found, F.lit(other))


def ordinal(value: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), value).cast("int")


def authority(evidence: Column, scope: str = "TECHNICAL_FACT") -> Column:
    """Greatest rank among evidence of a scope, 0 without any."""
    rank = lambda e: coded(e["type"], FACT_RANKS, 0) if scope == "TECHNICAL_FACT" else coded(e["type"], INTENT_RANKS, INTENT_OTHER)
    own = F.filter(evidence, lambda e: e["scope"] == scope)
    return F.coalesce(F.array_max(F.transform(own, rank)), F.lit(0))


# Precedence of declaration sources, best first; anything else comes after them.
SOURCE_ORDER = ("JAVA_SOURCE", "ACTUATOR", "OPENAPI")
