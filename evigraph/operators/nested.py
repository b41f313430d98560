"""Deeply nested records to related flat tables (problem 5).

Semi-structured values run through a tree automaton (``functions.treeauto``): it classifies
each object by the shape of its subtree, and each variant is routed to the table of its
subtype. The common supertype keeps what all children share, ``child_kind, parent_key,
child_key, pos``, beside ``variant`` and the subtype's own columns in ``facts``.
Typed columns (spans, events) need no automaton and stay in the JVM.

Defined results: text that isn't whole JSON gives no rows; null and empty parts give no
children; a single object is a list of one; an object whose values are all objects is a map
from child names; children without a name are left out; ``pos`` is the ordinal if given, else
the place from 1; equal rows come out once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.treeauto import TEXTS, Rule, Tree, TreeAutomaton
from evigraph.session import union_all

_TEXT = frozenset(TEXTS)
# The shapes of a catalog relation and of an endpoint parameter, first match holds.
RELATION_RULES = [
    Rule("relation", {"schema": _TEXT, "name": _TEXT}, frozenset({"columns", "constraints", "kind"})),
    Rule("envelope", {"data": frozenset({"relation", "envelope"})}),
    Rule("envelope", {"relation": frozenset({"relation", "envelope"})}),
    Rule("foreign_key", {"name": _TEXT, "columns": frozenset({"list:text", "list:empty", "array_text", "text"})}, frozenset({"referencedtable"})),
    Rule("check", {"name": _TEXT, "definition": _TEXT}, frozenset({"type"})),
    Rule("key", {"name": _TEXT, "columns": frozenset({"list:text", "list:empty", "array_text", "text", "map:empty"})}, frozenset({"type"})),
    Rule("index", {"name": _TEXT}, frozenset({"isunique", "accessmethod"})),
    Rule("column", {"name": _TEXT}, frozenset({"ordinal", "formattedtype", "nullable", "defaultexpression"})),
    Rule("column_body", {}, frozenset({"ordinal", "formattedtype", "nullable", "defaultexpression"}), frozenset({"name"})),
    Rule("constraint_body", {}, frozenset({"type", "definition", "referencedtable"}), frozenset({"name"})),
]
PARAMETER_RULES = [
    Rule("parameter", {"name": _TEXT}),
    Rule("parameter_body", {}, frozenset({"ordinal", "location", "required", "javatype", "type", "validation"}), frozenset({"name"})),
]
_COLUMNS = "child_kind string, parent_key string, child_key string, pos int, variant string, facts map<string,string>"


def members(part: Tree | None) -> list[tuple[str, int, Tree]]:
    """(name, pos, child) of a list, a map from names, a single object or an array text."""
    if part is None or part.state == "null":
        return []
    children: list[tuple[str | None, Tree]] = part.items
    if isinstance(part.value, dict):
        plain = any(not isinstance(t.value, dict) for _, t in part.items)
        children = [(None, part)] if plain else part.items
    out = []
    for place, (key, child) in enumerate(children, 1):
        if key is not None:
            name = key
        elif isinstance(child.value, str):
            name = child.value
        else:
            name = child.text("name")
        if name is not None:
            out.append((name, _ordinal(child) or place, child))
    return out


def _ordinal(child: Tree) -> int | None:
    text = child.text("ordinal")
    if text is None:
        return None
    try:
        number = float(text)
    except ValueError:
        return None
    return int(number) if number == int(number) else None


def _facts(child: Tree) -> dict[str, str]:
    if not isinstance(child.value, dict):
        return {}
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in child.value.items() if k != "name"}


_RELATIONS, _PARAMETERS = TreeAutomaton(RELATION_RULES), TreeAutomaton(PARAMETER_RULES)


def relation_children(text: str) -> list[tuple]:
    """Rows of the columns, constraints and constraint columns in one relation payload."""
    try:
        tree = _RELATIONS.run(json.loads(text))
    except (ValueError, RecursionError):
        return []
    while tree.state == "envelope":
        tree = next(t for _, t in tree.items if t.state in ("relation", "envelope"))
    if tree.state != "relation":
        return []
    rel = f"{tree.text('schema')}.{tree.text('name')}"
    out = []
    for name, pos, child in members(tree.child("columns")):
        out.append(("column", rel, name, pos, child.state.removesuffix("_body"), _facts(child)))
    for name, pos, child in members(tree.child("constraints")):
        out.append(("constraint", rel, name, pos, child.state.removesuffix("_body"), _facts(child)))
        for col, place, _ in members(_names(child)):
            out.append(("constraint_column", f"{rel}.{name}", col, place, child.state.removesuffix("_body"), {}))
    return out


def _names(constraint: Tree) -> Tree | None:
    """The constraint's column list; a lone name is a list of one."""
    part = constraint.child("columns") if isinstance(constraint.value, dict) else None
    if part is not None and part.state == "text" and part.value.strip():
        return Tree("list:text", None, [(None, part)])
    return part


def parameter_children(parent: str, text: str) -> list[tuple]:
    try:
        tree = _PARAMETERS.run(json.loads(text))
    except (ValueError, RecursionError):
        return []
    return [("parameter", parent, n, pos, t.state.removesuffix("_body"), _facts(t)) for n, pos, t in members(tree)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["child_kind", "parent_key", "child_key", "pos", "variant", "facts"])


def relation_rows(relations: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame([r for t in b["payload"] for r in relation_children(t)])

    return relations.where(F.col("payload").isNotNull()).select("payload").mapInPandas(parse, _COLUMNS)


def parameter_rows(nodes: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame([r for p, t in zip(b["parent_key"], b["text"], strict=True) for r in parameter_children(p, t)])

    key = F.concat_ws("|", "project_id", F.col("snapshot_no").cast("string"), "node_id")
    held = nodes.select(key.alias("parent_key"), F.try_element_at("attrs", F.lit("parameters")).alias("text"))
    return held.where(F.col("text").isNotNull()).distinct().mapInPandas(parse, _COLUMNS)


def span_rows(traces: DataFrame) -> DataFrame:
    """Spans under their parent span, or under the trace if the parent is in no row of it."""
    spans = (
        traces.select("trace_id", F.explode("spans").alias("s")).where(F.col("trace_id").isNotNull() & F.col("s.span_id").isNotNull())
        .select("trace_id", F.col("s.span_id").alias("span_id"), F.nullif("s.parent_span_id", F.lit("")).alias("parent")).distinct()
    )
    there = spans.select("trace_id", F.col("span_id").alias("parent")).distinct().withColumn("__found", F.lit(True))
    with_parent = spans.where("parent is not null").join(there, ["trace_id", "parent"], "left")
    rooted = spans.where("parent is null").withColumn("__found", F.lit(None).cast("boolean"))
    return with_parent.unionByName(rooted).select(
        F.lit("span").alias("child_kind"), F.when(F.col("__found"), F.col("parent")).otherwise(F.col("trace_id")).alias("parent_key"),
        F.col("span_id").alias("child_key"), F.lit(0).alias("pos"),
    )


def event_rows(traces: DataFrame) -> DataFrame:
    spans = traces.select("trace_id", F.explode("spans").alias("s")).where(F.col("trace_id").isNotNull() & F.col("s.span_id").isNotNull())
    events = spans.select(F.concat_ws(":", "trace_id", "s.span_id").alias("parent_key"), F.posexplode("s.events.name").alias("at", "child_key"))
    return (
        events.where(F.col("child_key").isNotNull())
        .select(F.lit("event").alias("child_kind"), "parent_key", "child_key", (F.col("at") + 1).alias("pos"))
    )


def nested_children(traces: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """The supertype table of all kinds."""
    keys = ["child_kind", "parent_key", "child_key", "pos"]
    return union_all([f.select(*keys) for f in (relation_rows(relations), span_rows(traces), event_rows(traces), parameter_rows(nodes))]).distinct()


# The columns of each subtype table and the spellings of their source keys.
SUBTYPES = {
    "column": {"formatted_type": ("formattedType", "formatted_type"), "nullable": ("nullable",), "default_expression": ("defaultExpression", "default_expression")},
    "foreign_key": {"referenced_schema": ("referencedSchema", "referenced_schema"), "referenced_table": ("referencedTable", "referenced_table"), "referenced_columns": ("referencedColumns", "referenced_columns")},
    "check": {"definition": ("definition",)},
    "key": {"constraint_type": ("type",)},
    "parameter": {"location": ("location",), "required": ("required",)},
}


def subtype_table(rows: DataFrame, variant: str) -> DataFrame:
    """The rows of one variant with its own columns; ``rows`` come from the row functions above."""
    own = [F.coalesce(*[F.try_element_at("facts", F.lit(k)) for k in keys]).alias(c) for c, keys in SUBTYPES[variant].items()]
    return rows.where((F.col("variant") == variant) & (F.col("child_kind") != "constraint_column")).select("child_kind", "parent_key", "child_key", "pos", *own)
