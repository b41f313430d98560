"""Semantic difference of two graphs, staleness and documentation claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.ids import digest
from evigraph.functions.text import strip
from evigraph.session import union_all


def changed_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields whose before and after (struct b, a) differ, null-safe."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in fields.items()])))


def diff_elements(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, change, changed_fields) of rows unique in ``keys``; equal rows give none."""
    b = before.select(*keys, F.struct(*fields).alias("b"))
    a = after.select(*keys, F.struct(*fields).alias("a"))
    both = b.join(a, list(keys), "full")
    names = changed_fields({f: F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")) for f in fields})
    change = F.when(F.col("b").isNull(), "ADDED").when(F.col("a").isNull(), "REMOVED").otherwise("MODIFIED")
    return (
        both.select(*keys, change.alias("change"), F.when(F.col("b").isNotNull() & F.col("a").isNotNull(), names).otherwise(F.array().cast("array<string>")).alias("changed_fields"))
        .where((F.col("change") != "MODIFIED") | (F.size("changed_fields") > 0))
    )


def diff_summary(node_diff: DataFrame, edge_diff: DataFrame) -> DataFrame:
    both = node_diff.select(F.lit("node").alias("kind"), "change").unionByName(edge_diff.select(F.lit("edge").alias("kind"), "change"))
    return both.groupBy("kind", "change").agg(F.count("*").alias("elements"))


def change_roots(node_diff: DataFrame, edge_diff: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes from which staleness spreads.

    Added and removed nodes, nodes changed in type, name or attributes, and both ends of
    changed edges other than DOCUMENTED_BY; custom sections are never roots.
    """
    touched = F.arrays_overlap("changed_fields", F.array(F.lit("type"), F.lit("display_name"), F.lit("attributes")))
    custom = F.col("id").startswith("custom")
    own = node_diff.where(((F.col("change") != "MODIFIED") | touched) & ~custom).select(*keys, "id")
    ends = edges.join(edge_diff.select(*keys, "id"), [*keys, "id"], "left_semi").where("type <> 'DOCUMENTED_BY'")
    return union_all([own, ends.select(*keys, F.col("src").alias("id")), ends.select(*keys, F.col("dst").alias("id"))]).where(~custom).distinct()


def stale_by_fingerprint(elements: DataFrame, fingerprints: DataFrame, complete: bool, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, stale, cause): against the fingerprints of a snapshot.

    ``elements``: keys, id, source_id (null for itself), fingerprint. A changed source makes
    stale, a missing one only if the snapshot is complete, a matching one clears.
    """
    e = elements.withColumn("__of", F.coalesce("source_id", "id"))
    f = fingerprints.select(*keys, F.col("id").alias("__of"), F.col("fingerprint").alias("__now"))
    cause = (
        F.when(F.col("__now").isNull(), F.lit("SOURCE_MISSING") if complete else F.lit(None).cast("string"))
        .when(F.col("__now") != F.col("fingerprint"), "SOURCE_CHANGED")
    )
    return e.join(f, [*keys, "__of"], "left").select(*keys, "id", cause.isNotNull().alias("stale"), cause.alias("cause"))


def stale_by_impact(documented: DataFrame, reached: DataFrame, unchanged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Durable documentation that didn't change though what it lies within reach of did."""
    ident = [*keys, "id"]
    near = reached.select(*keys, F.col("node").alias("id")).distinct()
    return documented.select(*ident).distinct().join(near, ident, "left_semi").join(unchanged.select(*ident), ident, "left_semi").withColumn("cause", F.lit("IMPACTED_IMPLEMENTATION"))


def actual_value(node: str = "") -> Column:
    """Value that a claim's field has in its node: a base field, an attribute, or null."""
    col = lambda c: F.col(f"{node}{c}")
    attr = F.regexp_replace(F.col("field"), r"^attributes\.", "")
    raw = F.try_element_at(col("attrs"), attr)
    return (
        F.when(F.col("field") == "type", col("type"))
        .when(F.col("field") == "displayName", col("display_name"))
        .when(F.col("field") == "description", col("description"))
        .otherwise(F.regexp_replace(raw, '^"(.*)"$', "$1"))
    )


def reconcile_claims(claims: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, section, id, field, expected, actual, verdict) of assertions in custom documentation.

    MISSING: no such node; ABSENT: the node lacks the field; MISMATCH or MATCH otherwise.
    """
    n = nodes.select(*keys, "id", F.struct("type", "display_name", "description", "attrs").alias("__n"))
    joined = claims.join(n, [*keys, "id"], "left").withColumn("actual", actual_value("__n."))
    verdict = (
        F.when(F.col("__n").isNull(), "MISSING").when(F.col("actual").isNull(), "ABSENT")
        .when(strip(F.col("actual")) == strip(F.col("expected")), "MATCH").otherwise("MISMATCH")
    )
    return joined.select(*keys, "section", "id", "field", "expected", "actual", verdict.alias("verdict"))


def mismatch_conflicts(verdicts: DataFrame) -> DataFrame:
    """Conflicts that replace the earlier ones of the same sections."""
    return verdicts.where("verdict in ('MISMATCH', 'ABSENT')").select(
        F.concat(F.lit("conflict:"), digest(F.col("section"), F.col("id"), F.col("field"))).alias("conflict_id"), F.lit("DOCUMENTATION_MISMATCH").alias("conflict_type"), "section", "id", "field", "expected", "actual"
    )
