"""Validation rules over a graph, each a query; their union is the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.session import union_all


def dangling(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    ids = nodes.select(*keys, F.col("id").alias("__id")).distinct()
    found = []
    for end, code in (("src", "DANGLING_EDGE_SOURCE"), ("dst", "DANGLING_EDGE_TARGET")):
        lost = edges.withColumn("__id", F.col(end)).join(ids, [*keys, "__id"], "left_anti")
        found.append(lost.select(*keys, F.lit("ERROR").alias("severity"), F.lit(code).alias("code"), "id", F.col("__id").alias("about")))
    return found[0].unionByName(found[1])


def duplicate_relations(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges whose (type, src, dst) is already stored under a smaller id."""
    first = edges.groupBy(*keys, "type", "src", "dst").agg(F.min("id").alias("about"), F.array_sort(F.collect_set("id")).alias("ids"))
    return first.where(F.size("ids") > 1).select(
        *keys, F.lit("ERROR").alias("severity"), F.lit("DUPLICATE_RELATION").alias("code"), F.explode(F.slice("ids", F.lit(2), F.size("ids"))).alias("id"), "about"
    )


def inverse_pairs(edges: DataFrame, keys: Sequence[str] = (), inverse: tuple[str, str] = ("CALLS", "CALLED_BY")) -> DataFrame:
    a, b = inverse
    left = edges.where(F.col("type").isin(a, b)).select(*keys, "id", "type", "src", "dst")
    right = left.select(*keys, F.col("id").alias("__id"), F.when(F.col("type") == a, b).otherwise(a).alias("type"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = left.join(right, [*keys, "type", "src", "dst"]).where(F.col("id") < F.col("__id"))
    return both.select(*keys, F.lit("ERROR").alias("severity"), F.lit("DUPLICATE_INVERSE_RELATION").alias("code"), F.col("__id").alias("id"), F.col("id").alias("about")).distinct()


def confidence_rules(elements: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rules on evidence and stored confidence.

    ``elements``: keys, id, confidence, expected, evidence_types (array).
    """
    has = lambda *xs: F.arrays_overlap("evidence_types", F.array(*[F.lit(x) for x in xs]))
    none = F.coalesce(F.size("evidence_types"), F.lit(0)) <= 0
    rules = F.array(
        F.when(none, F.struct(F.lit("WARNING").alias("severity"), F.lit("MISSING_EVIDENCE").alias("code"))),
        F.when(F.col("confidence") != F.col("expected"), F.struct(F.lit("ERROR").alias("severity"), F.lit("INVALID_CONFIDENCE").alias("code"))),
        F.when((F.col("confidence") == "OBSERVED") & ~F.coalesce(has("RUNTIME_OBSERVATION", "PLAYWRIGHT_OBSERVATION"), F.lit(False)), F.struct(F.lit("ERROR").alias("severity"), F.lit("OBSERVED_WITHOUT_OBSERVATION").alias("code"))),
        F.when((F.col("confidence") == "DECLARED") & ~F.coalesce(has("SPRING_MAPPING", "OPENAPI", "DATABASE_INTROSPECTION"), F.lit(False)), F.struct(F.lit("ERROR").alias("severity"), F.lit("DECLARED_WITHOUT_DECLARATION").alias("code"))),
    )
    return elements.select(*keys, "id", F.inline(F.array_compact(rules))).select(*keys, "severity", "code", "id", F.lit(None).cast("string").alias("about"))


def validate(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Structural rules of a graph; evidence rules come from :func:`confidence_rules`."""
    return union_all([dangling(nodes, edges, keys), duplicate_relations(edges, keys), inverse_pairs(edges, keys)])


def require_unique(df: DataFrame, key: str = "id") -> DataFrame:
    """The rows as they are; reading them raises if an id occurs twice."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("__n", F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate id "), F.col(key)))).otherwise(n)).where("__n > 0").drop("__n")
