"""What changed between consecutive full snapshots (problem 3).

Each snapshot row becomes signed cells (key, field, value digest): +1 towards its own
snapshot and -1 towards the next one present, plus a presence marker per key. Cells that
agree cancel; the sums that are left say what was added, removed or changed, field by field.

Plan: rows are reduced to five 64-bit digests, copies are collapsed with map-side partial
aggregates, the compact rows are partitioned once by (project, node) and the cells are
exploded, summed and classified inside that partitioning without a further exchange. The
snapshot sequence of each project is a lookup that is broadcast after a check of its size.

Defined results: rows without project, snapshot number or node id are left out; a node
delivered twice counts once, the latest delivery if they differ; the first snapshot of a
project gives no rows; null and blank names, null and empty maps, null and empty warnings
and null and false ``stale`` agree; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions.canon import attributes_digest
from evigraph.functions.text import strip
from evigraph.session import lookup_join

# Names of the compared fields.
NODE_FIELDS = ("type", "display_name", "description", "attributes", "metadata")
_PAIR, _PART = "\u0001", "\u0002"


@F.pandas_udf(T.LongType())
def _attributes_digest(flat: pd.Series, span: pd.Series) -> pd.Series:
    out = []
    for text, is_span in zip(flat, span, strict=True):
        pairs = [tuple(p.split(_PART, 1)) for p in text.split(_PAIR)] if text else []
        out.append(attributes_digest(pairs, bool(is_span)))
    return pd.Series(out, dtype="int64")


def attributes_hash(attrs: Column, node_type: Column) -> Column:
    """Digest of a map of JSON texts that ignores key order, number spelling and volatile keys.

    Recursion over unknown depth has no built-in, hence the Arrow-batched function; the map
    travels as one string.
    """
    flat = F.array_join(
        F.transform(F.map_entries(attrs), lambda e: F.concat(e["key"], F.lit(_PART), F.coalesce(e["value"], F.lit("null")))), _PAIR
    )
    return _attributes_digest(F.coalesce(flat, F.lit("")), F.coalesce(node_type == "SPAN", F.lit(False)))


def node_digests(nodes: DataFrame) -> DataFrame:
    """Snapshot rows reduced to their key, delivery time and one digest per field."""
    m = F.col("metadata")
    text = lambda c: F.coalesce(c, F.lit(""))
    warnings = F.array_join(F.coalesce(m["warnings"], F.array()), _PAIR, _PART)
    meta = F.concat_ws(_PAIR, text(m["confidence"]), text(m["review_state"]), F.coalesce(m["stale"], F.lit(False)).cast("string"), text(warnings))
    return nodes.where(F.col("project_id").isNotNull() & F.col("snapshot_no").isNotNull() & F.col("node_id").isNotNull()).select(
        "project_id", "snapshot_no", "node_id", "delivered_at",
        F.xxhash64(text(F.col("type"))).alias("type"),
        F.xxhash64(text(strip(F.col("display_name")))).alias("display_name"),
        F.xxhash64(text(strip(F.col("description")))).alias("description"),
        attributes_hash(F.col("attrs"), F.col("type")).alias("attributes"),
        F.xxhash64(meta).alias("metadata"),
    )


def snapshot_sequence(snapshots: DataFrame, group: str, number: str) -> DataFrame:
    """(group, number, next_no, has_previous) of the distinct snapshot numbers per group."""
    w = Window.partitionBy(group).orderBy(number)
    return (
        snapshots.where(F.col(group).isNotNull() & F.col(number).isNotNull()).select(group, number).distinct()
        .withColumns({"next_no": F.lead(number).over(w), "has_previous": F.lag(number).over(w).isNotNull()})
    )


def snapshot_changes(
    digests: DataFrame, sequence: DataFrame, group: str, number: str, key: str, fields: tuple[str, ...], delivered: str
) -> DataFrame:
    """(group, number, key, change_kind, field_name) between consecutive snapshots.

    ``digests`` has one 64-bit column per field; equal digests are equal values.
    """
    once = (
        digests.groupBy(group, number, key)
        .agg(F.max(F.struct(delivered, *fields)).alias("__row"))
        .select(group, number, key, *[F.col(f"__row.{f}").alias(f) for f in fields])
    )
    placed = lookup_join(once, sequence, [group, number], "inner").repartition(group, key)
    sides = F.filter(
        F.array(
            F.struct(F.when(F.col("has_previous"), F.col(number)).alias("__no"), F.lit(1).alias("__sign")),
            F.struct(F.col("next_no").alias("__no"), F.lit(-1).alias("__sign")),
        ),
        lambda s: s["__no"].isNotNull(),
    )
    cells = F.array(
        F.struct(F.lit("").alias("field_name"), F.lit(0).cast("bigint").alias("__value")),
        *[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("__value")) for f in fields],
    )
    signed = (
        placed.select(group, key, F.inline(sides), cells.alias("__cells"))
        .select(group, key, "__no", "__sign", F.inline("__cells"))
        .groupBy(group, key, "__no", "field_name", "__value")
        .agg(F.sum("__sign").alias("__sum"))
        .where("__sum <> 0")
    )
    rows = signed.groupBy(group, key, "__no").agg(
        F.coalesce(F.max(F.when(F.col("field_name") == "", F.col("__sum"))), F.lit(0)).alias("__presence"),
        F.collect_set(F.when(F.col("field_name") != "", F.col("field_name"))).alias("__fields"),
    )
    kind = F.when(F.col("__presence") > 0, "added").when(F.col("__presence") < 0, "removed").otherwise("changed")
    names = F.when(F.col("__presence") != 0, F.array(F.lit(""))).otherwise(F.col("__fields"))
    return rows.select(group, F.col("__no").alias(number), key, kind.alias("change_kind"), F.explode(names).alias("field_name"))


def node_changes(nodes: DataFrame) -> DataFrame:
    """(project_id, snapshot_no, node_id, change_kind, field_name) of the graph's snapshots."""
    return snapshot_changes(
        node_digests(nodes), snapshot_sequence(nodes, "project_id", "snapshot_no"),
        "project_id", "snapshot_no", "node_id", NODE_FIELDS, "delivered_at",
    )
