"""Best representative of each duplicate group (problem 1).

Records are unpivoted into (group, field, value) rows. Each row votes for its normalised value
with the trust of its source times a decay of recency; the votes of a value are summed, the
greatest sum wins by ``max_by``, and the winners pivot back to one record per group.

Two kinds of weights:

* ``dominant``: weights so far apart that a vote outweighs all votes of less trust together, and
  inside one trust all older ones: the radix of trust exceeds any number of votes, and the decay
  halves faster than the clock ticks, down to the record number. Such sums pass the range of any
  number type, so they are kept as a floating sum: an exponent (trusts, time, block of 256 record
  numbers) and the mantissa summed in it, 4^-n for the n-th number of a block. A sum of lower
  exponent is less than the last digit of one of higher, so comparing exponent, then mantissa, is
  comparing the sums. This is the weighting that gives a strict precedence of trust, time and number.
* ``summed``: trust in radix ``TRUST_RADIX`` and a half-life of ``HALF_LIFE_DAYS``. Many weak sources
  can outvote a strong one.

Everything is ``groupBy`` with map-side partial aggregates over columns of fixed width; a group
holding a third of all rows arrives at its task as few rows per map task.

Defined results: null, blank, punctuation-only and stand-in values never vote; records with
a null id or an unusable key are left out; a null ``collected_at`` is the oldest; copies
count once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import precedence, strip
from evigraph.schema import SOURCE_ORDER

# Texts that mean "not filled in", letters and digits only, lower case.
STAND_INS = (
    "na", "none", "null", "nil", "nan", "undefined", "unknown", "unspecified", "notspecified",
    "notset", "notavailable", "notapplicable", "missing", "empty", "blank", "todo", "tbd", "tba",
    "tbc", "tobedefined", "tobedone", "tobedetermined", "fixme", "xxx", "placeholder", "default", "dummy",
)
# Precedence of evidence confidence, best first.
CONFIDENCE_ORDER = ("OBSERVED", "HUMAN_REVIEWED", "DECLARED", "INFERRED", "UNKNOWN", "STALE", "CONFLICTED")
# The fields of a declaration that are reconciled one by one.
ENDPOINT_FIELDS = (
    "controller_class", "handler_method", "request_body_type", "operation_id", "summary", "description",
)

#: Days after which a vote counts half, and the factor between two trust ranks.
HALF_LIFE_DAYS = 180.0
TRUST_RADIX = 4.0


def says_something(value: Column) -> Column:
    """Not null, blank, mere punctuation or a stand-in for "not filled in"."""
    core = F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))
    return value.isNotNull() & (core != "") & ~core.isin(*STAND_INS)


def endpoint_path_key(path: Column) -> Column:
    """Path without origin, query, fragment, spare slashes and variable names."""
    p = strip(path)
    for _ in range(3):  # patterns such as {id:[0-9]{2}} nest braces
        p = F.regexp_replace(p, r"\{[^{}]*\}", "\u0001")
    p = F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    p = F.regexp_replace(p, r"[?#].*$", "")
    p = F.regexp_replace(F.concat(F.lit("/"), strip(p)), r"/+", "/")
    p = F.regexp_replace(p, r"(.)/$", "$1")
    return F.regexp_replace(p, "\u0001+", "{}")


def best_confidence(evidence: Column) -> Column:
    """Highest confidence rank among the evidence; none, null or unheard of count as UNKNOWN."""
    floor = len(CONFIDENCE_ORDER) - CONFIDENCE_ORDER.index("UNKNOWN")
    ranks = F.transform(evidence, lambda e: F.coalesce(F.nullif(precedence(e["confidence"], CONFIDENCE_ORDER), F.lit(0)), F.lit(floor)))
    return F.coalesce(F.array_max(ranks), F.lit(floor))


def cells(records: DataFrame, keys: Sequence[str], fields: Sequence[str], record_id: str, trust: Sequence[Column], recency: Column) -> DataFrame:
    """Distinct rows (keys, field_name, norm_value, value, id, trust ranks ``t*``, ``at``) of all fields.

    ``norm_value`` and what ranks a row are null where the value says nothing; such rows are kept, since they
    belong to the extent of their group.
    """
    tiers = [f"t{i}" for i in range(len(trust))]
    at = F.coalesce(F.unix_micros(recency.cast("timestamp")), F.lit(-(1 << 62)))
    long = records.where(F.col(record_id).isNotNull()).select(
        *keys, F.col(record_id).alias("id"), *[t.cast("int").alias(n) for n, t in zip(tiers, trust, strict=True)], at.alias("at"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])),
    )
    said = says_something(F.col("value"))
    norm = F.lower(F.regexp_replace(strip(F.col("value")), r"\s+", " "))
    return long.select(*keys, "field_name", "id", F.when(said, norm).alias("norm_value"), *[F.when(said, F.col(c)).alias(c) for c in ("value", *tiers, "at")]).distinct()


def dominant_votes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vote sums per value and exponent."""
    block = F.when(F.col("norm_value").isNotNull(), -F.floor(F.col("id") / 256))
    exponent = [c for c in rows.columns if c not in (*keys, "field_name", "id", "norm_value", "value")]
    return (
        rows.groupBy(*keys, "field_name", "norm_value", *exponent, block.alias("block"))
        .agg(F.sum(F.pow(F.lit(4.0), -F.pmod(F.col("id"), F.lit(256)))).alias("votes"), F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.min_by("value", "id").alias("value"))
        .withColumn("order", F.struct(*exponent, "block", "votes", "norm_value"))
    )


def plain_votes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vote sums per value; among equal sums the value whose best record ranks first."""
    tiers = [c for c in rows.columns if c.startswith("t") and c[1:].isdigit()]
    weight = F.lit(0.0)
    for t in tiers:
        weight = weight * TRUST_RADIX + F.col(t)
    days = F.when(F.col("at") > -(1 << 62), F.col("at") / F.lit(86_400_000_000)).otherwise(0.0)
    vote = weight * F.pow(F.lit(2.0), days / HALF_LIFE_DAYS - 120.0)
    rank = F.struct(*tiers, "at", (-F.col("id")).alias("tie"), "value")
    return (
        # a record delivered with other facts votes once, by its best
        rows.withColumn("vote", vote).groupBy(*keys, "field_name", "norm_value", "id").agg(F.max("vote").alias("vote"), F.max(rank).alias("rank"))
        .groupBy(*keys, "field_name", "norm_value")
        .agg(F.sum("vote").alias("votes"), F.max("rank").alias("rank"), F.min("id").alias("first"), F.max("id").alias("high_id"))
        .select("*", F.struct("votes", "rank").alias("order"), F.col("rank.value").alias("value"), (-F.col("rank.tie")).alias("low_id"))
    )


def field_winners(rows: DataFrame, keys: Sequence[str], mode: str = "dominant") -> DataFrame:
    """The surviving value of every field of every group with at least two records."""
    if mode not in ("dominant", "summed"):
        raise ValueError(mode)
    votes = dominant_votes(rows, keys) if mode == "dominant" else plain_votes(rows, keys)
    best = F.max_by(F.struct("low_id", "value", "votes"), F.when(F.col("norm_value").isNotNull(), F.col("order")))
    return (
        votes.groupBy(*keys, "field_name")
        .agg(F.min("low_id" if mode == "dominant" else "first").alias("group_id"), F.max("high_id").alias("__high"), best.alias("__best"))
        .where((F.col("group_id") < F.col("__high")) & F.col("__best.low_id").isNotNull() & F.col("__best.value").isNotNull())
        .select(*keys, "group_id", "field_name", F.col("__best.low_id").alias("record_id"), F.col("__best.value").alias("value"), F.col("__best.votes").alias("votes"))
    )


def endpoint_records(declarations: DataFrame) -> DataFrame:
    """Declarations with their endpoint key; those without method or path name no endpoint."""
    return declarations.select(
        "project_id",
        F.upper(strip(F.col("http_method"))).alias("method_key"),
        endpoint_path_key(F.col("path")).alias("path_key"),
        "declaration_id",
        "collected_at",
        best_confidence(F.col("evidence")).alias("conf_rank"),
        precedence(F.col("source"), SOURCE_ORDER).alias("source_rank"),
        *ENDPOINT_FIELDS,
    ).where(F.col("method_key").isNotNull() & F.col("path_key").isNotNull())


def surviving_fields(declarations: DataFrame, mode: str = "dominant") -> DataFrame:
    keys = ["project_id", "method_key", "path_key"]
    rows = cells(endpoint_records(declarations), keys, ENDPOINT_FIELDS, "declaration_id", [F.col("conf_rank"), F.col("source_rank")], F.col("collected_at"))
    return field_winners(rows, keys, mode)


def canonical_endpoints(declarations: DataFrame, mode: str = "dominant") -> DataFrame:
    """One surviving record per endpoint: the winners pivoted back to columns."""
    won = surviving_fields(declarations, mode)
    pick = lambda f: F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f)
    return (
        won.groupBy("project_id", "method_key", "path_key")
        .agg(F.min("group_id").alias("group_id"), *[pick(f) for f in ENDPOINT_FIELDS])
        .withColumnsRenamed({"method_key": "http_method", "path_key": "path"})
    )
