"""Merging fragments by authority, with conflicts and confidence.

All winners are ``max_by`` over a full order (authority, time, element key), so results don't
depend on row order and every group reduces by partial aggregates. Conflicts come from sets
of distinct values per field, not from pairs of rows: enumerated fields have at most as many
values as their enumeration, attributes only need to know whether there is more than one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.ids import digest
from evigraph.functions.text import strip
from evigraph.schema import CONFIDENCE_RANKS, coded
from evigraph.session import union_all


def canonical_attrs(attrs: Column) -> Column:
    """A map as one text with sorted keys."""
    pairs = F.array_sort(F.transform(F.map_entries(attrs), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))
    return F.coalesce(F.array_join(pairs, "\u0001"), F.lit(""))


def element_key() -> Column:
    """Last tie-break between fragments of one element."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws("\u0000", text("type"), text("display_name"), text("description"), canonical_attrs(F.col("attrs")), text("adapter"))


def merge_nodes(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per element: technical type, display name and description by authority.

    ``fragments``: keys, type, display_name, description, attrs, adapter, fact_rank,
    intent_rank, analyzed_at. A description backed by design intent precedes all others.
    """
    order = F.struct("fact_rank", "analyzed_at", element_key().alias("key"))
    intent = F.struct("intent_rank", "analyzed_at", element_key().alias("key"))
    named, told = strip(F.col("display_name")) != "", strip(F.col("description")) != ""
    return fragments.groupBy(*keys).agg(
        F.max_by("type", order).alias("type"),
        F.max_by("display_name", F.when(named, order)).alias("display_name"),
        F.coalesce(
            F.max_by("description", F.when(told & (F.col("intent_rank") > 0), intent)), F.max_by("description", F.when(told, order)), F.lit("")
        ).alias("description"),
        F.count("*").alias("fragments"),
    )


def merge_attributes(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, attr, value): the winner among the fragments that have the key."""
    order = F.struct("fact_rank", "analyzed_at", element_key().alias("key"))
    return fragments.select(*keys, order.alias("__order"), F.explode("attrs").alias("attr", "value")).groupBy(*keys, "attr").agg(F.max_by("value", "__order").alias("value"))


def attributes_map(attributes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attributes.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr", "value")))).alias("attrs"))


def merge_edges(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per edge: type and both ends from one technical winner, the description by authority.

    ``fragments``: keys, type, src, dst, description, attrs, adapter, fact_rank, analyzed_at. Attributes merge as those
    of nodes do (:func:`merge_attributes`).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.concat_ws("\u0000", text("type"), text("src"), text("dst"), text("description"), canonical_attrs(F.col("attrs")), text("adapter"))
    order = F.struct("fact_rank", "analyzed_at", key.alias("key"))
    told = strip(F.col("description")) != ""
    return (
        fragments.groupBy(*keys)
        .agg(F.max_by(F.struct("type", "src", "dst"), order).alias("__facts"), F.max_by("description", F.when(told, order)).alias("__told"), F.count("*").alias("fragments"))
        .select(*keys, "__facts.*", F.coalesce("__told", F.lit("")).alias("description"), "fragments")
    )


def merge_stale(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stale mark of an element: the latest of its stale fragments, ties by reason, fingerprints and cause; fresh if none.

    ``fragments``: keys, stale, detected_at, reason, source_fingerprint, current_fingerprint, cause.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    mark = F.struct("detected_at", *map(text, ("reason", "source_fingerprint", "current_fingerprint", "cause")))
    return (
        fragments.groupBy(*keys).agg(F.max(F.when(F.col("stale"), mark)).alias("__mark"))
        .select(*keys, F.col("__mark").isNotNull().alias("stale"), "__mark.*")
    )


def merge_root(roots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Root of merged documents (project_id, schema_version, target_commit, analyzed_at); those of several projects don't merge.

    With ``by`` there is one root per group, and the project is one of its keys.
    """
    if not by and len(roots.select("project_id").distinct().limit(2).collect()) > 1:
        raise ValueError("fragments of several projects")
    commit = F.max(F.when(strip(F.col("target_commit")) != "", F.col("target_commit")))
    out = [F.max("schema_version").alias("schema_version"), F.coalesce(commit, F.lit("")).alias("target_commit"), F.max("analyzed_at").alias("analyzed_at")]
    return roots.groupBy(*(by or ["project_id"])).agg(*out)


def evidence_union(fragments: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("locations", "warnings", "traces", "scenarios")) -> DataFrame:
    """Distinct sorted values of the list columns of an element's fragments; exploded first, so that repeated values meet early."""
    rows = union_all([fragments.select(*keys, F.lit(c).alias("__of"), F.explode_outer(c).alias("__v")) for c in columns]).distinct()
    return rows.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("__of") == c, F.col("__v")))).alias(c) for c in columns])


# Detail keys that say when something was seen, and those of one run; letters and digits, lower case.
VOLATILE_DETAILS = ("capturedat", "analyzedat", "generatedat", "observedat", "sourcefingerprint")
RUN_DETAILS = (
    "traceid", "spanid", "parentspanid", "tracestate", "starttime", "endtime", "starttimeunixnano", "endtimeunixnano", "durationmillis", "timestamp",
    "observedtimestamp", "eventtime", "eventtimeunixnano", "time", "timeunixnano", "serviceinstanceid", "processpid", "threadid",
)


def evidence_id(type_: Column, scope: Column, source: Column, description: Column, path: Column, symbol: Column, details: Column) -> Column:
    """Id of an evidence by what it means: neither line numbers nor volatile details count. ``details`` is a flat map."""
    plain = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    run = F.coalesce(type_.isin("RUNTIME_OBSERVATION", "PLAYWRIGHT_OBSERVATION"), F.lit(False))
    kept = F.map_filter(details, lambda k, v: ~plain(k).isin(*VOLATILE_DETAILS) & ~(run & plain(k).isin(*RUN_DETAILS)))
    text = [F.coalesce(c, F.lit("")) for c in (type_, scope, source, description, path, symbol)]
    return F.concat(F.lit("evidence:"), digest(*text, canonical_attrs(kept)))


def merge_review(states: Column) -> Column:
    """Review state of a set of states by precedence; approval against rejection needs review."""
    has = lambda *xs: F.arrays_overlap(states, F.array(*[F.lit(x) for x in xs]))
    return (
        F.when(has("NEEDS_REVIEW"), "NEEDS_REVIEW")
        .when(has("REJECTED") & has("APPROVED", "HUMAN_REVIEWED"), "NEEDS_REVIEW")
        .when(has("REJECTED"), "REJECTED")
        .when(has("APPROVED"), "APPROVED")
        .when(has("HUMAN_REVIEWED"), "HUMAN_REVIEWED")
        .when(has("AGENT_REVIEWED"), "AGENT_REVIEWED")
        .otherwise("UNREVIEWED")
    )


def merge_metadata(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greatest commit and time, distinct adapters and warnings, review state, stale flag."""
    adapters = F.transform(F.split(F.coalesce("adapter", F.lit("")), ","), lambda a: F.trim(a))
    return (
        fragments.withColumn("__adapters", adapters)
        .groupBy(*keys)
        .agg(
            F.max(F.when(strip(F.col("target_commit")) != "", F.col("target_commit"))).alias("target_commit"),
            F.max("analyzed_at").alias("analyzed_at"),
            F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set("__adapters")), lambda a: a != ""))), ",").alias("adapter"),
            merge_review(F.collect_set("review_state")).alias("review_state"),
            F.coalesce(F.bool_or("stale"), F.lit(False)).alias("stale"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("warnings", F.array()))))).alias("warnings"),
        )
    )


def richness(observed_bonus: int = 5) -> Column:
    """How much an evidence row tells; the merger counts ``observed_at`` as well, the normalizer doesn't."""
    said = lambda c: F.when(F.coalesce(strip(F.col(c)), F.lit("")) != "", 1).otherwise(0)
    base = said("description") * 2 + said("source") * 3 + said("adapter") + said("type")
    return base + F.when(F.col("observed_at").isNotNull(), observed_bonus).otherwise(0)


def dedupe_evidence(evidence: DataFrame, keys: Sequence[str], observed_bonus: int = 5) -> DataFrame:
    """One row per evidence id: the richest, ties by canonical text."""
    cols = [c for c in evidence.columns if c not in keys]
    key = F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return evidence.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(richness(observed_bonus).alias("r"), key.alias("k"))).alias("__e")).select(*keys, "__e.*")


def evaluate_confidence(conflicted: Column, stale: Column, review: Column, human: Column, best_evidence: Column) -> Column:
    """CONFLICTED, STALE, HUMAN_REVIEWED (reviewed with human evidence), the best evidence, UNKNOWN."""
    return (
        F.when(conflicted, "CONFLICTED")
        .when(stale, "STALE")
        .when(review.isin("HUMAN_REVIEWED", "APPROVED") & human, "HUMAN_REVIEWED")
        .otherwise(F.coalesce(best_evidence, F.lit("UNKNOWN")))
    )


def best_confidence(confidences: Column) -> Column:
    """Strongest of an array of confidences."""
    ranked = F.transform(confidences, lambda c: F.struct(coded(c, CONFIDENCE_RANKS, 0).alias("r"), c.alias("c")))
    return F.array_max(ranked)["c"]


def conflicts(fragments: DataFrame, keys: Sequence[str], enumerated: Sequence[str] = ("type",)) -> DataFrame:
    """(keys, conflict_id, conflict_type, field, description): disagreements between fragments.

    Display names and prose are alternatives, not contradictions.
    """
    subject = F.concat_ws("|", *keys)
    out = []
    for c in enumerated:
        sets = fragments.groupBy(*keys).agg(F.array_sort(F.collect_set(c)).alias("v")).where(F.size("v") > 1)
        pairs = F.filter(
            F.flatten(F.transform("v", lambda a: F.transform("v", lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda p: p["a"] < p["b"]
        )
        out.append(sets.select(*keys, F.lit("TYPE_MISMATCH").alias("conflict_type"), F.lit(c).alias("field"), F.explode(F.transform(pairs, lambda p: F.concat(p["a"], F.lit(" conflicts with "), p["b"]))).alias("description")))
    review = fragments.groupBy(*keys).agg(F.collect_set("review_state").alias("v"))
    out.append(
        review.where(F.array_contains("v", "REJECTED"))
        .select(*keys, F.lit("SOURCE_DISAGREEMENT").alias("conflict_type"), F.lit("reviewState").alias("field"), F.explode(F.filter("v", lambda s: s.isin("APPROVED", "HUMAN_REVIEWED"))).alias("s"))
        .select(*keys, "conflict_type", "field", F.concat(F.col("s"), F.lit(" conflicts with REJECTED")).alias("description"))
    )
    values = fragments.select(*keys, F.explode("attrs").alias("attr", "value")).groupBy(*keys, "attr").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    out.append(
        values.where("lo < hi").select(
            *keys, F.lit("ATTRIBUTE_MISMATCH").alias("conflict_type"), F.concat(F.lit("attributes."), F.col("attr")).alias("field"),
            F.concat(F.lit("Attribute '"), F.col("attr"), F.lit("' has conflicting values")).alias("description"),
        )
    )
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.withColumn("conflict_id", F.concat(F.lit("conflict:"), digest(subject, F.col("conflict_type"), F.col("field"), F.col("description"))))


def has_open_conflict(conflicts: Column) -> Column:
    """Whether an array of conflicts (status) has an open one."""
    return F.coalesce(F.exists(conflicts, lambda c: F.upper(c["status"]) == "OPEN"), F.lit(False))


def is_durable(type_: Column, evidence_types: Column) -> Column:
    """Documentation that outlives its source: a custom node, or one with evidence of a person, a doc comment or an agent."""
    return type_.startswith("CUSTOM") | F.coalesce(F.arrays_overlap(evidence_types, F.array(*[F.lit(t) for t in ("HUMAN_INPUT", "JAVADOC", "AGENT_INFERENCE")])), F.lit(False))


def is_runtime(type_: Column, evidence_types: Column) -> Column:
    """An element of a run: a trace, a span, or anything known by observation."""
    return type_.isin("TRACE", "SPAN") | F.coalesce(F.arrays_overlap(evidence_types, F.array(F.lit("RUNTIME_OBSERVATION"), F.lit("PLAYWRIGHT_OBSERVATION"))), F.lit(False))


def dedupe_conflicts(rows: DataFrame) -> DataFrame:
    """One row per conflict id: OPEN dominates, latest time, longest description, united evidence.

    A RESOLVED conflict without a resolution becomes IGNORED.
    """
    return (
        rows.groupBy("conflict_id")
        .agg(
            F.max(F.when(F.col("status") == "OPEN", 2).when(F.col("status") == "RESOLVED", 1).otherwise(0)).alias("__s"),
            F.max("detected_at").alias("detected_at"),
            F.max_by("description", F.struct(F.length("description"), "description")).alias("description"),
            F.max(F.coalesce("resolution", F.lit(""))).alias("resolution"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
        )
        .withColumn("status", F.when(F.col("__s") == 2, "OPEN").when((F.col("__s") == 1) & (strip(F.col("resolution")) != ""), "RESOLVED").otherwise("IGNORED"))
        .drop("__s")
    )
