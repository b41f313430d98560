"""Planning and running refreshes: which adapters run, which fragments are reused.

Plans are driver decisions over a closed set of categories; fragments stay DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import strip
from evigraph.operators import diff, traverse, validate
from evigraph.session import cut

# Categories after which only a full refresh is safe.
UNSAFE = frozenset({"CONFIGURATION", "UNKNOWN", "UNSAFE_GIT_STATE"})
FULL, INCREMENTAL = "FULL", "INCREMENTAL"


class Adapter(Protocol):
    """One source of facts: its name and version, what changes affect it, and its fragment."""

    name: str
    version: str
    categories: frozenset[str]
    incremental: bool

    def analyze(self) -> tuple[DataFrame, DataFrame]: ...


@dataclass(frozen=True)
class Plan:
    mode: str
    adapters: tuple[str, ...]
    reasons: tuple[str, ...] = ()


@dataclass
class Result:
    plan: Plan
    nodes: DataFrame
    edges: DataFrame
    runs: dict[str, str] = field(default_factory=dict)


def plan(mode: str, categories: Iterable[str], adapters: Iterable[Adapter], has_previous: bool) -> Plan:
    """FULL as asked; INCREMENTAL unless something makes it unsafe."""
    listed, changed = list(adapters), set(categories)
    every = tuple(a.name for a in listed)
    if mode == FULL:
        return Plan(FULL, every, ("asked for",))
    covered = set().union(*[a.categories for a in listed]) if listed else set()
    affected = [a for a in listed if a.categories & changed]
    reasons = [
        *(["no previous graph"] if not has_previous else []),
        *[f"unsafe category {c}" for c in sorted(changed & UNSAFE)],
        *[f"no adapter covers {c}" for c in sorted(changed - covered - UNSAFE)],
        *[f"{a.name} can't run incrementally" for a in affected if not a.incremental],
    ]
    if reasons:
        return Plan(FULL, every, tuple(reasons))
    return Plan(INCREMENTAL, tuple(a.name for a in affected))


def normalize_fragment(df: DataFrame, adapter: str, commit: str, analyzed_at: str) -> DataFrame:
    """Blank adapter, commit and time filled in."""
    fill = lambda c, v: F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), F.lit(v)) if c in df.columns else F.lit(v)
    at = F.coalesce(F.col("analyzed_at"), F.lit(analyzed_at).cast("timestamp")) if "analyzed_at" in df.columns else F.lit(analyzed_at).cast("timestamp")
    return df.withColumns({"adapter": fill("adapter", adapter), "target_commit": fill("target_commit", commit), "analyzed_at": at})


def run(
    chosen: Plan, adapters: Iterable[Adapter], cached: Callable[[str], tuple[DataFrame, DataFrame] | None], commit: str, analyzed_at: str, strict: bool = False
) -> Result:
    """Run the planned adapters and reuse cached fragments of the others.

    A missing cache falls back to a full run, or raises if ``strict``.
    """
    listed = list(adapters)
    runs: dict[str, str] = {}
    parts: list[tuple[DataFrame, DataFrame]] = []
    for a in listed:
        if chosen.mode == FULL or a.name in chosen.adapters:
            parts.append(tuple(normalize_fragment(x, a.name, commit, analyzed_at) for x in a.analyze()))
            runs[a.name] = "EXECUTED"
            continue
        held = cached(a.name)
        if held is None:
            if strict:
                raise LookupError(f"no cached fragment of {a.name}")
            return run(Plan(FULL, tuple(x.name for x in listed), (f"no cached fragment of {a.name}",)), listed, cached, commit, analyzed_at)
        parts.append(tuple(promote(x, commit, analyzed_at) for x in held))
        runs[a.name] = "CACHE_REUSED"
    nodes, edges = parts[0]
    for n, e in parts[1:]:
        nodes, edges = nodes.unionByName(n, allowMissingColumns=True), edges.unionByName(e, allowMissingColumns=True)
    return Result(chosen, nodes, edges, runs)


def promote(df: DataFrame, commit: str, analyzed_at: str) -> DataFrame:
    """A reused fragment under the new commit and time; its rows stay."""
    return df.withColumns({"target_commit": F.lit(commit), "analyzed_at": F.lit(analyzed_at).cast("timestamp")})


def retained_documentation(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Nodes of the previous graph that must not be lost: custom sections and nodes with human evidence.

    The latter become ``custom-retained:`` nodes of their own. ``previous`` has id, type,
    display_name, description, has_human.
    """
    gone = previous.join(current.select("id"), "id", "left_anti")
    custom = gone.where("type = 'CUSTOM_HTML_SECTION'").select("id", "type", "display_name", "description")
    human = gone.where("type <> 'CUSTOM_HTML_SECTION' and has_human").select(
        F.concat(F.lit("custom-retained:"), "id").alias("id"), F.lit("CUSTOM_HTML_SECTION").alias("type"), "display_name", "description"
    )
    return custom.unionByName(human)


NODE_FIELDS, EDGE_FIELDS = ("type", "display_name", "description", "attributes"), ("type", "src", "dst")


def cycle(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], keys: Sequence[str] = (), documented: Sequence[str] = ("CUSTOM_HTML_SECTION",)) -> dict[str, DataFrame]:
    """One round of a refresh: difference, stale marks, difference again, validation, impact.

    Both graphs are (nodes, edges), nodes with type, display_name, description, ``attributes`` (one
    comparable value), fingerprint and stale, unique in ``keys`` and id. Results by name:

    * ``nodes``: the later nodes with their new stale mark;
    * ``stale``: (keys, id, cause) by a changed or missing source, or by impact on documentation that didn't change;
    * ``node_diff``, ``edge_diff``: the difference, stale marks included;
    * ``findings``: the rules broken by the later graph;
    * ``impacted``: nodes within reach of a change in the earlier or the later graph.
    """
    ident, (nodes_b, edges_b), (nodes_a, edges_a) = [*keys, "id"], before, after
    node_diff, edge_diff = diff.diff_elements(nodes_b, nodes_a, ident, NODE_FIELDS), cut(diff.diff_elements(edges_b, edges_a, ident, EDGE_FIELDS))
    marked = nodes_b.where("fingerprint is not null").select(*ident, F.lit(None).cast("string").alias("source_id"), "fingerprint")
    sources = nodes_a.where("fingerprint is not null").select(*ident, "fingerprint")
    by_source = diff.stale_by_fingerprint(marked, sources, False, keys).where("stale").select(*ident, "cause")
    roots = cut(diff.change_roots(node_diff, edge_diff, edges_b.unionByName(edges_a), keys))
    reached = [cut(traverse.nearest(roots.select(*keys, F.col("id").alias("source"), F.col("id").alias("node")), cut(traverse.steps(e, traverse.BOTH, None, keys)), None, keys)) for e in (edges_b, edges_a)]
    impacted = reached[0].unionByName(reached[1]).select(*keys, F.col("node").alias("id")).distinct()
    docs = nodes_a.where(F.col("type").isin(*documented))
    same = docs.join(node_diff.select(*ident), ident, "left_anti")
    by_impact = diff.stale_by_impact(docs, reached[1], same, keys)
    stale = cut(by_source.unionByName(by_impact).groupBy(*ident).agg(F.max("cause").alias("cause")))
    remarked = nodes_a.drop("stale").join(stale.select(*ident, F.lit(True).alias("__stale")), ident, "left").withColumn("stale", F.coalesce("__stale", F.lit(False))).drop("__stale")
    again = diff.diff_elements(nodes_b.withColumn("stale", F.coalesce("stale", F.lit(False))), remarked, ident, (*NODE_FIELDS, "stale"))
    return {"nodes": remarked, "stale": stale, "node_diff": again, "edge_diff": edge_diff, "findings": validate.validate(nodes_a, edges_a, keys), "impacted": impacted}
