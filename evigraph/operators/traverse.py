"""Traversals as frontier loops over one edge table.

Every round joins the frontier with the edges, drops what was visited and cuts the lineage in
the shared checkpoint folder, so that a lost executor costs one round. The stop test is one
``isEmpty`` per round. All sources travel together as (source, node) pairs; a hub's edges are
a skewed join key that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.session import cut

OUTGOING, INCOMING, BOTH = "OUTGOING", "INCOMING", "BOTH"


def steps(edges: DataFrame, direction: str = OUTGOING, types: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, from, to) steps of the admitted edges."""
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    fore = e.select(*keys, F.col("src").alias("from"), F.col("dst").alias("to"))
    back = e.select(*keys, F.col("dst").alias("from"), F.col("src").alias("to"))
    if direction not in (OUTGOING, INCOMING, BOTH):
        raise ValueError(direction)
    chosen = fore if direction == OUTGOING else back if direction == INCOMING else fore.unionByName(back)
    return chosen.where(F.col("from").isNotNull() & F.col("to").isNotNull()).distinct()


def _rounds(max_depth: int | None) -> Iterable[int]:
    return count(1) if max_depth is None else range(1, max_depth + 1)


def reach(starts: DataFrame, moves: DataFrame, max_depth: int | None, keys: Sequence[str] = (), max_nodes: int | None = None) -> DataFrame:
    """(keys, source, node, depth) of everything within ``max_depth`` steps (None: any); starts are always in it.

    ``starts``: keys, source, node. ``max_nodes`` optionally stops after the round in which a
    total of so many pairs is known.
    """
    ident = [*keys, "source", "node"]
    frontier = cut(starts.select(*ident).distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    for depth in _rounds(max_depth):
        moved = frontier.select(*keys, "source", F.col("node").alias("from")).join(moves, [*keys, "from"])
        fresh = moved.select(*keys, "source", F.col("to").alias("node")).distinct().join(visited.select(*ident), ident, "left_anti")
        frontier = cut(fresh.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = cut(visited.unionByName(frontier)) if depth % 4 == 0 else visited.unionByName(frontier)
        if max_nodes is not None and visited.count() >= max_nodes:
            break
    return visited


def nearest(starts: DataFrame, moves: DataFrame, max_depth: int | None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, depth, source, path) of every node reached, from its nearest source only.

    One row per node, so that the result doesn't grow with sources times nodes. Of equally near
    sources the least wins and then the path that :func:`shortest_paths` gives: whatever is
    nearest to a node was nearest to the node before it on the path.
    """
    ident = [*keys, "node"]
    first = starts.groupBy(*ident).agg(F.min("source").alias("source"))
    frontier = cut(first.select(*ident, F.lit(0).alias("depth"), "source", F.array("node").alias("path")))
    visited = frontier
    for depth in _rounds(max_depth):
        moved = frontier.select(*keys, F.col("node").alias("from"), "source", "path").join(moves, [*keys, "from"])
        best = moved.groupBy(*keys, F.col("to").alias("node")).agg(F.min(F.struct("source", "path")).alias("__best"))
        fresh = best.join(visited.select(*ident), ident, "left_anti")
        frontier = cut(fresh.select(*ident, F.lit(depth).alias("depth"), F.col("__best.source").alias("source"), F.concat("__best.path", F.array("node")).alias("path")))
        if frontier.isEmpty():
            break
        visited = cut(visited.unionByName(frontier)) if depth % 4 == 0 else visited.unionByName(frontier)
    return visited


def shortest_paths(starts: DataFrame, moves: DataFrame, max_depth: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, source, node, depth, path): a shortest path to each node reached.

    Among equal lengths the parent that a queue would have served first wins, which is the
    path that is smallest level by level; carrying the path makes that order comparable.
    """
    ident = [*keys, "source", "node"]
    frontier = cut(starts.select(*ident).distinct().withColumns({"depth": F.lit(0), "path": F.array("node")}))
    visited = frontier
    for depth in range(1, max_depth + 1):
        moved = frontier.select(*keys, "source", F.col("node").alias("from"), "path").join(moves, [*keys, "from"])
        best = moved.groupBy(*keys, "source", F.col("to").alias("node")).agg(F.min("path").alias("path"))
        fresh = best.join(visited.select(*ident), ident, "left_anti")
        frontier = cut(fresh.select(*ident, F.lit(depth).alias("depth"), F.concat("path", F.array("node")).alias("path")))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def impact(changed: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int | None, keys: Sequence[str] = (), flow_type: str = "E2E_FLOW") -> dict[str, DataFrame]:
    """Direct and transitive impact of changed nodes in both directions, and the flows reached with their paths."""
    moves = cut(steps(edges, BOTH, None, keys))
    starts = changed.select(*keys, F.col("id").alias("source"), F.col("id").alias("node")).distinct()
    paths = nearest(starts, moves, max_depth, keys)
    ident = [*keys, "node"]
    transitive = paths.where("depth > 0").select(*ident)
    flows = nodes.where(F.col("type") == flow_type).select(*keys, F.col("id").alias("node"))
    hit = paths.join(flows, ident, "left_semi")
    return {"direct": starts.select(*ident), "transitive": transitive, "flows": hit}


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct existing successors or predecessors of every node."""
    near, far = ("src", "dst") if direction == OUTGOING else ("dst", "src")
    pairs = edges.select(*keys, F.col(near).alias("node"), F.col(far).alias("id")).distinct()
    return pairs.join(nodes.select(*keys, "id").distinct(), [*keys, "id"], "left_semi").select(*keys, "node", F.col("id").alias("neighbour"))


def projection(nodes: DataFrame, edges: DataFrame, types: Sequence[str], keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes of some types and the edges with both ends among them."""
    kept = nodes.where(F.col("type").isin(*types))
    ids = kept.select(*keys, F.col("id").alias("__id")).distinct()
    for end in ("src", "dst"):
        edges = edges.withColumn("__id", F.col(end)).join(ids, [*keys, "__id"], "left_semi").drop("__id")
    return kept, edges


def runtime_subgraph(flows: DataFrame, edges: DataFrame, max_depth: int, keys: Sequence[str] = ()) -> DataFrame:
    """Traces in which a flow was observed and all they contain or call."""
    seen = edges.where("type = 'OBSERVED_IN'").select(*keys, F.col("src").alias("source"), F.col("dst").alias("node"))
    starts = seen.join(flows.select(*keys, F.col("id").alias("source")), [*keys, "source"], "left_semi")
    return reach(starts, steps(edges, OUTGOING, ("CONTAINS", "CALLS"), keys), max_depth, keys)
