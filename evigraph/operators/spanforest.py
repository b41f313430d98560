"""Labels of unordered span forests that don't depend on raw ids or exporter order.

A span's form is the digest of its own identity and the sorted forms of its children, bottom
up; siblings of equal identity are told apart by an ordinal in the order of their forms. A
cycle is opened at its least identity. Traces are independent; the recursion has no built-in,
so traces stream through one Arrow pass over partitions sorted by trace. A trace is one
request's spans; one trace at a time is held in the memory of a Python worker, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _digest(*parts: str) -> str:
    return hashlib.sha256("\u0000".join(parts).encode()).hexdigest()[:24]


def label_trace(ids: list[str], parents: list[str | None], identities: list[str]) -> dict[str, str]:
    """Stable label per span id of one trace."""
    own = dict(zip(ids, identities, strict=True))
    children: dict[str | None, list[str]] = {}
    for s, p in zip(ids, parents, strict=True):
        children.setdefault(p if p in own and p != s else None, []).append(s)
    form: dict[str, str] = {}
    for root in ids:
        stack, path = [(root, False)], set()
        while stack:
            s, done = stack.pop()
            if done:
                path.discard(s)
                form[s] = _digest(own[s], *sorted(form.get(c, _digest(own[c])) for c in children.get(s, ())))
            elif s not in form and s not in path:
                path.add(s)
                stack.append((s, True))
                stack.extend((c, False) for c in children.get(s, ()))
    labels: dict[str, str] = {}
    start = sorted(children.get(None, []), key=lambda s: (own[s], form[s]))
    todo = [("", start)]

    def walk() -> None:
        while todo:
            path, group = todo.pop()
            seen: dict[str, int] = {}
            for s in sorted(group, key=lambda x: (own[x], form[x])):
                if s in labels:
                    continue
                n = seen[own[s]] = seen.get(own[s], 0) + 1
                labels[s] = _digest(path, own[s], str(n))
                todo.append((labels[s], children.get(s, [])))

    walk()
    for s in sorted((s for s in own if s not in labels), key=lambda s: (own[s], form[s])):  # spans on cycles
        if s not in labels:
            todo.append(("", [s]))
            walk()
    return labels


def span_labels(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, label) of spans with trace_id, span_id, parent_span_id, identity; rows are distinct first."""

    def finish(trace: str, held: list[tuple]) -> list[tuple]:
        unique = {s: (p, i) for s, p, i in reversed(held)}
        made = label_trace(list(unique), [p for p, _ in unique.values()], [i for _, i in unique.values()])
        return [(trace, s, made[s]) for s in unique]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trace, held = None, []
        for b in batches:
            out: list[tuple] = []
            for t, s, p, i in b.itertuples(index=False):
                if t != trace:
                    out += finish(trace, held) if held else []
                    trace, held = t, []
                held.append((s, p, i))
            yield pd.DataFrame(out, columns=["trace_id", "span_id", "label"])
        if held:
            yield pd.DataFrame(finish(trace, held), columns=["trace_id", "span_id", "label"])

    rows = spans.select("trace_id", "span_id", "parent_span_id", "identity").where("trace_id is not null and span_id is not null").distinct()
    grouped = rows.repartition("trace_id").sortWithinPartitions("trace_id", "span_id", "identity")
    return grouped.mapInPandas(label, "trace_id string, span_id string, label string")


def roots(spans: DataFrame) -> DataFrame:
    """Spans whose parent is blank or in no row of the trace."""
    there = spans.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct()
    return spans.join(there, ["trace_id", "parent_span_id"], "left_anti")


def calls(spans: DataFrame) -> DataFrame:
    """(trace_id, src, dst) of parent and child spans."""
    child = spans.where("parent_span_id is not null").select("trace_id", F.col("parent_span_id").alias("src"), F.col("span_id").alias("dst")).distinct()
    return child.join(spans.select("trace_id", F.col("span_id").alias("src")).distinct(), ["trace_id", "src"], "left_semi")
