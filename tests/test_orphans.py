"""Problem 6 against brute force, with and without the filter."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from evigraph.operators import orphans as o

T = datetime(2024, 1, 10)
TASKS = "id long, project_id long, assignee_id long, loaded_at timestamp, deleted_at timestamp, row_key string"
TARGETS = "id long, deleted_at timestamp, loaded_at timestamp, __key string"
NODES = "project_id string, snapshot_no int, node_id string, row_key string"
EDGES = "project_id string, snapshot_no int, edge_id string, src string, dst string, analyzed_at timestamp"


@pytest.mark.parametrize("filtered", [True, False])
def test_tasks(spark, monkeypatch, filtered):
    if not filtered:
        monkeypatch.setattr(o, "MOST_FILTER_ROWS", 0)
    r = random.Random(3)
    users = [(i, r.choice([None, T - timedelta(days=1), T, T + timedelta(days=1)]), r.choice([T - timedelta(days=2), T + timedelta(days=2)]), "x") for i in range(0, 60, 2)]
    tasks = [(i, None, r.choice([None, 4, 4, 4, *range(70)]), T, T, "x") for i in range(300)]
    known = {u[0]: u for u in users}
    want = set()
    for t in tasks:
        if t[2] is not None:
            u = known.get(t[2])
            kind = "missing" if u is None else "deleted" if u[1] and u[1] <= T else "late" if u[2] > T else None
            if kind:
                want.add(("tasks", "assignee_id", str(t[0]), "2024-01", kind))
    df, us = spark.createDataFrame(tasks + tasks[:20], TASKS), spark.createDataFrame(users + users[:5], TARGETS)
    assert sorted(tuple(x) for x in o.task_orphans(df, us, "assignee_id").collect()) == sorted(want)
    assert o.task_orphans(df.limit(0), us, "assignee_id").collect() == []
    assert {x["orphan_kind"] for x in o.task_orphans(df, us.limit(0), "assignee_id").collect()} == {"missing"}


def test_edges(spark):
    nodes = [("p", 1, "a", ""), ("p", 2, "b", ""), ("p", 3, "c", ""), ("q", 2, "z", ""), ("p", None, "n", "")]
    edges = [("p", 2, "e", " b\t", "a", T), ("p", 2, "f", "c", "z", T), ("p", 2, "g", None, "", T), ("p", 2, "e", " b\t", "a", T)]
    got = sorted(tuple(x) for x in o.edge_orphans(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES)).collect())
    assert got == [("edges", "dst", "e@2", "2024-01", "deleted"), ("edges", "dst", "f@2", "2024-01", "missing"), ("edges", "dst", "g@2", "2024-01", "missing"), ("edges", "src", "f@2", "2024-01", "late")]


def test_filter_never_loses_a_key(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as __key")
    possible, definite = o.split_by_bloom(keys.unionByName(spark.range(5000).selectExpr("concat('no', id) as __key")), keys, "__key")
    assert possible.where("__key like 'k%'").count() == 5000 and definite.where("__key like 'k%'").count() == 0
    assert definite.count() > 4000
