"""The driver's contract: names, flagship query, and queries against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__ as entry
from evigraph.__main__ import known, main

SAMPLE = ("p3_presence", "p5_spans", "p6_found", "merge_winner", "conflict_detect", "validate_rules", "diff_semantic", "shortest_path", "crud_matrix", "endpoint_reconcile", "unique_match_join", "trace_import")


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and set(known()) <= names and all(f"p{n}_found" in names for n in (2, 3, 5, 6))
    assert main(["list"]) == 0


def test_flagship(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert entry.entry(spark).columns == ["project_id", "snapshot_no", "node_id", "change_kind", "field_name"]


def _norm(v: object) -> str:
    return "[" + ",".join(map(_norm, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(data + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cur = c.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, data)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(_norm(r[k]) for k in cols) for r in df.collect()) == sorted(tuple(map(_norm, r)) for r in cur.fetchall())
