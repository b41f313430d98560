"""Problem 3 against a plain comparison of dictionaries."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from evigraph.functions.canon import canonical
from evigraph.operators.snapshots import node_changes

SCHEMA = (
    "project_id string, snapshot_no int, target_commit string, analyzed_at timestamp, delivered_at timestamp, node_id string, type string, display_name string, description string, "
    "attrs map<string,string>, metadata struct<adapter:string,confidence:string,review_state:string,source_path:string,stale:boolean,start_line:int,warnings:array<string>>, next_no int, field_name string"
)
T = datetime(2024, 1, 1)


def row(project, no, node, type_="SCREEN", name="n", text="d", attrs=None, conf="OBSERVED", stale=False, warnings=None, at=T):
    return (project, no, "c", T, at, node, type_, name, text, attrs, ("a", conf, "UNREVIEWED", "p", stale, 1, warnings), 9, "clash")


def changes(spark, rows):
    return sorted(tuple(r) for r in node_changes(spark.createDataFrame(rows, SCHEMA)).collect())


def test_kinds_and_fields(spark):
    rows = [
        row("p", 1, "a"), row("p", 3, "a", name=" n\n"), row("p", 1, "gone"), row("p", 3, "new"), row("p", 3, "new"),
        row("p", 1, "b", attrs={"k": '{"x":1.0,"y":[1,2]}', "observedAt": '"1"'}), row("p", 3, "b", attrs={"k": '{"y": [1, 2.0], "x": 1, "captured_at": 5}', "Observed-At": '"2"'}),
        row("p", 1, "c", attrs={"k": "[1,2]"}), row("p", 3, "c", attrs={"k": "[2,1]"}, conf=None),
        row("p", 1, "s", "SPAN", attrs={"traceId": '"1"'}), row("p", 3, "s", "SPAN", attrs={"traceId": '"2"'}),
        row("p", 1, "t", attrs={"traceId": '"1"'}), row("p", 3, "t", attrs={"traceId": '"2"'}),
        row("p", 1, "e", name=None, text=" ", attrs=None, warnings=None, stale=None), row("p", 3, "e", name=" ", text=None, attrs={}, warnings=[], stale=False),
        row("q", 7, "alone"), (None, *row("x", 1, "a")[1:]),
    ]
    assert changes(spark, rows) == [
        ("p", 3, "c", "changed", "attributes"), ("p", 3, "c", "changed", "metadata"), ("p", 3, "gone", "removed", ""), ("p", 3, "new", "added", ""), ("p", 3, "t", "changed", "attributes"),
    ]
    assert changes(spark, []) == []


def test_latest_of_differing_deliveries(spark):
    rows = [row("p", 1, "a", name="x"), row("p", 2, "a", name="y"), row("p", 2, "a", name="x", at=T + timedelta(days=1))]
    assert changes(spark, rows) == []


def test_against_brute_force(spark):
    r = random.Random(5)
    rows, state = [], {}
    for project in "pq":
        for no in (1, 2, 5, 6):
            for node in "abcdefgh":
                if r.random() < 0.8:
                    key = (project, no, node)
                    state[key] = (r.choice("XY"), r.choice("nm"), json.dumps({"v": r.randint(0, 1)}))
                    rows += [row(project, no, node, state[key][0], state[key][1], attrs={"k": state[key][2]})] * r.choice([1, 1, 3])
    want = []
    for project in "pq":
        for old, new in ((1, 2), (2, 5), (5, 6)):
            for node in "abcdefgh":
                a, b = state.get((project, old, node)), state.get((project, new, node))
                if a and not b:
                    want.append((project, new, node, "removed", ""))
                elif b and not a:
                    want.append((project, new, node, "added", ""))
                elif a and b:
                    want += [(project, new, node, "changed", f) for f, x, y in zip(("type", "display_name", "attributes"), a, b, strict=True) if x != y]
    assert changes(spark, rows) == sorted(want)


def test_canonical_json():
    assert canonical('{"b":1.50,"a":[3e0,"1.0"]}') == canonical('{ "a" : [3, "1.0"], "b": 1.5 }')
    assert canonical("[1,2]") != canonical("[2,1]") and canonical('"1"') != canonical("1") and canonical("-0.0") == canonical("0")
    assert canonical("not json") != canonical('"not json"')
    assert canonical('{"a":{"generated_at":1,"x":2}}') == canonical('{"a":{"x":2}}')
    assert canonical("12345678901234567890") != canonical("12345678901234567891")
