"""Problem 5: shapes, spellings and parents."""

from __future__ import annotations

import json

from evigraph.functions.treeauto import array_text
from evigraph.operators import nested as n


def rel(payload):
    return [r[:5] for r in n.relation_children(payload if isinstance(payload, str) else json.dumps(payload))]


COLS = [{"name": "id", "ordinal": 2, "formattedType": "bigint", "nullable": False}, {"name": "b", "formatted_type": "text"}]


def test_every_shape_of_a_relation_says_the_same():
    want = [("column", "s.t", "id", 2, "column"), ("column", "s.t", "b", 2, "column")]
    base = {"schema": "s", "name": "t", "kind": "TABLE"}
    for columns in (COLS, json.dumps(COLS), {"id": {k: v for k, v in COLS[0].items() if k != "name"}, "b": {"formatted_type": "text"}}):
        for wrap in (lambda x: x, lambda x: {"data": x}, lambda x: {"relation": x}, lambda x: {"data": {"relation": x}}):
            assert rel(wrap(base | {"columns": columns})) == want
    assert rel(base | {"columns": COLS[0]}) == [("column", "s.t", "id", 2, "column")]


def test_constraints_and_their_columns():
    cons = [{"name": "pk", "type": "PRIMARY_KEY", "columns": ["a", "b"]}, {"name": "fk", "type": "FOREIGN_KEY", "columns": '{x,"y,z"}', "referencedTable": "r", "referenced_columns": ["q"]}, {"name": "ck", "type": "CHECK", "columns": [], "definition": "CHECK (true)"}]
    got = rel({"schema": "s", "name": "t", "columns": None, "constraints": cons})
    assert got == [
        ("constraint", "s.t", "pk", 1, "key"), ("constraint_column", "s.t.pk", "a", 1, "key"), ("constraint_column", "s.t.pk", "b", 2, "key"),
        ("constraint", "s.t", "fk", 2, "foreign_key"), ("constraint_column", "s.t.fk", "x", 1, "foreign_key"), ("constraint_column", "s.t.fk", "y,z", 2, "foreign_key"), ("constraint", "s.t", "ck", 3, "check"),
    ]
    assert rel({"schema": "s", "name": "t", "columns": [], "constraints": json.dumps(cons[:1])})[0][:3] == ("constraint", "s.t", "pk")


def test_payloads_that_give_no_rows():
    for bad in ('{"schema": "s", "na', "", "null", "[]", "3", '"x"', '{"schema":"s"}', '{"schema":null,"name":"t","columns":[]}'):
        assert rel(bad) == []


def test_parameters():
    one = lambda t: [r[1:4] for r in n.parameter_children("k", t)]
    assert one('["id","q"]') == [("k", "id", 1), ("k", "q", 2)]
    assert one('"[{\\"name\\": \\"id\\", \\"required\\": true}]"') == [("k", "id", 1)]
    assert one('{"b": {"ordinal": 2, "location": "PATH"}, "a": {"ordinal": "1", "location": "PATH"}}') == [("k", "b", 2), ("k", "a", 1)]
    assert one('{"name": "solo", "location": "QUERY"}') == [("k", "solo", 1)]
    assert one("[]") == one("{}") == one("null") == one("oops") == one('"[]"') == []


def test_array_text():
    assert array_text('{a,"b,c",NULL,"q\\"x"}') == ["a", "b,c", None, 'q"x'] and array_text("{}") == []


TRACES = "trace_id string, spans array<struct<span_id:string,parent_span_id:string,name:string,events:array<struct<name:string>>>>, child_key string"


def test_spans_and_events(spark):
    rows = [("t", [("a", None, "x", None), ("b", "a", "x", [("e",), ("f",)])], "z"), ("t", [("c", "b", "x", []), ("b", "a", "x", [("e",), ("f",)]), ("d", "lost", "x", None), ("e", "", "x", None)], "z"), ("u", None, "z"), (None, [("a", None, "x", None)], "z"), ("u", [("q", "a", "x", None)], "z")]
    df = spark.createDataFrame(rows, TRACES)
    assert sorted(tuple(r)[1:] for r in n.span_rows(df).collect()) == [("a", "b", 0), ("b", "c", 0), ("t", "a", 0), ("t", "d", 0), ("t", "e", 0), ("u", "q", 0)]
    assert sorted({tuple(r)[1:] for r in n.event_rows(df).collect()}) == [("t:b", "e", 1), ("t:b", "f", 2)]
    assert n.span_rows(df.limit(0)).collect() == [] and n.event_rows(df.limit(0)).collect() == []


def test_subtype_tables(spark):
    p = json.dumps({"schema": "s", "name": "t", "columns": COLS, "constraints": [{"name": "fk", "type": "FOREIGN_KEY", "columns": ["a"], "referenced_table": "r", "referencedSchema": "x"}]})
    rows = n.relation_rows(spark.createDataFrame([(p,), (None,)], "payload string"))
    assert [tuple(r) for r in n.subtype_table(rows, "column").orderBy("pos", "child_key").collect()][1] == ("column", "s.t", "id", 2, "bigint", "false", None)
    assert [tuple(r)[4:6] for r in n.subtype_table(rows, "foreign_key").collect()] == [("x", "r")]
