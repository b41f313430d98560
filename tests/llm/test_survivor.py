"""Problem 1 against brute force and its stated edge cases."""

from __future__ import annotations

from datetime import datetime

from evigraph.llm import survivor as s

SCHEMA = (
    "declaration_id long, project_id string, http_method string, path string, controller_class string, handler_method string, request_body_type string, "
    "operation_id string, summary string, description string, source string, collected_at timestamp, evidence array<struct<confidence:string>>, path_key string"
)
T0, T1 = datetime(2024, 1, 1), datetime(2024, 6, 1)


def row(i, path="/a/{id}", method="GET", controller=None, source="OPENAPI", at=T0, conf=("DECLARED",), **other):
    fields = {"handler_method": None, "request_body_type": None, "operation_id": None, "summary": None, "description": None} | other
    return (i, "p", method, path, controller, *[fields[k] for k in ("handler_method", "request_body_type", "operation_id", "summary", "description")], source, at, None if conf is None else [(c,) for c in conf], "clash")


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["group_id"], r["field_name"]): (r["record_id"], r["value"]) for r in s.surviving_fields(df).collect()}


def test_precedence_of_confidence_source_time_and_id(spark):
    assert found(spark, [row(1, controller="A", conf=["INFERRED"], at=T1), row(2, controller="B", conf=["stale", "observed"])])[1, "controller_class"] == (2, "B")
    assert found(spark, [row(1, controller="A", source="openapi"), row(2, controller="B", source="Java_Source")])[1, "controller_class"] == (2, "B")
    assert found(spark, [row(1, controller="A"), row(2, controller="B", at=T1)])[1, "controller_class"] == (2, "B")
    assert found(spark, [row(2, controller="A"), row(1, controller="B")])[1, "controller_class"] == (1, "B")
    assert found(spark, [row(1, controller="A", conf=None), row(2, controller="B", conf=["STALE"])])[1, "controller_class"] == (1, "A")


def test_stand_ins_and_nulls_never_win(spark):
    rows = [row(1, controller=v, conf=["OBSERVED"]) for v in (None,)] + [row(i, controller=v, conf=["OBSERVED"]) for i, v in enumerate(("", " ", "...", "N/A", "tbd", "null", "TODO", "-", "unknown"), 2)]
    assert found(spark, rows) == {}
    assert found(spark, [*rows, row(20, controller="X", conf=["CONFLICTED"])])[1, "controller_class"] == (20, "X")


def test_spellings_of_a_path_are_one_endpoint(spark):
    paths = ["/a/{id}/b", "a/{key:[0-9]{2}}/b/", " http://h:80//a/{x}/b?q=1#f ", "HTTPS://h/a/{y:\\d{4}}/b"]
    got = found(spark, [row(i, p, m, controller=f"C{i}") for i, (p, m) in enumerate(zip(paths, ("GET", "get", "Get", " GET "), strict=True), 5)])
    assert got == {(5, "controller_class"): (5, "C5")}
    assert found(spark, [row(1, "/a/{x}", controller="A"), row(2, "/A/{x}", controller="B")]) == {}


def test_copies_and_single_declarations_make_no_group(spark):
    assert found(spark, [row(1, controller="A"), row(1, controller="A")]) == {}
    assert found(spark, []) == {}
    assert found(spark, [row(1, None, controller="A"), row(2, None, controller="B")]) == {}


def test_summed_votes_let_agreement_outvote(spark):
    rows = [row(1, controller="Lone", source="JAVA_SOURCE")] + [row(i, controller="Common", source="ACTUATOR") for i in range(2, 12)]
    df = spark.createDataFrame(rows, SCHEMA)
    by_mode = {m: s.surviving_fields(df, m).first()["value"] for m in ("dominant", "summed")}
    assert by_mode == {"dominant": "Lone", "summed": "Common"}


def test_pivot_back(spark):
    out = s.canonical_endpoints(spark.createDataFrame([row(1, controller="A", summary="S"), row(2, operation_id="op")], SCHEMA)).collect()
    assert [(r["group_id"], r["path"], r["controller_class"], r["summary"], r["operation_id"], r["description"]) for r in out] == [(1, "/a/{}", "A", "S", "op", None)]
