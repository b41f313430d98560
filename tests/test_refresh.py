"""Merges of edges, stale marks and roots, the refresh cycle and reports, against small expectations."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evigraph.operators import merge, orphans, refresh, reports, resolve
from evigraph.session import fits, hot_join, hot_keys, lookup_join, salted_join
from evigraph.sources import endpoints, graphjson

T0, T1 = datetime(2024, 1, 1), datetime(2024, 6, 1)
EDGE = "id string, type string, src string, dst string, description string, attrs map<string,string>, adapter string, fact_rank int, analyzed_at timestamp, extra string"


def test_edges_take_type_and_ends_from_one_winner(spark):
    rows = [("e", "CALLS", "a", "b", "", {"k": "1"}, "x", 600, T0, ""), ("e", "READS", "c", "d", "told", None, "y", 400, T1, ""), ("e", "CALLS", None, "b", None, {}, None, 600, None, ""), ("f", None, None, None, None, None, None, 0, None, "")]
    for order in (rows, rows[::-1]):
        got = {r["id"]: tuple(r) for r in merge.merge_edges(spark.createDataFrame(order, EDGE), ["id"]).collect()}
        assert got == {"e": ("e", "CALLS", "a", "b", "told", 3), "f": ("f", None, None, None, "", 1)}
    assert merge.merge_edges(spark.createDataFrame([], EDGE), ["id"]).collect() == []


def test_latest_stale_mark_wins_with_ties(spark):
    schema = "id string, stale boolean, detected_at timestamp, reason string, source_fingerprint string, current_fingerprint string, cause string"
    rows = [("a", True, T0, "z", "", "", ""), ("a", True, T1, "m", "1", None, "X"), ("a", True, T1, "m", "2", "", "B"), ("a", False, T1, "zz", "9", "9", "9"), ("b", False, None, "r", "", "", ""), ("c", True, None, None, None, None, None), ("d", None, T0, "r", "", "", "")]
    got = {r["id"]: (r["stale"], r["detected_at"], r["reason"], r["source_fingerprint"], r["cause"]) for r in merge.merge_stale(spark.createDataFrame(rows, schema), ["id"]).collect()}
    assert got == {"a": (True, T1, "m", "2", "B"), "b": (False, None, None, None, None), "c": (True, None, "", "", ""), "d": (False, None, None, None, None)}


def test_roots_of_one_project_merge(spark):
    schema = "project_id string, schema_version string, target_commit string, analyzed_at timestamp"
    one = spark.createDataFrame([("p", "1.0", "b", T0), ("p", "1.1", " ", T1), ("p", None, None, None)], schema)
    assert [tuple(r) for r in merge.merge_root(one).collect()] == [("p", "1.1", "b", T1)]
    with pytest.raises(ValueError, match="several"):
        merge.merge_root(one.unionByName(spark.createDataFrame([("q", "1.0", "b", T0)], schema)))


def test_evidence_ids_ignore_what_changes_with_a_run(spark):
    rows = [("RUNTIME_OBSERVATION", {"traceId": "1", "x": "a", "Observed-At": "t"}), ("RUNTIME_OBSERVATION", {"traceId": "2", "x": "a"}), ("SOURCE_CODE", {"traceId": "1", "x": "a"}), ("SOURCE_CODE", {"traceId": "2", "x": "a"}), ("SOURCE_CODE", None)]
    c = lambda x: F.lit(x)
    got = [r[0] for r in spark.createDataFrame(rows, "t string, d map<string,string>").select(merge.evidence_id(F.col("t"), c("s"), c(None), c("d"), c("p"), c("sym"), F.col("d"))).collect()]
    assert got[0] == got[1] and len(set(got)) == 4 and all(g.startswith("evidence:") and len(g) == 33 for g in got)


def test_predicates(spark):
    conflicts = spark.createDataFrame([([("open",)],), ([("RESOLVED",)],), ([],), (None,)], "c array<struct<status:string>>")
    assert [r[0] for r in conflicts.select(merge.has_open_conflict(F.col("c"))).collect()] == [True, False, False, False]
    d = spark.createDataFrame([("CUSTOM_HTML_SECTION", None), ("SPAN", []), ("DB_TABLE", ["HUMAN_INPUT"]), ("DB_TABLE", ["RUNTIME_OBSERVATION"])], "t string, e array<string>")
    assert [(r[0], r[1]) for r in d.select(merge.is_durable(F.col("t"), F.col("e")), merge.is_runtime(F.col("t"), F.col("e"))).collect()] == [(True, False), (False, True), (True, False), (False, True)]


def test_list_columns_unite(spark):
    rows = [("a", ["w2", "w1"], ["t"], None), ("a", ["w1"], None, []), ("b", None, None, None)]
    got = {r["id"]: (r["warnings"], r["traces"], r["scenarios"]) for r in merge.evidence_union(spark.createDataFrame(rows, "id string, warnings array<string>, traces array<string>, scenarios array<string>"), ["id"], ("warnings", "traces", "scenarios")).collect()}
    assert got == {"a": (["w1", "w2"], ["t"], []), "b": ([], [], [])}


def test_refresh_cycle(spark):
    node = "id string, type string, display_name string, description string, attributes long, fingerprint string, stale boolean"
    edge = "id string, type string, src string, dst string"
    before = [("t", "DB_TABLE", "t", "", 1, "f1", False), ("m", "JAVA_METHOD", "m", "", 1, None, False), ("custom:d", "CUSTOM_HTML_SECTION", "d", "", 1, None, False), ("x", "SCREEN", "x", "", 1, None, False), ("gone", "SCREEN", "g", "", 1, None, False)]
    after = [("t", "DB_TABLE", "t", "", 2, "f2", False), *before[1:4]]
    edges = [("1", "READS", "m", "t"), ("2", "DOCUMENTED_BY", "m", "custom:d"), ("3", "NAVIGATES_TO", "gone", "x")]
    frames = [(spark.createDataFrame(n, node), spark.createDataFrame(e, edge)) for n, e in ((before, edges), (after, [*edges[:2], ("4", "READS", "x", "lost")]))]
    out = {k: [tuple(r) for r in v.collect()] for k, v in refresh.cycle(*frames).items()}
    assert set(out["stale"]) == {("t", "SOURCE_CHANGED"), ("custom:d", "IMPACTED_IMPLEMENTATION")}
    assert {r[:2] for r in out["node_diff"]} == {("t", "MODIFIED"), ("gone", "REMOVED"), ("custom:d", "MODIFIED")}
    assert {r[:2] for r in out["edge_diff"]} == {("3", "REMOVED"), ("4", "ADDED")}
    assert [r[1] for r in out["findings"]] == ["DANGLING_EDGE_TARGET"]
    assert {r[0] for r in out["impacted"]} == {"t", "m", "custom:d", "gone", "x", "lost"}


def test_error_responses_of_own_and_general_handlers(spark):
    e = spark.createDataFrame([("e1", "A"), ("e2", "B"), ("e3", None)], "endpoint_id string, controller string")
    h = spark.createDataFrame([("g", None, "INTERNAL_SERVER_ERROR", "Problem"), ("a", "A", "404", "Missing"), ("a2", "A", "500", "Other")], "handler_id string, controller string, status string, type string")
    got = {(r["endpoint_id"], r["status"]): (r["types"], r["handlers"]) for r in endpoints.error_responses(e, h).collect()}
    assert got == {("e1", "500"): (["Other", "Problem"], ["a2", "g"]), ("e1", "404"): (["Missing"], ["a"]), ("e2", "500"): (["Problem"], ["g"]), ("e3", "500"): (["Problem"], ["g"])}
    assert {r["endpoint_id"] for r in endpoints.error_responses(e, h.where("controller is not null")).collect()} == {"e1"}


def test_reports(spark):
    nodes = spark.createDataFrame([("table:s.t", "DB_TABLE", "T", True, False), ("column:s.t.c", "DB_COLUMN", " ", False, True), ("s1", "SCREEN", "A", None, None), ("s2", "SCREEN", "B", False, False)], "id string, type string, display_name string, stale boolean, conflicted boolean")
    reached = spark.createDataFrame([("f1", "table:s.t"), ("f2", "column:s.t.c"), ("f2", "x")], "source string, node string")
    assert {tuple(r) for r in reports.flows_using(reached, nodes).collect()} == {("table:s.t", "f1"), ("column:s.t.c", "f1"), ("column:s.t.c", "f2")}
    assert {tuple(r) for r in reports.state_report(nodes).collect()} == {("table:s.t", "STALE"), ("column:s.t.c", "CONFLICTED")}
    assert {r["title"] for r in reports.collection_index(nodes).collect()} == {"T", "column:s.t.c", "A", "B"}
    edges = spark.createDataFrame([("NAVIGATES_TO", "s1", "s2", "OBSERVED"), ("NAVIGATES_TO", "s1", "s2", "DECLARED"), ("NAVIGATES_TO", "s1", "table:s.t", "OBSERVED")], "type string, src string, dst string, confidence string")
    assert reports.observed_screen_edges(edges, nodes).count() == 1
    pages = spark.createDataFrame([("p", ["s1", "no<", "s1"]), ("q", None)], "page string, references array<string>")
    got = {r["reference"]: (r["found"], r["html"]) for r in reports.replace_references(pages, nodes).collect()}
    assert got["s1"][0] and got["s1"][1].startswith('<a href="') and got["no<"] == (False, '<span class="broken-ref">no&lt;</span>')
    d = spark.createDataFrame([("ADDED", f"n{i}", "p") for i in range(6)] + [("REMOVED", "x", "q"), ("REMOVED", "x", "p")], "change string, id string, project_id string")
    assert sorted(tuple(r) for r in reports.top_per_kind(d, keys=["project_id"]).collect()) == [*[("ADDED", f"n{i}", 2) for i in range(4)], ("REMOVED", "x", 0), ("REMOVED", "x", 0)]


def test_statements_in_blocks_match_as_in_one(spark):
    spans = spark.createDataFrame([(i, f"select c{i % 7} from t{i % 5}") for i in range(30)], "span_id int, sql string")
    statements = spark.createDataFrame([(i, f"c{i} from t{i % 5}") for i in range(12)] + [(99, None), (98, " ")], "statement_id int, sql string")
    got = [sorted(tuple(r) for r in resolve.contained_sql(spans, statements, most).collect()) for most in (5_000, 3)]
    assert got[0] == got[1] == sorted((i, j) for i in range(30) for j in range(12) if f"c{j} from t{j % 5}" in f"select c{i % 7} from t{i % 5}")


def test_joins_agree_with_a_plain_one_whatever_is_hot(spark):
    r = random.Random(5)
    left = spark.createDataFrame([(r.choice(["h", None, *"abcdefgh"]) if i % 3 else "h", i) for i in range(400)], "k string, n int")
    right = spark.createDataFrame([(k, k * 2) for k in "habcxyz"], "k string, v string")
    want = sorted(map(str, left.join(right, "k", "left").collect()))
    hot = hot_keys(left, "k")
    assert "h" in hot and hot_keys(left.limit(0), "k") == []
    assert sorted(map(str, hot_join(left, right, "k", "left", hot).collect())) == sorted(map(str, hot_join(left, right, "k", "left", []).collect())) == want
    assert sorted(map(str, salted_join(left, right, ["k"]).collect())) == sorted(map(str, lookup_join(left, right, ["k"]).collect())) == want
    assert fits(right) and not fits(right, 6) and not fits(right, 100, 20)


def test_filter_is_the_same_in_parts(spark, monkeypatch):
    keys = spark.range(3000).selectExpr("concat('k', id) as __key")
    refs = keys.unionByName(spark.range(3000).selectExpr("concat('no', id) as __key"))
    whole = {r["__key"] for r in orphans.held_by_bloom(refs, keys, "__key").where("__held").collect()}
    monkeypatch.setattr(orphans, "MOST_FILTER_ROWS", 0)
    assert whole == {r["__key"] for r in orphans.held_by_bloom(refs, keys, "__key").where("__held").collect()} and len(whole) < 3600


def test_difference_files_content_hash_and_managed_folders(spark, tmp_path):
    d = spark.createDataFrame([("node", "ADDED", "a", []), ("edge", "MODIFIED", "e", ["type"])], graphjson.DIFF)
    graphjson.write_diff(d, str(tmp_path / "d"))
    assert sorted(map(str, graphjson.read_diff(spark, str(tmp_path / "d")).collect())) == sorted(map(str, d.collect()))
    assert graphjson.read_diff(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "d" / "part-x.json").write_text("{broken")
    assert graphjson.read_diff(spark, str(tmp_path / "d")).count() == 2
    h = lambda *ids: graphjson.content_hash(spark.createDataFrame([(i,) for i in ids], "id string"), "k")
    assert h("a", "a", "b") != h("c", "c", "b") and h("a", "b") == h("b", "a")
    graphjson.require_managed(spark, str(tmp_path / "new"))
    graphjson.require_managed(spark, str(tmp_path / "new"))
    with pytest.raises(ValueError, match="holds files"):
        graphjson.require_managed(spark, str(tmp_path / "d"))
