"""Source scanning and adapter mappings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evigraph.functions.ids import match_key, normalize_path
from evigraph.operators import fragments, spanforest
from evigraph.sources import codefiles, otlp

CONTROLLER = '''
package app.web;
/** Projects of a team. More text. */
@RestController
@RequestMapping(ProjectController.BASE + "/projects")
public class ProjectController {
    static final String BASE = "/api";
    // @GetMapping("/commented")
    /** Finds one. */
    @GetMapping("/{id:\\\\d+}")
    public ResponseEntity<Project> find(@PathVariable Long id, @RequestParam(required = false) String q) { return ResponseEntity.ok(service.find(id)); }
    @PostMapping
    @ResponseStatus(HttpStatus.CREATED)
    Project create(@RequestBody final ProjectForm form) { if (x) { y(); } return null; }
    @RequestMapping(value = {"/a", "/b"}, method = {RequestMethod.PUT, RequestMethod.PATCH})
    void both() {}
    private void helper(List<Map<String, Integer>> xs, int n) {}
}
'''
DAO = '''
package app.dao;
@Dao
public interface ProjectDao { @Select List<Project> find(Long id); @Insert int add(Project p); @Select Project lost(); }
'''


def test_java(spark):
    f = codefiles.java_facts(spark.createDataFrame([("C.java", CONTROLLER), ("D.java", DAO), ("E.java", None), ("F.java", "")], "path string, text string")).cache()
    e = codefiles.endpoints(f).withColumn("path", normalize_path(F.col("path"))).collect()
    got = {(r["http_method"], r["path"]): (r["handler_method"], [s["status"] for s in r["responses"]], r["request_body_type"]) for r in e}
    assert got == {
        ("GET", "/api/projects/{id}"): ("find", ["200"], None), ("POST", "/api/projects"): ("create", ["CREATED"], "ProjectForm"),
        **{(m, f"/api/projects/{x}"): ("both", ["200"], None) for m in ("PUT", "PATCH") for x in "ab"},
    }
    n = {r["id"]: (r["type"], r["description"]) for r in codefiles.symbols(f).collect()}
    assert n["class:app.web.ProjectController"] == ("CONTROLLER", "Projects of a team.") and n["method:app.web.ProjectController#find(Long,String)"] == ("JAVA_METHOD", "Finds one.")
    assert n["method:app.web.ProjectController#helper(List<Map<String,Integer>>,int)"][0] == "JAVA_METHOD" and n["method:app.dao.ProjectDao#add(Project)"][0] == "DOMA_DAO_METHOD"
    edges, lost = codefiles.dao_sql_edges(f, spark.createDataFrame([("META-INF/app/dao/ProjectDao/find.sql",)], "source_id string"))
    assert [r["dst"] for r in edges.collect()] == ["sql:META-INF/app/dao/ProjectDao/find.sql"] and [r["src"] for r in lost.collect()] == ["method:app.dao.ProjectDao#lost()"]


def test_frontend_and_scenarios(spark, tmp_path):
    ts = "const r = [{ path: '/projects/:id' }]; fetch(`/api/projects`); <button onClick={go}>Save</button>"
    got = {(r["kind"], r["value"]) for r in codefiles.frontend_facts(spark.createDataFrame([("a.tsx", ts)], "path string, text string")).collect()}
    assert got == {("ROUTE", "/projects/:id"), ("CALL", "/api/projects"), ("CONTROL", "Save")}
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"defaults": {"role": "USER"}, "scenarios": [{"id": "a"}, {"id": "b", "role": "ADMIN"}]}))
    assert [s["role"] for s in codefiles.scenarios(str(p))] == ["USER", "ADMIN"]
    p.write_text(json.dumps({"scenarios": [{"id": "a"}, {"id": "a"}]}))
    with pytest.raises(ValueError):
        codefiles.scenarios(str(p))


def test_fragments(spark):
    doc = '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"a","spanId":"1","name":"GET","kind":"SERVER","attributes":[{"key":"http.route","value":{"stringValue":"/x"}},{"key":"secret.thing","value":{"stringValue":"y"}}]},{"traceId":"a","spanId":"2","parentSpanId":"1","name":"sql","attributes":[{"key":"db.statement","value":{"stringValue":"select 1"}}]}]}]}]}'
    s = otlp.spans(spark.createDataFrame([("f", doc)], "file string, text string"))
    n, e = fragments.runtime_fragment(s, spanforest.span_labels(s.withColumn("identity", F.col("name"))))
    assert sorted(r["type"] for r in n.collect()) == ["SPAN", "SPAN", "TRACE"] and sorted(r["type"] for r in e.collect()) == ["CALLS", "CONTAINS", "CONTAINS"]
    assert all("secret.thing" not in r["attrs"] for r in n.collect())
    rec = spark.createDataFrame([("GET", "/a/{x}", "C", "find", "Dto", "op1")], "http_method string, path string, controller_class string, handler_method string, request_body_type string, operation_id string").withColumn("match_key", match_key(F.col("path")))
    n, e = fragments.endpoint_fragment(rec)
    assert {r["id"] for r in n.collect()} == {"endpoint:GET:/a/{}", "request-schema:Dto", "operation:op1"} and e.count() == 2
    made, warned = fragments.route_edges(rec, spark.createDataFrame([("m1", "C", "find"), ("m2", "D", "find")], "id string, owner string, member string"))
    assert [r["dst"] for r in made.collect()] == ["m1"] and fragments.ambiguity_nodes(warned, "src").count() == 0
    spans = spark.createDataFrame([("1", "t", "SELECT * FROM a WHERE id = ?", True), ("2", "u", "select 2", False)], "span_id string, trace_id string, sql string, direct boolean")
    st = spark.createDataFrame([("s1", "select * from a where id=?"), ("s2", "delete from b")], "statement_id string, sql string")
    crud = spark.createDataFrame([("READS", "s1", "table:a")], "type string, src string, dst string")
    assert [tuple(r) for r in fragments.observed_crud(spans, st, crud).collect()] == [("READS", "s1", "table:a", 1, ["t"], True)]
