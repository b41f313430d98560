"""Expectations of the reference behaviour, as small hand-made graphs."""

from __future__ import annotations

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evigraph import schema as sc
from evigraph.functions import codes, ids, mask, sqltext
from evigraph.operators import diff, merge, refresh, reports, resolve, spanforest, traverse, validate
from evigraph.sources import catalog, endpoints, graphjson, observations, otlp, sqlfiles

FRAG = "id string, type string, display_name string, description string, attrs map<string,string>, adapter string, fact_rank int, intent_rank int, analyzed_at timestamp, review_state string, target_commit string, stale boolean, warnings array<string>, extra string"
T = datetime(2024, 1, 1)


def frag(id_, attrs, rank, text="", intent=0, review="UNREVIEWED", type_="HTTP_ENDPOINT", adapter="a", commit="", stale=False):
    return (id_, type_, "n", text, attrs, adapter, rank, intent, T, review, commit, stale, [], "x")


def test_observation_beats_mapping_and_conflicts(spark):
    rows = [frag("e", {"status": "200", "method": '"POST"'}, 600), frag("e", {"status": "201"}, 700)]
    for order in (rows, rows[::-1]):
        f = spark.createDataFrame(order, FRAG)
        assert {r["attr"]: r["value"] for r in merge.merge_attributes(f, ["id"]).collect()} == {"status": "201", "method": '"POST"'}
        assert [(r["field"], r["conflict_type"]) for r in merge.conflicts(f, ["id"]).collect()] == [("attributes.status", "ATTRIBUTE_MISMATCH")]
    same = spark.createDataFrame([rows[0], rows[0]], FRAG)
    assert merge.conflicts(same, ["id"]).collect() == []
    assert merge.attributes_map(merge.merge_attributes(f, ["id"]), ["id"]).first()["attrs"] == {"status": "201", "method": '"POST"'}


def test_attribute_winner_is_among_those_that_have_it(spark):
    f = spark.createDataFrame([frag("e", {"only": '"A"'}, 700), frag("e", {"shared": '"B"'}, 400), frag("e", {"shared": '"C"'}, 400)], FRAG)
    assert {r["attr"]: r["value"] for r in merge.merge_attributes(f, ["id"]).collect()} == {"only": '"A"', "shared": '"C"'}


def test_intent_supplies_the_description_and_reviews_merge(spark):
    f = spark.createDataFrame([frag("e", {}, 400, "from code", adapter="x, y", commit="b"), frag("e", {}, 300, "from a person", 700, "APPROVED", adapter="y", commit="c"), frag("e", {}, 100, "", 0, "REJECTED", stale=True)], FRAG)
    assert merge.merge_nodes(f, ["id"]).first()["description"] == "from a person"
    m = merge.merge_metadata(f, ["id"]).first()
    assert (m["review_state"], m["adapter"], m["target_commit"], m["stale"]) == ("NEEDS_REVIEW", "a,x,y", "c", True)
    assert [r["field"] for r in merge.conflicts(f, ["id"]).collect()] == ["reviewState"]


def test_confidence_precedence(spark):
    case = lambda c, s, r, h, b: spark.range(1).select(merge.evaluate_confidence(F.lit(c), F.lit(s), F.lit(r), F.lit(h), F.lit(b).cast("string"))).first()[0]
    assert case(True, True, "APPROVED", True, "OBSERVED") == "CONFLICTED" and case(False, True, "APPROVED", True, "OBSERVED") == "STALE"
    assert case(False, False, "APPROVED", True, "OBSERVED") == "HUMAN_REVIEWED" and case(False, False, "APPROVED", False, "OBSERVED") == "OBSERVED" and case(False, False, "APPROVED", False, None) == "UNKNOWN"


GRAPH = "id string, type string, src string, dst string"


def edges(spark, *rows):
    return spark.createDataFrame([(f"{t}:{a}:{b}", t, a, b) for t, a, b in rows], GRAPH)


def nodes(spark, **types):
    return spark.createDataFrame(list(types.items()), "id string, type string")


def test_validation(spark):
    e = edges(spark, ("CALLS", "a", "b"), ("CALLED_BY", "b", "a"), ("READS", "a", "gone")).unionByName(spark.createDataFrame([("other", "CALLS", "a", "b")], GRAPH))
    got = {(r["code"], r["id"]) for r in validate.validate(nodes(spark, a="X", b="X"), e).collect()}
    assert got >= {("DANGLING_EDGE_TARGET", "READS:a:gone"), ("DUPLICATE_RELATION", "other"), ("DUPLICATE_INVERSE_RELATION", "CALLS:a:b")}
    el = spark.createDataFrame([("a", "OBSERVED", "OBSERVED", ["OPENAPI"]), ("b", "DECLARED", "INFERRED", ["SOURCE_CODE"]), ("c", "UNKNOWN", "UNKNOWN", [])], "id string, confidence string, expected string, evidence_types array<string>")
    assert {(r["code"], r["id"]) for r in validate.confidence_rules(el).collect()} == {("OBSERVED_WITHOUT_OBSERVATION", "a"), ("INVALID_CONFIDENCE", "b"), ("DECLARED_WITHOUT_DECLARATION", "b"), ("MISSING_EVIDENCE", "c")}
    assert validate.require_unique(nodes(spark, a="X", b="Y")).count() == 2
    with pytest.raises(Exception, match="duplicate id"):
        validate.require_unique(nodes(spark, a="X").unionByName(nodes(spark, a="Y"))).collect()


def test_traversal_against_brute_force(spark):
    r = random.Random(7)
    pairs = {(r.choice("abcdefghij"), r.choice("abcdefghij")) for _ in range(18)}
    e = edges(spark, *[("CALLS", a, b) for a, b in pairs])
    starts = spark.createDataFrame([(x, x) for x in "abz"], "source string, node string")
    want = {}
    for s in "abz":
        best, frontier = {s: (s,)}, {s: (s,)}
        for _ in range(3):
            step: dict = {}
            for n, p in frontier.items():
                for a, b in pairs:
                    if a == n and b not in best:
                        step[b] = min(step.get(b, (*p, b)), (*p, b))
            best |= step
            frontier = step
        want |= {(s, n): p for n, p in best.items()}
    got = {(x["source"], x["node"]): tuple(x["path"]) for x in traverse.shortest_paths(starts, traverse.steps(e), 3).collect()}
    assert got == want
    assert {(x["source"], x["node"], x["depth"]) for x in traverse.reach(starts, traverse.steps(e), 3).collect()} == {(*k, len(p) - 1) for k, p in want.items()}


def test_impact_reaches_the_flow_and_depth_zero_reports_itself(spark):
    n = nodes(spark, flow="E2E_FLOW", ep="HTTP_ENDPOINT", t="DB_TABLE")
    e = edges(spark, ("CALLS_HTTP", "flow", "ep"), ("CREATES", "ep", "t"))
    got = traverse.impact(spark.createDataFrame([("t",)], "id string"), n, e, 4)
    assert [tuple(r["path"]) for r in got["flows"].collect()] == [("t", "ep", "flow")] and {r["node"] for r in got["transitive"].collect()} == {"ep", "flow"}
    assert [tuple(r["path"]) for r in traverse.impact(spark.createDataFrame([("flow",)], "id string"), n, e, 0)["flows"].collect()] == [("flow",)]


def test_projection_neighbours_and_runtime(spark):
    n = nodes(spark, a="SCREEN", b="SCREEN", c="TRACE", d="SPAN")
    e = edges(spark, ("NAVIGATES_TO", "a", "b"), ("OBSERVED_IN", "a", "c"), ("CONTAINS", "c", "d"), ("READS", "a", "gone"))
    kept, inner = traverse.projection(n, e, sc.UI_TYPES)
    assert kept.count() == 2 and [r["type"] for r in inner.collect()] == ["NAVIGATES_TO"]
    assert {(r["node"], r["neighbour"]) for r in traverse.neighbours(e, n, "INCOMING").collect()} >= {("b", "a"), ("c", "a"), ("d", "c")}
    assert {r["node"] for r in traverse.runtime_subgraph(n.where("id = 'a'"), e, 3).collect()} == {"c", "d"}


def test_diff_and_staleness(spark):
    s = "id string, type string, display_name string, attributes string"
    b = spark.createDataFrame([("a", "X", "n", "1"), ("b", "X", "n", "1"), ("c", "X", None, "1")], s)
    a = spark.createDataFrame([("a", "X", "n", "2"), ("c", "X", None, "1"), ("d", "X", "n", "1"), ("custom:x", "X", "n", "1")], s)
    d = diff.diff_elements(b, a, ["id"], ["type", "display_name", "attributes"])
    assert {(r["id"], r["change"], tuple(r["changed_fields"])) for r in d.collect()} == {("a", "MODIFIED", ("attributes",)), ("b", "REMOVED", ()), ("d", "ADDED", ()), ("custom:x", "ADDED", ())}
    e = edges(spark, ("CALLS", "p", "q"), ("DOCUMENTED_BY", "r", "s"))
    roots = diff.change_roots(d, e.select("id", F.lit("ADDED").alias("change")), e)
    assert {r["id"] for r in roots.collect()} == {"a", "b", "d", "p", "q"}
    el = spark.createDataFrame([("a", None, "1"), ("b", None, "1"), ("c", "z", "1")], "id string, source_id string, fingerprint string")
    now = spark.createDataFrame([("a", "2"), ("z", "1")], "id string, fingerprint string")
    for complete, lost in ((True, (True, "SOURCE_MISSING")), (False, (False, None))):
        got = {r["id"]: (r["stale"], r["cause"]) for r in diff.stale_by_fingerprint(el, now, complete).collect()}
        assert got == {"a": (True, "SOURCE_CHANGED"), "b": lost, "c": (False, None)}
    claims = spark.createDataFrame([("s", "a", "displayName", "n"), ("s", "a", "attributes.k", "2"), ("s", "a", "attributes.none", "2"), ("s", "gone", "type", "X")], "section string, id string, field string, expected string")
    n = spark.createDataFrame([("a", "X", "n", "", {"k": '"1"'})], "id string, type string, display_name string, description string, attrs map<string,string>")
    v = diff.reconcile_claims(claims, n)
    assert sorted((r["field"], r["verdict"]) for r in v.collect()) == [("attributes.k", "MISMATCH"), ("attributes.none", "ABSENT"), ("displayName", "MATCH"), ("type", "MISSING")]
    assert diff.mismatch_conflicts(v).count() == 2


def test_ids_and_paths(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    ep = lambda v: one(lambda c: ids.endpoint_id(F.lit("post"), c), v)
    assert ep("https://localhost:8080//api/projects/{id:[0-9]+}/?debug=true") == "endpoint:POST:/api/projects/{id}"
    assert ep("/x/{id:[0-9]{2}}") == "endpoint:POST:/x/{id}" and ep("/x/{id:[0-9]+") is None
    assert one(ids.screen_id, "projects/new/") == "screen:/projects/new"
    t = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(ids.table_id(F.col("a"), F.col("b"))).first()[0]
    assert t("PUBLIC", "Projects") == "table:public.projects" and t("public", '"MixedCase"') == "table:public.MixedCase"
    assert ids.signature("create(Request request)") == ids.signature("create(final Request)") == "create(Request)" and ids.signature("m(@Valid Map<String, List<A>> value, int[] x)") == "m(Map<String,List<A>>,int[])"
    assert ids.arity("m(Map<A,B>,int[])") == 2 and ids.arity("m()") == 0 and ids.percent_encode("a b/ü") == "a%20b%2F%C3%BC"
    assert one(ids.ui_route, "https://h/projects/7?x") == "/projects/{id}" and one(ids.java_name, "a.B$C") == "a.B.C" and one(ids.java_name, "a..B") is None
    assert [one(ids.is_valid_id, v) for v in ("a:b", "a:", "a b:c", None)] == [True, False, False, False]
    with_udf = spark.createDataFrame([("m(A a)",), (None,)], "v string").select(ids.signature_of("v").alias("s"), ids.arity_of("v").alias("n"), ids.percent_encoded("v").alias("p")).collect()
    assert (with_udf[0]["s"], with_udf[0]["n"], with_udf[1]["s"]) == ("m(A)", 1, None)


def test_codes(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    assert [one(codes.http_status, v) for v in ("CREATED", "HttpStatus.NO_CONTENT_VALUE", "5xx", "Default", "", None, "TEAPOT")] == ["201", "204", "5XX", "default", "UNSPECIFIED", "UNSPECIFIED", "TEAPOT"]
    assert one(codes.is_success, "2XX") is True and one(codes.is_success, "302") is False
    paths = {"a/graphdocs.yml": "CONFIGURATION", "x/db/migration/V1.sql": "MIGRATION", "x.sql": "SQL", "A.java": "JAVA", "openapi.yaml": "OPENAPI", "graphdocs/custom/a.html": "CUSTOM_HTML", "my-scenario.yaml": "PLAYWRIGHT_SCENARIO", "fixture.json": "FIXTURE", "a.tsx": "FRONTEND", "README": "UNKNOWN", "graphdocs/traces/x.json": "RUNTIME_CAPTURE"}
    assert {p: one(codes.change_category, p) for p in paths} == paths
    assert one(codes.compatible_type, "Mono<org.x.ResponseEntity<a.b.Dto>>") == "Dto" and one(codes.first_sentence, "It works。そう") == "It works。"
    assert [one(codes.repository_relative, v) for v in ("a/b.sql", "../a", "/tmp/a", "C:/a")] == [True, False, False, False]
    assert [one(codes.span_kind, v) for v in ("2", "SPAN_KIND_CLIENT", "x", None)] == ["SERVER", "CLIENT", "UNSPECIFIED", "UNSPECIFIED"]
    assert one(codes.nano_instant, "1000").timestamp() == pytest.approx(1e-6) and one(codes.nano_instant, "bad").timestamp() == 0
    assert one(codes.catalog_bool, "t") is True and one(codes.catalog_bool, "?") is None


def test_masking(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    sql = "select \"a'1\" from t1 where x = 'it''s 5' and y = -3.5e2 and z = $1 and w = $tag$ q 7 $tag$"
    assert mask.mask_sql(sql) == "select \"a'1\" from t1 where x = ? and y = -? and z = $1 and w = ?" and mask.mask_sql(r"select E'a\'b' ") == "select ?"
    assert one(mask.mask_sql_columns, "select \"a'1\" from t1 where x = 'it''s 5' and y = 3.5 and z = $1") == "select \"a'1\" from t1 where x = ? and y = ? and z = $1"
    assert one(mask.normalize_sql, "SELECT  a ,b\nFROM t ( x ) ;; ") == "select a,b from t(x)"
    m = spark.range(1).select(mask.mask_key_values(F.create_map(*map(F.lit, ("X-Api-Key", "k", "userPassword", "p", "name", "n"))))).first()[0]
    assert m == {"X-Api-Key": "[MASKED]", "userPassword": "[MASKED]", "name": "n"}
    assert one(mask.redact_paths, 'see /home/u/x.txt and "C:\\tmp\\y"') == 'see [path] and "[path]"'
    assert one(mask.secret_kinds, "Authorization: Bearer abcdefghijklmnop1234 password=hunter22") == ["BEARER", "PASSWORD"]
    assert one(mask.sanitize_html, "<p onclick='x()'>a<script>b</script></p>") == "<p>a</p>" and one(mask.sanitize_html, "<a href='jav&#97;'>x</a> java&Tab;script:go()") is None
    assert one(mask.links_of, "<a href='/a?x'>1</a><img src=\"b.png\"><a href='https://x'>2</a><a href='#y'>3</a>") == ["/a", "b.png"]
    assert [tuple(r)[0::3] for r in one(mask.assertions_of, "<i data-assert='n:1|type=X'></i>")] == [("n:1", "X")]
    assert one(mask.html_escape, "<a&'\">") == "&lt;a&amp;&#39;&quot;&gt;"


def test_sql_analysis(spark):
    s = sqltext.analyse("with active as (select id from projects) select p.id from active a join projects p on p.id = a.id left join users u on p.owner_id = u.id where p.name ilike 'x%' and exists (select 1 from tasks t where t.pid = p.id)")[0]
    assert (s.kind, len(s.joins), s.has_subquery, s.ctes) == ("SELECT", 2, True, {"active"}) and {"projects", "users", "tasks"} == {t["table"] for t in s.tables.values()}
    assert ("p", "owner_id", "JOIN") in s.columns and "'x%'" not in s.normalized_sql
    many = sqltext.analyse("insert into tasks (id, title) values (1, 'a') returning id; update tasks set title = 'b' where id = 5 returning title; delete from tasks where id = 3")
    assert [m.kind for m in many] == ["INSERT", "UPDATE", "DELETE"] and ("", "title", "INSERT_TARGET") in many[0].columns and {("", "title", "UPDATE_TARGET"), ("", "title", "RETURNING"), ("", "id", "WHERE")} <= many[1].columns
    up = sqltext.analyse("insert into x(id) values (1) on conflict (id) do update set id = excluded.id")[0]
    assert up.tables[".x"]["operations"] == {"CREATE", "UPDATE"}
    tr = sqltext.analyse("truncate a, public.b")[0]
    assert {t["table"]: t["operations"] for t in tr.tables.values()} == {"a": {"DELETE"}, "b": {"DELETE"}}
    assert [t["alias"] for t in sqltext.analyse("select a.x, b.y from t a join t b on a.id = b.id")[0].tables.values()] == ["a"]
    assert sqltext.analyse("grant all")[0].warnings == ["UNKNOWN statement kind"] and sqltext.analyse("") == []


def test_sql_templates(spark):
    q = "select 1 from p where /*%if a */ p.a = /* a */'x' /*%elseif b */ p.b = 1 /*%else*/ p.c = 2 /*%end*/"
    assert len(sqltext.variants(q)) == 3 and "p.a = ?" in sqltext.variants(q)[0] and sqltext.variants("select 1 /* active */ from t") == ["select 1 /* active */ from t"]
    many = "select 1 where " + " ".join(f"/*%if x{i} */ a{i} /*%else*/ b{i} /*%end*/" for i in range(8))
    assert len(sqltext.variants(many)) == sqltext.MOST_VARIANTS
    t = sqltext.analyse_template("update p set /*%populate */ where id = /* id */1")[0]
    assert t.dynamic and t.warnings == ["dynamic template"] and ("", "dynamic_column", "UPDATE_TARGET") in t.columns
    e = sqlfiles.crud_edges(sqlfiles.statements(spark.createDataFrame([("s", "update tasks t set title = 'x' where t.id = 1"), ("n", None)], "source_id string, sql string")))
    assert {(r["type"], r["dst"]) for r in e.collect()} == {("UPDATES", "table:public.tasks"), ("UPDATES", "column:public.tasks.title"), ("UPDATES", "column:public.tasks.id")}
    assert sqlfiles.sql_path_of("app.TaskDao", "find") == "META-INF/app/TaskDao/find.sql"


def test_traces(spark, tmp_path):
    import gzip

    camel = '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"s"}}]},"scopeSpans":[{"spans":[{"traceId":"0xAB","spanId":"01","name":"GET","kind":2,"startTimeUnixNano":"1000","endTimeUnixNano":"2000","attributes":[{"key":"http.route","value":{"stringValue":"/a"}},{"key":"apiToken","value":{"stringValue":"s3"}},{"key":"n","value":{"intValue":"7"}}],"status":{"code":2}}]}]}]}'
    snake = '[{"scope_spans":[{"spans":[{"trace_id":"ab","span_id":"02","parent_span_id":"01","name":"q","kind":"SPAN_KIND_CONSUMER","start_time_unix_nano":"1500","end_time_unix_nano":"1400"},{"trace_id":"ab","span_id":"01","name":"again"}]}]}]'
    (tmp_path / "a.json").write_bytes(gzip.compress(camel.encode()))
    (tmp_path / "b.json").write_text(snake)
    (tmp_path / "c.json").write_text("not json")
    flat = otlp.merged_spans(otlp.spans(otlp.documents(spark, str(tmp_path))))
    got = {r["span_id"]: r for r in flat.collect()}
    assert set(got) == {"01", "02"} and got["01"]["boundary"] == "HTTP_SERVER" and got["01"]["status_code"] == "ERROR" and got["02"]["boundary"] == "ASYNC"
    assert got["01"]["attrs"] == {"http.route": "/a", "apiToken": "[MASKED]", "n": "7"} and got["01"]["end_unix_nano"] - got["01"]["start_unix_nano"] == 1000
    assert [r["warning"] for r in otlp.warnings_of(flat).collect()] == ["ends before it starts"]
    assert {r["span_id"] for r in spanforest.roots(flat).collect()} == {"01"} and [(r["src"], r["dst"]) for r in spanforest.calls(flat).collect()] == [("01", "02")]


def test_forest_labels_ignore_ids_and_order(spark):
    tree = [("a", None, "root"), ("b", "a", "x"), ("c", "a", "x"), ("d", "c", "leaf"), ("e", "f", "cyc"), ("f", "e", "cyc2")]
    want = None
    for perm in itertools.islice(itertools.permutations(tree), 0, 700, 97):
        name = {s: f"{i}{s}" for i, (s, _, _) in enumerate(perm)}
        got = spanforest.label_trace([name[s] for s, _, _ in perm], [name[p] if p else None for _, p, _ in perm], [i for _, _, i in perm])
        labels = {s: got[name[s]] for s, _, _ in tree}
        want = want or labels
        assert labels == want and len(set(labels.values())) == 6
    df = spark.createDataFrame([("t", s, p, i) for s, p, i in tree] + [("t", "a", None, "root"), ("u", "a", None, "root")], "trace_id string, span_id string, parent_span_id string, identity string")
    assert {(r["trace_id"], r["span_id"]): r["label"] for r in spanforest.span_labels(df).collect()} == {("t", s): v for s, v in want.items()} | {("u", "a"): want["a"]}


def test_resolvers(spark):
    calls = spark.createDataFrame([("c1", "get", "/a/7"), ("c2", "GET", "/a/b"), ("c3", "GET", "/z")], "call_id string, method string, path string")
    eps = spark.createDataFrame([("e1", "GET", "/a/{id}"), ("e2", "GET", "/a/b"), ("e3", "POST", "/a/{id}")], "endpoint_id string, method string, path string")
    made, warned = resolve.unique_match(resolve.path_join(calls, eps), ["call_id"], "endpoint_id")
    assert [tuple(r) for r in made.collect()] == [("c1", "e1")] and [r["candidates"] for r in warned.collect()] == [2]
    left = spark.createDataFrame([("x", "o"), ("y", "o"), ("z", "q")], "a string, b string")
    out = resolve.with_fallback(left, spark.createDataFrame([("x", "1")], "a string, v string"), spark.createDataFrame([("o", "2")], "b string, v string"), ["a"], ["b"], "v")
    assert {r["a"]: r["v"] for r in out.collect()} == {"x": "1", "y": "2", "z": None}
    assert [r["b"] for r in resolve.stubs(left, spark.createDataFrame([("o",)], "b string"), "b").collect()] == ["q"]


def test_endpoints(spark):
    s = "http_method string, path string, source string, controller_class string, handler_method string, request_body_type string, operation_id string, summary string, description string, consumes array<string>, produces array<string>, parameters array<struct<name:string>>, responses array<struct<status:string>>, order_id long"
    base = (None, None, None, None, None, None, [], [], [])
    row = lambda source, status, i, body=None: ("GET", "/a/{x}", source, base[0], base[1], body, *base[3:9], [(status,)], i)
    case = lambda *rows: endpoints.reconcile(spark.createDataFrame(list(rows), s)).first()["conflicts"]
    assert case(row("JAVA_SOURCE", "CREATED", 1), row("OPENAPI", "201", 2)) == [] and case(row("OPENAPI", "200", 1), row("JAVA_SOURCE", "201", 2)) == ["responses"]
    assert case(row("OPENAPI", "200", 1, "Mono<a.Dto>"), row("JAVA_SOURCE", "200", 2, "b.Dto")) == [] and case(row("OPENAPI", "200", 1, "A"), row("JAVA_SOURCE", "200", 2, "B")) == ["requestBodyType"]
    doc = {"a": {"$ref": "#/b"}, "b": {"$ref": "#/a"}, "c~/d": {"type": "array", "items": {"$ref": "#/x/Dto"}}}
    assert endpoints.resolve_ref(doc, {"$ref": "#/a"}) in ({"$ref": "#/b"}, {"$ref": "#/a"}) and endpoints.schema_type(doc, endpoints.resolve_ref(doc, {"$ref": "#/c~0~1d"})) == "array<Dto>"
    assert endpoints.schema_type({}, {"oneOf": [{"type": "string"}, {"type": "integer", "format": "int64"}]}) == "string|integer(int64)" and endpoints.validations({"minLength": 1, "x": 2}) == ["minLength=1"]
    assert endpoints.openapi_rows("oops") == [] and endpoints.mapping_rows("[]") == []


def test_reports(spark):
    e = edges(spark, ("READS", "f", "table:p.t"), ("UPDATES", "f", "column:p.t.c"), ("CALLS", "f", "g"))
    assert [(r["target"], r["label"]) for r in reports.crud_matrix(e).collect()] == [("table:p.t", "R / U")]
    cons = spark.createDataFrame([("c", "fk", "FOREIGN_KEY", ["a", "b"], "p", ["x"]), ("c", "pk", "PRIMARY_KEY", ["b", "a"], None, None), ("c", "uq", "UNIQUE", ["z"], None, None)], "relation string, name string, type string, columns array<string>, referenced_table string, referenced_columns array<string>")
    cols = spark.createDataFrame([("c", "a", True), ("c", "b", False), ("c", "z", False)], "relation string, column string, nullable boolean")
    assert tuple(reports.foreign_keys(cons, cols).first()) == ("c", "fk", "p", "a=x", "0..1", "0..1", True)
    assert {r["column"]: r["markers"] for r in reports.column_badges(cols, cons).collect()} == {"a": "FK PK", "b": "FK PK", "z": "UQ"}
    acts = edges(spark, ("PERFORMED_ON", "act", "s1"), ("TRANSITIONS_TO", "act", "s2"))
    assert [tuple(r)[:] for r in reports.action_transitions(acts).collect()] == [("act", "s1", "s2")]
    docs = spark.createDataFrame([("b", "X", "Ledger", ""), ("a", "X", "t", "a LEDGER"), ("c", "X", "t", "")], "id string, type string, title string, description string")
    assert [r["id"] for r in reports.search(docs, "ledger", 1).collect()] == ["a"]


class Fake:
    def __init__(self, spark, name, cats, incremental=True):
        self.name, self.version, self.categories, self.incremental, self.spark = name, "1", frozenset(cats), incremental, spark

    def analyze(self):
        n = self.spark.createDataFrame([(f"{self.name}:1", "")], "id string, adapter string")
        return n, n


def test_refresh(spark):
    a, b = Fake(spark, "a", ["JAVA"]), Fake(spark, "b", ["SQL"], incremental=False)
    assert refresh.plan("INCREMENTAL", ["JAVA"], [a, b], True) == refresh.Plan("INCREMENTAL", ("a",))
    for cats, previous in ((["JAVA"], False), (["CONFIGURATION"], True), (["FRONTEND"], True), (["SQL"], True)):
        assert refresh.plan("INCREMENTAL", cats, [a, b], previous).mode == "FULL"
    held = {"b": tuple(refresh.normalize_fragment(x, "b", "old", "2020-01-01") for x in b.analyze())}
    out = refresh.run(refresh.Plan("INCREMENTAL", ("a",)), [a, b], held.get, "new", "2024-01-01")
    assert out.runs == {"a": "EXECUTED", "b": "CACHE_REUSED"} and {(r["id"], r["adapter"], r["target_commit"]) for r in out.nodes.collect()} == {("a:1", "a", "new"), ("b:1", "b", "new")}
    assert refresh.run(refresh.Plan("INCREMENTAL", ("a",)), [a, b], lambda _: None, "new", "2024-01-01").runs == {"a": "EXECUTED", "b": "EXECUTED"}
    with pytest.raises(LookupError):
        refresh.run(refresh.Plan("INCREMENTAL", ("a",)), [a, b], lambda _: None, "new", "2024-01-01", strict=True)
    prev = spark.createDataFrame([("x", "CUSTOM_HTML_SECTION", "n", "d", False), ("y", "DB_TABLE", "n", "d", True), ("z", "DB_TABLE", "n", "d", False), ("k", "DB_TABLE", "n", "d", True)], "id string, type string, display_name string, description string, has_human boolean")
    assert {r["id"] for r in refresh.retained_documentation(prev, spark.createDataFrame([("k",)], "id string")).collect()} == {"x", "custom-retained:y"}


def test_documents_caches_and_changes(spark, tmp_path):
    g = tmp_path / "g.json"
    g.write_text('{"schemaVersion":"1.0","projectId":"p","nodes":[{"id":"a:1","type":"SCREEN","attrs":{"k":"1"}}],"edges":[]}')
    meta, n, e = graphjson.read_graph(spark, str(g))
    assert meta.first()["projectId"] == "p" and n.first()["attrs"] == {"k": "1"} and e.count() == 0
    graphjson.write_graph({"projectId": "p"}, n, e, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "nodes")).count() == 1
    g.write_text('{"schemaVersion":"2.0"}')
    with pytest.raises(ValueError, match="version"):
        graphjson.read_graph(spark, str(g))
    g.write_text('{"schemaVersion":"1.0","strange":1}')
    with pytest.raises(ValueError, match="strange"):
        graphjson.read_graph(spark, str(g))
    lines = spark.createDataFrame([("M\ta/X.java",), ("R100\told.sql\tnew/db/migration/V1.sql",), ("notes.txt",), ("",)], "value string")
    got = {r["path"]: (r["previous_path"], r["change"], r["category"]) for r in graphjson.name_status(lines).collect()}
    assert got == {"a/X.java": (None, "MODIFIED", "JAVA"), "new/db/migration/V1.sql": ("old.sql", "RENAMED", "MIGRATION"), "notes.txt": (None, "ADDED", "UNKNOWN")}
    assert {r["category"] for r in graphjson.categories(graphjson.name_status(lines)).collect()} == {"JAVA", "MIGRATION", "SQL", "UNKNOWN"}
    ent = spark.createDataFrame([("GRAPH", "p", "x", "c1", "h", "a", "1", 1, "s1"), ("GRAPH", "p", "x", "c1", "h", "a", "1", 2, "s2"), ("GRAPH", "p", "x", "c2", "h", "a", "1", 3, "s3")], "kind string, project string, name string, commit string, config_hash string, adapter string, version string, created_at int, sha256 string")
    assert [r["sha256"] for r in graphjson.accepted(ent, graphjson.Requirements(commit="c1", adapter="a")).collect()] == ["s2"]
    assert graphjson.content_hash(ent, "k") == graphjson.content_hash(ent.orderBy("created_at"), "k") != graphjson.content_hash(ent.limit(1), "k")
    with pytest.raises(ValueError):
        graphjson.inside(str(tmp_path), "../x")


def test_observations_and_catalog(spark):
    text = '{"id":"flow1","route":"/projects/7","state":"loaded","transitions":[{"sequence":1,"from":{"route":"/login","state":"default"},"action":{"kind":"click","label":"Go"},"to":{"route":"/projects/7","state":"loaded"}}],"requests":[{"method":"get","path":"/api/p/3","actionSequence":1},{"method":"get","path":"/api/q"}]}'
    o = observations.observations(spark.createDataFrame([(text,), ('{"id":"x"}',), ("bad",)], "text string"))
    n, e = observations.fragment(o)
    assert "screen:/projects/{id}" in {r["id"] for r in n.collect()}
    calls = [(r["src"].split(":")[0], r["dst"]) for r in e.where("type = 'CALLS_HTTP'").collect()]
    assert sorted(calls) == [("flow", "http-call:GET:/api/p/{id}"), ("flow", "http-call:GET:/api/q"), ("ui-action", "http-call:GET:/api/p/{id}")]
    sections, refs, claims = observations.custom_sections(spark.createDataFrame([("s", "<i data-ref='a:1'></i><b data-assert='a:1|type=X'></b>")], "section string, html string"))
    assert refs.first()["id"] == "a:1" and tuple(claims.first()) == ("s", "a:1", "type", "X") and sections.count() == 1
    enums = {"enums": spark.createDataFrame([("p", "e", "b", 2.0), ("p", "e", "a", 1.0)], "schema_name string, enum_name string, label string, sort_order double")}
    assert catalog.enum_values(enums.__getitem__).first()["labels"] == ["a", "b"] and len(catalog.CATALOG_QUERIES) == 12


def test_streaming_spans(spark, tmp_path):
    from evigraph.streaming import spans as st

    (tmp_path / "in").mkdir()
    line = '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"a","spanId":"%s","name":"svc service","kind":"SERVER","startTimeUnixNano":"1700000000000000000","endTimeUnixNano":"1700000000000001000"}]}]}]}'
    (tmp_path / "in" / "x.json").write_text("\n".join([line % "1", line % "1", line % "2"]))
    q = st.span_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("evigraph_spans").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("evigraph_spans").count() == 2


def test_queries_follow_edges_to_the_fixpoint(spark, data):
    from evigraph.plans import graph_queries as gq

    n, e = gq.graph(spark, data)
    kinds = {(r["project_id"], r["id"]): (r["type"], r["stale"]) for r in n.select("project_id", "id", "type", "stale").collect()}
    rows = [(r["project_id"], r["type"], r["src"], r["dst"]) for r in e.collect() if r["src"] is not None and r["dst"] is not None]

    def closure(starts, pairs):
        near: dict = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
        depth = {s: 0 for s in starts}
        todo = list(depth)
        for x in todo:
            for y in near.get(x, ()):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    todo.append(y)
        return depth

    for query, start, types, turn in (("reach_all_flows", "HTTP_ENDPOINT", reports.EXECUTION_EDGES, 1), ("reverse_usage", "DB_TABLE", reports.USAGE_EDGES, -1)):
        pairs = [((p, s), (p, d))[::turn] for p, t, s, d in rows if t in types]
        want = {(*s, y[1], k) for s, (t, _) in kinds.items() if t == start for y, k in closure([s], pairs).items()}
        assert {(r["project_id"], r["source"], r["node"], r["depth"]) for r in gq.QUERIES[query](spark, data).collect()} == want
    both = [x for p, _, s, d in rows for x in (((p, s), (p, d)), ((p, d), (p, s)))]
    stale = {x for x, (_, is_stale) in kinds.items() if is_stale}
    depth = closure(stale, both)
    assert max(depth.values()) > 3
    assert {(r["project_id"], r["node"]) for r in gq.impact_transitive(spark, data).collect()} == set(depth) - stale
    flows = gq.impact_flows(spark, data).collect()
    assert {(r["project_id"], r["node"], r["depth"]) for r in flows} == {(*x, k) for x, k in depth.items() if kinds.get(x, ("",))[0] == "HTTP_ENDPOINT"} and len(flows) == len({(r["project_id"], r["node"]) for r in flows})
    assert {(r["project_id"], r["id"]) for r in gq.stale_impact(spark, data).collect()} == {x for x in depth if kinds.get(x, ("",))[0] == "CUSTOM_HTML_SECTION" and not kinds[x][1] and kinds[x][1] is not None}


def test_nearest_is_the_best_of_all_shortest_paths(spark):
    r = random.Random(3)
    e = edges(spark, *{("CALLS", f"n{r.randint(0, 30)}", f"n{r.randint(0, 30)}") for _ in range(60)})
    starts = spark.createDataFrame([(f"n{i}", f"n{i}") for i in (3, 7, 11, 20)], "source string, node string")
    best: dict = {}
    for x in traverse.shortest_paths(starts, traverse.steps(e), 40).collect():
        new = (x["depth"], x["source"], tuple(x["path"]))
        best[x["node"]] = min(best.get(x["node"], new), new)
    assert {x["node"]: (x["depth"], x["source"], tuple(x["path"])) for x in traverse.nearest(starts, traverse.steps(e), None).collect()} == best


def test_html_sanitize_sees_the_whole_unescaped_text(spark, tmp_path):
    from evigraph.plans import source_queries as sq

    long = "word " * 100
    texts = [(1, long + "<script>steal()</script><b onclick='x()'>end</b>"), (2, long + "<p>last</p>"), (3, long + "java&Tab;script:go()"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["html"] for r in sq.html_sanitize(spark, str(tmp_path)).collect()}
    wrap = lambda s: f'<div><a href="#">{s}</a></div>'
    assert got == {1: wrap(long + "<b>end</b>"), 2: wrap(long + "<p>last</p>"), 3: None}


def test_diff_has_edges_attributes_and_metadata(spark, tmp_path):
    from evigraph.plans import graph_queries as gq

    meta = "struct<adapter string, confidence string, review_state string, stale boolean, source_path string, start_line int, warnings array<string>>"
    m = ("source", "DECLARED", None, None, None, None, None)
    row = lambda no, i, attrs, meta: ("p", no, "c", None, datetime(2026, 1, no), i, "SCREEN", i, None, attrs, meta)
    rows = [row(1, i, {"a": "1"}, m) for i in "abc"] + [row(2, "a", {"a": "2"}, m), row(2, "b", {"a": "1.0"}, (*m[:3], True, *m[4:])), row(2, "c", {"a": "1"}, m)]
    spark.createDataFrame(rows, f"project_id string, snapshot_no int, target_commit string, analyzed_at timestamp, delivered_at timestamp, node_id string, type string, display_name string, description string, attrs map<string,string>, metadata {meta}").write.parquet(f"{tmp_path}/nodes.parquet")
    edge = lambda no, i, dst, attrs: ("p", no, datetime(2026, 1, no), i, "CALLS", "a", dst, None, attrs)
    found = [edge(1, "gone", "b", {}), edge(1, "moved", "b", {}), edge(1, "same", "c", {"k": "1"}), edge(2, "moved", "c", {"k": "2"}), edge(2, "same", " c", {"k": "1.0"}), edge(2, "new", "c", None)]
    spark.createDataFrame(found, "project_id string, snapshot_no int, analyzed_at timestamp, edge_id string, type string, src string, dst string, description string, attrs map<string,string>").write.parquet(f"{tmp_path}/edges.parquet")
    sf = str(tmp_path)
    assert {(r["kind"], r["id"], r["change"], *r["changed_fields"]) for r in gq.diff_full(spark, sf).collect()} == {
        ("node", "a", "MODIFIED", "attributes"), ("node", "b", "MODIFIED", "metadata"), ("edge", "gone", "REMOVED"), ("edge", "moved", "MODIFIED", "attributes", "dst"), ("edge", "new", "ADDED"),
    }
    assert {tuple(r) for r in gq.diff_summary(spark, sf).collect()} == {("node", "MODIFIED", 2), ("edge", "REMOVED", 1), ("edge", "MODIFIED", 1), ("edge", "ADDED", 1)}
    assert {r["id"] for r in gq.top_changes(spark, sf).collect()} == {"a", "b"}


def test_labels_of_a_large_trace_ignore_ids(spark):
    ids = spark.range(60_000).withColumn("up", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 8)))
    name = lambda c, k: F.concat(F.lit(k), F.lpad(F.when(F.lit(k == "a"), F.col(c)).otherwise(99_999 - F.col(c)).cast("string"), 5, "0"))
    spans = [ids.select(F.lit(k).alias("trace_id"), name("id", k).alias("span_id"), name("up", k).alias("parent_span_id"), F.concat(F.lit("op"), F.col("id") % 7).alias("identity")) for k in "ab"]
    got = spanforest.span_labels(spans[0].unionByName(spans[1])).groupBy("label").agg(F.collect_set("trace_id").alias("t"), F.count("*").alias("n"))
    assert {(tuple(sorted(r["t"])), r["n"], r["count"]) for r in got.groupBy("t", "n").count().collect()} == {(("a", "b"), 2, 60_000)}


def test_search_top_searches_all_projects(spark, data):
    from evigraph.plans import graph_queries as gq

    n, _ = gq.graph(spark, data)
    want = sorted((r["id"], r["project_id"]) for r in n.collect() if "ledger" in " ".join(r[c] or "" for c in ("display_name", "id", "type", "description")).lower())[:30]
    assert len({p for _, p in want}) > 1
    assert [r["id"] for r in gq.search_top(spark, data).collect()] == [i for i, _ in want]


def test_source_queries_read_their_tables(spark, data):
    import json

    from evigraph.functions import sqltext as st
    from evigraph.plans import source_queries as sq

    spans = {(r["trace_id"], s["span_id"]): s["attributes"] for r in spark.read.parquet(f"{data}/traces.parquet").collect() if r["trace_id"] for s in r["spans"] or () if s and s["span_id"]}
    want = {f"sql:{t}:{s}#{i}" for (t, s), a in spans.items() if a and a.get("db.statement") for i, x in enumerate(st.analyse(a["db.statement"])) if x.tables}
    assert want and {r["src"] for r in sq.sql_crud(spark, data).collect()} == want
    seen = set()
    for r in spark.read.parquet(f"{data}/raw_observations.parquet").collect():
        try:
            if json.loads(r["payload"]).get("route") is not None:
                seen.add(r["observation_id"])
        except (TypeError, ValueError, AttributeError):
            pass
    assert seen and {r["id"] for r in sq.ui_routes(spark, data).collect()} >= seen
    order = sq.er_hub_order(spark, data).collect()
    by: dict = {}
    for r in order:
        assert r["table"].startswith(r["diagram"] + ".")
        by.setdefault(r["diagram"], []).append(r["place"])
    assert by and sum(r["incoming"] for r in order) > 0 and all(sorted(p) == list(range(1, len(p) + 1)) for p in by.values())


STATEMENTS = [
    ("tasks/selectOpen", "with active as (select id from projects where deleted_at is null) select p.id, u.name from active a join projects p on p.id = a.id left join users u on p.owner_id = u.id where p.name ilike '%x%' and exists (select 1 from tasks t where t.project_id = p.id)"),
    ("tasks/write", "insert into tasks (id, title) values (1, 'a') returning id; update tasks set title = 'b' where id = 5 returning title; delete from tasks where id = 3"),
    ("tasks/upsert", "insert into labels (id, name) values (1, 'a') on conflict (id) do update set name = excluded.name"),
    ("tasks/clear", "truncate audit_logs, public.sessions cascade"),
    ("tasks/selfJoin", "select a.id, b.id from tasks a join tasks b on a.parent_id = b.id"),
]


def test_crud_of_statements(spark):
    got = {(r["src"], r["type"], r["dst"]) for r in sqlfiles.crud_edges(sqlfiles.statements(spark.createDataFrame(STATEMENTS, "source_id string, sql string"))).collect()}
    assert {("sql:tasks/write#0", "CREATES", "table:public.tasks"), ("sql:tasks/write#2", "DELETES", "table:public.tasks"), ("sql:tasks/upsert#0", "CREATES", "table:public.labels")} <= got
