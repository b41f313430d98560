"""Queries of the sources, functions and resolver joins; a few run over small literals (README, known limits)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import codes, ids, mask
from evigraph.operators import reports, resolve, spanforest
from evigraph.operators import merge as merging
from evigraph.session import table
from evigraph.sources import catalog, endpoints, otlp, sqlfiles
from evigraph.sources import observations as obs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Endpoints (D13, I10, I15, I36, I37, C1) --------------------------------------------------------------


def _declared(spark, sf) -> DataFrame:
    return table(spark, sf, "endpoint_declarations").dropDuplicates(["declaration_id"])


_NORM = r"""norm as (select *, case when strlen(regexp_replace(q, '[^{]', '', 'g')) = strlen(regexp_replace(q, '[^}]', '', 'g')) and not regexp_matches(q, '\s') then q end as npath from
 (select *, regexp_replace(regexp_replace('/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(path), '(\{[^{}]*)\{[^{}]*\}', '\1', 'g'), '\{\s*([^{}:\s]+)\s*(?::[^{}]*)?\}', '{\1}', 'g'), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g'), '(.)/$', '\1') as q from d))"""
_DECLARED = "with d as (select distinct on (declaration_id) * from endpoint_declarations order by declaration_id), " + _NORM


@query(_DECLARED + " select declaration_id, npath as path, regexp_replace(npath, '\\{[^}]*\\}', '{}', 'g') as match_key, 'endpoint:' || upper(trim(http_method)) || ':' || npath as endpoint_id from norm")
def route_normalize(spark, sf):
    p = ids.normalize_path(F.col("path"))
    return _declared(spark, sf).select("declaration_id", p.alias("path"), ids.match_key(p).alias("match_key"), ids.endpoint_id(F.col("http_method"), F.col("path")).alias("endpoint_id"))


_STATUS = "case v when 'DEFAULT' then 'default' " + " ".join(f"when '{k}' then '{c}'" for k, c in codes.HTTP_STATUS.items()) + " else v end"


@query(f"""with d as (select distinct on (declaration_id) * from endpoint_declarations order by declaration_id), r as (select declaration_id, unnest(responses).status as s from d), v as (select *, upper(trim(coalesce(s, ''))) as v from r)
 select declaration_id, s as status, case when v = '' then 'UNSPECIFIED' else {_STATUS} end as code from v""")
def http_status(spark, sf):
    return _declared(spark, sf).select("declaration_id", F.explode("responses.status").alias("status")).withColumn("code", codes.http_status(F.col("status")))


@query(_DECLARED + f""", m as (select project_id, upper(trim(http_method)) as http_method, regexp_replace(npath, '\\{{[^}}]*\\}}', '{{}}', 'g') as match_key, declaration_id, upper(trim(source)) as src,
  case upper(trim(source)) when 'JAVA_SOURCE' then 3 when 'ACTUATOR' then 2 when 'OPENAPI' then 1 else 0 end as p, operation_id, responses, npath, path, consumes from norm where npath is not null)
 select project_id, http_method, match_key, arg_max(path, p * 1000000000000 - declaration_id) as path,
  arg_max(operation_id, p * 1000000000000 - declaration_id) filter (trim(coalesce(operation_id, '')) <> '') as operation_id,
  coalesce(list_sort(list(distinct src) filter (src is not null)), []) as sources, list_sort(list_distinct(flatten(list(coalesce(consumes, []))))) as consumes from m group by 1, 2, 3""")
def endpoint_reconcile(spark, sf):
    d = _declared(spark, sf).withColumn("order_id", F.col("declaration_id"))
    return endpoints.reconcile(d, ("project_id",)).select("project_id", "http_method", "match_key", "path", "operation_id", "sources", "consumes")


_CALLS = _DECLARED + """, calls as (select distinct project_id, upper(trim(http_method)) as m, regexp_replace(npath, '\\{[^}]*\\}', '42', 'g') as p, string_split(substr(regexp_replace(npath, '\\{[^}]*\\}', '42', 'g'), 2), '/') as s from norm where npath is not null),
 temps as (select distinct project_id, upper(trim(http_method)) as m, npath as p, string_split(substr(npath, 2), '/') as s from norm where npath is not null and contains(npath, '{')),
 hits as (select c.project_id, c.m || ' ' || c.p as call_id, t.p as endpoint_id from calls c join temps t on c.project_id = t.project_id and c.m = t.m and len(c.s) = len(t.s)
  and list_bool_and(list_transform(list_zip(c.s, t.s), lambda x: x[1] = x[2] or starts_with(x[2], '{')))) """


def _paths(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = _declared(spark, sf).select("project_id", F.upper(F.trim("http_method")).alias("method"), ids.normalize_path(F.col("path")).alias("path")).where("path is not null").distinct()
    calls = d.withColumn("path", F.regexp_replace("path", r"\{[^}]*\}", "42")).distinct()  # every template called with its slots filled
    return calls.withColumn("call_id", F.concat_ws(" ", "method", "path")), d.where(F.contains(F.col("path"), F.lit("{"))).withColumn("endpoint_id", F.col("path"))


@query(_CALLS + "select project_id, call_id, endpoint_id from hits")
def template_match_join(spark, sf):
    calls, templates = _paths(spark, sf)
    return resolve.path_join(calls, templates, ("project_id",)).select("project_id", "call_id", "endpoint_id")


@query(_CALLS + "select project_id, call_id, min(endpoint_id) as endpoint_id from hits group by 1, 2 having count(distinct endpoint_id) = 1")
def unique_match_join(spark, sf):
    edges, _ = resolve.unique_match(template_match_join(spark, sf), ["project_id", "call_id"], "endpoint_id")
    return edges


@query(_CALLS + "select project_id, call_id, count(distinct endpoint_id) as candidates, min(endpoint_id) as endpoint_id, max(endpoint_id) as last_candidate from hits group by 1, 2 having count(distinct endpoint_id) > 1")
def ambiguous_matches(spark, sf):
    _, warnings = resolve.unique_match(template_match_join(spark, sf), ["project_id", "call_id"], "endpoint_id")
    return warnings


@query("with d as (select distinct on (declaration_id) * from endpoint_declarations order by declaration_id) select declaration_id, trim(regexp_extract(description, '(?s)^[^.。]*[.。]?', 0), ' ' || chr(9) || chr(10) || chr(13)) as sentence from d where description is not null")
def first_sentence(spark, sf):
    return _declared(spark, sf).where("description is not null").select("declaration_id", codes.first_sentence(F.col("description")).alias("sentence"))


# Traces (A10, A11, H8, H9, C11, I46-I50) ---------------------------------------------------------------


def _spans(spark, sf) -> DataFrame:
    t = table(spark, sf, "traces").select("trace_id", F.inline("spans"))
    return t.where("trace_id is not null and span_id is not null").withColumn("parent_span_id", F.nullif("parent_span_id", F.lit(""))).dropDuplicates(["trace_id", "span_id"])


_SPANS = "with s as (select distinct on (trace_id, s.span_id) trace_id, s.span_id as span_id, nullif(s.parent_span_id, '') as parent_span_id, s.name as name, s.kind as kind, s.start_unix_nano as start_unix_nano, s.end_unix_nano as end_unix_nano, s.attributes as attributes, s.status as status from (select trace_id, unnest(spans) as s from traces) where trace_id is not null and s.span_id is not null order by trace_id, s.span_id)"


@query(_SPANS + " select trace_id, span_id, name from s where parent_span_id is null or not exists (select 1 from s p where p.trace_id = s.trace_id and p.span_id = s.parent_span_id)")
def trace_roots(spark, sf):
    return spanforest.roots(_spans(spark, sf)).select("trace_id", "span_id", "name")


@query(_SPANS + " select distinct s.trace_id, p.span_id as src, s.span_id as dst from s join s p on p.trace_id = s.trace_id and p.span_id = s.parent_span_id")
def trace_calls(spark, sf):
    return spanforest.calls(_spans(spark, sf))


@query(_SPANS + """ select trace_id, span_id, greatest(0, end_unix_nano - start_unix_nano) as duration_nano,
 case when map_contains(attributes, 'db.system') or map_contains(attributes, 'db.statement') or map_contains(attributes, 'db.query.text') then 'JDBC' when kind = 'SERVER' and (map_contains(attributes, 'http.route') or map_contains(attributes, 'url.path')) then 'HTTP_SERVER'
 when kind in ('PRODUCER', 'CONSUMER') then 'ASYNC' when contains(lower(name), 'controller') then 'CONTROLLER' when contains(lower(name), 'dao') then 'DOMA_DAO' when contains(lower(name), 'service') or contains(lower(name), 'usecase') then 'APPLICATION_SERVICE' else 'OTHER' end as boundary from s""")
def span_boundary(spark, sf):
    s = _spans(spark, sf)
    return s.select("trace_id", "span_id", codes.span_duration(F.col("start_unix_nano"), F.col("end_unix_nano")).alias("duration_nano"), codes.span_boundary(F.col("kind"), F.coalesce("attributes", F.create_map().cast("map<string,string>")), F.col("name")).alias("boundary"))


@query(_SPANS + " select trace_id, span_id, parent_span_id, name, kind, start_unix_nano, end_unix_nano, coalesce(status.code, 'UNSET') as status_code, coalesce(cardinality(attributes), 0)::integer as attributes from s")
def trace_import(spark, sf):
    """Export the traces as OTLP JSON text and read them back."""
    attrs = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    s = _spans(spark, sf).select(
        "trace_id", F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", "kind", F.col("start_unix_nano").cast("string").alias("startTimeUnixNano"),
                             F.col("end_unix_nano").cast("string").alias("endTimeUnixNano"), attrs(F.col("attributes")).alias("attributes"), F.struct(F.col("status.code").alias("code")).alias("status")).alias("span"))
    doc = s.select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array("span").alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))).alias("text"), F.col("trace_id").alias("file"))
    flat = otlp.merged_spans(otlp.spans(doc))
    return flat.select("trace_id", "span_id", "parent_span_id", "name", "kind", "start_unix_nano", "end_unix_nano", "status_code", F.size("attrs").alias("attributes"))


@query()
def span_forest_labels(spark, sf):
    """Labels that don't depend on raw ids; no SQL says this recursion."""
    s = _spans(spark, sf).withColumn("identity", F.concat_ws("|", "name", "kind", "boundary"))
    return spanforest.span_labels(s)


# Masking and text (I21-I33) ---------------------------------------------------------------------------


@query("""with r as (select resource from traces where resource is not null), k as (select unnest(map_entries(resource)) as e from r)
 select e.key as key, case when regexp_replace(lower(e.key), '[^a-z0-9]', '', 'g') in ('password', 'passwd', 'pwd', 'secret', 'token', 'authorization', 'cookie', 'setcookie', 'apikey', 'accesskey', 'privatekey', 'credential', 'sessionid')
  or regexp_matches(lower(e.key), 'password|secret|token|credential|apikey|authorization') then '[MASKED]' else e.value end as value, count(*) as rows from k group by 1, 2""")
def mask_keys(spark, sf):
    r = table(spark, sf, "traces").where("resource is not null")
    return r.select(F.explode(mask.mask_key_values(F.col("resource")))).groupBy("key", "value").agg(F.count("*").alias("rows"))


@query("select distinct id, 'update tasks set title = ?, rank = ? where id = ? and owner = \"o1\"' as sql from tasks where id is not null and title is not null and not contains(title, '''')")
def sql_mask(spark, sf):
    t = table(spark, sf, "tasks").where("id is not null and title is not null and not contains(title, \"'\")")
    sql = F.concat(F.lit("update tasks set title = '"), "title", F.lit("', rank = 3.5 where id = "), F.col("id").cast("string"), F.lit(' and owner = "o1" '))
    return t.select("id", mask.mask_sql_columns(sql).alias("sql")).distinct()


@query("""with d as (select doc_id, regexp_replace(regexp_replace(text, '(^|[\\s"''(=])/(?:home|Users|tmp|var|opt|root|private|workspace|mnt)/[^\\s"'')]*', '\\1[path]', 'g'), '(^|[\\s"''(=])[A-Za-z]:\\\\[^\\s"'')]*', '\\1[path]', 'g') as r, text from documents where text is not null)
 select doc_id, length(r) as redacted_chars, r <> text as changed from d""")
def redact_paths_secrets(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").withColumn("r", mask.redact_paths(F.col("text")))
    return d.select("doc_id", F.length("r").cast("bigint").alias("redacted_chars"), (F.col("r") != F.col("text")).alias("changed"))


@query("""with d as (select doc_id, text from documents where text is not null) select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as html from d""")
def html_escape(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", mask.html_escape(F.col("text")).alias("html"))


@query()
def html_sanitize(spark, sf):
    """Whole texts with their own markup, wrapped in risky markup; null means that danger was left and the page is refused."""
    d = table(spark, sf, "documents").where("text is not null")
    html = F.concat(F.lit("<div onclick='x()'><script>alert(1)</script><a href=\"javascript:go()\">"), F.col("text"), F.lit("</a></div>"))
    return d.select("doc_id", mask.sanitize_html(html).alias("html"))


@query("""with l as (select doc_id, unnest(regexp_extract_all(text, '(?i)(?:href|src)\\s*=\\s*["'']([^"'']*)["'']', 1)) as u from documents where text is not null)
 select doc_id, count(*) as links, count(distinct u) as targets from l group by 1""")
def link_check(spark, sf):
    """Link targets per page; internal ones are what :func:`mask.links_of` keeps."""
    found = F.regexp_extract_all("text", F.lit(r"(?i)(?:href|src)\s*=\s*[\"']([^\"']*)[\"']"), 1)
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(found).alias("u"))
    return d.groupBy("doc_id").agg(F.count("*").alias("links"), F.count_distinct("u").alias("targets"))


# SQL as data (J, C8, C12, C14) -------------------------------------------------------------------------

TEMPLATES = [
    ("dao/search", "select * from projects p where 1 = 1 /*%if name != null */ and p.name = /* name */'sample' /*%else*/ and p.archived = false /*%end*/ order by /*# orderBy */"),
    ("dao/update", "update projects set /*%populate */ where id = /* id */1"),
]


@query()
def sql_crud(spark, sf):
    """CRUD edges of every span's SQL text."""
    sql = _spans(spark, sf).select(F.concat_ws(":", "trace_id", "span_id").alias("source_id"), F.try_element_at("attributes", F.lit("db.statement")).alias("sql"))
    parsed = sqlfiles.statements(sql)
    return sqlfiles.crud_edges(parsed).select("id", "type", "src", "dst")


@query()
def sql_template_variants(spark, sf):
    parsed = sqlfiles.statements(spark.createDataFrame(TEMPLATES, "source_id string, sql string"), template=True)
    return parsed.select("source_id", "statement_index", "kind", "dynamic", F.to_json("tables").alias("tables"), F.size("columns").alias("columns"))


@query("""with q(statement_id, b) as (values (1, 'select * from session where id=?'), (2, 'where id=?'), (3, 'delete from users')), s as (select distinct trace_id || ':' || s.span_id as span_id, coalesce(s.attributes['db.statement'], '') as st from (select trace_id, unnest(spans) as s from traces) where s.span_id is not null and trace_id is not null),
 n as (select span_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(st), '\\s+', ' ', 'g')), '\\s*([(),;=])\\s*', '\\1', 'g'), ';+$', '')) as a from s where trim(st) <> '')
 select span_id, statement_id from n join q on contains(a, b) or contains(b, a)""")
def sql_containment_join(spark, sf):
    s = table(spark, sf, "traces").select("trace_id", F.inline("spans")).where("span_id is not null and trace_id is not null")
    spans = s.select(F.concat_ws(":", "trace_id", "span_id").alias("span_id"), mask.normalize_sql(F.try_element_at("attributes", F.lit("db.statement"))).alias("sql")).distinct()
    q = spark.createDataFrame([(1, "select * from session where id=?"), (2, "where id=?"), (3, "delete from users")], "statement_id int, sql string")
    return resolve.contained_sql(spans, q)


# Catalog, entities, observations (A8, A9, A14, A16, C15, C17, C29, I54, I55, L6, L8) --------------------


def _catalog(spark) -> Callable[[str], DataFrame]:
    rows = {
        "relations": spark.createDataFrame([("public", "users", "r", "t"), ("public", "tasks", "r", "f"), ("public", "open_tasks", "v", "f"), ("pg_toast_1", "x", "r", "f")], "schema_name string, relation_name string, relation_kind string, rls_enabled string"),
        "columns": spark.createDataFrame([("public", "users", "id", 1, False), ("public", "tasks", "id", 1, False), ("public", "tasks", "owner_id", 2, True), ("public", "lost", "id", 1, False)], "schema_name string, relation_name string, column_name string, ordinal int, nullable boolean"),
        "constraints": spark.createDataFrame([("public", "users", "users_pkey", "p", ["id"], None, None, None), ("public", "tasks", "tasks_pkey", "p", ["id"], None, None, None), ("public", "tasks", "tasks_owner", "f", ["owner_id"], "public", "users", ["id"]), ("public", "tasks", "tasks_team", "f", ["team_id"], "hr", "teams", ["id"])], "schema_name string, relation_name string, constraint_name string, constraint_type string, columns array<string>, referenced_schema string, referenced_table string, referenced_columns array<string>"),
        "enums": spark.createDataFrame([("public", "state", "DONE", 2.0), ("public", "state", "TODO", 1.0)], "schema_name string, enum_name string, label string, sort_order double"),
    }
    return rows.__getitem__


@query("""select * from (values ('schema:public', 'DB_SCHEMA', 'public'), ('table:public.users', 'DB_TABLE', 'users'), ('table:public.tasks', 'DB_TABLE', 'tasks'), ('table:public.open_tasks', 'DB_VIEW', 'open_tasks'), ('column:public.users.id', 'DB_COLUMN', 'id'), ('column:public.tasks.id', 'DB_COLUMN', 'id'), ('column:public.tasks.owner_id', 'DB_COLUMN', 'owner_id'), ('table:hr.teams', 'DB_TABLE', 'teams')) v(id, type, display_name)""")
def catalog_snapshot(spark, sf):
    run = _catalog(spark)
    rel = catalog.relations(run)
    cols = run("columns").join(rel.select("schema_name", "relation_name"), ["schema_name", "relation_name"], "left_semi")
    return catalog.fragment(rel, cols, catalog.constraints(run))[0]


@query("select 'unknown relation public.lost' as warning")
def catalog_warnings(spark, sf):
    run = _catalog(spark)
    return catalog.unknown_children(run("columns"), catalog.relations(run))


def _constraints(spark, sf) -> tuple[DataFrame, DataFrame]:
    from evigraph.operators import nested

    rows = nested.relation_rows(table(spark, sf, "raw_relations"))
    cols = rows.where("child_kind = 'column'").select(F.col("parent_key").alias("relation"), F.col("child_key").alias("column"), F.coalesce(F.try_element_at("facts", F.lit("nullable")) == "true", F.lit(False)).alias("nullable"), "pos").dropDuplicates(["relation", "column"])
    kinds = rows.where("child_kind = 'constraint'").select(F.col("parent_key").alias("relation"), F.col("child_key").alias("name"), F.try_element_at("facts", F.lit("type")).alias("type"), F.coalesce(F.try_element_at("facts", F.lit("referencedTable")), F.try_element_at("facts", F.lit("referenced_table"))).alias("referenced_table")).dropDuplicates(["relation", "name"])
    parts = rows.where("child_kind = 'constraint_column'").select(F.regexp_extract("parent_key", r"^(.*)\.[^.]*$", 1).alias("relation"), F.substring_index("parent_key", ".", -1).alias("name"), "child_key", "pos").distinct()
    lists = parts.groupBy("relation", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "child_key"))), lambda x: x["child_key"]).alias("columns"))
    full = kinds.join(lists, ["relation", "name"], "left").withColumns({"columns": F.coalesce("columns", F.array().cast("array<string>")), "referenced_columns": F.coalesce("columns", F.array().cast("array<string>"))})
    return full, cols


@query()
def er_relationships(spark, sf):
    return reports.foreign_keys(*_constraints(spark, sf))


@query()
def table_definition_badges(spark, sf):
    constraints, columns = _constraints(spark, sf)
    return reports.column_badges(columns, constraints)


@query("""with o as (select distinct observation_id, json_extract_string(payload, '$.route') as route, json_extract_string(payload, '$.state') as state, json_extract_string(payload, '$.id') as id from raw_observations where json_valid(payload)),
 r as (select *, case state when 'success' then 1 when 'loaded' then 2 when 'default' then 3 when 'empty' then 4 when 'error' then 5 else 99 end as p from o where route is not null)
 select route as screen, state, id as scenario, observation_id as point from r qualify row_number() over (partition by route, state order by p, id, observation_id) = 1""")
def state_capture_first(spark, sf):
    p = F.col("payload")
    o = table(spark, sf, "raw_observations").select(F.get_json_object(p, "$.route").alias("screen"), F.get_json_object(p, "$.state").alias("state"), F.get_json_object(p, "$.id").alias("scenario"), F.col("observation_id").alias("point")).where("screen is not null").distinct()
    return obs.first_capture(o)


@query()
def observation_fragment(spark, sf):
    """Nodes of the observations' graph fragment."""
    return obs.fragment(obs.observations(table(spark, sf, "raw_observations").select(F.col("payload").alias("text"))))[0]


SCREEN = '{"id":"login","route":"/login","state":"default","transitions":[{"sequence":1,"from":{"route":"/login","state":"default"},"action":{"kind":"click","role":"button","name":"Sign in"},"to":{"route":"/projects/7","state":"loaded"},"condition":{"outcome":"ok"}},{"sequence":2,"from":{"route":"/login","state":"default"},"action":{"kind":"click","role":"button","name":"Sign in"},"to":{"route":"/login","state":"error"},"condition":{"outcome":"denied"}}],"requests":[{"method":"post","path":"/api/login","actionSequence":1}]}'


@query("select 'screen-state:/login#default' as from_state, 'role=button name=Sign in' as action, 2::bigint as outcomes, 2::bigint as observations")
def screen_transitions(spark, sf):
    return reports.branch_counts(obs.transitions(obs.observations(spark.createDataFrame([(SCREEN,)], "text string"))))


OPENAPI = '{"paths":{"/api/projects/{id}":{"get":{"operationId":"getProject","parameters":[{"name":"id","in":"path","required":true,"schema":{"type":"integer","format":"int64"}}],"responses":{"200":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/Project"}}}},"404":{"description":"none"}}}}}}'
MAPPINGS = '{"contexts":{"app":{"mappings":{"dispatcherServlets":{"d":[{"details":{"handlerMethod":{"className":"app.ProjectController","name":"get"},"requestMappingConditions":{"methods":["GET"],"patterns":["/api/projects/{id}"],"produces":[{"mediaType":"application/json","negated":false}]}}}]}}}}}'


@query("select * from (values ('GET', '/api/projects/{id}', null, 'getProject', 'OPENAPI', 2), ('GET', '/api/projects/{id}', 'get', null, 'ACTUATOR', 0)) v(http_method, path, handler_method, operation_id, source, responses)")
def endpoint_documents(spark, sf):
    one = lambda t, kind: endpoints.declarations(spark.createDataFrame([(t,)], "text string"), kind)
    both = one(OPENAPI, "openapi").unionByName(one(MAPPINGS, "mappings"))
    return both.select("http_method", "path", "handler_method", "operation_id", "source", F.size("responses").alias("responses"))


@query("select * from (values (1, 'm1'), (2, 'm2'), (3, 'm2')) v(seq, mock_id)")
def nth_mock(spark, sf):
    r = spark.createDataFrame([("s", "GET", "/a", i) for i in (1, 2, 3)], "scenario string, method string, path string, seq int")
    m = spark.createDataFrame([("s", "GET", "/a", i, f"m{i}") for i in (1, 2)], "scenario string, method string, path string, position int, mock_id string")
    return resolve.nth_mock(r, m).select("seq", "mock_id")


@query(r"""with o as (select distinct observation_id as id, json_extract_string(payload, '$.route') as r from raw_observations where json_valid(payload) and json_extract_string(payload, '$.route') is not null),
 s as (select id, r, regexp_replace(regexp_replace(trim(r), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') as p from o),
 q as (select id, list_transform(string_split(p, '/'), lambda x: case when regexp_full_match(x, '[0-9]+') then '{id}' when x like ':%' then '{' || x[2:] || '}' else x end) as a,
  list_transform(string_split(r, '/'), lambda x: case when regexp_full_match(x, '[0-9]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') then '{id}' else x end) as b from s)
 select id, case when array_to_string(a, '/') = '' then '/' else array_to_string(a, '/') end as route, array_to_string(b, '/') as server_route from q""")
def ui_routes(spark, sf):
    """Both normal forms of every observation's route."""
    o = table(spark, sf, "raw_observations").select(F.col("observation_id").alias("id"), F.get_json_object("payload", "$.route").alias("r")).where("r is not null").distinct()
    return o.select("id", ids.ui_route(F.col("r")).alias("route"), ids.server_route(F.col("r")).alias("server_route"))


@query("with c(conflict_id, status, d) as (values ('c1', 'OPEN', 'longer text'), ('c2', 'IGNORED', 'x')) select conflict_id, status, d as description from c")
def conflict_dedup(spark, sf):
    rows = [("c1", "RESOLVED", "short", "done", 1, ["e1"]), ("c1", "OPEN", "longer text", "", 2, ["e2"]), ("c2", "RESOLVED", "x", "", 1, ["e1"])]
    d = spark.createDataFrame(rows, "conflict_id string, status string, description string, resolution string, detected_at int, evidence array<string>")
    return merging.dedupe_conflicts(d).select("conflict_id", "status", "description")


@query()
def er_hub_order(spark, sf):
    """Every relation with columns or constraints, a diagram for each schema; foreign keys of all relations count."""
    from evigraph.operators import nested

    rows = nested.relation_rows(table(spark, sf, "raw_relations"))
    schema = F.substring_index("parent_key", ".", 1)
    fact = lambda *names: F.coalesce(*[F.try_element_at("facts", F.lit(n)) for n in names])
    keys = rows.where("child_kind = 'constraint'").select("parent_key", "child_key", fact("referencedTable", "referenced_table").alias("t"), fact("referencedSchema", "referenced_schema").alias("s")).where("t is not null")
    references = keys.dropDuplicates(["parent_key", "child_key"]).select(F.concat_ws(".", F.coalesce("s", schema), "t").alias("referenced_table"))
    relations = rows.where("child_kind in ('column', 'constraint')").select(schema.alias("diagram"), F.col("parent_key").alias("table")).distinct()
    return reports.er_order(relations, references)
