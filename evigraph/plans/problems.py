"""Queries of the general data problems 2, 3, 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import nested, orphans, snapshots, timestamps
from evigraph.session import table, union_all


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all([
        timestamps.stamps_of_tasks(table(spark, sf_dir, "tasks")),
        timestamps.stamps_of_evidence(table(spark, sf_dir, "endpoint_declarations")),
        timestamps.stamps_of_observations(table(spark, sf_dir, "raw_observations")),
    ])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.node_changes(table(spark, sf_dir, "nodes"))


def p3_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added and removed nodes per project and snapshot."""
    rows = snapshots.node_changes(table(spark, sf_dir, "nodes")).where("change_kind <> 'changed'")
    return rows.groupBy("project_id", "snapshot_no", "change_kind").agg(F.count("*").alias("nodes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nested_children(table(spark, sf_dir, "traces"), table(spark, sf_dir, "raw_relations"), table(spark, sf_dir, "nodes"))


def p5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "traces")
    return nested.span_rows(t).unionByName(nested.event_rows(t)).distinct()


def p5_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.subtype_table(nested.relation_rows(table(spark, sf_dir, "raw_relations")), "foreign_key").distinct()


def p5_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.subtype_table(nested.relation_rows(table(spark, sf_dir, "raw_relations")), "column").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_references(*[table(spark, sf_dir, n) for n in ("tasks", "users", "projects", "edges", "nodes")])


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(p6_found(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p3_found, p3_presence, p5_found, p5_spans, p5_foreign_keys, p5_columns, p6_found, p6_report,
    )
}

_ORPHANS = """
with t as (select distinct id, project_id, assignee_id, loaded_at from tasks where id is not null),
u as (select id, min(loaded_at) as l, arg_max(deleted_at, loaded_at) as d from users where id is not null group by id),
pr as (select id, min(loaded_at) as l, arg_max(deleted_at, loaded_at) as d from projects where id is not null group by id),
tr as (
  select 'assignee_id' as ref_field, t.id, t.loaded_at as a, u.id as found, u.l, u.d from t left join u on t.assignee_id = u.id where t.assignee_id is not null
  union all
  select 'project_id', t.id, t.loaded_at, pr.id, pr.l, pr.d from t left join pr on t.project_id = pr.id where t.project_id is not null),
tk as (
  select 'tasks' as src_table, ref_field, cast(id as varchar) as row_key, strftime(a, '%Y-%m') as month_key,
    case when found is null then 'missing' when d <= a then 'deleted' when l > a then 'late' end as orphan_kind from tr),
ends as (
  select distinct project_id, snapshot_no, edge_id || '@' || snapshot_no as row_key, strftime(analyzed_at, '%Y-%m') as month_key, f as ref_field,
    trim(case f when 'src' then src else dst end, ' ' || chr(9) || chr(10) || chr(13)) as ref
  from edges, (values ('src'), ('dst')) v(f) where project_id is not null),
n as (select project_id, node_id, list(distinct snapshot_no) as nos from nodes group by all),
ed as (
  select 'edges' as src_table, ref_field, row_key, month_key,
    case when nos is null then 'missing' when list_contains(nos, snapshot_no) then null when list_min(nos) < snapshot_no then 'deleted' else 'late' end as orphan_kind
  from ends left join n on ends.project_id = n.project_id and ends.ref = n.node_id where ref is not null),
found as (select distinct * from (select * from tk union all select * from ed) where orphan_kind is not null)
"""

_SPANS = """
with s as (select distinct trace_id, s.span_id as span_id, nullif(s.parent_span_id, '') as parent
  from (select trace_id, unnest(spans) as s from traces) where s.span_id is not null and trace_id is not null),
ev as (select trace_id, s.span_id as span_id, unnest(s.events) as e, unnest(range(1, len(s.events) + 1)) as pos
  from (select trace_id, unnest(spans) as s from traces) where s.span_id is not null)
select 'span' as child_kind, case when k.span_id is not null then s.parent else s.trace_id end as parent_key, s.span_id as child_key, 0 as pos
from s left join (select distinct trace_id, span_id from s) k on k.trace_id = s.trace_id and k.span_id = s.parent
union
select 'event', trace_id || ':' || span_id, e.name, cast(pos as integer) from ev where e.name is not null
"""

_PRESENCE = """
with s as (select project_id, snapshot_no, lag(snapshot_no) over (partition by project_id order by snapshot_no) as prev from (select distinct project_id, snapshot_no from nodes)),
n as (select distinct project_id, snapshot_no, node_id from nodes where project_id is not null and snapshot_no is not null and node_id is not null),
a as (select n.project_id, n.snapshot_no, 'added' as change_kind from n join s using (project_id, snapshot_no) where s.prev is not null and not exists (select 1 from n o where o.project_id = n.project_id and o.snapshot_no = s.prev and o.node_id = n.node_id)),
r as (select o.project_id, s.snapshot_no, 'removed' as change_kind from n o join s on s.project_id = o.project_id and s.prev = o.snapshot_no where not exists (select 1 from n where n.project_id = o.project_id and n.snapshot_no = s.snapshot_no and n.node_id = o.node_id))
select project_id, snapshot_no, change_kind, count(*) as nodes from (select * from a union all select * from r) group by all
"""

SQL = {
    "p3_presence": _PRESENCE,
    "p6_found": _ORPHANS + "select * from found",
    "p6_report": _ORPHANS + "select src_table, ref_field, month_key, orphan_kind, count(distinct row_key) as orphans from found group by all",
    "p5_spans": _SPANS,
}
