"""Queries of the graph operators over the snapshot, trace and declaration tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph import schema as sc
from evigraph.functions import codes, ids
from evigraph.functions.text import strip
from evigraph.operators import diff, merge, refresh, reports, resolve, snapshots, traverse, validate
from evigraph.session import cut, lookup_join, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS = ["project_id"]
# The evidence type behind each adapter's rows.
ADAPTERS = {"runtime": "RUNTIME_OBSERVATION", "ui": "PLAYWRIGHT_OBSERVATION", "postgres": "DATABASE_INTROSPECTION", "openapi": "OPENAPI", "spring": "SPRING_MAPPING", "source": "SOURCE_CODE", "agent": "AGENT_INFERENCE", "human": "HUMAN_INPUT"}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Frames ------------------------------------------------------------------------------------------


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of every snapshot as a fragment of its element, by its latest delivery."""
    m, key = F.col("metadata"), ["project_id", "snapshot_no", "node_id"]
    t = table(spark, sf, "nodes")
    rest = F.struct(*[c for c in t.columns if c not in key])
    n = t.groupBy(*key).agg(F.max_by(rest, F.coalesce("delivered_at", F.lit("1970-01-01").cast("timestamp_ntz"))).alias("__row")).select(*key, "__row.*")
    rank = sc.coded(m["adapter"], {a: sc.FACT_RANKS[t] for a, t in ADAPTERS.items()}, 0)
    return n.select(
        "project_id", "snapshot_no", F.col("node_id").alias("id"), "type", strip(F.col("display_name")).alias("display_name"), strip(F.col("description")).alias("description"),
        "attrs", "target_commit", "analyzed_at", m["adapter"].alias("adapter"), m["confidence"].alias("confidence"), m["review_state"].alias("review_state"), m["stale"].alias("stale"),
        m["warnings"].alias("warnings"), m["source_path"].alias("source_path"), rank.alias("fact_rank"), F.lit(0).alias("intent_rank"),
    )


def _at(df: DataFrame, last: DataFrame) -> DataFrame:
    return lookup_join(df, last, ["project_id", "snapshot_no"], "left_semi")


def latest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nodes").groupBy("project_id").agg(F.max("snapshot_no").alias("snapshot_no"))


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the latest snapshot of every project."""
    last = latest(spark, sf)
    e = _at(table(spark, sf, "edges"), last).select("project_id", F.col("edge_id").alias("id"), "type", strip(F.col("src")).alias("src"), strip(F.col("dst")).alias("dst"))
    return _at(fragments(spark, sf), last), e.dropDuplicates()


_LAST = "last as (select project_id, max(snapshot_no) as snapshot_no from nodes group by 1)"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
_RANK = "case metadata.adapter " + " ".join(f"when '{a}' then {sc.FACT_RANKS[t]}" for a, t in ADAPTERS.items()) + " else 0 end"
_FRAG = f"""frag as (select project_id, snapshot_no, node_id as id, type, trim(display_name, {_BLANKS}) as display_name, trim(description, {_BLANKS}) as description, attrs, target_commit, analyzed_at,
  metadata.adapter as adapter, metadata.confidence as confidence, metadata.review_state as review_state, metadata.stale as stale, metadata.warnings as warnings, metadata.source_path as source_path, {_RANK} as fact_rank
  from nodes qualify row_number() over (partition by project_id, snapshot_no, node_id order by delivered_at desc nulls last) = 1)"""
_GRAPH = f"""with recursive {_LAST}, {_FRAG},
n as (select f.* from frag f join last using (project_id, snapshot_no)),
e as (select distinct project_id, edge_id as id, type, trim(src, {_BLANKS}) as src, trim(dst, {_BLANKS}) as dst from edges join last using (project_id, snapshot_no))"""


# Counts and projections (B, D17) -------------------------------------------------------------------


@query(_GRAPH + " select type, count(*) as nodes, count(*) filter (stale) as stale, sum(coalesce(len(warnings), 0))::bigint as warnings from n group by 1")
def home_metrics(spark, sf):
    n, _ = graph(spark, sf)
    return n.groupBy("type").agg(F.count("*").alias("nodes"), F.count_if("stale").alias("stale"), F.sum(F.coalesce(F.size("warnings"), F.lit(0))).alias("warnings"))


@query(_GRAPH + f""", k as (select project_id, id from n where type in {sc.SCHEMA_TYPES})
 select e.project_id, e.id, e.type from e join k a on a.project_id = e.project_id and a.id = e.src join k b on b.project_id = e.project_id and b.id = e.dst""")
def projection_schema(spark, sf):
    _, e = traverse.projection(*graph(spark, sf), sc.SCHEMA_TYPES, KEYS)
    return e.select("project_id", "id", "type")


@query(_GRAPH + f""", k as (select project_id, id from n where type in {sc.UI_TYPES})
 select e.project_id, e.id, e.type from e join k a on a.project_id = e.project_id and a.id = e.src join k b on b.project_id = e.project_id and b.id = e.dst""")
def projection_ui(spark, sf):
    _, e = traverse.projection(*graph(spark, sf), sc.UI_TYPES, KEYS)
    return e.select("project_id", "id", "type")


@query(_GRAPH + " select project_id, node, sum(o)::bigint as outgoing, sum(i)::bigint as incoming from (select project_id, src as node, 1 as o, 0 as i from e union all select project_id, dst, 0, 1 from e) where node is not null group by 1, 2")
def incoming_outgoing_degree(spark, sf):
    _, e = graph(spark, sf)
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return e.select("project_id", F.inline(ends)).where("node is not null").groupBy("project_id", "node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


@query(_GRAPH + " select distinct e.project_id, src as node, dst as neighbour from e join n on n.project_id = e.project_id and n.id = e.dst")
def successors(spark, sf):
    n, e = graph(spark, sf)
    return traverse.neighbours(e, n, traverse.OUTGOING, KEYS)


@query(_GRAPH + " select project_id, src, dst, count(*) as edges, string_agg(distinct type, ',' order by type) as types from e where src is not null and dst is not null group by 1, 2, 3 having count(*) > 1")
def edges_between(spark, sf):
    _, e = graph(spark, sf)
    g = e.where("src is not null and dst is not null").groupBy("project_id", "src", "dst").agg(F.count("*").alias("edges"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return g.where("edges > 1")


@query(_GRAPH + " select distinct type, src, dst, 'edge:' || lower(type) || ':' || substr(sha256(type || chr(0) || src || chr(0) || dst), 1, 24) as edge_id from e where src is not null and dst is not null")
def edge_ids(spark, sf):
    _, e = graph(spark, sf)
    d = e.where("src is not null and dst is not null").select("type", "src", "dst").distinct()
    return d.withColumn("edge_id", ids.edge_id(F.col("type"), F.col("src"), F.col("dst")))


@query(_GRAPH + " select project_id, type, src, dst, min(id) as id from e group by 1, 2, 3, 4")
def distinct_relations(spark, sf):
    _, e = graph(spark, sf)
    return resolve.first_by(e, ["project_id", "type", "src", "dst"], ["id"])


# Merging (D, K13) ------------------------------------------------------------------------------------

_ATTRS_TEXT = "coalesce(array_to_string(list_sort(list_transform(map_entries(attrs), lambda x: x.key || '=' || coalesce(x.value, 'null'))), chr(1)), '')"
_KEYED = f"""with {_FRAG}, k as (select *, concat_ws(chr(0), coalesce(type, ''), coalesce(display_name, ''), coalesce(description, ''), {_ATTRS_TEXT}, coalesce(adapter, '')) as ek from frag)"""
_ORDER = "order by fact_rank desc, analyzed_at desc nulls last, ek desc"


@query(_KEYED + f""", t as (select project_id, id, type from k qualify row_number() over (partition by project_id, id {_ORDER}) = 1),
 d as (select project_id, id, display_name from k where display_name <> '' qualify row_number() over (partition by project_id, id {_ORDER}) = 1),
 p as (select project_id, id, description from k where description <> '' qualify row_number() over (partition by project_id, id {_ORDER}) = 1),
 c as (select project_id, id, count(*) as fragments from k group by 1, 2)
 select c.project_id, c.id, t.type, d.display_name, coalesce(p.description, '') as description, c.fragments from c join t using (project_id, id) left join d using (project_id, id) left join p using (project_id, id)""")
def merge_winner(spark, sf):
    return merge.merge_nodes(fragments(spark, sf), ["project_id", "id"])


@query(_KEYED + f""", a as (select project_id, id, unnest(map_entries(attrs)) as x, fact_rank, analyzed_at, ek from k)
 select project_id, id, x.key as attr, x.value as value from a qualify row_number() over (partition by project_id, id, x.key {_ORDER}) = 1""")
def merge_attributes(spark, sf):
    return merge.merge_attributes(fragments(spark, sf), ["project_id", "id"])


_REVIEW = """case when bool_or(review_state = 'NEEDS_REVIEW') then 'NEEDS_REVIEW'
 when bool_or(review_state = 'REJECTED') and bool_or(review_state in ('APPROVED', 'HUMAN_REVIEWED')) then 'NEEDS_REVIEW'
 when bool_or(review_state = 'REJECTED') then 'REJECTED' when bool_or(review_state = 'APPROVED') then 'APPROVED'
 when bool_or(review_state = 'HUMAN_REVIEWED') then 'HUMAN_REVIEWED' when bool_or(review_state = 'AGENT_REVIEWED') then 'AGENT_REVIEWED' else 'UNREVIEWED' end"""


@query(f"""with {_FRAG} select project_id, id, max(target_commit) as target_commit, max(analyzed_at) as analyzed_at, string_agg(distinct adapter, ',' order by adapter) as adapter,
 {_REVIEW} as review_state, coalesce(bool_or(stale), false) as stale, list_sort(list_distinct(flatten(list(coalesce(warnings, []))))) as warnings from frag group by 1, 2""")
def merge_metadata(spark, sf):
    return merge.merge_metadata(fragments(spark, sf), ["project_id", "id"])


@query("""with ev as (select e.id as evidence_id, e.* from (select unnest(evidence) as e from endpoint_declarations)),
 r as (select *, case when trim(coalesce(description, '')) <> '' then 2 else 0 end + case when trim(coalesce(source, '')) <> '' then 3 else 0 end + case when trim(coalesce(adapter, '')) <> '' then 1 else 0 end
   + case when trim(coalesce(type, '')) <> '' then 1 else 0 end + case when observed_at is not null then 5 else 0 end as rich,
   concat_ws(chr(0), coalesce(type, ''), coalesce(source, ''), coalesce(description, ''), coalesce(observed_at, ''), coalesce(adapter, ''), coalesce(confidence, '')) as k from ev)
 select evidence_id, type, source, description, observed_at, adapter, confidence from r qualify row_number() over (partition by evidence_id order by rich desc, k desc) = 1""")
def evidence_dedup(spark, sf):
    e = table(spark, sf, "endpoint_declarations").select(F.inline("evidence")).withColumnRenamed("id", "evidence_id")
    return merge.dedupe_evidence(e.select("evidence_id", "type", "source", "description", "observed_at", "adapter", "confidence"), ["evidence_id"])


@query("""select distinct e.id as stored_id, 'evidence:' || substr(sha256(concat_ws(chr(0), coalesce(e.type, ''), coalesce(e.scope, ''), coalesce(e.source, ''), coalesce(e.description, ''), '', '', '')), 1, 24) as evidence_id
 from (select unnest(evidence) as e from endpoint_declarations)""")
def evidence_ids(spark, sf):
    """Semantic id of every evidence beside the one it came with; the table has neither locations nor details."""
    e, none = table(spark, sf, "endpoint_declarations").select(F.inline("evidence")), F.lit("")
    new = merge.evidence_id(F.col("type"), F.col("scope"), F.col("source"), F.col("description"), none, none, F.lit(None).cast("map<string,string>"))
    return e.select(F.col("id").alias("stored_id"), new.alias("evidence_id")).distinct()


_CONF_CASE = "case upper(e.confidence) when 'HUMAN_REVIEWED' then 600 when 'OBSERVED' then 500 when 'DECLARED' then 400 when 'INFERRED' then 300 when 'STALE' then -100 when 'CONFLICTED' then -200 else 0 end"


@query(f"""with d as (select declaration_id, any_value(evidence) as evidence, any_value(collector_zone) as z from endpoint_declarations group by 1),
 b as (select declaration_id, upper(e.confidence) as c from (select declaration_id, unnest(evidence) as e from d) qualify row_number() over (partition by declaration_id order by {_CONF_CASE} desc, upper(e.confidence) desc nulls last) = 1)
 select d.declaration_id, case when exists (select 1 from (select unnest(d.evidence) as e) where upper(e.confidence) = 'CONFLICTED') then 'CONFLICTED'
  when exists (select 1 from (select unnest(d.evidence) as e) where upper(e.confidence) = 'STALE') then 'STALE' else coalesce(b.c, 'UNKNOWN') end as confidence
 from d left join b using (declaration_id)""")
def confidence_eval(spark, sf):
    d = table(spark, sf, "endpoint_declarations").dropDuplicates(["declaration_id"])
    c = F.transform(F.coalesce("evidence", F.array()), lambda e: F.upper(e["confidence"]))
    has = lambda x: F.coalesce(F.array_contains(c, x), F.lit(False))
    return d.select("declaration_id", merge.evaluate_confidence(has("CONFLICTED"), has("STALE"), F.lit("UNREVIEWED"), F.lit(False), merge.best_confidence(c)).alias("confidence"))


@query(f"""with {_FRAG}, t as (select distinct project_id, id, type from frag),
 a as (select project_id, id, x.key as attr, min(x.value) as lo, max(x.value) as hi from (select project_id, id, unnest(map_entries(attrs)) as x from frag) group by 1, 2, 3),
 s as (select distinct project_id, id, review_state from frag where review_state in ('APPROVED', 'HUMAN_REVIEWED', 'REJECTED')),
 u as (
 select a.project_id, a.id, 'TYPE_MISMATCH' as conflict_type, 'type' as field, a.type || ' conflicts with ' || b.type as description from t a join t b on a.project_id = b.project_id and a.id = b.id and a.type < b.type
 union all select p.project_id, p.id, 'SOURCE_DISAGREEMENT', 'reviewState', p.review_state || ' conflicts with REJECTED' from s p join s r on p.project_id = r.project_id and p.id = r.id and r.review_state = 'REJECTED' and p.review_state <> 'REJECTED'
 union all select project_id, id, 'ATTRIBUTE_MISMATCH', 'attributes.' || attr, 'Attribute ''' || attr || ''' has conflicting values' from a where lo < hi)
 select *, 'conflict:' || substr(sha256(project_id || '|' || id || chr(0) || conflict_type || chr(0) || field || chr(0) || description), 1, 24) as conflict_id from u""")
def conflict_detect(spark, sf):
    return merge.conflicts(fragments(spark, sf), ["project_id", "id"])


_EFRAG = f"""with k as (select project_id, edge_id as id, type, src, dst, description, attrs, analyzed_at, concat_ws(chr(0), coalesce(type, ''), coalesce(src, ''), coalesce(dst, ''), coalesce(description, ''), {_ATTRS_TEXT}, '') as ek
 from (select distinct project_id, snapshot_no, edge_id, type, trim(src, {_BLANKS}) as src, trim(dst, {_BLANKS}) as dst, trim(description, {_BLANKS}) as description, attrs, analyzed_at from edges where edge_id is not null))"""


@query(_EFRAG + """, t as (select project_id, id, type, src, dst from k qualify row_number() over (partition by project_id, id order by analyzed_at desc nulls last, ek desc) = 1),
 p as (select project_id, id, description from k where description <> '' qualify row_number() over (partition by project_id, id order by analyzed_at desc nulls last, ek desc) = 1),
 c as (select project_id, id, count(*) as fragments from k group by 1, 2)
 select c.project_id, c.id, t.type, t.src, t.dst, coalesce(p.description, '') as description, c.fragments from c join t using (project_id, id) left join p using (project_id, id)""")
def merge_edges(spark, sf):
    clean = [strip(F.col(c)).alias(c) for c in ("src", "dst", "description")]
    e = table(spark, sf, "edges").where("edge_id is not null").select("project_id", "snapshot_no", F.col("edge_id").alias("id"), "type", *clean, F.array_sort(F.map_entries("attrs")).alias("__a"), "analyzed_at").distinct()
    e = e.withColumns({"attrs": F.map_from_entries("__a"), "adapter": F.lit(""), "fact_rank": F.lit(0)})
    return merge.merge_edges(e, ["project_id", "id"])


@query(f"""with {_FRAG}, s as (select project_id, id, analyzed_at as detected_at, coalesce(source_path, '') as reason, coalesce(attrs['sourceFingerprint'], '') as source_fingerprint, '' as current_fingerprint, coalesce(adapter, '') as cause from frag where stale),
 w as (select * from s qualify row_number() over (partition by project_id, id order by detected_at desc nulls last, reason desc, source_fingerprint desc, cause desc) = 1), i as (select distinct project_id, id from frag)
 select i.project_id, i.id, w.id is not null as stale, w.detected_at, w.reason, w.source_fingerprint, w.current_fingerprint, w.cause from i left join w on w.project_id = i.project_id and w.id = i.id""")
def merge_stale(spark, sf):
    """Latest stale mark of every node; the path stands for the reason and the adapter for the cause."""
    f = fragments(spark, sf).select("project_id", "id", "stale", F.col("analyzed_at").alias("detected_at"), F.col("source_path").alias("reason"), F.try_element_at("attrs", F.lit("sourceFingerprint")).alias("source_fingerprint"), F.lit("").alias("current_fingerprint"), F.col("adapter").alias("cause"))
    return merge.merge_stale(f, ["project_id", "id"])


@query("select project_id, '1.0' as schema_version, coalesce(max(target_commit) filter (trim(target_commit) <> ''), '') as target_commit, max(analyzed_at) as analyzed_at from nodes group by 1")
def merge_root(spark, sf):
    n = table(spark, sf, "nodes").select("project_id", "target_commit", "analyzed_at", F.lit("1.0").alias("schema_version"))
    return merge.merge_root(n, KEYS)


# Validation (K15) -----------------------------------------------------------------------------------


@query(_GRAPH + """, ids as (select distinct project_id, id from n),
 d as (select project_id, 'ERROR' as severity, 'DANGLING_EDGE_SOURCE' as code, id, src as about from e where not exists (select 1 from ids where ids.project_id = e.project_id and ids.id = e.src)
 union all select project_id, 'ERROR', 'DANGLING_EDGE_TARGET', id, dst from e where not exists (select 1 from ids where ids.project_id = e.project_id and ids.id = e.dst)),
 g as (select distinct project_id, type, src, dst, id, min(id) over (partition by project_id, type, src, dst) as about from e)
 select * from d union all select project_id, 'ERROR', 'DUPLICATE_RELATION', id, about from g where id <> about
 union all (select distinct a.project_id, 'ERROR', 'DUPLICATE_INVERSE_RELATION', b.id, a.id from e a join e b on a.project_id = b.project_id and a.src = b.dst and a.dst = b.src
  and ((a.type = 'CALLS' and b.type = 'CALLED_BY') or (a.type = 'CALLED_BY' and b.type = 'CALLS')) where a.id < b.id)""")
def validate_rules(spark, sf):
    return validate.validate(*graph(spark, sf), KEYS)


_ADAPTER_TYPE = "case adapter " + " ".join(f"when '{a}' then '{t}'" for a, t in ADAPTERS.items()) + " end"
_EXPECTED = "case t " + " ".join(f"when '{k}' then '{v}'" for k, v in sc.TYPE_CONFIDENCE.items()) + " else 'INFERRED' end"


@query(_GRAPH + f""", x as (select project_id, id, confidence, t, {_EXPECTED} as expected from (select *, {_ADAPTER_TYPE} as t from n))
 select project_id, 'ERROR' as severity, 'INVALID_CONFIDENCE' as code, id, null::varchar as about from x where confidence <> expected
 union all select project_id, 'WARNING', 'MISSING_EVIDENCE', id, null from x where t is null
 union all select project_id, 'ERROR', 'OBSERVED_WITHOUT_OBSERVATION', id, null from x where confidence = 'OBSERVED' and coalesce(t, '') not in ('RUNTIME_OBSERVATION', 'PLAYWRIGHT_OBSERVATION')
 union all select project_id, 'ERROR', 'DECLARED_WITHOUT_DECLARATION', id, null from x where confidence = 'DECLARED' and coalesce(t, '') not in ('SPRING_MAPPING', 'OPENAPI', 'DATABASE_INTROSPECTION')""")
def validate_confidence(spark, sf):
    n, _ = graph(spark, sf)
    t = sc.coded(F.col("adapter"), ADAPTERS)
    return validate.confidence_rules(n.select("project_id", "id", "confidence", sc.coded(t, sc.TYPE_CONFIDENCE, "INFERRED").alias("expected"), F.array_compact(F.array(t)).alias("evidence_types")), KEYS)


# Differences and staleness (K9, K12) ----------------------------------------------------------------

_PAIR = f"""{_LAST}, prev as (select n.project_id, max(n.snapshot_no) as snapshot_no from nodes n join last l on n.project_id = l.project_id and n.snapshot_no < l.snapshot_no group by 1), {_FRAG},
 a as (select f.* from frag f join last using (project_id, snapshot_no) where project_id in (select project_id from prev)), b as (select f.* from frag f join prev using (project_id, snapshot_no))"""
_DIFF = f"""{_PAIR}, dn as (select coalesce(a.project_id, b.project_id) as project_id, coalesce(a.id, b.id) as id, case when b.id is null then 'ADDED' when a.id is null then 'REMOVED' else 'MODIFIED' end as change,
  case when a.id is null or b.id is null then [] else list_filter([case when coalesce(a.description, '') <> coalesce(b.description, '') then 'description' end, case when coalesce(a.display_name, '') <> coalesce(b.display_name, '') then 'display_name' end, case when a.type is distinct from b.type then 'type' end], lambda v: v is not null) end as changed_fields
  from a full join b on a.project_id = b.project_id and a.id = b.id)"""


def _last_two(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(project_id, snapshot_no) of the previous and of the latest snapshot of projects with both."""
    last = latest(spark, sf)
    every = table(spark, sf, "nodes").select("project_id", "snapshot_no").distinct()
    prev = every.join(last.withColumnRenamed("snapshot_no", "__last"), "project_id").where("snapshot_no < __last").groupBy("project_id").agg(F.max("snapshot_no").alias("snapshot_no"))
    return prev, last.join(prev.select("project_id"), "project_id", "left_semi")


def _changes(spark, sf, rows: DataFrame, at: str, fields: tuple[str, ...]) -> DataFrame:
    """Difference of the last two snapshots over rows of one digest per field; of rows delivered twice the latest counts."""
    once = rows.groupBy("project_id", "snapshot_no", "id").agg(F.max(F.struct(at, *fields)).alias("__row")).select("project_id", "snapshot_no", "id", *[F.col(f"__row.{f}").alias(f) for f in fields])
    return diff.diff_elements(*[_at(once, s) for s in _last_two(spark, sf)], ["project_id", "id"], fields)


def node_changes(spark, sf) -> DataFrame:
    """Difference of the nodes in all fields, attributes and metadata included."""
    return _changes(spark, sf, snapshots.node_digests(table(spark, sf, "nodes")).withColumnRenamed("node_id", "id"), "delivered_at", snapshots.NODE_FIELDS)


def edge_changes(spark, sf) -> DataFrame:
    """Difference of the edges in type, ends, description and attributes."""
    text = lambda c: F.xxhash64(F.coalesce(strip(F.col(c)), F.lit(""))).alias(c)
    e = table(spark, sf, "edges").where("edge_id is not null").select("project_id", "snapshot_no", F.col("edge_id").alias("id"), "analyzed_at", *map(text, ("type", "src", "dst", "description")), snapshots.attributes_hash(F.col("attrs"), F.col("type")).alias("attributes"))
    return _changes(spark, sf, e, "analyzed_at", ("type", "src", "dst", "description", "attributes"))


def _pair(spark, sf) -> tuple[DataFrame, DataFrame]:
    prev, last = _last_two(spark, sf)
    f = fragments(spark, sf).withColumns({"display_name": F.coalesce("display_name", F.lit("")), "description": F.coalesce("description", F.lit(""))})
    return _at(f, prev), _at(f, last)


@query(f"with {_DIFF} select project_id, id, change, changed_fields from dn where change <> 'MODIFIED' or len(changed_fields) > 0")
def diff_semantic(spark, sf):
    """The nodes' difference in the three fields of its SQL; :func:`diff_full` has all fields and the edges."""
    b, a = _pair(spark, sf)
    return diff.diff_elements(b, a, ["project_id", "id"], ["type", "display_name", "description"])


@query()
def diff_summary(spark, sf):
    return diff.diff_summary(node_changes(spark, sf), edge_changes(spark, sf))


@query()
def refresh_cycle(spark, sf):
    """What a refresh from the last snapshot but one to the last finds: rows by project and finding."""
    prev, last = _last_two(spark, sf)
    n = fragments(spark, sf).withColumns({
        "display_name": F.coalesce("display_name", F.lit("")), "description": F.coalesce("description", F.lit("")), "attributes": snapshots.attributes_hash(F.col("attrs"), F.col("type")),
        "fingerprint": F.try_element_at("attrs", F.lit("sourceFingerprint")), "stale": F.coalesce("stale", F.lit(False)),
    }).select("project_id", "snapshot_no", "id", *refresh.NODE_FIELDS, "fingerprint", "stale")
    e = table(spark, sf, "edges").where("edge_id is not null").groupBy("project_id", "snapshot_no", F.col("edge_id").alias("id")).agg(F.max(F.struct("analyzed_at", "type", strip(F.col("src")).alias("src"), strip(F.col("dst")).alias("dst"))).alias("__e")).select("project_id", "snapshot_no", "id", "__e.type", "__e.src", "__e.dst")
    out = refresh.cycle(*[(cut(_at(n, at).drop("snapshot_no")), cut(_at(e, at).drop("snapshot_no"))) for at in (prev, last)], KEYS)
    count = lambda k, what: out[k].groupBy("project_id", what.alias("finding")).agg(F.count("*").alias("rows"))
    parts = [count("node_diff", F.concat(F.lit("node "), "change")), count("edge_diff", F.concat(F.lit("edge "), "change")), count("stale", F.concat(F.lit("stale "), "cause")), count("findings", F.concat(F.lit("rule "), "code")), count("impacted", F.lit("impacted"))]
    return reduce(DataFrame.unionByName, parts)


@query()
def diff_full(spark, sf):
    """Every added, removed and changed node and edge with its changed fields."""
    return node_changes(spark, sf).withColumn("kind", F.lit("node")).unionByName(edge_changes(spark, sf).withColumn("kind", F.lit("edge")))


@query(f"""{_GRAPH.split("n as")[0]} prev as (select x.project_id, max(x.snapshot_no) as snapshot_no from nodes x join last l on x.project_id = l.project_id and x.snapshot_no < l.snapshot_no group by 1),
 ed as (select project_id, snapshot_no, edge_id as id, coalesce(trim(type, {_BLANKS}), '') as type, coalesce(trim(src, {_BLANKS}), '') as src, coalesce(trim(dst, {_BLANKS}), '') as dst from edges where edge_id is not null qualify row_number() over (partition by project_id, snapshot_no, edge_id order by analyzed_at desc) = 1),
 a as (select ed.* from ed join last using (project_id, snapshot_no) where project_id in (select project_id from prev)), b as (select ed.* from ed join prev using (project_id, snapshot_no)),
 d as (select coalesce(a.project_id, b.project_id) as project_id, coalesce(a.id, b.id) as id, case when b.id is null then 'ADDED' when a.id is null then 'REMOVED' else 'MODIFIED' end as change,
  (a.type, a.src, a.dst) is distinct from (b.type, b.src, b.dst) as differs from a full join b on a.project_id = b.project_id and a.id = b.id)
 select project_id, change, count(*) as edges from d where differs group by 1, 2""")
def diff_edges(spark, sf):
    """Edges added, removed, or changed in type or ends between the last two snapshots, per project."""
    ends = F.arrays_overlap("changed_fields", F.array(F.lit("type"), F.lit("src"), F.lit("dst")))
    return edge_changes(spark, sf).where((F.col("change") != "MODIFIED") | ends).groupBy("project_id", "change").agg(F.count("*").alias("edges"))


@query()
def top_changes(spark, sf):
    return reports.top_per_kind(node_changes(spark, sf), keys=KEYS)


@query(f"""with {_PAIR} select b.project_id, b.id, (a.id is null or a.attrs['sourceFingerprint'] is distinct from b.attrs['sourceFingerprint']) as stale,
 case when a.id is null then 'SOURCE_MISSING' when a.attrs['sourceFingerprint'] is distinct from b.attrs['sourceFingerprint'] then 'SOURCE_CHANGED' end as cause
 from b left join (select * from a where attrs['sourceFingerprint'] is not null) a on a.project_id = b.project_id and a.id = b.id where b.attrs['sourceFingerprint'] is not null""")
def stale_fingerprint(spark, sf):
    b, a = _pair(spark, sf)
    f = F.try_element_at("attrs", F.lit("sourceFingerprint"))
    elements = b.where(f.isNotNull()).select("project_id", "id", F.lit(None).cast("string").alias("source_id"), f.alias("fingerprint"))
    return diff.stale_by_fingerprint(elements, a.where(f.isNotNull()).select("project_id", "id", f.alias("fingerprint")), True, KEYS)


@query(f"""with {_PAIR} select b.project_id, 'handbook' as section, b.id, 'displayName' as field, b.display_name as expected, a.display_name as actual,
 case when a.id is null then 'MISSING' when a.display_name is null then 'ABSENT' when a.display_name = b.display_name then 'MATCH' else 'MISMATCH' end as verdict
 from b left join a on a.project_id = b.project_id and a.id = b.id where b.type = 'DB_TABLE' and b.display_name is not null""")
def custom_reconcile(spark, sf):
    b, a = _pair(spark, sf)
    claims = b.where("type = 'DB_TABLE'").select("project_id", F.lit("handbook").alias("section"), "id", F.lit("displayName").alias("field"), F.col("display_name").alias("expected"))
    return diff.reconcile_claims(claims, a, KEYS)


# Traversal (H) --------------------------------------------------------------------------------------

_WALK = """, r(project_id, source, node, depth) as (select project_id, id, id, 0 from n where type = 'SCREEN' union select r.project_id, r.source, e.dst, r.depth + 1 from r join e on e.project_id = r.project_id and e.src = r.node where r.depth < 3 and e.dst is not null)"""


@query(_GRAPH + _WALK + " select project_id, source, node, min(depth) as depth from r group by 1, 2, 3")
def bfs_depth_3(spark, sf):
    n, e = graph(spark, sf)
    starts = n.where("type = 'SCREEN'").select("project_id", F.col("id").alias("source"), F.col("id").alias("node"))
    return traverse.reach(starts, cut(traverse.steps(e, traverse.OUTGOING, None, KEYS)), 3, KEYS)


@query(_GRAPH + """, r(project_id, source, node, depth, path) as (select project_id, id, id, 0, [id] from n where type = 'SCREEN'
 union all select r.project_id, r.source, e.dst, r.depth + 1, list_append(r.path, e.dst) from r join (select distinct project_id, src, dst from e) e on e.project_id = r.project_id and e.src = r.node where r.depth < 3 and e.dst is not null)
 select project_id, source, node, depth, array_to_string(path, ' > ') as path from r qualify row_number() over (partition by project_id, source, node order by depth, path) = 1""")
def shortest_path(spark, sf):
    n, e = graph(spark, sf)
    starts = n.where("type = 'SCREEN'").select("project_id", F.col("id").alias("source"), F.col("id").alias("node"))
    return traverse.shortest_paths(starts, cut(traverse.steps(e, traverse.OUTGOING, None, KEYS)), 3, KEYS).withColumn("path", F.array_join("path", " > "))


@query(_GRAPH + f""", x as (select project_id, src, dst from e where type in {reports.USAGE_EDGES}), r(project_id, source, node, depth) using key (project_id, source, node) as (select distinct project_id, id, id, 0 from n where type = 'DB_TABLE'
 union select r.project_id, r.source, x.src, min(r.depth + 1) from r join x on x.project_id = r.project_id and x.dst = r.node where x.src is not null and not exists (select 1 from recurring.r q where q.project_id = r.project_id and q.source = r.source and q.node = x.src) group by 1, 2, 3) select project_id, source, node, depth from r""")
def reverse_usage(spark, sf):
    n, e = graph(spark, sf)
    return reports.table_usage(n.where("type = 'DB_TABLE'"), e, None, KEYS)


@query(_GRAPH + f""", x as (select project_id, src, dst from e where type in {reports.EXECUTION_EDGES}), r(project_id, source, node, depth) using key (project_id, source, node) as (select distinct project_id, id, id, 0 from n where type = 'HTTP_ENDPOINT'
 union select r.project_id, r.source, x.dst, min(r.depth + 1) from r join x on x.project_id = r.project_id and x.src = r.node where x.dst is not null and not exists (select 1 from recurring.r q where q.project_id = r.project_id and q.source = r.source and q.node = x.dst) group by 1, 2, 3) select project_id, source, node, depth from r""")
def reach_all_flows(spark, sf):
    n, e = graph(spark, sf)
    return reports.flow_reach(n.where("type = 'HTTP_ENDPOINT'"), e, None, KEYS)


@query(_GRAPH + """, bt as (select project_id, src as a, dst as b from e union select project_id, dst, src from e), c as (select project_id, id from n where stale),
 r(project_id, node) as (select project_id, id from c union select r.project_id, bt.b from r join bt on bt.project_id = r.project_id and bt.a = r.node where bt.b is not null)
 select distinct project_id, node from r where not exists (select 1 from c where c.project_id = r.project_id and c.id = r.node)""")
def impact_transitive(spark, sf):
    n, e = graph(spark, sf)
    return traverse.impact(n.where("stale"), n, e, None, KEYS, "HTTP_ENDPOINT")["transitive"]


@query()
def impact_flows(spark, sf):
    n, e = graph(spark, sf)
    return traverse.impact(n.where("stale"), n, e, None, KEYS, "HTTP_ENDPOINT")["flows"].withColumn("path", F.array_join("path", " > "))


@query(_GRAPH + """, bt as (select project_id, src as a, dst as b from e union select project_id, dst, src from e), c as (select project_id, id from n where stale),
 r(project_id, node) as (select project_id, id from c union select r.project_id, bt.b from r join bt on bt.project_id = r.project_id and bt.a = r.node where bt.b is not null)
 select distinct n.project_id, n.id, 'IMPACTED_IMPLEMENTATION' as cause from n join r on r.project_id = n.project_id and r.node = n.id where n.type = 'CUSTOM_HTML_SECTION' and not n.stale""")
def stale_impact(spark, sf):
    n, e = graph(spark, sf)
    starts = n.where("stale").select("project_id", F.col("id").alias("source"), F.col("id").alias("node"))
    near = traverse.nearest(starts, cut(traverse.steps(e, traverse.BOTH, None, KEYS)), None, KEYS)
    docs = n.where("type = 'CUSTOM_HTML_SECTION'")
    return diff.stale_by_impact(docs, near, docs.where("not stale"), KEYS)


# Reports (M) ----------------------------------------------------------------------------------------

_LIFT = "case when dst like 'column:%' then regexp_replace(dst, '^column:(.*)\\.[^.]*$', 'table:\\1') else dst end"


@query(_GRAPH + f", x as (select project_id, src, {_LIFT} as target, case type when 'CREATES' then 'C' when 'READS' then 'R' when 'UPDATES' then 'U' when 'DELETES' then 'D' end as op from e where type in ('CREATES', 'READS', 'UPDATES', 'DELETES')) select project_id, src, target, string_agg(distinct op, ' / ' order by op) as label, count(*) as edges from x where target like 'table:%' group by 1, 2, 3")
def crud_matrix(spark, sf):
    return reports.crud_matrix(graph(spark, sf)[1], KEYS)


@query(_GRAPH + " select c.src as id, count(distinct c.dst) as tables, bool_or(t.adapter in ('runtime', 'ui')) as observed, case when bool_or(t.adapter in ('runtime', 'ui')) then 'observed' else 'direct' end as label, c.project_id from e c join n t on t.project_id = c.project_id and t.id = c.dst where c.type in ('CREATES', 'READS', 'UPDATES', 'DELETES') group by c.project_id, c.src")
def crud_observation(spark, sf):
    n, e = graph(spark, sf)
    t = n.select("project_id", F.col("id").alias("dst"), F.col("adapter").isin("runtime", "ui").alias("seen"))
    g = reports.crud_edges(e).join(t, ["project_id", "dst"]).groupBy("project_id", F.col("src").alias("id")).agg(F.count_distinct("dst").alias("tables"), F.bool_or("seen").alias("observed"))
    return g.withColumn("label", reports.provenance_label(F.col("observed"), F.lit(False), F.lit(True)))


@query("with d as (select distinct declaration_id, evidence from endpoint_declarations), e as (select declaration_id, unnest(evidence) as e from d) select e.type, e.scope, e.adapter, upper(e.confidence) as confidence, count(*) as rows from e group by all")
def evidence_report(spark, sf):
    d = table(spark, sf, "endpoint_declarations").dropDuplicates(["declaration_id"]).select(F.inline("evidence"))
    return d.groupBy("type", "scope", "adapter", F.upper("confidence").alias("confidence")).agg(F.count("*").alias("rows"))


@query(f"""{_GRAPH}, x as (select project_id, src, dst from e where type in {reports.EXECUTION_EDGES}), r(project_id, source, node) as (select distinct project_id, id, id from n where type = 'HTTP_ENDPOINT'
 union select r.project_id, r.source, x.dst from r join x on x.project_id = r.project_id and x.src = r.node where x.dst is not null),
 t as (select project_id, id as target, id as at from n where type in ('DB_TABLE', 'DB_COLUMN') union all select project_id, id, regexp_replace(id, '^column:(.*)\\.[^.]*$', 'table:\\1') from n where type = 'DB_COLUMN')
 select distinct t.project_id, t.target, r.source as flow from t join r on r.project_id = t.project_id and r.node = t.at""")
def flows_using(spark, sf):
    n, e = graph(spark, sf)
    return reports.flows_using(reports.flow_reach(n.where("type = 'HTTP_ENDPOINT'"), e, None, KEYS), n, KEYS)


@query(_GRAPH + " select project_id, id, 'STALE' as state from n where stale union all (select distinct project_id, id, 'CONFLICTED' from (select project_id, id, count(distinct type) as types from frag group by 1, 2) c join n using (project_id, id) where c.types > 1)")
def state_report(spark, sf):
    """Stale nodes of the latest graph, and those that snapshots type differently."""
    n, _ = graph(spark, sf)
    torn = fragments(spark, sf).groupBy("project_id", "id").agg((F.count_distinct("type") > 1).alias("conflicted"))
    return reports.state_report(n.join(torn, ["project_id", "id"], "left"), KEYS)


@query(_GRAPH + " select distinct e.project_id, dst as node, src as neighbour from e join n on n.project_id = e.project_id and n.id = e.src")
def predecessors(spark, sf):
    n, e = graph(spark, sf)
    return traverse.neighbours(e, n, traverse.INCOMING, KEYS)


_DIRS = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in ids.PAGE_DIRECTORIES.items()) + " else 'other' end"
_SLUG = "regexp_replace(substr(regexp_replace(regexp_replace(lower(id), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 70), '-$', '')"


@query(_GRAPH + f" select project_id, id, type, display_name as title, {_DIRS} || '/' || case when {_SLUG} = '' then 'item' else {_SLUG} end || '-' || substr(sha256(id), 1, 10) || '.html' as url from n")
def search_index(spark, sf):
    n, _ = graph(spark, sf)
    return n.select("project_id", "id", "type", F.col("display_name").alias("title"), ids.page_path(F.col("type"), F.col("id")).alias("url"))


@query(_GRAPH + " select id, type, display_name as title, coalesce(description, '') as description from n where contains(lower(concat_ws(' ', coalesce(display_name, ''), id, type, coalesce(description, ''))), 'ledger') order by id, project_id limit 30")
def search_top(spark, sf):
    n, _ = graph(spark, sf)
    docs = n.select("project_id", "id", "type", F.col("display_name").alias("title"), F.coalesce("description", F.lit("")).alias("description"))
    return reports.search(docs, "ledger", keys=KEYS).drop("project_id")


@query(_GRAPH + """, d as (select project_id, id, src as node, 'forward' as way, type, dst as other from e union all select project_id, id, dst, 'reverse', type, src from e)
 select d.project_id, d.node, d.way, d.type, count(*) as relations, string_agg(distinct o.adapter, ',' order by o.adapter) as adapters from d join n o on o.project_id = d.project_id and o.id = d.other where d.node is not null group by all""")
def node_relations(spark, sf):
    n, e = graph(spark, sf)
    ways = F.array(F.struct(F.col("src").alias("node"), F.lit("forward").alias("way"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.lit("reverse").alias("way"), F.col("src").alias("other")))
    d = e.select("project_id", "type", F.inline(ways)).where("node is not null")
    o = n.select("project_id", F.col("id").alias("other"), "adapter")
    return d.join(o, ["project_id", "other"]).groupBy("project_id", "node", "way", "type").agg(F.count("*").alias("relations"), F.array_join(F.array_sort(F.collect_set("adapter")), ",").alias("adapters"))


@query(_GRAPH + f" select project_id, {_DIRS} as directory, id, coalesce(nullif(display_name, ''), id) as title from n")
def collection_index(spark, sf):
    return reports.collection_index(graph(spark, sf)[0], KEYS)


@query(_GRAPH + f", p as (select distinct {_DIRS} || '/' || id as path from frag), x as (select distinct {_DIRS} || '/' || id as path from n) select path from p where path not in (select path from x)")
def stale_outputs(spark, sf):
    n, _ = graph(spark, sf)
    path = F.concat(sc.coded(F.col("type"), ids.PAGE_DIRECTORIES, "other"), F.lit("/"), F.col("id")).alias("path")
    return reports.stale_outputs(fragments(spark, sf).select(path), n.select(path))


_CATEGORY = """case when p like 'graphdocs/snapshots/ui/%' then 'UI_CAPTURE' when p like '%/db/migration/%' or p like '%/migrations/%' then 'MIGRATION' when p like '%.sql' then 'SQL' when p like '%.java' then 'JAVA'
 when regexp_matches(p, 'openapi\\.(json|ya?ml)$') then 'OPENAPI' when p like '%scenario%' and regexp_matches(p, '\\.(yaml|yml|spec\\.ts|test\\.ts)$') then 'PLAYWRIGHT_SCENARIO' when p like '%fixture%' or p like '%__mocks__%' then 'FIXTURE'
 when regexp_matches(p, '\\.(ts|tsx|js|jsx|vue|svelte|css|html)$') then 'FRONTEND' else 'UNKNOWN' end"""


@query(f"with {_FRAG}, f as (select distinct source_path, lower(source_path) as p from frag where source_path is not null) select source_path, {_CATEGORY} as category from f")
def change_classify(spark, sf):
    return fragments(spark, sf).where("source_path is not null").select("source_path").distinct().withColumn("category", codes.change_category(F.col("source_path")))



