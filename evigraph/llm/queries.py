"""Queries of problems 1, 4, 7, 8 and 9, and the SQL of those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import encoding, leakage, pii, stuffing, survivor
from evigraph.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = survivor.surviving_fields(table(spark, sf_dir, "endpoint_declarations"))
    return won.select("group_id", "field_name", F.col("record_id").alias("declaration_id"))


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.canonical_endpoints(table(spark, sf_dir, "endpoint_declarations"))


def p1_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same record by summed votes: agreement of many sources counts."""
    return survivor.canonical_endpoints(table(spark, sf_dir, "endpoint_declarations"), "summed")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_items(*[table(spark, sf_dir, n) for n in ("tasks", "audit_logs", "traces")])


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with typed placeholders in place of the items."""
    return pii.redacted(pii.text_rows(*[table(spark, sf_dir, n) for n in ("tasks", "audit_logs", "traces")]))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encoded(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked test items with the number of documents that hold a passage of them."""
    items = table(spark, sf_dir, "eval_items").groupBy("item_id").agg(F.min("suite").alias("suite"))
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents")).join(items, "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_canonical, p1_voted, p4_found, p4_redacted, p7_ids, p8_found, p8_report, p9_found)}
_STAND_INS = ", ".join(f"'{w}'" for w in survivor.STAND_INS)
_RANK = lambda c, names: f"case upper(trim({c})) " + " ".join(f"when '{n}' then {len(names) - i}" for i, n in enumerate(names)) + " else 0 end"

_P1_BASE = rf"""
with d as (
  select distinct project_id, upper(trim(http_method, ' ' || chr(9) || chr(10) || chr(13))) as m,
    regexp_replace(regexp_replace(regexp_replace(trim(path, ' ' || chr(9) || chr(10) || chr(13)), '\{{[^{{}}]*\}}', chr(1), 'g'), '\{{[^{{}}]*\}}', chr(1), 'g'), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', '') as p0,
    declaration_id, source, collected_at, {", ".join(survivor.ENDPOINT_FIELDS)},
    coalesce(list_max(list_transform(evidence, lambda e: case when ({_RANK("e.confidence", survivor.CONFIDENCE_ORDER)}) = 0 then 3 else ({_RANK("e.confidence", survivor.CONFIDENCE_ORDER)}) end)), 3) as conf
  from endpoint_declarations),
e as (
  select *, replace(regexp_replace(regexp_replace('/' || trim(regexp_replace(p0, '[?#].*$', '')), '/+', '/', 'g'), '(.)/$', '\1'), chr(1), '{{}}') as p,
    {_RANK("source", survivor.SOURCE_ORDER)} as src
  from d where m is not null and p0 is not null),
g as (select project_id, m, p, min(declaration_id) as group_id from e group by all having min(declaration_id) < max(declaration_id)),
l as (unpivot e on {", ".join(survivor.ENDPOINT_FIELDS)} into name field_name value val),
s as (select *, lower(regexp_replace(val, '[^\p{{L}}\p{{N}}]+', '', 'g')) as core from l),
w as (
  select s.*, g.group_id, row_number() over (partition by g.group_id, field_name order by conf desc, src desc, collected_at desc nulls last, declaration_id) as rn
  from s join g on s.project_id is not distinct from g.project_id and s.m = g.m and s.p = g.p
  where core <> '' and core not in ({_STAND_INS}))
"""

_P1_VOTES = _P1_BASE.rstrip() + r""",
v as (
  select project_id, m, p, field_name, group_id, declaration_id, lower(regexp_replace(trim(val), '\s+', ' ', 'g')) as norm, val, conf, src, collected_at,
    (conf * 4.0 + src) * pow(2.0, coalesce(epoch_us(collected_at) / 86400000000.0, 0.0) / 180.0 - 120.0) as vote from w),
y as (select *, sum(vote) over (partition by group_id, field_name, norm) as votes from (select distinct on (group_id, field_name, norm, declaration_id) * from v order by vote desc)),
z as (select *, row_number() over (partition by group_id, field_name order by votes desc, conf desc, src desc, collected_at desc nulls last, declaration_id) as best from y)
"""
_PIVOT = ", ".join(f"max(val) filter (field_name = '{f}') as {f}" for f in survivor.ENDPOINT_FIELDS)
SQL: dict[str, str] = {
    "p1_found": _P1_BASE + "select group_id, field_name, declaration_id from w where rn = 1",
    "p1_canonical": _P1_BASE + f"select project_id, m as http_method, p as path, min(group_id) as group_id, {_PIVOT} from w where rn = 1 group by all",
    "p1_voted": _P1_VOTES + f"select project_id, m as http_method, p as path, min(group_id) as group_id, {_PIVOT} from z where best = 1 group by all",
}
