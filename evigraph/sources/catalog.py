"""PostgreSQL catalog rows: the queries, and their rows as typed tables and graph fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.codes import catalog_bool, constraint_type, relation_kind
from evigraph.functions.ids import edge_id

_USER = "n.nspname not in ('pg_catalog', 'information_schema') and n.nspname not like 'pg_toast%' and n.nspname not like 'pg_temp%'"
#: One text per catalog object kind; each can be pushed to a JDBC source whole.
CATALOG_QUERIES = {
    "database": "select current_database() as database_name, version() as version, pg_encoding_to_char(encoding) as encoding from pg_database where datname = current_database()",
    "schemas": f"select n.nspname as schema_name, r.rolname as owner_name, obj_description(n.oid, 'pg_namespace') as comment from pg_namespace n join pg_roles r on r.oid = n.nspowner where {_USER}",
    "relations": f"select n.nspname as schema_name, c.relname as relation_name, c.relkind as relation_kind, r.rolname as owner_name, obj_description(c.oid, 'pg_class') as comment, case when c.relkind in ('v', 'm') then pg_get_viewdef(c.oid) end as definition, c.relrowsecurity as rls_enabled, c.relforcerowsecurity as rls_forced from pg_class c join pg_namespace n on n.oid = c.relnamespace join pg_roles r on r.oid = c.relowner where c.relkind in ('r', 'p', 'v', 'm', 'f') and {_USER}",
    "columns": f"select n.nspname as schema_name, c.relname as relation_name, a.attname as column_name, a.attnum as ordinal, format_type(a.atttypid, a.atttypmod) as formatted_type, not a.attnotnull as nullable, pg_get_expr(d.adbin, d.adrelid) as default_expression, a.attidentity as identity_kind, a.attgenerated as generated_kind, col_description(c.oid, a.attnum) as comment from pg_attribute a join pg_class c on c.oid = a.attrelid join pg_namespace n on n.oid = c.relnamespace left join pg_attrdef d on d.adrelid = c.oid and d.adnum = a.attnum where a.attnum > 0 and not a.attisdropped and c.relkind in ('r', 'p', 'v', 'm', 'f') and {_USER}",
    "constraints": f"select n.nspname as schema_name, c.relname as relation_name, k.conname as constraint_name, k.contype as constraint_type, (select array_agg(a.attname order by u.ord) from unnest(k.conkey) with ordinality u(att, ord) join pg_attribute a on a.attrelid = k.conrelid and a.attnum = u.att) as columns, fn.nspname as referenced_schema, fc.relname as referenced_table, (select array_agg(a.attname order by u.ord) from unnest(k.confkey) with ordinality u(att, ord) join pg_attribute a on a.attrelid = k.confrelid and a.attnum = u.att) as referenced_columns, pg_get_constraintdef(k.oid) as definition, k.condeferrable as deferrable, k.condeferred as initially_deferred from pg_constraint k join pg_class c on c.oid = k.conrelid join pg_namespace n on n.oid = c.relnamespace left join pg_class fc on fc.oid = k.confrelid left join pg_namespace fn on fn.oid = fc.relnamespace where {_USER}",
    "indexes": f"select n.nspname as schema_name, c.relname as relation_name, i.relname as index_name, x.indisunique as is_unique, x.indisprimary as is_primary, m.amname as access_method, pg_get_expr(x.indpred, x.indrelid) as predicate, pg_get_indexdef(x.indexrelid) as definition from pg_index x join pg_class i on i.oid = x.indexrelid join pg_class c on c.oid = x.indrelid join pg_namespace n on n.oid = c.relnamespace join pg_am m on m.oid = i.relam where {_USER}",
    "sequences": "select schemaname as schema_name, sequencename as sequence_name, data_type, start_value, min_value, max_value, increment_by, cycle from pg_sequences",
    "enums": f"select n.nspname as schema_name, t.typname as enum_name, e.enumlabel as label, e.enumsortorder as sort_order from pg_enum e join pg_type t on t.oid = e.enumtypid join pg_namespace n on n.oid = t.typnamespace where {_USER}",
    "domains": f"select n.nspname as schema_name, t.typname as domain_name, format_type(t.typbasetype, t.typtypmod) as base_type, t.typnotnull as not_null, t.typdefault as default_expression from pg_type t join pg_namespace n on n.oid = t.typnamespace where t.typtype = 'd' and {_USER}",
    "functions": f"select n.nspname as schema_name, p.proname as function_name, pg_get_function_identity_arguments(p.oid) as arguments, pg_get_function_result(p.oid) as result_type, l.lanname as language, p.provolatile as volatility from pg_proc p join pg_namespace n on n.oid = p.pronamespace join pg_language l on l.oid = p.prolang where p.prokind in ('f', 'p') and {_USER}",
    "triggers": f"select n.nspname as schema_name, c.relname as relation_name, t.tgname as trigger_name, pg_get_triggerdef(t.oid) as definition, fn.nspname as function_schema, p.proname as function_name, t.tgenabled as enabled from pg_trigger t join pg_class c on c.oid = t.tgrelid join pg_namespace n on n.oid = c.relnamespace join pg_proc p on p.oid = t.tgfoid join pg_namespace fn on fn.oid = p.pronamespace where not t.tgisinternal and {_USER}",
    "policies": f"select n.nspname as schema_name, c.relname as relation_name, p.polname as policy_name, p.polcmd as command, p.polpermissive as permissive, pg_get_expr(p.polqual, p.polrelid) as using_expression, pg_get_expr(p.polwithcheck, p.polrelid) as check_expression from pg_policy p join pg_class c on c.oid = p.polrelid join pg_namespace n on n.oid = c.relnamespace where {_USER}",
}


def jdbc_executor(spark: SparkSession, url: str, options: dict[str, str] | None = None, fetchsize: int = 512) -> Callable[[str], DataFrame]:
    """Executor of catalog queries over JDBC; any callable from a query name to a DataFrame may stand in."""

    def run(name: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, query=CATALOG_QUERIES[name], fetchsize=str(fetchsize), **(options or {})).load()

    return run


def saved_executor(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{folder}/{name}")


def save_snapshot(executor: Callable[[str], DataFrame], folder: str) -> None:
    for name in CATALOG_QUERIES:
        executor(name).write.mode("overwrite").parquet(f"{folder}/{name}")


def kept_schema(schema: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    ok = ~schema.startswith("pg_toast") & ~schema.startswith("pg_temp_") & ~schema.isin("pg_catalog", "information_schema")
    if include:
        ok = ok & schema.isin(*include)
    return ok & ~schema.isin(*exclude) if exclude else ok


def relations(executor: Callable[[str], DataFrame], include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    r = executor("relations").where(kept_schema(F.col("schema_name"), include, exclude))
    return r.withColumns({"relation_kind": relation_kind(F.col("relation_kind")), "rls_enabled": catalog_bool(F.col("rls_enabled"))})


def constraints(executor: Callable[[str], DataFrame]) -> DataFrame:
    return executor("constraints").withColumn("constraint_type", constraint_type(F.col("constraint_type")))


def unknown_children(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Catalog rows whose relation isn't known, as warnings."""
    lost = children.join(parents.select("schema_name", "relation_name"), ["schema_name", "relation_name"], "left_anti")
    return lost.select(F.concat(F.lit("unknown relation "), "schema_name", F.lit("."), "relation_name").alias("warning")).distinct()


def enum_values(executor: Callable[[str], DataFrame]) -> DataFrame:
    return executor("enums").groupBy("schema_name", "enum_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "label"))), lambda x: x["label"]).alias("labels"))


# Node type of each kind of relation.
RELATION_NODES = {"TABLE": "DB_TABLE", "PARTITIONED_TABLE": "DB_TABLE", "FOREIGN_TABLE": "DB_TABLE", "VIEW": "DB_VIEW", "MATERIALIZED_VIEW": "DB_MATERIALIZED_VIEW"}


def fragment(rels: DataFrame, cols: DataFrame, cons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of schemas, relations and columns; CONTAINS and FK_TO edges; stubs for unknown targets."""
    dot = F.lit(".")
    table = lambda s, r: F.concat(F.lit("table:"), s, dot, r)
    kind = F.lit("DB_TABLE")
    for k, t in RELATION_NODES.items():
        kind = F.when(F.col("relation_kind") == k, t).otherwise(kind)
    schemas = rels.select(F.concat(F.lit("schema:"), "schema_name").alias("id"), F.lit("DB_SCHEMA").alias("type"), F.col("schema_name").alias("display_name")).distinct()
    tables = rels.select(table(F.col("schema_name"), F.col("relation_name")).alias("id"), kind.alias("type"), F.col("relation_name").alias("display_name"))
    columns = cols.select(F.concat(F.lit("column:"), "schema_name", dot, "relation_name", dot, "column_name").alias("id"), F.lit("DB_COLUMN").alias("type"), F.col("column_name").alias("display_name"))
    fks = cons.where("constraint_type = 'FOREIGN_KEY' and referenced_table is not null").select(
        F.lit("FK_TO").alias("type"), table(F.col("schema_name"), F.col("relation_name")).alias("src"), table(F.coalesce("referenced_schema", "schema_name"), F.col("referenced_table")).alias("dst")
    )
    contains = rels.select(F.lit("CONTAINS").alias("type"), F.concat(F.lit("schema:"), "schema_name").alias("src"), table(F.col("schema_name"), F.col("relation_name")).alias("dst")).unionByName(
        cols.select(F.lit("CONTAINS").alias("type"), table(F.col("schema_name"), F.col("relation_name")).alias("src"), F.concat(F.lit("column:"), "schema_name", dot, "relation_name", dot, "column_name").alias("dst"))
    )
    known = schemas.unionByName(tables).unionByName(columns)
    stub = fks.select(F.col("dst").alias("id")).distinct().join(known.select("id"), "id", "left_anti").select("id", F.lit("DB_TABLE").alias("type"), F.substring_index("id", ".", -1).alias("display_name"))
    edges = contains.unionByName(fks).distinct()
    return known.unionByName(stub).distinct(), edges.withColumn("id", edge_id(F.col("type"), F.col("src"), F.col("dst")))
