"""SQL texts to statements, tables, columns and CRUD edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.ids import edge_id, table_id
from evigraph.functions.sqltext import analyse, analyse_template

STATEMENTS = (
    "source_id string, statement_index int, kind string, normalized_sql string, "
    "tables array<struct<schema:string,`table`:string,alias:string,operations:array<string>,direct_target:boolean>>, "
    "columns array<struct<qualifier:string,column:string,usage:string>>, "
    "joins array<struct<join_type:string,right_item:string,condition:string>>, ctes array<string>, functions array<string>, "
    "has_where boolean, has_subquery boolean, dynamic boolean, warnings array<string>"
)


def statements(sqls: DataFrame, template: bool = False) -> DataFrame:
    """One row per statement of (source_id, sql) rows; the parser is Python, rows are independent."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in ("source_id", "statement_index", "kind", "normalized_sql", "tables", "columns", "joins", "ctes", "functions", "has_where", "has_subquery", "dynamic", "warnings")]
        for batch in batches:
            rows = []
            for source, sql in zip(batch["source_id"], batch["sql"], strict=True):
                for i, s in enumerate(analyse_template(sql) if template else analyse(sql)):
                    tables = [{**t, "operations": sorted(t["operations"])} for _, t in sorted(s.tables.items())]
                    columns = [{"qualifier": q, "column": c, "usage": u} for q, c, u in sorted(s.columns)]
                    rows.append((source, i, s.kind, s.normalized_sql, tables, columns, s.joins, sorted(s.ctes), sorted(s.functions), s.has_where, s.has_subquery, s.dynamic, s.warnings))
            yield pd.DataFrame(rows, columns=names)

    return sqls.where(F.col("sql").isNotNull()).select("source_id", "sql").mapInPandas(parse, STATEMENTS)


def sql_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, sql) of the .sql files below ``path``; the id is the path behind it."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.sql").select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("sql"))
    return files.select(F.regexp_extract("p", r"(META-INF/.*|[^/]*)$", 1).alias("source_id"), "sql")


def sql_path_of(dao: str, method: str) -> str:
    """Conventional resource of a DAO method's SQL."""
    return f"META-INF/{dao.replace('.', '/')}/{method}.sql"


# Edge type of each operation.
CRUD_EDGES = {"CREATE": "CREATES", "READ": "READS", "UPDATE": "UPDATES", "DELETE": "DELETES"}


def crud_edges(parsed: DataFrame, default_schema: str = "public") -> DataFrame:
    """CRUD edges from statements to tables and to each matching column.

    A column belongs to a table if its qualifier is blank, the alias or the table's name in
    any case; an unqualified column attaches to every table of its statement.
    """
    sql = F.concat(F.lit("sql:"), F.col("source_id"), F.lit("#"), F.col("statement_index").cast("string"))
    t = parsed.select(sql.alias("src"), F.col("columns"), F.explode("tables").alias("t")).withColumn("schema", F.coalesce(F.nullif("t.schema", F.lit("")), F.lit(default_schema)))
    ops = t.select("src", "columns", "t.alias", "schema", F.col("t.table").alias("table"), "t.direct_target", F.explode("t.operations").alias("operation"))
    kind = F.lit(None).cast("string")
    for op, edge in CRUD_EDGES.items():
        kind = F.when(F.col("operation") == op, edge).otherwise(kind)
    typed = ops.withColumn("type", kind).withColumn("dst", table_id(F.col("schema"), F.col("table")))
    own = F.filter("columns", lambda c: (c["qualifier"] == "") | (F.lower(c["qualifier"]) == F.lower("alias")) | (F.lower(c["qualifier"]) == F.lower("table")))
    columns = typed.select("src", "type", F.explode(F.array_distinct(F.transform(own, lambda c: c["column"]))).alias("c"), "schema", "table")
    edges = typed.select("src", "type", "dst").unionByName(columns.select("src", "type", F.concat(F.lit("column:"), F.col("schema"), F.lit("."), F.col("table"), F.lit("."), F.col("c")).alias("dst")))
    return edges.distinct().withColumn("id", edge_id(F.col("type"), F.col("src"), F.col("dst")))
