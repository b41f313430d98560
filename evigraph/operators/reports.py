"""Report queries over a graph: CRUD, entities, transitions, captures, search, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.ids import PAGE_DIRECTORIES, page_path
from evigraph.functions.mask import html_escape
from evigraph.functions.text import blank_to_null
from evigraph.operators.traverse import OUTGOING, reach, steps
from evigraph.schema import coded

# Edge types along which a flow executes, and the CRUD operations they end in.
EXECUTION_EDGES = (
    "STARTS_AT", "HAS_STATE", "NAVIGATES_TO", "TRANSITIONS_TO", "PERFORMED_ON", "CALLS_HTTP", "MATCHES_OPERATION", "ROUTES_TO",
    "CALLS", "EXECUTES", "EXECUTES_SQL", "CREATES", "READS", "UPDATES", "DELETES", "FIRES_TRIGGER", "CALLS_FUNCTION", "OBSERVED_IN", "CONTAINS", "ACCEPTS", "RETURNS",
)
CRUD_LETTERS = {"CREATES": "C", "READS": "R", "UPDATES": "U", "DELETES": "D"}
USAGE_EDGES = ("READS", "CREATES", "UPDATES", "DELETES", "EXECUTES_SQL", "CALLS", "ROUTES_TO", "CALLS_HTTP")


def operation_label(operations: Column) -> Column:
    """Distinct operations in order, joined; a dash without any."""
    joined = F.array_join(F.array_sort(F.array_distinct(F.array_compact(operations))), " / ")
    return F.when(joined == "", "—").otherwise(joined)


def crud_edges(edges: DataFrame) -> DataFrame:
    e = edges.where(F.col("type").isin(*CRUD_LETTERS))
    letter = F.lit(None).cast("string")
    for k, v in CRUD_LETTERS.items():
        letter = F.when(F.col("type") == k, v).otherwise(letter)
    return e.withColumn("operation", letter)


def lift_columns(target: Column) -> Column:
    """A column's id as the id of its table."""
    return F.when(target.startswith("column:"), F.regexp_replace(target, r"^column:(.*)\.[^.]*$", "table:$1")).otherwise(target)


def crud_matrix(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, src, target, label, operations): what each element does to each table."""
    e = crud_edges(edges).withColumn("target", lift_columns(F.col("dst"))).where(F.col("target").startswith("table:"))
    return e.groupBy(*keys, "src", "target").agg(operation_label(F.collect_set("operation")).alias("label"), F.count("*").alias("edges"))


def provenance_label(observed: Column, asynchronous: Column, direct: Column) -> Column:
    """Any observed; async, else direct or indirect."""
    return F.when(observed, "observed").when(asynchronous, "async").when(direct, "direct").otherwise("indirect")


def flow_reach(flows: DataFrame, edges: DataFrame, max_depth: int | None, keys: Sequence[str] = (), max_nodes: int | None = None) -> DataFrame:
    """Everything that flows execute, all flows in one traversal."""
    starts = flows.select(*keys, F.col("id").alias("source"), F.col("id").alias("node"))
    return reach(starts, steps(edges, OUTGOING, EXECUTION_EDGES, keys), max_depth, keys, max_nodes)


def table_usage(tables: DataFrame, edges: DataFrame, max_depth: int | None, keys: Sequence[str] = ()) -> DataFrame:
    """What uses a table, back along usage edges."""
    starts = tables.select(*keys, F.col("id").alias("source"), F.col("id").alias("node"))
    return reach(starts, steps(edges, "INCOMING", USAGE_EDGES, keys), max_depth, keys)


def foreign_keys(constraints: DataFrame, columns: DataFrame) -> DataFrame:
    """Relationships with cardinalities.

    ``constraints``: relation, name, type, columns[], referenced_table, referenced_columns[];
    ``columns``: relation, column, nullable. The child is ``0..1`` if its columns are unique,
    the parent ``0..1`` if any foreign-key column may be null; identifying if the primary key
    holds all of them. Column pairs stop at the shorter list.
    """
    fk = constraints.where("type = 'FOREIGN_KEY'")
    unique = constraints.where("type in ('PRIMARY_KEY', 'UNIQUE')").groupBy("relation").agg(F.collect_set(F.array_sort("columns")).alias("__unique"), F.first(F.when(F.col("type") == "PRIMARY_KEY", F.array_sort("columns")), ignorenulls=True).alias("__pk"))
    nullable = columns.where("nullable").groupBy("relation").agg(F.collect_set("column").alias("__nullable"))
    j = fk.join(unique, "relation", "left").join(nullable, "relation", "left")
    size = F.least(F.size("columns"), F.size("referenced_columns"))
    return j.select(
        "relation", "name", "referenced_table",
        F.array_join(F.transform(F.arrays_zip(F.slice("columns", F.lit(1), size).alias("a"), F.slice("referenced_columns", F.lit(1), size).alias("b")), lambda p: F.concat(p["a"], F.lit("="), p["b"])), ",").alias("pairs"),
        F.when(F.coalesce(F.array_contains("__unique", F.array_sort("columns")), F.lit(False)), "0..1").otherwise("0..*").alias("child"),
        F.when(F.coalesce(F.arrays_overlap("columns", "__nullable"), F.lit(False)), "0..1").otherwise("1").alias("parent"),
        F.coalesce(F.size(F.array_except("columns", F.coalesce("__pk", F.array()))) == 0, F.lit(False)).alias("identifying"),
    )


def column_badges(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """(relation, column, markers): PK, FK, UQ and CHECK of every column."""
    marks = constraints.select("relation", F.explode("columns").alias("column"), F.when(F.col("type") == "PRIMARY_KEY", "PK").when(F.col("type") == "FOREIGN_KEY", "FK").when(F.col("type") == "UNIQUE", "UQ").when(F.col("type") == "CHECK", "CHECK").alias("m"))
    per = marks.groupBy("relation", "column").agg(F.array_sort(F.collect_set("m")).alias("m"))
    return columns.join(per, ["relation", "column"], "left").select("relation", "column", F.array_join(F.coalesce("m", F.array()), " ").alias("markers"))


def er_order(tables: DataFrame, references: DataFrame) -> DataFrame:
    """Order of a diagram's tables by name, the hub moved to the second place if there are three or more."""
    counted = tables.join(references.groupBy(F.col("referenced_table").alias("table")).agg(F.count("*").alias("incoming")), "table", "left").fillna(0, ["incoming"])
    w = Window.partitionBy("diagram")
    hub = counted.withColumns({"__rank": F.row_number().over(w.orderBy(F.desc("incoming"), "table")), "__size": F.count("*").over(w), "__place": F.row_number().over(w.orderBy("table"))})
    is_hub = (F.col("__rank") == 1) & (F.col("incoming") > 1) & (F.col("__size") >= 3)
    key = F.when(is_hub, 1.5).otherwise(F.col("__place").cast("double"))
    return hub.withColumn("place", F.row_number().over(w.orderBy(key, "table"))).select("diagram", "table", "incoming", "place")


def branch_counts(transitions: DataFrame) -> DataFrame:
    """Transitions of each (from, action) with the number of its distinct outcomes."""
    return transitions.groupBy("from_state", "action").agg(
        F.count_distinct(F.concat_ws("\u0000", F.coalesce("to_state", F.lit("")), F.coalesce("outcome", F.lit("")))).alias("outcomes"), F.count("*").alias("observations")
    )


def action_transitions(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, from_state, action, to_state) along PERFORMED_ON and TRANSITIONS_TO."""
    on = edges.where("type = 'PERFORMED_ON'").select(*keys, F.col("src").alias("action"), F.col("dst").alias("from_state"))
    to = edges.where("type = 'TRANSITIONS_TO'").select(*keys, F.col("src").alias("action"), F.col("dst").alias("to_state"))
    return on.join(to, [*keys, "action"]).distinct()


def search(documents: DataFrame, query: str, limit: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """First matches of a text in title, id, type and description, in order of id, equal ids by ``keys``; the limit is the feature."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "id", "type", "description")]))
    return documents.where(F.contains(text, F.lit(query.lower()))).orderBy("id", *keys).limit(limit)


def search_index(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "type", F.col("display_name").alias("title"), "description", page_path(F.col("type"), F.col("id")).alias("url"))


def top_per_kind(diff: DataFrame, per_kind: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    """The first changes of each kind with the number left over."""
    order = [c for c in ("id", *keys)]
    # a rank with nothing beside it is cut to the first rows before the shuffle, so that a kind's rows don't meet in one task
    first = diff.withColumn("__n", F.row_number().over(Window.partitionBy("change").orderBy(*order))).where(F.col("__n") <= per_kind)
    counts = diff.groupBy("change").agg(F.count("*").alias("__all"))  # at most one row per kind of change
    return first.join(F.broadcast(counts), "change").select("change", "id", F.greatest(F.lit(0), F.col("__all") - per_kind).alias("more"))


def flows_using(reached: DataFrame, targets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, target, flow): flows that reach a table or column; a column is used as well where its table is reached.

    ``reached``: keys, source, node of :func:`flow_reach`; ``targets``: keys, id, type.
    """
    hits = reached.select(*keys, F.col("node").alias("__at"), F.col("source").alias("flow"))
    table_of = F.when(F.col("type") == "DB_COLUMN", F.regexp_replace("id", r"^column:(.*)\.[^.]*$", "table:$1"))
    asked = targets.where("type in ('DB_TABLE', 'DB_COLUMN')").select(*keys, F.col("id").alias("target"), F.explode(F.array_compact(F.array(F.col("id"), table_of))).alias("__at"))
    return asked.join(hits, [*keys, "__at"]).select(*keys, "target", "flow").distinct()


def collection_index(nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, directory, id, title): the members of every page directory."""
    directory = coded(F.col("type"), PAGE_DIRECTORIES, "other").alias("directory")
    return nodes.select(*keys, directory, "id", F.coalesce(blank_to_null(F.col("display_name")), F.col("id")).alias("title"))


def observed_screen_edges(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Observed NAVIGATES_TO edges between two screens; ``edges`` has ``confidence``."""
    screens = nodes.where("type = 'SCREEN'").select(*keys, F.col("id").alias("__id")).distinct()
    out = edges.where("type = 'NAVIGATES_TO' and confidence = 'OBSERVED'")
    for end in ("src", "dst"):
        out = out.withColumn("__id", F.col(end)).join(screens, [*keys, "__id"], "left_semi").drop("__id")
    return out


def state_report(nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, state): the stale nodes, and those with an open conflict."""
    states = F.array_compact(F.array(F.when(F.col("stale"), "STALE"), F.when(F.col("conflicted"), "CONFLICTED")))
    return nodes.select(*keys, "id", F.explode(states).alias("state"))


def replace_references(pages: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, page, reference, found, html): what each ``data-ref`` of a page becomes, a link or a marked broken reference.

    Every distinct reference of a page is looked up once; ``pages``: keys, page, references (array of ids).
    """
    asked = pages.select(*keys, "page", F.explode(F.array_distinct("references")).alias("reference"))
    known = nodes.select(*keys, F.col("id").alias("reference"), page_path(F.col("type"), F.col("id")).alias("__url")).dropDuplicates([*keys, "reference"])
    met = asked.join(known, [*keys, "reference"], "left")
    text = html_escape(F.col("reference"))
    link = F.concat(F.lit('<a href="'), F.col("__url"), F.lit('">'), text, F.lit("</a>"))
    broken = F.concat(F.lit('<span class="broken-ref">'), text, F.lit("</span>"))
    return met.select(*keys, "page", "reference", F.col("__url").isNotNull().alias("found"), F.coalesce(link, broken).alias("html"))


def stale_outputs(previous: DataFrame, expected: DataFrame) -> DataFrame:
    """Files of an earlier run that this one doesn't make."""
    return previous.select("path").distinct().join(expected.select("path"), "path", "left_anti")


def write_pages(pages: DataFrame, folder: str) -> None:
    """Write (path, body) rows as files below a shared folder; paths must stay inside it."""
    import os

    def write(rows) -> None:  # noqa: ANN001
        for r in rows:
            target = os.path.realpath(os.path.join(folder, r["path"]))
            if not target.startswith(os.path.realpath(folder) + os.sep):
                raise ValueError(f"{r['path']} leaves the folder")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w", encoding="utf-8") as f:
                f.write(r["body"])

    pages.select("path", "body").foreachPartition(write)
