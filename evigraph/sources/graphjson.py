"""Graphs as JSON documents, fragment folders, caches, configuration and change lists."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions.codes import change_category, change_type, repository_relative
from evigraph.schema import EDGE, NODE

VERSION = "1.0"
_META = T.StructType([T.StructField(n, T.StringType()) for n in ("schemaVersion", "projectId", "targetCommit", "analyzedAt")])


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, nodes, edges) of a graph document; another version or unknown top-level keys raise."""
    known = {"schemaVersion", "projectId", "targetCommit", "analyzedAt", "nodes", "edges"}
    keys = spark.read.text(path, wholetext=True).select(F.explode(F.json_object_keys("value")).alias("k")).distinct()
    strange = [r["k"] for r in keys.where(~F.col("k").isin(*known)).limit(20).collect()]
    if strange:
        raise ValueError(f"unknown properties {sorted(strange)}")
    schema = T.StructType([*_META.fields, T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE))])
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    version = doc.select("schemaVersion").first()
    if version is None or version[0] != VERSION:
        raise ValueError(f"schema version {version and version[0]} isn't {VERSION}")
    return doc.select(*[f.name for f in _META.fields]), doc.select(F.inline("nodes")), doc.select(F.inline("edges"))


def write_graph(meta: dict[str, str], nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines sorted by id, written aside and moved into place.

    The two lists stay distributed files; only the small root is one document.
    """
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(os.path.join(path + ".staging", name))
    with open(os.path.join(path + ".staging", "graph.json"), "w", encoding="utf-8") as f:
        json.dump({"schemaVersion": VERSION, **meta}, f, sort_keys=True)
    if os.path.exists(path):
        os.rename(path, path + ".previous")
    os.rename(path + ".staging", path)


def write_fragment(df: DataFrame, folder: str, adapter: str) -> None:
    df.withColumn("adapter_name", F.lit(adapter)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("adapter_name").parquet(folder)


@dataclass(frozen=True)
class Requirements:
    """What a cached fragment must match; None asks nothing."""

    commit: str | None = None
    config_hash: str | None = None
    adapter: str | None = None
    version: str | None = None


def accepted(entries: DataFrame, need: Requirements) -> DataFrame:
    """Cache entries that meet the requirements, the newest per (kind, project, name)."""
    ok = F.lit(True)
    for f in fields(need):
        wanted = getattr(need, f.name)
        if wanted is not None:
            ok = ok & F.col(f.name).eqNullSafe(F.lit(wanted))
    w = Window.partitionBy("kind", "project", "name").orderBy(F.desc("created_at"), F.desc("sha256"))
    return entries.where(ok).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def content_hash(df: DataFrame, key: str) -> str:
    """SHA-256 of a frame's rows, order-free: two digests of every row are added up exactly, so that repeated rows count."""
    text = F.to_json(F.struct(*sorted(df.columns)))
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    low, high, n = df.agg(total(text), total(F.lit("high"), text), F.count(F.lit(1))).first()
    import hashlib

    return hashlib.sha256(f"{key}|{low}|{high}|{n}".encode()).hexdigest()


def name_status(lines: DataFrame, workspace: str = "graphdocs") -> DataFrame:
    """(path, previous_path, change, category, previous_category) of name-status lines in ``value``.

    A line without a tab is an untracked file. Paths outside the repository raise on reading.
    """
    parts = F.split("value", "\t")
    tracked = F.size(parts) > 1
    renamed = tracked & F.col("value").rlike("^[RC][0-9]*\t")
    path = F.when(renamed, F.get(parts, F.lit(2))).when(tracked, F.get(parts, F.lit(1))).otherwise(F.col("value"))
    made = lines.where(F.trim("value") != "").select(
        path.alias("path"), F.when(renamed, F.get(parts, F.lit(1))).alias("previous_path"), F.when(tracked, change_type(F.col("value"))).otherwise("ADDED").alias("change"),
    )
    safe = F.when(repository_relative(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("path outside the repository: "), F.col("path"))))
    return made.withColumns({"path": safe, "category": change_category(F.col("path"), workspace), "previous_category": change_category(F.col("previous_path"), workspace)})


def categories(changes: DataFrame) -> DataFrame:
    return changes.select(F.explode(F.array_compact(F.array("category", F.when(F.col("previous_path").isNotNull(), F.col("previous_category"))))).alias("category")).distinct()


def load_config(path: str, known: dict[str, object]) -> dict[str, object]:
    """JSON configuration with defaults; unknown keys raise."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    strange = set(given) - set(known)
    if strange:
        raise ValueError(f"unknown configuration keys {sorted(strange)}")
    return {**known, **given}


def inside(root: str, path: str) -> str:
    """The absolute path if it lies below ``root``; raises otherwise."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError(f"{path} leaves {root}")
    return full


DIFF = "kind string, change string, id string, changed_fields array<string>"


def write_diff(diff: DataFrame, path: str) -> None:
    """(kind, change, id, changed_fields) rows as JSON lines, replacing an earlier difference."""
    diff.select("kind", "change", "id", "changed_fields").write.mode("overwrite").json(path)


def read_diff(spark: SparkSession, path: str) -> DataFrame:
    """A written difference; one that isn't there or can't be read is empty."""
    try:
        rows = spark.read.schema(DIFF).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], DIFF)
    return rows.where("id is not null and change is not null")


def require_managed(spark: SparkSession, folder: str, marker: str = ".evigraph-output") -> None:
    """Raise if a folder has files but no marker of an earlier run; otherwise leave the marker. Works on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = jvm.org.apache.hadoop.fs.Path(path, marker)
    if fs.exists(path) and not fs.exists(mark) and len(fs.listStatus(path)) > 0:
        raise ValueError(f"{folder} holds files that no run of ours wrote")
    fs.mkdirs(path)
    if not fs.exists(mark):
        fs.create(mark).close()
