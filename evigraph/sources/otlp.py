"""Trace exports in OTLP JSON to flat spans.

Both spellings of keys, the ``data`` wrapper, raw arrays of resource spans and gzip by content
are read. Text goes through ``from_json`` with one schema of both spellings; only gzip content
needs Python. Nanoseconds stay in 64-bit columns, since timestamps hold microseconds.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions.codes import span_boundary, span_kind, span_status, trace_hex
from evigraph.functions.mask import mask_key_values

_VALUE = "struct<stringValue:string,string_value:string,boolValue:boolean,bool_value:boolean,intValue:string,int_value:string,doubleValue:double,double_value:double,bytesValue:string,bytes_value:string,arrayValue:string,array_value:string,kvlistValue:string,kvlist_value:string>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_EVENT = f"struct<name:string,timeUnixNano:string,time_unix_nano:string,attributes:{_ATTRS}>"
_LINK = f"struct<traceId:string,trace_id:string,spanId:string,span_id:string,traceState:string,trace_state:string,attributes:{_ATTRS}>"
_SPAN = (
    "struct<traceId:string,trace_id:string,spanId:string,span_id:string,parentSpanId:string,parent_span_id:string,name:string,kind:string,"
    "startTimeUnixNano:string,start_time_unix_nano:string,endTimeUnixNano:string,end_time_unix_nano:string,"
    f"attributes:{_ATTRS},events:array<{_EVENT}>,links:array<{_LINK}>,status:struct<code:string,message:string>>"
)
_SCOPE = f"struct<scope:struct<name:string,version:string>,spans:array<{_SPAN}>>"
_RESOURCE = f"struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<{_SCOPE}>,scope_spans:array<{_SCOPE}>>"
_DOCUMENT = f"struct<resourceSpans:array<{_RESOURCE}>,resource_spans:array<{_RESOURCE}>,data:array<{_RESOURCE}>>"


def any_value(v: Column) -> Column:
    """An attribute value as text; bytes are withheld, arrays and lists stay JSON text."""
    return F.coalesce(
        v["stringValue"], v["string_value"], v["boolValue"].cast("string"), v["bool_value"].cast("string"), v["intValue"], v["int_value"],
        v["doubleValue"].cast("string"), v["double_value"].cast("string"), F.when(F.coalesce(v["bytesValue"], v["bytes_value"]).isNotNull(), "[bytes]"),
        v["arrayValue"], v["array_value"], v["kvlistValue"], v["kvlist_value"],
    )


def attribute_map(attributes: Column) -> Column:
    """Attributes as a map; the last of a repeated key counts, blank keys are left out."""
    pairs = F.filter(F.transform(attributes, lambda a: F.struct(a["key"].alias("key"), any_value(a["value"]).alias("value"))), lambda a: F.coalesce(F.trim(a["key"]), F.lit("")) != "")
    last = F.filter(pairs, lambda a, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda b: b["key"] == a["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of trace files, one row per JSON document; gzip is told by its magic bytes."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, raw in zip(b["path"], b["content"], strict=True):
                text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace")
                lines = [x for x in text.splitlines() if x.strip()]
                one_each = len(lines) > 1 and all(x.lstrip()[:1] in "{[" and x.rstrip()[-1:] in "}]" for x in lines)
                rows += [(file, x) for x in (lines if one_each else [text])]
            yield pd.DataFrame(rows, columns=["file", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(unpack, "file string, text string")


def spans(docs: DataFrame, layer_key: str = "app.layer") -> DataFrame:
    """Flat spans of (file, text) documents; unreadable documents give none."""
    bare = F.trim("text").startswith("[")
    parsed = docs.select("file", F.from_json(F.when(bare, F.concat(F.lit('{"data":'), F.col("text"), F.lit("}"))).otherwise(F.col("text")), _DOCUMENT).alias("d"))
    resources = parsed.select("file", F.explode(F.coalesce("d.resourceSpans", "d.resource_spans", "d.data")).alias("r"))
    scopes = resources.select("file", attribute_map(F.col("r.resource.attributes")).alias("resource"), F.explode(F.coalesce("r.scopeSpans", "r.scope_spans")).alias("sc"))
    each = scopes.select("file", "resource", F.col("sc.scope.name").alias("scope_name"), F.col("sc.scope.version").alias("scope_version"), F.posexplode("sc.spans").alias("at", "s"))
    both = lambda a, b: F.coalesce(F.col(f"s.{a}"), F.col(f"s.{b}"))
    nano = lambda a, b: F.coalesce(both(a, b).try_cast("bigint"), F.lit(0).cast("bigint"))
    flat = each.select(
        "file", "at", trace_hex(both("traceId", "trace_id")).alias("trace_id"), trace_hex(both("spanId", "span_id")).alias("span_id"),
        F.nullif(trace_hex(both("parentSpanId", "parent_span_id")), F.lit("")).alias("parent_span_id"), F.col("s.name").alias("name"), span_kind(F.col("s.kind")).alias("kind"),
        nano("startTimeUnixNano", "start_time_unix_nano").alias("start_unix_nano"), nano("endTimeUnixNano", "end_time_unix_nano").alias("end_unix_nano"),
        span_status(F.col("s.status.code")).alias("status_code"), mask_key_values(attribute_map(F.col("s.attributes"))).alias("attrs"), mask_key_values(F.col("resource")).alias("resource"),
        "scope_name", "scope_version",
        F.transform(F.coalesce("s.events", F.array()), lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["timeUnixNano"], e["time_unix_nano"]).try_cast("bigint").alias("time_unix_nano"), mask_key_values(attribute_map(e["attributes"])).alias("attrs"))).alias("events"),
        F.transform(F.coalesce("s.links", F.array()), lambda e: F.struct(trace_hex(F.coalesce(e["traceId"], e["trace_id"])).alias("trace_id"), trace_hex(F.coalesce(e["spanId"], e["span_id"])).alias("span_id"))).alias("links"),
    )
    return flat.where("trace_id <> '' and span_id <> ''").withColumn("boundary", span_boundary(F.col("kind"), F.col("attrs"), F.col("name"), layer_key))


def merged_spans(flat: DataFrame) -> DataFrame:
    """One row per (trace, span); of repeated ones the first of the files in order wins."""
    w = Window.partitionBy("trace_id", "span_id").orderBy("file", "at")
    return flat.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "at")


def warnings_of(flat: DataFrame) -> DataFrame:
    """Spans that end before they start or lack a time."""
    return flat.where("start_unix_nano = 0 or end_unix_nano < start_unix_nano").select("trace_id", "span_id", F.when(F.col("start_unix_nano") == 0, "missing start time").otherwise("ends before it starts").alias("warning"))
