"""Screen observations and custom documentation to graph fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions.codes import action_locator
from evigraph.functions.ids import digest, edge_id, normalize_path, ui_route
from evigraph.functions.mask import assertions_of, id_references

_POINT = "struct<route:string,state:string,name:string,screenshot:string>"
_ACTION = "struct<kind:string,role:string,name:string,label:string,value:string,resultState:string>"
_HTTP = "struct<method:string,path:string,status:int,mockId:string,`undefined`:boolean,actionSequence:int>"
OBSERVATION = (
    f"id string, title string, route string, pageUrl string, state string, screenName string, screenshot string, actions array<{_ACTION}>, "
    f"transitions array<struct<sequence:int,`from`:{_POINT},action:{_ACTION},`to`:{_POINT},condition:struct<role:string,outcome:string,scenarioOutcome:string>,relatedHttp:array<{_HTTP}>>>, "
    f"requests array<{_HTTP}>, capturedAt string"
)


def observations(texts: DataFrame) -> DataFrame:
    """Parsed observations of (text) rows; those without id or route are skipped."""
    o = texts.select(F.from_json("text", OBSERVATION).alias("o")).select("o.*")
    return o.where("coalesce(id, '') <> '' and coalesce(route, '') <> ''")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return observations(files.where(~F.col("_metadata.file_name").isin("discovery.json")).select(F.col("value").alias("text")))


def _screen(route: str) -> F.Column:  # type: ignore[name-defined]
    return F.concat(F.lit("screen:"), normalize_path(ui_route(F.col(route))))


def _state(route: str, state: str) -> F.Column:  # type: ignore[name-defined]
    return F.concat(F.lit("screen-state:"), normalize_path(ui_route(F.col(route))), F.lit("#"), F.coalesce(F.col(state), F.lit("default")))


def transitions(obs: DataFrame) -> DataFrame:
    """Flat transitions: scenario, sequence, states, action and outcome."""
    t = obs.select(F.col("id").alias("scenario"), F.explode("transitions").alias("t")).select("scenario", "t.*")
    flat = t.select("scenario", "sequence", F.col("from.route").alias("r0"), F.col("from.state").alias("s0"), F.col("to.route").alias("r1"), F.col("to.state").alias("s1"), "action", "condition", "relatedHttp")
    action = action_locator(F.col("action.kind"), F.col("action.role"), F.col("action.name"), F.col("action.label"))
    return flat.select(
        "scenario", "sequence", _state("r0", "s0").alias("from_state"), _state("r1", "s1").alias("to_state"), _screen("r0").alias("from_screen"), _screen("r1").alias("to_screen"),
        action.alias("action"), F.col("action.kind").alias("action_kind"), F.coalesce("condition.outcome", "condition.scenarioOutcome").alias("outcome"),
        F.coalesce(F.size("relatedHttp"), F.lit(0)).alias("http_calls"),
    )


def fragment(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flows, screens, states, actions and client calls with their edges."""
    flow = F.concat(F.lit("flow:"), F.col("id"))
    base = obs.select(flow.alias("flow"), F.col("id").alias("scenario"), "title", _screen("route").alias("screen"), _state("route", "state").alias("state_id"), "screenName", "screenshot", "requests", "route")
    t = transitions(obs).withColumn("flow", F.concat(F.lit("flow:"), F.col("scenario")))
    action = t.withColumn("action_id", F.concat(F.lit("ui-action:"), digest(F.col("from_state"), F.col("action"))))
    calls = base.select("flow", F.explode("requests").alias("r")).select("flow", F.concat(F.lit("http-call:"), F.upper("r.method"), F.lit(":"), normalize_path(ui_route(F.col("r.path")))).alias("call"), F.col("r.actionSequence").alias("sequence"))
    node = lambda df, i, k, name: df.select(F.col(i).alias("id"), F.lit(k).alias("type"), F.col(name).alias("display_name"))
    nodes = [node(base.withColumn("title", F.coalesce("title", "scenario")), "flow", "E2E_FLOW", "title"), node(base.withColumn("n", F.coalesce("screenName", "route")), "screen", "SCREEN", "n"), node(base, "state_id", "SCREEN_STATE", "state_id"),
             node(t, "from_screen", "SCREEN", "from_screen"), node(t, "to_screen", "SCREEN", "to_screen"), node(t, "from_state", "SCREEN_STATE", "from_state"), node(t, "to_state", "SCREEN_STATE", "to_state"), node(action, "action_id", "UI_ACTION", "action"), node(calls, "call", "HTTP_CLIENT_CALL", "call")]
    edge = lambda df, k, a, b: df.select(F.lit(k).alias("type"), F.col(a).alias("src"), F.col(b).alias("dst"))
    by_action = calls.where("sequence is not null").join(action.select("flow", "sequence", "action_id").distinct(), ["flow", "sequence"])
    edges = [edge(base, "STARTS_AT", "flow", "screen"), edge(base, "HAS_STATE", "screen", "state_id"), edge(t, "HAS_STATE", "from_screen", "from_state"), edge(t, "HAS_STATE", "to_screen", "to_state"), edge(action, "PERFORMED_ON", "action_id", "from_state"),
             edge(action, "TRANSITIONS_TO", "action_id", "to_state"), edge(t.where("from_screen <> to_screen"), "NAVIGATES_TO", "from_screen", "to_screen"), edge(calls, "CALLS_HTTP", "flow", "call"), edge(by_action, "CALLS_HTTP", "action_id", "call")]
    every = nodes[0]
    for n in nodes[1:]:
        every = every.unionByName(n)
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e)
    named = every.where("id is not null").groupBy("id", "type").agg(F.min("display_name").alias("display_name"))
    kept = all_edges.where("src is not null and dst is not null").distinct()
    return named, kept.withColumn("id", edge_id(F.col("type"), F.col("src"), F.col("dst")))


def first_capture(captures: DataFrame, states: tuple[str, ...] = ("success", "loaded", "default", "empty", "error")) -> DataFrame:
    """First capture of every screen state: by state priority, then scenario, then point."""
    rank = F.array_position(F.array(*[F.lit(s) for s in states]), F.col("state"))
    w = Window.partitionBy("screen", "state").orderBy(F.when(rank == 0, 99).otherwise(rank), "scenario", "point")
    return captures.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def previous_points(points: DataFrame) -> DataFrame:
    """Pairs of neighbouring points of a scenario in the order of ``sequence``."""
    w = Window.partitionBy("scenario").orderBy("sequence")
    return points.withColumn("next_point", F.lead("point").over(w)).where("next_point is not null")


def custom_sections(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, references, claims) of custom HTML pages (section, html)."""
    sections = pages.select(F.concat(F.lit("custom-html-section:"), "section").alias("id"), F.lit("CUSTOM_HTML_SECTION").alias("type"), F.col("section").alias("display_name"), "html")
    references = pages.select("section", F.explode(id_references(F.col("html"))).alias("id"))
    claims = pages.select("section", F.inline(assertions_of(F.col("html")))).select("section", "id", "field", F.col("value").alias("expected"))
    return sections, references, claims
