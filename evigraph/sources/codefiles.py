"""Source files as facts: Java symbols, endpoints and DAO methods; TypeScript routes and calls.

Files are read whole, one per row, and scanned independently by a small scanner over comments,
strings, braces and annotations; it isn't a compiler and leaves out what it can't tell.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.ids import edge_id, signature
from evigraph.sources.sqlfiles import sql_path_of

_TYPE = re.compile(r"((?:@\w[\w.]*(?:\((?:[^()]|\([^()]*\))*\))?\s*)*)(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(class|interface|record|enum)\s+(\w+)[^{;]*\{")
_METHOD = re.compile(r"((?:@\w[\w.]*(?:\((?:[^()\"]|\"[^\"]*\"|\((?:[^()\"]|\"[^\"]*\")*\))*\))?\s*)*)(?:(?:public|protected|private|static|final|default|abstract|synchronized)\s+)*(?:<[^<>]*>\s*)?([\w.]+(?:<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)?(?:\[\])*)\s+(\w+)\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)[^{};]*[{;]")
_ANNOTATION = re.compile(r"@(\w[\w.]*)(?:\(((?:[^()\"]|\"[^\"]*\"|\((?:[^()\"]|\"[^\"]*\")*\))*)\))?")
_CONSTANT = re.compile(r"static\s+final\s+String\s+(\w+)\s*=\s*([^;]+);")
# Mapping annotations and their methods, DAO annotations and their operations, response builders and their statuses.
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": ""}
DAO_OPERATIONS = {"Select": "SELECT", "Insert": "INSERT", "Update": "UPDATE", "Delete": "DELETE", "BatchInsert": "BATCH_INSERT", "BatchUpdate": "BATCH_UPDATE", "BatchDelete": "BATCH_DELETE", "Function": "FUNCTION", "Procedure": "PROCEDURE", "Script": "SCRIPT", "SqlProcessor": "SQL_PROCESSOR"}
BUILDERS = {"ok": "200", "created": "201", "accepted": "202", "noContent": "204", "badRequest": "400", "notFound": "404", "unprocessableEntity": "422", "internalServerError": "500"}
LOCATIONS = {"PathVariable": "PATH", "RequestParam": "QUERY", "RequestHeader": "HEADER", "CookieValue": "COOKIE", "RequestBody": "BODY", "ModelAttribute": "MODEL"}
_COLUMNS = "path string, package string, type_name string, type_kind string, annotations array<string>, member string, member_signature string, method string, route string, parameters string, body_type string, statuses array<string>, operation string, summary string"


def without_comments(text: str) -> str:
    """Comments blanked out, strings kept."""
    return re.sub(r'"(?:[^"\\\n]|\\.)*"|//[^\n]*|/\*.*?\*/', lambda m: m[0] if m[0][0] == '"' else re.sub(r"[^\n]", " ", m[0]), text, flags=re.DOTALL)


def fold(expression: str, constants: dict[str, str]) -> str | None:
    """Text of a string expression of literals, constants and ``+``; null if it isn't one."""
    out = ""
    for part in re.split(r"\+(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", expression.strip()):
        part = part.strip()
        if len(part) > 1 and part[0] == part[-1] == '"':
            out += part[1:-1]
        elif (name := part.rsplit(".", 1)[-1]) in constants:
            out += constants[name]
        else:
            return None
    return out


def constants_of(code: str) -> dict[str, str]:
    known: dict[str, str] = {}
    for _ in range(4):  # constants may build on one another
        for name, value in _CONSTANT.findall(code):
            if (text := fold(value, known)) is not None:
                known[name] = text
    return known


def _values(arguments: str, names: tuple[str, ...], constants: dict[str, str]) -> list[str]:
    named = re.search(rf"\b(?:{'|'.join(names)})\s*=\s*(\{{[^}}]*\}}|[^,]+(?:\+[^,]+)*)", arguments)
    raw = named[1] if named else "" if re.search(r"\w+\s*=", arguments) else arguments
    return [v for x in re.split(r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", raw.strip().strip("{}")) if x.strip() and (v := fold(x, constants)) is not None]


def _block(code: str, open_at: int) -> int:
    depth = 0
    for m in re.compile(r'"(?:[^"\\\n]|\\.)*"|[{}]').finditer(code, open_at):
        depth += (m[0] == "{") - (m[0] == "}")
        if depth == 0 and m[0] == "}":
            return m.end()
    return len(code)


def scan_java(path: str, text: str) -> list[tuple]:
    """Rows of the types and members of one file; endpoints and DAO methods carry their own columns."""
    code = without_comments(text)
    package = (re.search(r"\bpackage\s+([\w.]+)\s*;", code) or ["", ""])[1]
    constants, out = constants_of(code), []
    for t in _TYPE.finditer(code):
        marks = {a: b or "" for a, b in _ANNOTATION.findall(t[1] or "")}
        base = next((_values(marks[m], ("value", "path"), constants) for m in ("RequestMapping",) if m in marks), []) or [""]
        out.append((path, package, t[3], t[2], sorted(marks), None, None, None, None, None, None, [], None, _doc(text, t.start())))
        body, end = code[t.end() : _block(code, t.end() - 1)], 0
        for m in _METHOD.finditer(body):
            if m.start() < end or m[2] in ("return", "new", "throw", "else"):
                continue
            stop = _block(body, m.end() - 1) if m[0].endswith("{") else m.end()
            end = stop
            own = {a: b or "" for a, b in _ANNOTATION.findall(m[1] or "")}
            sig = signature(f"{m[3]}({m[4]})")
            doc = _doc(text, t.end() + m.start())
            mapped = [k for k in own if k in MAPPINGS]
            dao = next((v for k, v in DAO_OPERATIONS.items() if k in own), None) if "Dao" in marks else None
            if not mapped:
                out.append((path, package, t[3], t[2], sorted(own), m[3], sig, None, None, None, None, [], dao, doc))
            for k in mapped:
                verbs = [MAPPINGS[k]] if MAPPINGS[k] else re.findall(r"RequestMethod\.(\w+)", own[k]) or [""]
                params = [(n, LOCATIONS[a], kind) for a, kind, n in re.findall(r"@(\w+)(?:\([^()]*\))?\s+(?:final\s+|@\w+\s+)*([\w.<>\[\], ]+?)\s+(\w+)\s*(?:,|$)", m[4]) if a in LOCATIONS]
                statuses = re.findall(r"HttpStatus\.(\w+)", own.get("ResponseStatus", "") + body[m.start() : stop]) + [BUILDERS[b] for b in re.findall(r"ResponseEntity\s*\.\s*(\w+)\s*\(", body[m.start() : stop]) if b in BUILDERS]
                for verb in verbs:
                    for a in base:
                        for b in _values(own[k], ("value", "path"), constants) or [""]:
                            out.append((path, package, t[3], t[2], sorted(own), m[3], sig, verb, f"/{a}/{b}", json.dumps([{"name": n, "location": loc, "type": kind} for n, loc, kind in params]), next((kind for _, loc, kind in params if loc == "BODY"), None), sorted(set(statuses)) or ["200"], None, doc))
    return out


def _doc(text: str, at: int) -> str:
    """First sentence of the doc comment that ends right before ``at``."""
    m = re.search(r"/\*\*((?:[^*]|\*(?!/))*)\*/\s*(?:@[^\n]*\n\s*)*$", text[:at])
    plain = re.sub(r"\s*\n\s*\*?\s?", " ", m[1]).strip() if m else ""
    return re.match(r"[^.。]*[.。]?", plain)[0].strip()


def java_facts(files: DataFrame) -> DataFrame:
    """Facts of (path, text) rows."""
    names = [c.strip().split(" ")[0] for c in _COLUMNS.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["text"], strict=True) for r in scan_java(p, t)], columns=names)

    return files.where(F.col("text").isNotNull()).select("path", "text").mapInPandas(scan, _COLUMNS)


def source_files(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def symbols(facts: DataFrame) -> DataFrame:
    """Nodes of types and members."""
    owner = F.concat_ws(".", F.nullif("package", F.lit("")), "type_name")
    has = lambda *xs: F.arrays_overlap("annotations", F.array(*map(F.lit, xs)))
    kind = F.when(has("Controller", "RestController"), "CONTROLLER").when(has("Service"), "APPLICATION_SERVICE").when(has("Dao"), "DOMA_DAO").otherwise("JAVA_CLASS")
    types = facts.where("member is null").select(F.concat(F.lit("class:"), owner).alias("id"), kind.alias("type"), F.col("type_name").alias("display_name"), F.col("summary").alias("description"))
    members = facts.where("member is not null").select(
        F.concat(F.lit("method:"), owner, F.lit("#"), "member_signature").alias("id"), F.when(F.col("operation").isNotNull(), "DOMA_DAO_METHOD").otherwise("JAVA_METHOD").alias("type"), F.col("member").alias("display_name"), F.col("summary").alias("description")
    )
    return types.unionByName(members).dropDuplicates(["id"])


def endpoints(facts: DataFrame) -> DataFrame:
    """Declarations in the shape of the other endpoint sources."""
    return facts.where("route is not null").select(
        F.col("method").alias("http_method"), F.col("route").alias("path"), F.concat_ws(".", "package", "type_name").alias("controller_class"), F.col("member").alias("handler_method"),
        F.col("body_type").alias("request_body_type"), F.transform("statuses", lambda s: F.struct(s.alias("status"))).alias("responses"), F.lit("JAVA_SOURCE").alias("source"), F.col("summary"),
    )


def dao_sql_edges(facts: DataFrame, sqls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, warnings): DAO methods to their SQL by convention; a method without its file is a warning."""
    where = F.udf(lambda p, t, m: sql_path_of(f"{p}.{t}" if p else t, m), "string")
    dao = facts.where("operation is not null").select(F.concat(F.lit("method:"), F.concat_ws(".", F.nullif("package", F.lit("")), "type_name"), F.lit("#"), "member_signature").alias("src"), where("package", "type_name", "member").alias("source_id"), "operation")
    joined = dao.join(sqls.select("source_id", F.lit(True).alias("__there")), "source_id", "left")
    edges = joined.where("__there").select(F.lit("EXECUTES_SQL").alias("type"), "src", F.concat(F.lit("sql:"), "source_id").alias("dst"))
    lost = joined.where("__there is null and operation in ('SELECT', 'SCRIPT', 'SQL_PROCESSOR')").select("src", F.concat(F.lit("no SQL at "), "source_id").alias("warning"))
    return edges.withColumn("id", edge_id(F.col("type"), F.col("src"), F.col("dst"))), lost


def frontend_facts(files: DataFrame) -> DataFrame:
    """(path, kind, value) of routes, client calls and labelled controls in TypeScript or markup, by patterns."""
    # The patterns of routes, calls and controls.
    patterns = {
        "ROUTE": r"(?:path\s*[:=]\s*[\"'`]|<Route[^>]*\bpath=[\"'`])([^\"'`]+)", "CALL": r"(?:fetch|axios\.\w+|api\.\w+|http\.\w+)\(\s*[\"'`]([^\"'`]+)", "CONTROL": r"<(?:button|Button|a|Link)\b[^>]*>\s*([^<>{}]+?)\s*<",
    }
    found = [files.select("path", F.lit(k).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(p), 1)).alias("value")) for k, p in patterns.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).where(F.trim("value") != "").distinct()


def scenarios(path: str) -> list[dict]:
    """Scenarios of a JSON file with its ``defaults`` merged in; a repeated or missing id raises."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    merged = [{**doc.get("defaults", {}), **s} for s in doc.get("scenarios", [])]
    names = [s.get("id") for s in merged]
    if None in names or len(set(names)) < len(names):
        raise ValueError("scenario ids must be there and unique")
    return merged
