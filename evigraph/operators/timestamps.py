"""Mixed timestamp formats and time zones to UTC microseconds (problem 2).

All formats are one regex alternation with named groups. A single ``regexp_replace`` rewrites
a stamp into its components (every alternative's groups side by side, the unused ones empty),
so the regex runs once per stamp inside the JVM. Components are checked against the calendar
and assembled by integer day arithmetic; only a wall-clock time consults zone rules.

Defined results: null, blank, wordy and impossible stamps give null; a stamp's own offset,
abbreviation or ``Z`` counts first, then the zone in its brackets, then the row's zone; a null or blank zone is UTC, an unheard-of
one makes wall-clock stamps unreadable; a wall-clock time that occurs twice is the earlier
instant, a skipped one is read with the offset before the change; digits finer than
microseconds are cut off; missing parts are zero.
"""

from __future__ import annotations

import re
import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import strip
from evigraph.session import lookup_join

# Zone abbreviations that may end a stamp, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540,
    "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "BRT": -180, "BRST": -120, "ART": -180, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540,
    "AKDT": -480, "HST": -600,
}
# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_CLOCK = r"(?<h>\d{1,2}):(?<mi>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d+))?)?"
_ZONE = r"(?:\s*(?:(?<off>[+\-]\d{2}(?::?\d{2})?)|(?<abbr>[A-Za-z]{1,5})))?(?:\[(?<br>[^\]]*)\])?"
_HALF = r"(?:\s*(?<ap>[AaPp])\.?[Mm]\.?)"
_NAME = r"(?<mon>[A-Za-z]{3})[A-Za-z]*\.?"
#: The formats; an alternative may leave out any group.
FORMATS = {
    "epoch": r"(?<ep>\d{9,10}(?:\.\d+)?|\d{12,13}|\d{15,16}|\d{18,19})",
    "iso": rf"(?<y>\d{{4}})[-/.](?<mo>\d{{1,2}})[-/.](?<d>\d{{1,2}})(?:[Tt\s]\s*{_CLOCK}{_ZONE})?",
    "ordinal": rf"(?<y>\d{{4}})-(?<doy>\d{{3}})(?:[Tt\s]\s*{_CLOCK}{_ZONE})?",
    "compact": rf"(?<y>\d{{4}})(?<mo>\d{{2}})(?<d>\d{{2}})(?:[Tt]?(?<h>\d{{2}})(?<mi>\d{{2}})(?<s>\d{{2}})(?:[.,](?<f>\d+))?{_ZONE})?",
    "slashes": rf"(?<sa>\d{{1,2}})/(?<sb>\d{{1,2}})/(?<y>\d{{4}})(?:,?\s+{_CLOCK}(?:{_HALF}|{_ZONE}))?",
    "dots": rf"(?<d>\d{{1,2}})\.(?<mo>\d{{1,2}})\.(?<y>\d{{4}})(?:,?\s+{_CLOCK}(?:{_HALF}|{_ZONE}))?",
    "day_name": rf"(?:[A-Za-z]{{3,9}},?\s+)?(?<d>\d{{1,2}})[ \-]{_NAME}[ \-](?<y>\d{{4}})(?:,?\s+{_CLOCK}(?:{_HALF}|{_ZONE}))?",
    "name_day": rf"(?:[A-Za-z]{{3,9}},\s+)?{_NAME}\s+(?<d>\d{{1,2}}),?\s+(?<y>\d{{4}})(?:,?\s+{_CLOCK}(?:{_HALF}|{_ZONE}))?",
    "kanji": r"(?<y>\d{4})年\s*(?<mo>\d{1,2})月\s*(?<d>\d{1,2})日(?:\s*(?<h>\d{1,2})時(?:(?<mi>\d{1,2})分(?:(?<s>\d{1,2})秒)?)?)?",
}
GROUPS = ("y", "mo", "d", "mon", "sa", "sb", "doy", "h", "mi", "s", "f", "ap", "off", "abbr", "br", "ep")
_MARK, _GAP = "\u0001", "\u0002"


def alternation() -> tuple[str, str]:
    """The compiled alternation and the replacement that lays its components side by side."""
    parts, used = [], {g: [] for g in GROUPS}
    for i, pattern in enumerate(FORMATS.values()):
        for g in re.findall(r"\(\?<([a-z]+)>", pattern):
            if f"{g}{i}" not in used[g]:
                used[g].append(f"{g}{i}")
        seen: dict[str, int] = {}

        def name(m: re.Match, i: int = i, seen: dict = seen) -> str:
            g = m[1]
            seen[g] = seen.get(g, 0) + 1
            if seen[g] > 1:  # the same part at another place of one format
                own = f"{g}{i}x{seen[g]}"
                used[g].append(own)
                return f"(?<{own}>"
            return f"(?<{g}{i}>"

        parts.append(re.sub(r"\(\?<([a-z]+)>", name, pattern))
    return "^(?:" + "|".join(parts) + ")$", _MARK + _GAP.join("".join(f"${{{n}}}" for n in used[g]) for g in GROUPS)


def components(stamp: Column) -> Column:
    """Array of the parts in the order of ``GROUPS`` (empty where absent), or null."""
    pattern, layout = alternation()
    s = F.translate(strip(stamp), "０１２３４５６７８９：．／－", "0123456789:./-")
    laid = F.regexp_replace(s, pattern, layout)
    return F.when(laid.startswith(_MARK), F.split(F.substring(laid, 2, 1_000_000), _GAP, -1))


def kept(c: Column) -> Column:
    """Generator of ``c`` where it isn't null.

    Unlike a filter it is never pushed through the projections that compute ``c``, which
    would copy their expressions and run the regex twice.
    """
    return F.explode(F.array_compact(F.array(c)))


def slash_orders(stamps: DataFrame, by: str) -> DataFrame:
    """Per ``by`` (null as ''): whether the day comes first between slashes.

    A first part over 12 speaks for the day, a second one for the month; without any sign the
    day is taken to be first. Only counts are kept, so a hot exporter costs one row per task.
    """
    a, b = (F.col("parts")[GROUPS.index(g)].try_cast("int") for g in ("sa", "sb"))
    return (
        stamps.where(F.col("parts")[GROUPS.index("sa")] != "")
        .groupBy(F.coalesce(F.col(by), F.lit("")).alias("__by"))
        .agg((F.count_if(b > 12) <= F.count_if(a > 12)).alias("day_first"))
    )


def known_zones() -> list[str]:
    return sorted(zoneinfo.available_timezones())


def _days(y: str, m: str, d: str) -> str:
    """SQL for the days from 1970-01-01 to a proleptic Gregorian date, all in integers."""
    yy = f"({y} - if({m} <= 2, 1, 0))"
    doy = f"((153 * ({m} + if({m} > 2, -3, 9)) + 2) div 5 + {d} - 1)"
    return f"({yy} * 365 + {yy} div 4 - {yy} div 100 + {yy} div 400 + {doy} - 719468)"


def with_utc_micros(df: DataFrame, zone: Column, day_first: Column, out: str = "utc_micros") -> DataFrame:
    """Add ``out`` to rows that carry ``parts`` from :func:`components`; ``parts`` is dropped."""
    n = {g: f"nullif(element_at(__p, {i + 1}), '')" for i, g in enumerate(GROUPS)}
    whole = lambda g: f"try_cast({n[g]} as bigint)"
    month_name = "array_position(array({}), lower({}))".format(", ".join(f"'{m}'" for m in MONTHS), n["mon"])
    abbr = "element_at(map({}), upper({}))".format(", ".join(f"'{k}', {v}" for k, v in ABBREVIATIONS.items()), n["abbr"])
    off = n["off"]
    digits = f"regexp_replace(substring({off}, 2), ':', '')"
    zones = ", ".join(f"'{z}'" for z in known_zones())
    first = (
        df.withColumns({"__p": F.col("parts"), "__df": F.coalesce(day_first, F.lit(True)), "__row_zone": zone})
        .withColumn("__zone", F.coalesce(F.expr(n["br"]), F.nullif(strip(F.col("__row_zone")), F.lit("")), F.lit("UTC")))
        .withColumns({
            "__y": F.expr(whole("y")),
            "__m": F.expr(f"coalesce({whole('mo')}, case when {n['mon']} is not null then cast({month_name} as bigint) when {n['sa']} is not null then if(__df, {whole('sb')}, {whole('sa')}) when {n['doy']} is not null then 1 end)"),
            "__d": F.expr(f"coalesce({whole('d')}, case when {n['sa']} is not null then if(__df, {whole('sa')}, {whole('sb')}) when {n['doy']} is not null then 1 end)"),
            "__doy": F.expr(whole("doy")),
            "__h0": F.expr(f"coalesce({whole('h')}, 0)"),
            "__mi": F.expr(f"coalesce({whole('mi')}, 0)"),
            "__s": F.expr(f"coalesce({whole('s')}, 0)"),
            "__us": F.expr(f"cast(coalesce(rpad(substring({n['f']}, 1, 6), 6, '0'), '0') as bigint)"),
            "__ap": F.expr(f"lower({n['ap']})"),
            "__own": F.expr(f"case when {off} is not null then if(substring({off}, 1, 1) = '-', -1, 1) * (cast(substring({digits}, 1, 2) as int) * 60 + coalesce(cast(nullif(substring({digits}, 3, 2), '') as int), 0)) when {n['abbr']} is not null then {abbr} end"),
            "__tagged": F.expr(f"{off} is not null or {n['abbr']} is not null"),
            "__ep": F.expr(n["ep"]),
        })
    )
    leap = "((__y % 4 = 0 and __y % 100 <> 0) or __y % 400 = 0)"
    last = f"case when __m = 2 then if({leap}, 29, 28) when __m in (4, 6, 9, 11) then 30 else 31 end"
    hour = "case when __ap is null then __h0 else __h0 % 12 + if(__ap = 'p', 12, 0) end"
    fine = (
        f"__y between 1 and 9999 and __m between 1 and 12 and __d between 1 and {last}"
        f" and (__doy is null or __doy between 1 and if({leap}, 366, 365))"
        " and (__h0 between 0 and 23) and (__ap is null or __h0 between 1 and 12) and __mi <= 59 and __s <= 59"
        " and (not __tagged or abs(__own) <= 1080)"
    )
    local = f"(({_days('__y', '__m', '__d')} + coalesce(__doy, 1) - 1) * 86400 + ({hour}) * 3600 + __mi * 60 + __s) * 1000000 + __us"
    epoch = (
        "case when instr(__ep, '.') > 0 then cast(substring_index(__ep, '.', 1) as bigint) * 1000000"
        " + cast(rpad(substring(substring_index(__ep, '.', -1), 1, 6), 6, '0') as bigint)"
        " when length(__ep) <= 10 then cast(__ep as bigint) * 1000000 when length(__ep) <= 13 then cast(__ep as bigint) * 1000"
        " when length(__ep) <= 16 then cast(__ep as bigint) else try_cast(__ep as bigint) div 1000 end"
    )
    walled = f"case when __zone in ({zones}) or __zone rlike '^[+-][0-9]{{2}}:[0-9]{{2}}$' then unix_micros(to_utc_timestamp(timestamp_micros(__local), __zone)) end"
    done = (
        first.withColumn("__local", F.expr(f"case when {fine} then {local} end"))
        .withColumn(out, F.expr(f"case when __ep is not null then {epoch} when __local is null then null when __tagged then __local - __own * 60000000L else {walled} end"))
    )
    return done.select(*[c for c in df.columns if c != "parts"], out)


def stamps_of_tasks(tasks: DataFrame) -> DataFrame:
    """(src_table, row_key, utc_micros) of the readable ``created_at``."""
    parsed = tasks.where(F.col("id").isNotNull()).select(
        F.col("id").cast("string").alias("row_key"), F.col("export_zone").alias("zone"),
        F.coalesce(F.col("exporter"), F.lit("")).alias("__by"), kept(components(F.col("created_at"))).alias("parts"),
    )
    ordered = lookup_join(parsed, slash_orders(parsed, "__by"), ["__by"])
    return _rows("tasks", with_utc_micros(ordered, F.col("zone"), F.col("day_first")))


def stamps_of_evidence(declarations: DataFrame) -> DataFrame:
    each = declarations.select(F.col("collector_zone").alias("zone"), F.explode("evidence").alias("e"))
    parsed = each.select(F.col("e.id").alias("row_key"), "zone", kept(components(F.col("e.observed_at"))).alias("parts"))
    return _rows("endpoint_declarations", with_utc_micros(parsed, F.col("zone"), F.lit(True)))


def stamps_of_observations(observations: DataFrame) -> DataFrame:
    payload = F.col("payload")
    parsed = observations.select(
        F.col("observation_id").cast("string").alias("row_key"),
        F.get_json_object(payload, "$.environment.timezone").alias("zone"),
        kept(components(F.get_json_object(payload, "$.capturedAt"))).alias("parts"),
    )
    return _rows("raw_observations", with_utc_micros(parsed, F.col("zone"), F.lit(True)))


def _rows(src: str, df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("row_key").isNotNull())
        .select(F.lit(src).alias("src_table"), "row_key", kept(F.col("utc_micros")).alias("utc_micros"))
        .distinct()
    )
