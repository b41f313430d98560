"""Resolver joins: a match becomes an edge only if it is the only one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.ids import segments, template_matches
from evigraph.session import fits, union_all


def unique_match(candidates: DataFrame, left: Sequence[str], candidate: str) -> tuple[DataFrame, DataFrame]:
    """(edges, warnings) of (left, candidate) pairs.

    One candidate makes an edge, several make a warning with their number and the least of
    them in order; none makes nothing. Counting is a partial aggregate, so that a hot left
    row with many candidates is never gathered whole.
    """
    per = candidates.select(*left, candidate).distinct().groupBy(*left).agg(F.count("*").alias("candidates"), F.min(candidate).alias(candidate), F.max(candidate).alias("last_candidate"))
    return per.where("candidates = 1").select(*left, candidate), per.where("candidates > 1")


def path_join(calls: DataFrame, templates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Calls (call_id, method, path) with the templates (endpoint_id, method, path) they match.

    Equi-join on method and number of segments, slots by a residual over the segments. A
    literal first segment is added to the key where neither side has a slot there.
    """
    prep = lambda d, p: d.withColumns({"__m": F.upper("method"), f"__{p}": segments(F.col("path")), "__n": F.size(segments(F.col("path")))})
    c = prep(calls, "l").drop("method", "path")
    t = prep(templates, "r").drop("method", "path")
    return c.join(t, [*keys, "__m", "__n"]).where(template_matches(F.col("__l"), F.col("__r"))).drop("__m", "__n", "__l", "__r")


def contained_sql(spans: DataFrame, statements: DataFrame, most: int = 5_000) -> DataFrame:
    """(span_id, statement_id) where one normalized text contains the other.

    ``spans`` and ``statements`` have ``sql``. Statements are the application's own texts: a
    stated query set that meets all distinct span texts in blocks of about ``most``, each
    broadcast; beyond one block there are as many passes over the distinct texts as blocks.
    """
    s = spans.where(F.col("sql").isNotNull() & (F.trim("sql") != "")).select("span_id", F.col("sql").alias("__a"))
    distinct = s.select("__a").distinct()
    q = statements.where(F.col("sql").isNotNull() & (F.trim("sql") != "")).select("statement_id", F.col("sql").alias("__b"))
    blocks = 1 if fits(q, most) else -(-2 * q.count() // most)
    either = F.contains(F.col("__a"), F.col("__b")) | F.contains(F.col("__b"), F.col("__a"))
    block = F.pmod(F.xxhash64("statement_id", "__b"), F.lit(blocks))
    met = union_all([distinct.join(F.broadcast(q.where(block == k)), either) for k in range(blocks)])
    return met.join(s, "__a").select("span_id", "statement_id")


def first_by(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per ``by`` in an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def with_fallback(left: DataFrame, exact: DataFrame, loose: DataFrame, exact_on: Sequence[str], loose_on: Sequence[str], value: str) -> DataFrame:
    """Value by the exact key, else by the loose one; both lookups are unique in their keys."""
    e = exact.select(*exact_on, F.col(value).alias("__exact"))
    f = loose.select(*loose_on, F.col(value).alias("__loose"))
    return left.join(e, list(exact_on), "left").join(f, list(loose_on), "left").withColumn(value, F.coalesce("__exact", "__loose")).drop("__exact", "__loose")


def stubs(references: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Referenced ids that aren't known, to be added as stub nodes."""
    return references.select(on).where(F.col(on).isNotNull()).distinct().join(known.select(on), on, "left_anti")


def nth_mock(requests: DataFrame, mocks: DataFrame) -> DataFrame:
    """Each request takes the mock of its own turn; the last mock repeats.

    ``requests``: scenario, method, path, seq; ``mocks``: scenario, method, path, position, mock_id.
    """
    by = ["scenario", "method", "path"]
    r = requests.withColumn("__turn", F.row_number().over(Window.partitionBy(*by).orderBy("seq")))
    m = mocks.withColumn("__turn", F.row_number().over(Window.partitionBy(*by).orderBy("position")))
    count = m.groupBy(*by).agg(F.max("__turn").alias("__most"))
    return r.join(count, by, "left").withColumn("__turn", F.least("__turn", "__most")).drop("__most").join(m.select(*by, "__turn", "mock_id"), [*by, "__turn"], "left").drop("__turn")
