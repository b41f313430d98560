"""Problem 2 against the standard library's zone rules."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigraph.operators import timestamps as t


def micros(spark, pairs, day_first=True):
    df = spark.createDataFrame([(i, a, z) for i, (a, z) in enumerate(pairs)], "i int, s string, z string").withColumn("parts", t.components(F.col("s")))
    out = t.with_utc_micros(df, F.col("z"), F.lit(day_first)).orderBy("i").collect()
    return [r["utc_micros"] for r in out]


def utc(*a, us=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000 + us


@pytest.mark.parametrize(
    ("stamp", "zone", "want"),
    [
        ("2024-01-01T02:01:30.829Z", "Asia/Tokyo", utc(2024, 1, 1, 2, 1, 30, us=829000)),
        ("2024-01-02t12:34:58.674496047z", None, utc(2024, 1, 2, 12, 34, 58, us=674496)),
        ("2024-01-03T12:16:03+09:00[Asia/Tokyo]", None, utc(2024, 1, 3, 3, 16, 3)),
        ("2024-01-01 17:27:03+11", None, utc(2024, 1, 1, 6, 27, 3)),
        ("Fri, 02 Aug 2024 01:21:10 +1000", None, utc(2024, 8, 1, 15, 21, 10)),
        ("2024-07-01 09:32:44 CEST", None, utc(2024, 7, 1, 7, 32, 44)),
        ("1704334554908", "Asia/Tokyo", 1704334554908000),
        ("1764498613203728076", None, 1764498613203728),
        ("1704193167", None, 1704193167000000),
        ("2024-060T00:00:01Z", None, utc(2024, 2, 29, 0, 0, 1)),
        ("20240102T024825Z", None, utc(2024, 1, 2, 2, 48, 25)),
        ("20240103211637", "Asia/Kolkata", utc(2024, 1, 3, 15, 46, 37)),
        ("10 Apr 2024, 18:23", "UTC", utc(2024, 4, 10, 18, 23)),
        ("Apr 1, 2024 12:33 AM", "UTC", utc(2024, 4, 1, 0, 33)),
        ("2024年9月5日 1時02分03秒", "Asia/Tokyo", utc(2024, 9, 4, 16, 2, 3)),
        ("05/06/2024 10:00:00 PM", "UTC", utc(2024, 6, 5, 22)),
        (" 31.12.2023 22:18:19\t", "UTC", utc(2023, 12, 31, 22, 18, 19)),
        ("2024-10-27T02:30:00", "Europe/Berlin", utc(2024, 10, 27, 0, 30)),
        ("2024-03-31 02:30", "Europe/Berlin", utc(2024, 3, 31, 1, 30)),
        ("2024-01-05", " ", utc(2024, 1, 5)),
        ("2024-07-01T12:00[Europe/Berlin]", "Asia/Tokyo", utc(2024, 7, 1, 10)),
    ],
)
def test_forms(spark, stamp, zone, want):
    assert micros(spark, [(stamp, zone)]) == [want]


def test_unreadable(spark):
    bad = [None, "", " ", "yesterday", "n/a", "--", "2024-02-30", "0000-00-00 00:00:00", "2023-366T00:00:00Z", "32.01.2024 10:00:00", "2024-01-01 25:00:00", "13:05 2024", "2024-01-01 10:00:00 XYZ", "13/13/2024 10:00:00", "2024-01-01T10:00:00+19:00"]
    assert micros(spark, [(b, "UTC") for b in bad]) == [None] * len(bad)
    assert micros(spark, [("2024-01-01 10:00", "Mars/Base"), ("2024-01-01T10:00Z", "Mars/Base")]) == [None, utc(2024, 1, 1, 10)]


def test_each_exporter_has_its_order(spark):
    rows = [(1, "01/02/2024 00:00:00", "a"), (2, "01/13/2024 00:00:00", "a"), (3, "01/02/2024 00:00:00", "b"), (4, "13/02/2024 00:00:00", "b"), (5, "01/02/2024 00:00:00", None)]
    df = spark.createDataFrame([(i, s, e, "UTC", "x") for i, s, e in rows], "id long, created_at string, exporter string, export_zone string, parts string")
    got = {r["row_key"]: r["utc_micros"] for r in t.stamps_of_tasks(df).collect()}
    assert got == {"1": utc(2024, 1, 2), "2": utc(2024, 1, 13), "3": utc(2024, 2, 1), "4": utc(2024, 2, 13), "5": utc(2024, 2, 1)}
    assert t.stamps_of_tasks(df.limit(0)).collect() == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.datetimes(datetime(1950, 1, 1), datetime(2099, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "America/Sao_Paulo", "Asia/Kolkata", "Australia/Sydney", "UTC"])), min_size=30, max_size=30))
def test_wall_clock_agrees_with_zone_rules(spark, stamps):
    def brute(d, z):  # the earlier of two instants; a skipped time with the offset before the change
        zone = ZoneInfo(z)
        first = d.replace(tzinfo=zone, fold=0)
        return (first - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)

    assert micros(spark, [(d.isoformat(sep=" "), z) for d, z in stamps]) == [brute(d, z) for d, z in stamps]
