from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismcube.operators.instants import OUTCOMES, clock_from_table, load_zones, normalise_instants, parser_of, with_profiles

FLEETS = [
    {"fleet_id": 1, "tz_name": "America/New_York", "date_order": "MDY", "std_abbr": "EST", "dst_abbr": "EDT"},
    {"fleet_id": 2, "tz_name": "Europe/Lisbon", "date_order": "DMY", "std_abbr": "WET", "dst_abbr": "WEST"},
    {"fleet_id": 3, "tz_name": "Asia/Kathmandu", "date_order": "DMY", "std_abbr": None, "dst_abbr": None},
    {"fleet_id": 4, "tz_name": "No/Where", "date_order": "DMY", "std_abbr": None, "dst_abbr": None},
]


@pytest.fixture(scope="module")
def clock(spark):
    return clock_from_table(spark, FLEETS, "fleet_id", "tz_name", "date_order", "std_abbr", "dst_abbr")


def utc(*x):
    return int(datetime(*x, tzinfo=timezone.utc).timestamp())


CASES = [
    ("2016-05-19 01:31:34", 1, "instant", utc(2016, 5, 19, 5, 31, 34)),
    (" \t2016/01/02 03:04:05.678 ", 3, "instant", utc(2016, 1, 1, 21, 19, 5)),
    ("03/04/2016 12:15:00 AM", 1, "instant", utc(2016, 3, 4, 5, 15)),
    ("03/04/2016 12:15 pm", 2, "instant", utc(2016, 4, 3, 11, 15)),
    ("3/4/16 09:30", 2, "instant", utc(2016, 4, 3, 8, 30)),
    ("2016-05-19T10:00:00Z", 1, "instant", utc(2016, 5, 19, 10)),
    ("2016-05-19T10:00-04", 3, "instant", utc(2016, 5, 19, 14)),
    ("2016-05-19 10:00:00 +0545", 1, "instant", utc(2016, 5, 19, 4, 15)),
    ("2016-11-06 01:30:00 EST", 1, "instant", utc(2016, 11, 6, 6, 30)),
    ("2016-07-01 01:30:00 WEST", 2, "instant", utc(2016, 7, 1, 0, 30)),
    ("2016-07-01 01:30:00 EDT", 2, "instant", utc(2016, 7, 1, 5, 30)),
    ("20160131T183011Z", 1, "instant", utc(2016, 1, 31, 18, 30, 11)),
    ("01-Apr-2016 02:34", 3, "instant", utc(2016, 3, 31, 20, 49)),
    ("SEP 9, 2016 18:24", 1, "instant", utc(2016, 9, 9, 22, 24)),
    ("2016-09-12@23:00Z", 1, "instant", utc(2016, 9, 12, 23)),
    ("2015-12-31T19", 1, "instant", utc(2016, 1, 1, 0)),
    ("2016-09-12", 3, "instant", utc(2016, 9, 11, 18, 15)),
    ("1451629923", 1, "instant", 1451629923),
    ("1451629923999", 1, "instant", 1451629923),
    ("1451629923999999", 4, "instant", 1451629923),
    ("2016-11-06 01:30:00", 1, "ambiguous", 0),
    ("2016-03-13 02:30:00", 1, "nonexistent", 0),
    ("2016-03-27T01:30", 2, "nonexistent", 0),
    ("13:00 PM", 1, "unreadable", 0),
    ("01/02/2016 13:00:00 PM", 1, "unreadable", 0),
    ("2015-02-29 10:00:00", 1, "unreadable", 0),
    ("2016-02-30 10:00:00", 1, "unreadable", 0),
    ("2016-01-01 24:00:00", 1, "unreadable", 0),
    ("0000-00-00 00:00:00", 1, "unreadable", 0),
    ("2016-01-1O 09:36:00", 1, "unreadable", 0),
    ("2016-01-01 10:00:00 XYZ", 1, "unreadable", 0),
    ("2016-01-01 10:00:00", 4, "unreadable", 0),
    ("2016-01-01 10:00:00", None, "unreadable", 0),
    ("", 1, "unreadable", 0),
    (None, 1, "unreadable", 0),
    ("٢٠١٦-01-01 10:00:00", 1, "unreadable", 0),
    ("9" * 5000, 1, "unreadable", 0),
]


def test_cases(clock):
    outcome, second = clock.batch(pa.array([c[0] for c in CASES]), pa.array([c[1] for c in CASES], pa.int32()))
    got = [(t, f, str(OUTCOMES[o]), int(s)) for (t, f, _, _), o, s in zip(CASES, outcome, second)]
    assert got == CASES


def test_zone_tables_agree_with_system_zones(spark):
    for name in ("America/New_York", "Australia/Adelaide", "Europe/Helsinki"):
        z = load_zones(spark, [name])[name]
        assert z.version
        for s in range(utc(2015, 1, 1), utc(2017, 1, 1), 40_000):
            local = datetime.fromtimestamp(s, ZoneInfo(name)).replace(tzinfo=None)
            state, back = z.to_utc(__import__("numpy").array([utc(*local.timetuple()[:6])]))
            assert state[0] == 1 or back[0] == s


def test_rows_and_empty_table(spark, clock):
    schema = "utc_second string, fleet_id int, outcome string, t string"
    df = spark.createDataFrame([("a", 1, "x", "2016-05-19 01:31:34")] * 2, schema)
    rows = normalise_instants(df.withColumnRenamed("utc_second", "id"), "id", "t", "fleet_id", clock).collect()
    assert [tuple(r) for r in rows] == [("a", "instant", utc(2016, 5, 19, 5, 31, 34))] * 2
    assert normalise_instants(spark.createDataFrame([], schema), "fleet_id", "t", "fleet_id", clock).count() == 0


@pytest.mark.parametrize(
    "text,outcome,second",
    [
        ("1965-07-01 12:00:00", "instant", utc(1965, 7, 1, 16)), ("1965-01-15 12:00:00", "instant", utc(1965, 1, 15, 17)), ("1965-10-31 01:30:00", "ambiguous", 0), ("1965-04-25 02:30:00", "nonexistent", 0),
        ("2150-07-01 12:00:00", "instant", utc(2150, 7, 1, 16)), ("2950-07-01 12:00:00", "instant", utc(2950, 7, 1, 16)), ("2950-01-01 12:00:00", "instant", utc(2950, 1, 1, 17)), ("9999-12-31 12:00:00", "instant", utc(9999, 12, 31, 17)),
    ],
)
def test_rules_hold_before_1970_and_after_2100(clock, text, outcome, second):
    code, at = clock.batch(pa.array([text]), pa.array([1]))
    assert (OUTCOMES[code[0]], at[0]) == (outcome, second)


def test_a_mask_is_compiled_once():
    parser_of.cache_clear()
    parser_of("9999-99-99")
    parser_of("9999-99-99")
    assert parser_of.cache_info().hits == 1


def test_long_fractions_and_years_far_away(spark, clock):
    rows = [(1, "2016-05-19T10:00:00." + "3" * 200 + "Z", 1), (2, "1950-07-01 12:00:00", 1), (3, "2150-07-01 12:00:00", 1), (4, "2150-07-01 12:00:00 EDT", 2), (5, "x" * 500, 1), (6, "1955-07-01 12:00:00 EDT", 2)]
    got = {r["k"]: (r["outcome"], r["utc_second"]) for r in normalise_instants(spark.createDataFrame(rows, "k long, v string, f int"), "k", "v", "f", clock).collect()}
    assert got[1] == ("instant", utc(2016, 5, 19, 10)) and got[5] == ("unreadable", 0)
    assert got[2] == ("instant", utc(1950, 7, 1, 16)) and got[3] == got[4] == ("instant", utc(2150, 7, 1, 16)) and got[6] == ("instant", utc(1955, 7, 1, 16))


def test_many_fleets_have_few_profiles(spark):
    n = 100_001
    fleets = spark.range(n).select(F.col("id").cast("int").alias("fleet_id"), F.when(F.col("id") % 2 == 0, "America/New_York").otherwise("Asia/Kathmandu").alias("tz_name"), F.lit("MDY").alias("date_order"), F.lit(None).cast("string").alias("std_abbr"), F.lit(None).cast("string").alias("dst_abbr"))
    rides = spark.createDataFrame([(1, "2016-01-01 12:00", n - 1), (2, "2016-01-01 12:00", n - 2), (3, "2016-01-01 12:00", None), (4, "2016-01-01 12:00", n)], "k long, v string, f int")
    df, clock = with_profiles(rides, "f", fleets, "fleet_id", "tz_name", "date_order", "std_abbr", "dst_abbr")
    assert len(clock.slot) == 2
    got = {r["k"]: (r["outcome"], r["utc_second"]) for r in normalise_instants(df, "k", "v", "profile", clock).collect()}
    assert got == {1: ("instant", utc(2016, 1, 1, 17)), 2: ("instant", utc(2016, 1, 1, 6, 15)), 3: ("unreadable", 0), 4: ("unreadable", 0)}
