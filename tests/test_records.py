import csv
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismcube.operators import records
from prismcube.plans.problems import RECORD

CASES = [
    ("1,2,3,4.5,6.7", None, 0), ('"1","2","3","4.5","6.7"', None, 0), (" 1 , 2,3 ,-4.5,6", None, 0), ("001,255,0,90,-180", None, 0), ("0,0,0,90.000,180.0", None, 0),
    ("256,2,3,4,5", "value", 1), ("1,2,3,90.1,5", "value", 4), ("1,2,3,4,180.01", "value", 5), ("1,2,3,4.,5", "value", 4), ("1,+2,3,4,5", "value", 2), ("1,2,3,1e1,5", "value", 4),
    ('" 1",2,3,4,5', "value", 1), ('1,"",3,4,5', "value", 2), ("1,,3,4,5", "value", 2), ("﻿1,2,3,4,5", "value", 1), ("1,٣,3,4,5", "value", 2), ("1\t,2,3,4,5", "value", 1),
    ("1,2,3,4", "column_count", 4), ("1,2,3,4,5,6", "column_count", 6), ("1,2,3,4,5,", "column_count", 6), ("", "column_count", 1), (" ", "column_count", 1), (None, "column_count", 1),
    ('"1,2,3,4,5"', "column_count", 1), ("1;2;3;4;5", "column_count", 1),
    ('1,2"3,3,4,5', "quoting", 2), ('"1"x,2,3,4,5', "quoting", 1), ('1,2,3,4,"5', "quoting", 5), ('"', "quoting", 1), (' "1",2,3,4,5', "quoting", 1), ('"1" ,2,3,4,5', "quoting", 1), ('1,""2"",3,4,5', "quoting", 2),
    ('"1""2",2,3,4,5', "value", 1), ('1,"2\n",3,4,5', "value", 2), ("x" * 200_000, "column_count", 1), ('"' + '""' * 100_000 + '"', "column_count", 1),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)], "n long, line string, reason string")
    bad = {r["n"]: (r["reason"], r["broken_field"]) for r in records.failed_records(df, "line", RECORD, "n").collect()}
    good = {r["n"] for r in records.load_records(df, "line", RECORD, "n").collect()}
    assert {i: (r, f) for i, (_, r, f) in enumerate(CASES) if r} == bad
    assert good == {i for i, c in enumerate(CASES) if c[1] is None}


def test_failed_query_gives_the_broken_field(spark):
    import __spark_entry__ as entry

    small = "/root/testdata/sf0.001"
    got = entry.queries()["p6_failed"](spark, small)
    assert got.columns == ["line_no", "reason", "broken_field"]
    assert got.where("broken_field IS NULL OR broken_field NOT BETWEEN 1 AND 6").count() == 0
    assert sorted(map(tuple, got.select("line_no", "reason").collect())) == sorted(map(tuple, entry.queries()["p6_found"](spark, small).collect()))


def test_values_and_empty(spark):
    df = spark.createDataFrame([(7, ' 1,"02",3 ,-4.50,"6"')], "line_no long, line string")
    assert tuple(records.load_records(df, "line", RECORD, "line_no").first()) == (7, 1, 2, 3, -4.5, 6.0)
    assert records.failed_records(df.limit(0), "line", RECORD, "line_no").count() == 0


@given(st.integers(0, 400))
@settings(max_examples=200, deadline=None)
def test_bounded_digits(n):
    for most in (7, 90, 180, 255):
        assert bool(re.fullmatch(records.upto(most), str(n))) == (n <= most)
        assert bool(re.fullmatch(records.upto(most), f"00{n}")) == (n <= most)


@pytest.mark.parametrize("alphabet", ['1",'])
def test_structure_like_a_strict_reader(spark, alphabet):
    import itertools

    lines = ["".join(x) for k in range(1, 7) for x in itertools.product(alphabet, repeat=k)]
    field = re.compile(r'[^",]*|"(?:[^"]|"")*"')
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r["line"]: r["reason"] for r in records.failed_records(df, "line", RECORD, "line").collect()}
    for x in lines:
        sound = re.fullmatch(f"(?:{field.pattern})(?:,(?:{field.pattern}))*", x)
        if not sound:
            assert got[x] == "quoting", x
        elif len(next(csv.reader([x]))) != 5:
            assert got[x] == "column_count", x
        else:
            assert got.get(x) in ("value", None), x
