import math
import random

import numpy as np
import pytest

from prismcube.llm import rank_summary as R


def data(n=20_000):
    r = random.Random(3)
    return [(r.choices(["a", "b", None, "solo"], [60, 39, 10, 0.01])[0], r.choice([1, 2, 3]), r.choice([None, float("nan"), float("inf"), 7.0, round(r.gauss(0, 3), 1), r.random()])) for _ in range(n)]


def check(found, rows, eps):
    groups = {}
    for k, _, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(k, []).append(v)
    assert {r["k"] for r in found} == set(groups)
    for r in found:
        v = np.sort(groups[r["k"]])
        want = max(1, math.ceil(r["prob"] * len(v) - 1e-9))
        lo, hi = np.searchsorted(v, r["value"], "left") + 1, np.searchsorted(v, r["value"], "right")
        off = max(lo - want, want - hi, 0)
        assert r["n"] == len(v) and lo <= hi
        assert off <= r["err"] <= max(1, eps * len(v)), (r, lo, hi, want)


@pytest.mark.parametrize("fan,chunk", [(32, 1 << 20), (2, 700)])
def test_bounded_error(spark, monkeypatch, fan, chunk):
    monkeypatch.setattr(R, "FAN_IN", fan)
    monkeypatch.setattr(R, "CHUNK", chunk)
    rows = data()
    df = spark.createDataFrame(rows, "k string, day int, x double").repartition(13)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    s = R.summarise(df, ["k"], ["x"], 0.01)
    assert all(r["err"] <= max(0.5, 0.01 * r["n"]) and len(r["v"]) <= 250 for r in s.collect())
    check(R.percentiles(s, ["k"], probs).collect(), rows, 0.01)
    days = R.summarise(df, ["k", "day"], ["x"], 0.005)
    check(R.percentiles(R.combine(days, ["k"], ["x"], 0.005, 0.01, 3), ["k"], probs).collect(), rows, 0.01)


def test_edges(spark):
    df = spark.createDataFrame([("a", 1, None)], "k string, day int, x double")
    assert R.summarise(df, ["k"], ["x"]).count() == 0
    assert R.summarise(df.limit(0), ["k"], ["x"]).count() == 0
    one = R.summarise(spark.createDataFrame([("a", 5.0, "z")], "k string, x double, field string"), ["k"], ["x"]).first()
    assert (one["n"], one["err"], one["v"]) == (1, 0.0, [5.0])
    whole = R.summarise(spark.createDataFrame([(float(i),) for i in range(1000)], "x double"), [], ["x"], 0.01)
    assert abs(R.percentiles(whole, [], [0.5]).first()["value"] - 500) <= 10
    with pytest.raises(ValueError):
        R.summarise(df.withColumnRenamed("k", "node"), ["node"], ["x"])
