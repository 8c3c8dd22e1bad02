import math
import random

import pytest
from pyspark.sql import functions as F

from prismcube.operators import skew


def table(spark, n=3000):
    r = random.Random(5)
    rows = []
    for _ in range(n):
        k = r.choices(["hot", "warm", None, *[f"k{i}" for i in range(60)]], [900, 300, 60, *[20] * 60])[0]
        v = r.choice([None, float("nan"), float("inf"), 0.5, 0.5, round(r.gauss(10, 5), 2)])
        rows.append((k, v, "x"))
    return rows, spark.createDataFrame(rows, "key string, v double, n_rows string")


@pytest.mark.parametrize("share", [0.05, 0.9, 0.005])
def test_stats_like_brute_force(spark, share):
    rows, df = table(spark)
    got = {r["key"]: r for r in skew.keyed_stats(df, F.col("key"), ["v"], {"p50": 0.5, "p99": 0.99, "p0": 0.0}, share).collect()}
    keys = {k for k, _, _ in rows if k is not None}
    assert set(got) == keys
    for k in keys:
        vs = sorted(v for x, v, _ in rows if x == k and v is not None and math.isfinite(v))
        assert got[k]["n_rows"] == sum(x == k for x, _, _ in rows)
        for name, p in (("p50", 0.5), ("p99", 0.99), ("p0", 0.0)):
            assert got[k][f"{name}_v"] == (vs[max(1, math.ceil(p * len(vs) - 1e-9)) - 1] if vs else None)
        assert got[k]["sum_v"] == (pytest.approx(sum(vs)) if vs else None)


def test_sums_hold_large_values(spark):
    rows = [("a", 1e22), ("a", 2e300), ("a", 1.5), ("b", -3e22), ("c", 0.25), ("c", 0.5)]
    df = spark.createDataFrame(rows, "key string, v double")
    got = {r["key"]: r["sum_v"] for r in skew.keyed_stats(df, F.col("key"), ["v"], {"p50": 0.5}).collect()}
    assert got == {"a": pytest.approx(2e300), "b": -3e22, "c": 0.75}


def test_heavy_keys(spark):
    rows, df = table(spark)
    got = {r["key"]: r["n"] for r in skew.heavy_keys(df, F.col("key"), 0.05).collect()}
    count = {k: sum(x == k for x, _, _ in rows) for k in {x for x, _, _ in rows}}
    assert got == {k: n for k, n in count.items() if k is not None and n * 20 >= len(rows)}
    assert skew.heavy_keys(df.limit(0), F.col("key"), 0.05).count() == 0
    assert skew.keyed_stats(df.limit(0), F.col("key"), ["v"], {"p50": 0.5}).count() == 0
    nothing = df.select(F.lit(None).cast("string").alias("key"), "v")
    assert skew.keyed_stats(nothing, F.col("key"), ["v"], {"p50": 0.5}).count() == 0
    with pytest.raises(ValueError):
        skew.heavy_keys(df, F.col("key"), 1e-6)
