import random

import numpy as np
import pytest

from prismcube.llm import mixing


def test_quotas():
    share, cap = np.array([0.5, 0.3, 0.2, 0.0]), np.array([1e9, 100.0, 1e9, 5.0])
    q = mixing.quotas(share, cap, 1000)
    assert q.tolist() == pytest.approx([900 * 5 / 7, 100, 900 * 2 / 7, 0])
    assert mixing.quotas(share, np.array([10.0, 10, 10, 10]), 1000).tolist() == [10, 10, 10, 0]


def test_splitting_tree_is_exact_and_even():
    counts = np.array([100, 37, 5, 0])
    t = mixing.splitting_tree(counts, 7, 1)
    assert (t.sum(axis=0) == counts).all() and t.min() >= 0
    assert t.sum(axis=1).max() - t.sum(axis=1).min() <= 3


def test_subtrees_agree_with_one_tree(spark):
    counts = np.array([1000, 370, 5, 0])
    one = mixing.splitting_tree(counts, 70, 2)
    rows = [x for lo, hi, own in mixing.subtrees(counts, 0, 70, 2, 9) for x in mixing.subtrees(own, lo, hi, 2)]
    assert (np.array([own for _, _, own in rows]) == one).all()
    got = mixing.deal(spark, list("abcd"), counts, 70, 2).toPandas()
    assert all((np.bincount(g.shard, minlength=70) == one[:, "abcd".index(s)]).all() and sorted(g.place) == list(range(len(g))) for s, g in got.groupby("source"))


def test_a_million_shards(spark):
    counts = np.array([3_000_000, 1_200_000, 50_000])
    got = mixing.deal(spark, list("abc"), counts, 10**6, 3).groupBy("shard").count().selectExpr("count(*)", "min(count)").first()
    assert got[0] == 10**6 and got[1] >= 4


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, r.choices(["big", "small", "free", None], [80, 5, 10, 5])[0], r.choice([0, r.randrange(1, 90)])) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.4, 3), ("gone", 0.2, 2)], "source string, target_share double, max_repeats int")
    have = {s: sum(n for _, x, n in rows if x == s) for s in ("big", "small")}
    mixed, report = mixing.mix(df, targets, 20_000, seed=1, shard_tokens=3000)
    m = mixed.toPandas()
    rep = {x["source"]: x for x in report.collect()}
    assert set(m.source) == {"big", "small"}
    assert m.groupby("doc_id").size().max() <= 3
    assert m[m.source == "big"].groupby("doc_id").size().max() == 1
    want = mixing.quotas(np.array([0.4, 0.4, 0.2]), np.array([have["big"], 3.0 * have["small"], 0]), 20_000)
    for s, q in zip(("big", "small"), want):
        assert abs(m[m.source == s].n_tokens.sum() - q) <= 90
        assert rep[s]["mixed_tokens"] == m[m.source == s].n_tokens.sum()
        assert rep[s]["actual_share"] == pytest.approx(m[m.source == s].n_tokens.sum() / m.n_tokens.sum())
    assert rep["gone"]["mixed_tokens"] == 0
    assert not m.duplicated(["shard", "position"]).any() and not m.duplicated(["doc_id", "pass"]).any()
    again = mixing.mix(df, targets, 20_000, seed=1, shard_tokens=3000)[0].toPandas()
    key = ["shard", "position", "doc_id", "pass"]
    assert sorted(map(tuple, m[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(df, targets)
    assert mixed.count() == 0 and report.first()["actual_share"] is None
    none = spark.createDataFrame([], targets.schema)
    assert mixing.mix(spark.createDataFrame([(1, "a", 5)], df.schema), none)[0].count() == 0
