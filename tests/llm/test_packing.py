import random

import numpy as np

from prismcube.llm import packing


def pages(spark, n=400):
    r = random.Random(2)
    rows = [(i, r.choices(["hot", "a", "b", None, "other"], [50, 20, 10, 5, 5])[0], r.choice([0, 1, 50, 99, 100, 101, 200, 333, r.randrange(300)])) for i in range(n)]
    rows += [rows[3], (None, "a", 10)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_whole_pages_within_capacity(spark):
    rows, df = pages(spark)
    targets = spark.createDataFrame([("hot", 0.2), ("a", 0.5), ("b", 0.3), ("none", 0.0)], "source string, target_share double")
    for shard in (10**9, 5000):
        got = packing.pack_documents(df, targets, {"small": 100, "big": 1000}, shard).toPandas()
        for name, cap in (("small", 100), ("big", 1000)):
            p = got[got.pack_name == name]
            assert p.n_tokens.sum() == sum(n for _, _, n in rows)
            assert p.groupby("container_id").n_tokens.sum().max() <= cap
            full = p[p.doc_id.notna()].copy()
            sizes = {}
            for i, _, n in rows:
                if i is not None:
                    sizes.setdefault(i, []).append(n)
            for i, g in full.groupby("doc_id"):
                assert g.n_tokens.sum() == sum(sizes[i])
                assert (g.piece == 0).sum() == len(sizes[i])
                if max(sizes[i]) <= cap:
                    assert (g.piece == 0).all()
            assert len(p) >= len(rows)
        if shard > 10**6:
            used = packing.fill_report(packing.pack_documents(df, targets, {"small": 100}, shard), {"small": 100}).first()["used"]
            assert used > 0.95


def test_windows_follow_targets_while_supply_lasts():
    r = np.random.default_rng(1)
    size = r.integers(20, 200, 6000)
    source = r.choice(3, 6000, p=[0.8, 0.1, 0.1])
    share = np.array([0.5, 0.3, 0.2])
    seen, total = np.zeros(3), []
    for w in packing.windows(source, size, share, np.zeros(3), 20_000):
        total.append(w)
        got = np.bincount(source[w], size[w], 3)
        if len(total) <= 8:
            assert abs(got / got.sum() - share).max() < 0.02
        seen += got
    assert sorted(np.concatenate(total).tolist()) == list(range(6000))


def test_debts_are_carried_in_full():
    # A shard that owes a source far more than a window pays it back over several.
    size, source, share = np.full(4000, 10), np.repeat([0, 1], 2000), np.array([0.5, 0.5])
    first = [np.bincount(source[w], size[w], 2) for w in packing.windows(source, size, share, np.array([5000.0, -5000.0]), 1000)]
    paid = np.cumsum([x[0] - x[1] for x in first])
    assert (paid[:9] == 1000 * np.arange(1, 10)).all() and abs(paid[14] - 10_000) <= 1000


def test_empty(spark):
    _, df = pages(spark)
    targets = spark.createDataFrame([], "source string, target_share double")
    assert packing.pack_documents(df.limit(0), targets, {"x": 10}).count() == 0
    assert packing.pack_documents(df, targets, {"x": 10**6}).count() == df.count()
