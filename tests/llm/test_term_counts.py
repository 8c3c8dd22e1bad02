import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from prismcube.llm import term_counts
from prismcube.llm.term_counts import TermStore, batches_by_time, marked

SCHEMA = "field string, record string, terms array<string>, sign long"


def state(store):
    return {(r["field"], r["term"]): (r["occurrences"], r["records"], r["total_records"]) for r in store.counts().collect()}


def brute(rows):
    occ, rec, all_ = Counter(), defaultdict(Counter), defaultdict(Counter)
    for f, r, ts, s in rows:
        all_[f][r] += s
        for t in ts or []:
            if t is not None:
                occ[f, t] += s
                rec[f, t][r] += s
    return {k: (n, sum(v > 0 for r, v in rec[k].items() if r is not None), sum(v > 0 for r, v in all_[k[0]].items() if r is not None)) for k, n in occ.items() if n > 0}


def test_signed_deltas_like_brute_force(spark):
    r = random.Random(1)
    live, log, store = [], [], TermStore(spark)
    for step in range(3):
        batch = []
        for _ in range(120):
            row = (r.choice("fg"), r.choice([None, *map(str, range(30))]), r.choice([None, [], ["a"], ["a", "a", "b"], [None, "c"], ["d" * 3000, ""]]), 1)
            live.append(row)
            batch.append(row)
        if step:
            for _ in range(60):
                gone = live.pop(r.randrange(len(live)))
                batch.append((*gone[:3], -1))
        log += batch
        store.apply(spark.createDataFrame(batch, SCHEMA))
        assert state(store) == brute(log)
    before = state(store)
    store.apply(spark.createDataFrame([], SCHEMA))
    assert state(store) == before


def test_replace_takes_the_place_of_a_record(spark):
    store = TermStore(spark)
    store.apply(spark.createDataFrame([("f", "1", ["x", "y"], 1), ("f", "2", ["x"], 1)], SCHEMA), replace=True)
    store.apply(spark.createDataFrame([("f", "1", ["z"], 1), ("f", "3", ["x"], 1)], SCHEMA), replace=True)
    assert state(store) == {("f", "x"): (2, 2, 3), ("f", "z"): (1, 1, 3)}


def test_empty_store_and_marks(spark):
    store = TermStore(spark)
    store.apply(spark.createDataFrame([], SCHEMA))
    assert state(store) == {}
    rows = spark.createDataFrame([("f", "a", 9, 4, 20), ("f", "b", 9, 5, 50), ("f", "c", 9, 6, 50)], "field string, term string, occurrences long, records long, total_records long")
    assert {r["term"]: r["mark"] for r in marked(rows, 5, 0.1).collect()} == {"a": "rare", "b": None, "c": "common"}


def test_batches_keep_every_row(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 7 > 0, F.timestamp_seconds(F.col("id") / 3)).alias("t"))
    got = [r["id"] for b in batches_by_time(df, F.col("t"), [0.5, 0.8]) for r in b.collect()]
    assert sorted(got) == list(range(100))
    assert sum(b.count() for b in batches_by_time(df.limit(0), F.col("t"), [0.5])) == 0
    same = df.withColumn("t", F.lit(None).cast("timestamp"))
    assert sum(b.count() for b in batches_by_time(same, F.col("t"), [0.5])) == 100


def test_a_store_is_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    for i in range(3):
        TermStore(spark, path).apply(spark.createDataFrame([("f", str(i), ["x", str(i)], 1)], SCHEMA))
    store = TermStore(spark, path)
    assert store.version == 3 and state(store)["f", "x"] == (3, 3, 3)
    # A batch that fails before its manifest is written leaves no trace.
    broken = TermStore(spark, path)
    broken._commit = lambda: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        broken.apply(spark.createDataFrame([("f", "9", ["x"], 1)], SCHEMA))
    except RuntimeError:
        pass
    assert state(TermStore(spark, path)) == state(store)


def test_deleting_with_replace(spark):
    store = TermStore(spark)
    one, gone = [("f", "1", ["x", "x"], 1), ("f", "2", ["y"], 1)], [("f", "1", ["x"], -1)]
    store.apply(spark.createDataFrame(one, SCHEMA), replace=True)
    store.apply(spark.createDataFrame(gone, SCHEMA), replace=True)
    assert state(store) == {("f", "y"): (1, 1, 1)}
    store.apply(spark.createDataFrame(one[:1], SCHEMA), replace=True)
    assert state(store) == {("f", "x"): (2, 1, 2), ("f", "y"): (1, 1, 2)}


def test_taking_away_first_and_adding_later(spark):
    store = TermStore(spark)
    store.apply(spark.createDataFrame([("f", "1", ["x"], -1), ("f", "2", ["x"], 1)], SCHEMA))
    assert ("f", "x") not in state(store)
    store.apply(spark.createDataFrame([("f", "1", ["x"], 1), ("f", "1", ["x"], 1)], SCHEMA))
    assert state(store) == {("f", "x"): (2, 2, 2)}


def test_segments_are_merged_and_few_hashes_are_named(spark, monkeypatch):
    monkeypatch.setattr(term_counts, "SEGMENTS", 2)
    monkeypatch.setattr(term_counts, "NAMED", 2)
    r, log, store = random.Random(3), [], TermStore(spark)
    for step in range(4):
        batch = [("f", str(r.randrange(40)), [r.choice("abc")], 1) for _ in range(2 if step % 2 else 30)]
        log += batch
        store.apply(spark.createDataFrame(batch, SCHEMA))
        assert state(store) == brute(log) and len(store.segments) <= 2
