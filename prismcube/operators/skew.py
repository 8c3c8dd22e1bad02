"""Per-key results where a few keys hold most rows.

A mergeable frequent-items sketch names the keys that hold more than a share of
all rows; the share follows the number of tasks, so that any other key is small
work for one of them. The rows of heavy keys are picked by a broadcast join (their
number is at most one over the share) and worked off in ways that split a key:
sums per task, counts per value and, for percentiles, ranges of values cut
by approximate quantiles. All other keys go through an ordinary shuffle on the key.
The results are united.

Percentile ``p`` of ``n`` values is the value of rank ``ceil(p * n)``.

Defined results: null keys belong to no key but count in the total of a share;
null, NaN and infinite values count as rows but enter neither sums nor
percentiles (null where none is left). Sums are exact in units of 0.000001;
values from 1e22 on are added to them as doubles (infinite beyond their range).
Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Least and most items that the sketch tracks; its error is below 4 / items of all rows.
TRACKED, MOST = 16384, 1 << 20


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _candidates(k: DataFrame, share: float) -> tuple[list, int]:
    """Keys that may hold ``share`` of all rows, by the sketch, and the number of rows."""
    tracked = max(TRACKED, 1 << math.ceil(math.log2(16 / share)))
    if share > 1 or tracked > MOST:
        raise ValueError("share is out of the sketch's range")
    low = share - 4 / tracked
    head = k.agg(F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k(key, {min(tracked, int(4 / low) + 4)}, {tracked})").alias("top")).first()
    return [x["item"] for x in head["top"] or [] if x["item"] is not None and x["count"] >= low * head["total"]], head["total"]


def split(df: DataFrame, names: list) -> tuple[DataFrame, DataFrame]:
    """Rows of the heavy keys, picked by a broadcast join, and those of all other keys that are not null."""
    few = F.broadcast(df.sparkSession.createDataFrame([(n,) for n in names], df.select("key").schema))
    return df.join(few, "key"), df.where(F.col("key").isNotNull()).join(few, "key", "left_anti")


def keyed_counts(df: DataFrame, key: Column, share: float | None = None) -> DataFrame:
    """``(key, n, total)``: rows of every key, and of the table; keys above ``share`` are heavy."""
    k = df.select(key.alias("key"))
    names, total = _candidates(k, share or min(0.005, 1 / (4 * tasks(df.sparkSession))))
    heavy, light = split(k, names)
    count = F.count(F.lit(1)).alias("n")
    return heavy.groupBy("key").agg(count).unionByName(light.groupBy("key").agg(count)).withColumn("total", F.lit(total).cast("long"))


def heavy_keys(df: DataFrame, key: Column, share: float) -> DataFrame:
    """``(key, n, total)`` of the keys that hold at least ``share`` of all rows."""
    # Compared in whole numbers: n / total >= share.
    per = round(1 / share) if abs(1 / share - round(1 / share)) < 1e-9 else None
    big = (F.col("n") * per >= F.col("total")) if per else (F.col("n") >= share * F.col("total"))
    return keyed_counts(df, key, share).where(big)


def _finite(v: str) -> Column:
    c = F.col(v).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _ranks(probs: list[float], n: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), F.ceil(F.lit(p) * n - F.lit(1e-9))).cast("long").alias("rank")) for i, p in enumerate(probs)])


def _pick(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Rows of values with counts, positions ``upto`` and wanted ranks, to the values at the ranks."""
    hit = (F.col("r.rank") > F.col("upto") - F.col("c")) & (F.col("r.rank") <= F.col("upto"))
    return ranked.where(hit).select(*by, F.col("r.i").alias("i"), "v")


def keyed_stats(df: DataFrame, key: Column, values: list[str], probs: dict[str, float], share: float | None = None) -> DataFrame:
    """``key, n_rows, sum_V, PROB_V`` for each value column V and named probability.

    ``share`` is the part of all rows from which on a key counts as heavy: by
    default a quarter of what a task would have if all had the same.
    """
    ranges = max(64, min(tasks(df.sparkSession), 1024))
    names, ps = list(probs), list(probs.values())
    base = df.select(key.alias("key"), *[_finite(v).alias(f"v{i}") for i, v in enumerate(values)]).where(F.col("key").isNotNull())
    names_of, _ = _candidates(base.select("key"), share or min(0.005, 1 / (4 * tasks(df.sparkSession))))
    sums = [F.count(F.lit(1)).alias("n_rows")]
    for i in range(len(values)):
        whole = F.expr(f"try_cast(v{i} AS DECIMAL(28,6))")
        exact, large = F.sum(whole).cast("double"), F.sum(F.when(whole.isNull(), F.col(f"v{i}")))
        sums += [F.coalesce(exact + large, exact, large).alias(f"s{i}")]
    heavy, light = split(base, names_of)
    # Each task sums its rows first, so a heavy key comes as one row per task.
    head = heavy.groupBy("key").agg(*sums).unionByName(light.groupBy("key").agg(*sums))

    def counted(rows: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"v{i}").alias("v")) for i in range(len(values))])
        long = rows.select("key", F.explode(each).alias("x")).select("key", "x.*").where("v IS NOT NULL")
        return long.groupBy("key", "f", "v").agg(F.count(F.lit(1)).alias("c"))

    light, hot = counted(light), counted(heavy)

    w = Window.partitionBy("key", "f")
    cum = light.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    picked = _pick(cum.withColumn("r", F.explode(_ranks(ps, F.col("n")))), ["key", "f"])

    hot = materialise(hot, "hot")
    cuts = hot.groupBy("key", "f").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 10 * ranges))).alias("cuts"))
    ranged = hot.join(F.broadcast(cuts), ["key", "f"]).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    per = ranged.groupBy("key", "f", "part").agg(F.sum("c").alias("c"))
    per = per.withColumn("upto", F.sum("c").over(w.orderBy("part"))).withColumn("n", F.sum("c").over(w))
    aim = per.withColumn("r", F.explode(_ranks(ps, F.col("n")))).where((F.col("r.rank") > F.col("upto") - F.col("c")) & (F.col("r.rank") <= F.col("upto")))
    aim = aim.select("key", "f", "part", "r", (F.col("upto") - F.col("c")).alias("before"))
    inner = ranged.join(F.broadcast(aim), ["key", "f", "part"])
    wi = Window.partitionBy("key", "f", "part", "r.i").orderBy("v")
    inner = inner.withColumn("upto", F.col("before") + F.sum("c").over(wi))
    picked = picked.unionByName(_pick(inner, ["key", "f"]))

    wide = picked.groupBy("key").agg(*[F.max(F.when((F.col("f") == i) & (F.col("i") == j), F.col("v"))).alias(f"{n}_{v}") for i, v in enumerate(values) for j, n in enumerate(names)])
    out = head.join(wide, "key", "left")
    return out.select("key", "n_rows", *[F.col(f"s{i}").alias(f"sum_{v}") for i, v in enumerate(values)], *[f"{n}_{v}" for v in values for n in names])
