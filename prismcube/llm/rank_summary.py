"""Percentiles with a bounded rank error from mergeable summaries.

A summary of n values is a list of stored values, each with the least and the
greatest rank it can have. Every partition makes exact summaries of its own
values and thins them to the uncertainty permitted there; summaries are then
merged level by level, a bounded number at a time, and thinned again. The error
that has accumulated is measured on the tuples themselves and kept with the
summary: a percentile of rank r is answered by a stored value whose rank differs
from r by at most ``err``. ``err <= eps * n`` holds for the result of every level.

A tuple travels as ``v`` with ``g`` (growth of the least rank over the tuple
before it), ``du`` (growth of the number of values that may lie below once the
tuple is passed) and ``u0`` (that number ahead of the first tuple); ``i`` keeps the order of equal values. In this form
a merge is a sort by value and two running sums.

Defined results: null and NaN are no values; a group without values gives no
row; infinite values are values. Null keys form a group. Ties count one by one.
A key column may not be named like a column of the summary.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a partition gathers before it summarises, and summaries merged at once.
CHUNK, FAN_IN = 1 << 20, 32
_TUPLE = [T.StructField(n, t) for n, t in (("f", T.IntegerType()), ("node", T.LongType()), ("v", T.DoubleType()), ("i", T.LongType()), ("g", T.LongType()), ("du", T.LongType()), ("u0", T.LongType()))]


def _codes(cols: list[pa.Array]) -> np.ndarray:
    """One number per row, equal where all columns are equal."""
    code = np.zeros(len(cols[0]) if cols else 0, np.int64)
    for c in cols:
        d = c.dictionary_encode()
        own = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (len(d.dictionary) + 1) + own, return_inverse=True)[1]
    return code


def _thin(lo: np.ndarray, hi: np.ndarray, limit: float) -> np.ndarray:
    """Positions to keep so that ``hi[next] - lo[kept]`` stays within ``limit``, or grows nowhere."""
    kept, i, last = [0], 0, len(lo) - 1
    while i < last:
        i = max(i + 1, int(np.searchsorted(hi, lo[i] + limit, side="right")) - 1)
        kept.append(i)
    return np.array(kept)


def _leaf(code: np.ndarray, v: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows to keep of one chunk, with their exact ranks and group sizes."""
    order = np.lexsort((v, code))
    c = code[order]
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    n = np.diff(np.concatenate([start, [len(c)]]))
    size = np.repeat(n, n)
    rank = np.arange(len(c)) - np.repeat(start, n)
    step = np.maximum(1, np.floor(2 * eps * size).astype(np.int64))
    keep = (rank % step == 0) | (rank == size - 1)
    return order[keep], rank[keep] + 1, size[keep]


def _deltas(lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray):
    """g, du, u0 of consecutive tuples of groups; ``n`` is the group's size."""
    g = lo - np.where(first, 0, np.concatenate([[0], lo[:-1]]))
    du = np.where(last, n, np.concatenate([hi[1:], [0]]) - 1) - (hi - 1)
    return g, du, np.where(first, hi - 1, 0)


def _ranks(start: np.ndarray, g: np.ndarray, du: np.ndarray, u0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest ranks of merged tuples in value order, and tuples per group."""
    size = np.diff(np.concatenate([start, [len(g)]]))

    def running(x):
        c = np.cumsum(x)
        return c - np.repeat(c[start] - x[start], size)

    base = np.repeat(np.add.reduceat(u0, start), size)
    return running(g), base + running(du) - du + 1, size


def _by_group(batches, keys: int):
    """Batches regrouped so that no group of the sorted input is cut: (columns, group starts)."""
    rest: pa.Table | None = None
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.num_rows >= 1 << 16:
                rest = rest.combine_chunks()
                code = _codes([rest.column(i).combine_chunks() for i in range(keys)])
                cut = np.flatnonzero(code[1:] != code[:-1])
                if len(cut):
                    yield from _groups(rest.slice(0, cut[-1] + 1), keys)
                    rest = rest.slice(cut[-1] + 1)
    if rest is not None and rest.num_rows:
        yield from _groups(rest, keys)


def _groups(t: pa.Table, keys: int):
    cols = [t.column(i).combine_chunks() for i in range(t.num_columns)]
    code = _codes(cols[:keys])
    yield cols, np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))


def _merge_level(df: DataFrame, keys: list[str], key_fields: list[T.StructField], eps: float, final: bool) -> DataFrame:
    """Merge the tuples of each (keys, f, node) to one summary that errs by ``eps`` at most."""
    by = [*keys, "f", "node"]
    laid = df.repartition(*by).sortWithinPartitions(*by, "v", "i")
    k = len(by)
    if final:
        schema = T.StructType([*key_fields, T.StructField("f", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("err", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("lo", T.ArrayType(T.LongType())), T.StructField("hi", T.ArrayType(T.LongType()))])
    else:
        schema = T.StructType([*key_fields, *_TUPLE])
    names = schema.fieldNames()

    def merge(batches):
        for cols, start in _by_group(batches, k):
            v, g, du, u0 = (c.to_numpy(zero_copy_only=False) for c in cols[k : k + 4])
            lo, hi, size = _ranks(start, g, du, u0)
            n = lo[start + size - 1]
            room = int(math.ceil(1 / eps)) + 2
            keep = np.ones(len(v), bool)
            for i in np.flatnonzero(size > room):
                s = slice(start[i], start[i] + size[i])
                mask = np.zeros(size[i], bool)
                mask[_thin(lo[s], hi[s], 2 * eps * n[i])] = True
                keep[s] = mask
            group = np.repeat(np.arange(len(start)), size)[keep]
            v, lo, hi = v[keep], lo[keep], hi[keep]
            first = np.concatenate([[True], group[1:] != group[:-1]])
            last = np.concatenate([group[1:] != group[:-1], [True]])
            if not final:
                g, du, u0 = _deltas(lo, hi, first, last, n[group])
                own = [c.take(pa.array(start[group])) for c in cols[:k]]
                yield from pa.Table.from_arrays([*own, pa.array(v), pa.array(np.arange(len(v))), pa.array(g), pa.array(du), pa.array(u0)], names=names).to_batches()
                continue
            # The error of answering a rank between two tuples by the nearer one.
            gap = np.where(last, 0, np.concatenate([hi[1:], [0]]) - lo) / 2
            at = np.flatnonzero(first)
            err = np.maximum.reduceat(gap, at)
            offs = pa.array(np.concatenate([at, [len(v)]]).astype(np.int32))
            own = [c.take(pa.array(start)) for c in cols[: k - 1]]
            lists = [pa.ListArray.from_arrays(offs, pa.array(x)) for x in (v, lo, hi)]
            yield from pa.Table.from_arrays([*own, pa.array(n), pa.array(err), *lists], names=names).to_batches()

    return laid.select(*by, "v", "g", "du", "u0").mapInArrow(merge, schema)


def _levels(df: DataFrame, keys: list[str], nodes: int, eps_from: float, eps: float) -> DataFrame:
    """Merge ``nodes`` summaries per key down to one, ``FAN_IN`` at a time."""
    key_fields = [df.schema[c] for c in keys]
    depth = max(1, math.ceil(math.log(max(2, nodes), FAN_IN)))
    for level in range(1, depth + 1):
        nodes = 1 if level == depth else math.ceil(nodes / FAN_IN)
        df = df.withColumn("node", F.pmod(F.col("node"), F.lit(nodes)).cast("long"))
        df = _merge_level(df, keys, key_fields, eps_from + (eps - eps_from) * level / depth, level == depth)
    return df


def summarise(df: DataFrame, keys: list[str], values: list[str], eps: float = 0.005) -> DataFrame:
    """``keys, field, n, err, v, lo, hi``: one summary per group and value column."""
    if clash := {*keys} & {"f", "node", "v", "i", "g", "du", "u0", "n", "err", "lo", "hi", "field"}:
        raise ValueError(f"key columns {sorted(clash)} need other names")
    key_fields = [df.schema[c] for c in keys]
    cols = df.select(*keys, *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(values)])
    k, names = len(keys), [*keys, "f", "node", "v", "i", "g", "du", "u0"]
    partitions = cols.rdd.getNumPartitions()

    def leaf(batches):
        node = TaskContext.get().partitionId()
        held, rows = [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            own = [t.column(i).combine_chunks() for i in range(k)]
            code = _codes(own) if k else np.zeros(t.num_rows, np.int64)
            for i in range(len(values)):
                v = t.column(k + i).to_numpy()
                good = np.flatnonzero(~np.isnan(v))
                if len(good):
                    at, rank, size = _leaf(code[good], v[good], eps / 2)
                    first, last = rank == 1, rank == size
                    g, du, u0 = _deltas(rank, rank, first, last, size)
                    rows_at = pa.array(good[at])
                    fill = [pa.array(np.full(len(at), i, np.int32)), pa.array(np.full(len(at), node))]
                    yield from pa.Table.from_arrays([*(c.take(rows_at) for c in own), *fill, pa.array(v[good[at]]), pa.array(rank), pa.array(g), pa.array(du), pa.array(u0)], names=names).to_batches()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    tuples = cols.mapInArrow(leaf, T.StructType([*key_fields, *_TUPLE]))
    return _named(_levels(tuples, keys, partitions, eps / 2, eps), keys, values)


def _named(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, F.element_at(F.array(*[F.lit(v) for v in values]), F.col("f") + 1).alias("field"), "n", "err", "v", "lo", "hi")


def combine(summaries: DataFrame, keys: list[str], values: list[str], eps_from: float, eps: float, parts: int) -> DataFrame:
    """Summaries of finer groups (such as single days) combined to groups of ``keys``.

    ``eps_from`` is the error of the summaries given, ``parts`` how many of them
    meet in one group at most.
    """
    f = sum((F.when(F.col("field") == v, F.lit(i)).otherwise(F.lit(0)) for i, v in enumerate(values)), F.lit(0)).cast("int")
    node = F.xxhash64("v", "n", *[c for c in summaries.columns if c not in ("v", "lo", "hi")])
    t = F.posexplode(F.arrays_zip("v", "lo", "hi")).alias("i", "t")
    flat = summaries.withColumn("node", node).select(*keys, f.alias("f"), "node", "n", "lo", "hi", t)
    before = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.get("lo", F.col("i") - 1))
    after = F.when(F.col("i") == F.size("hi") - 1, F.col("n")).otherwise(F.get("hi", F.col("i") + 1) - 1)
    flat = flat.select(*keys, "f", "node", F.col("t.v").alias("v"), F.col("i").cast("long").alias("i"), (F.col("t.lo") - before).cast("long").alias("g"), (after - (F.col("t.hi") - 1)).cast("long").alias("du"), F.when(F.col("i") == 0, F.col("t.hi") - 1).otherwise(F.lit(0)).cast("long").alias("u0"))
    return _named(_levels(flat, keys, parts, eps_from, eps), keys, values)


def percentiles(summaries: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """``keys, field, prob, value, rank_lo, rank_hi, n, err`` for each probability.

    The value stands at a rank between ``rank_lo`` and ``rank_hi``, at most ``err``
    away from ``ceil(prob * n)``.
    """
    want = F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("n") - F.lit(1e-9))).cast("long")
    each = summaries.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs]))).withColumn("t", want)
    best = F.array_min(F.transform(F.arrays_zip("v", "lo", "hi"), lambda x: F.struct(F.greatest(F.col("t") - x["lo"], x["hi"] - F.col("t")).alias("off"), x["v"].alias("v"), x["lo"].alias("lo"), x["hi"].alias("hi"))))
    each = each.withColumn("b", best)
    return each.select(*keys, "field", "prob", F.col("b.v").alias("value"), F.col("b.lo").alias("rank_lo"), F.col("b.hi").alias("rank_hi"), "n", F.col("b.off").alias("err"))
