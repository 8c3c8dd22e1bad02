"""Mixing sources to target shares of a total size.

Quotas: each source gets its share of the total, at most its size times the
repeats allowed; what a capped source cannot give is divided among the others in
proportion to their shares. A source's pages fall into blocks by hash. Whole
passes over a source take all its blocks, a last pass as many blocks of a random
order as the rest of the quota holds, and from one more block only pages up to
the quota. How many blocks of each source an output shard gets is drawn down a
splitting tree: at each node the blocks of all sources are dealt to the two
halves by a multivariate hypergeometric draw, so shards differ only by chance
and their quotas add up exactly. Each shard then takes disjoint runs of the
randomly ordered blocks and shuffles its pages by hash.

There are at least ``PER_SHARD`` blocks to a shard, so that none stays empty, and
they stay on the executors: their random order is a hash, whose first bits part it
into ranges; only sums and counts per source and range (at most ``RANGES`` each)
come to the driver. It splits the tree down to some ``NODES`` subtrees, which tasks
deal on by the same seeds. Pages are joined to the blocks, never gathered.

Defined results: a page without a source, or of one without a target, is not
used. Null and empty texts have no tokens; they may be drawn and add nothing.
Repeated rows are pages of their own. If the caps leave the total out of reach,
the mix is smaller and the report shows it. No pages give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise

BLOCKS, SHARD_TOKENS = 20_000, 2_000_000
#: Blocks to a shard at least, ranges of the random order, and subtrees left to tasks.
PER_SHARD, RANGES, NODES = 4, 1024, 1024


def quotas(share: np.ndarray, cap: np.ndarray, total: float) -> np.ndarray:
    """Tokens per source: shares of ``total`` under caps, the shortfall divided in proportion."""
    out, free = np.zeros(len(share)), share > 0
    while free.any():
        left = total - out[~free].sum()
        want = left * share / share[free].sum()
        over = free & (want >= cap)
        if not over.any():
            out[free] = want[free]
            break
        out[over] = cap[over]
        free &= ~over
    return out


def subtrees(counts: np.ndarray, lo: int, hi: int, seed: int, size: int = 1) -> list[tuple[int, int, np.ndarray]]:
    """``(lo, hi, counts)`` of ranges of at most ``size`` shards, in order, dealt down a tree of hypergeometric draws.

    A range split further gives the same as one split at once.
    """
    out, stack = [], [(lo, hi, counts.astype(np.int64))]
    while stack:
        lo, hi, own = stack.pop()
        if hi - lo <= size:
            out.append((lo, hi, own))
            continue
        mid = (lo + hi) // 2
        n = int(round(own.sum() * (mid - lo) / (hi - lo)))
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(own, n, method="marginals") if own.sum() else own
        stack += [(mid, hi, own - left), (lo, mid, left)]
    return out


def splitting_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source per shard."""
    return np.array([own for _, _, own in subtrees(counts, 0, shards, seed)]).reshape(shards, len(counts))


def deal(spark: SparkSession, names: list[str], counts: np.ndarray, shards: int, seed: int) -> DataFrame:
    """``(source, place, shard)``: the shard of every place in the random order of each source's blocks."""
    nodes, start = [], np.zeros(len(counts), np.int64)
    for lo, hi, own in subtrees(counts, 0, shards, seed, -(-shards // NODES)):
        nodes.append((lo, hi, own.tolist(), start.tolist()))
        start = start + own

    def leaves(batches):
        for b in batches:
            for lo, hi, own, first in zip(b["lo"], b["hi"], b["own"], b["first"]):
                own = np.asarray(own, np.int64)
                tree = np.array([x for _, _, x in subtrees(own, lo, hi, seed)]).reshape(hi - lo, len(own))
                for k, name in enumerate(names):
                    if own[k]:
                        yield pd.DataFrame({"source": name, "place": first[k] + np.arange(own[k]), "shard": np.repeat(np.arange(lo, hi), tree[:, k])})

    df = spark.createDataFrame(nodes, "lo long, hi long, own array<long>, first array<long>")
    return df.repartition(min(len(nodes), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInPandas(leaves, "source string, place long, shard long")


def _per_range(df: DataFrame, names: list[str], value) -> dict[str, np.ndarray]:
    """Sums of a value per source and range of the order; sources x ``RANGES`` numbers."""
    out = {s: np.zeros(RANGES, np.int64) for s in names}
    for r in df.groupBy("source", "range").agg(F.sum(value).alias("x")).collect():
        out[r["source"]][r["range"]] = r["x"]
    return out


def uses_of_blocks(sizes: DataFrame, quota: dict[str, float], have: dict[str, int], shards: int, seed: int) -> DataFrame:
    """``(source, block, pass, shard, take)`` of every use of a block; ``take`` limits the tokens of one per source.

    ``sizes`` holds ``source, block, t`` tokens and is read several times.
    """
    spark, names = sizes.sparkSession, sorted(quota)
    turns = {s: int(quota[s] // have[s]) if have.get(s) else 0 for s in names}
    left = {s: quota[s] - turns[s] * have.get(s, 0) if have.get(s) else 0.0 for s in names}
    plan = F.broadcast(spark.createDataFrame([(s, turns[s], float(left[s])) for s in names] or [("", 0, 0.0)], "source string, turns int, left double"))
    each = sizes.join(plan, "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("turns"))))
    each = each.withColumn("r", F.xxhash64(F.lit(seed), "pass", "source", "block")).withColumn("range", F.shiftrightunsigned("r", 54).cast("int"))
    full, last = each.where(F.col("pass") < F.col("turns")), each.where((F.col("pass") == F.col("turns")) & (F.col("left") >= 1))
    # The last pass takes whole ranges, and of one range more blocks one by one.
    cut = []
    for s, sums in _per_range(last, names, "t").items():
        upto = np.cumsum(sums)
        k = int(np.searchsorted(upto, left[s] + 0.5, side="right"))
        cut.append((s, k, float(left[s] - (upto[k - 1] if k else 0))))
    edge = F.broadcast(spark.createDataFrame(cut or [("", 0, 0.0)], "source string, edge int, more double"))
    last = last.join(edge, "source")
    order = Window.partitionBy("source").orderBy("r", "block").rowsBetween(Window.unboundedPreceding, 0)
    inner = last.where(F.col("range") == F.col("edge")).withColumn("upto", F.sum("t").over(order))
    whole = F.col("upto") <= F.col("more") + 0.5
    take = F.when(~whole, F.col("more") - (F.col("upto") - F.col("t")))
    inner = inner.withColumn("take", take).where(whole | (F.col("take") >= 1))
    cols = ["source", "block", "pass", "r", "range"]
    none = F.lit(None).cast("double").alias("take")
    uses = full.select(*cols, none).unionByName(last.where(F.col("range") < F.col("edge")).select(*cols, none)).unionByName(inner.select(*cols, "take"))
    uses = materialise(uses, "uses")
    held = _per_range(uses, names, F.lit(1))
    before = [(s, k, int(n)) for s in names for k, n in enumerate(np.cumsum(held[s]) - held[s]) if held[s][k]]
    offset = F.broadcast(spark.createDataFrame(before or [("", 0, 0)], "source string, range int, before long"))
    place = F.row_number().over(Window.partitionBy("source", "range").orderBy("r", "pass", "block")) - 1
    uses = uses.withColumn("place", place).join(offset, ["source", "range"]).withColumn("place", F.col("place") + F.col("before"))
    dealt = deal(spark, names, np.array([held[s].sum() for s in names], np.int64), shards, seed)
    return uses.join(dealt, ["source", "place"]).select("source", "block", "pass", "shard", "take")


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The mix ``(shard, position, doc_id, source, pass, n_tokens)`` and its report.

    ``sized`` holds ``doc_id, source, n_tokens`` and should be cheap to read
    again; ``targets`` holds ``source, target_share, max_repeats``. The default
    total is the size of the collection. Report: ``source, target_share,
    available_tokens, quota_tokens, mixed_tokens, actual_share, passes``.
    """
    spark = sized.sparkSession
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.where("source IS NOT NULL").collect()}
    small = F.broadcast(spark.createDataFrame([(s,) for s in goal] or [("",)], "source string"))
    pages = sized.select("doc_id", "source", "n_tokens").join(small, "source", "left_semi")
    have = {r["source"]: r["t"] for r in pages.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    if total_tokens is None:
        total_tokens = sized.agg(F.sum("n_tokens")).first()[0] or 0
    names = sorted(goal)
    share, cap = np.array([goal[s][0] for s in names]), np.array([float(have.get(s, 0)) * goal[s][1] for s in names])
    quota = dict(zip(names, quotas(share, cap, total_tokens).tolist()))
    shards = max(1, int(-(-sum(quota.values()) // shard_tokens)))
    per_block = max(1.0, sum(have.values()) / max(BLOCKS, PER_SHARD * shards))
    count = {s: max(1, int(round(have.get(s, 0) / per_block))) for s in names}
    dealt = F.broadcast(spark.createDataFrame([(s, n) for s, n in count.items()] or [("", 1)], "source string, blocks int"))
    pages = pages.join(dealt, "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "n_tokens"))
    pages = pages.withColumn("block", F.pmod("h", F.col("blocks")).cast("int")).drop("blocks")
    sizes = materialise(pages.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")), "blocks")
    uses = materialise(uses_of_blocks(sizes, quota, have, shards, seed), "dealt")
    whole = uses.where("take IS NULL").drop("take")
    # At most one cut block per source.
    cut = F.broadcast(uses.where("take IS NOT NULL"))
    order = Window.partitionBy("source", "block", "pass").orderBy("h", "doc_id", "n_tokens")
    some = pages.join(cut, ["source", "block"]).withColumn("upto", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    some = some.where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("take")).drop("upto", "take")
    drawn = pages.join(whole, ["source", "block"]).unionByName(some)
    local = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "pass", "h"), "pass", "doc_id", "n_tokens"))
    mixed = drawn.select("shard", local.cast("long").alias("position"), "doc_id", "source", "pass", "n_tokens")

    used = drawn.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), (F.max("pass") + 1).alias("passes"))
    facts = [(s, goal[s][0], int(have.get(s, 0)), quota[s]) for s in names]
    base = spark.createDataFrame(facts, "source string, target_share double, available_tokens long, quota_tokens double")
    report = base.join(F.broadcast(used), "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    everything = F.sum("mixed_tokens").over(Window.partitionBy())
    report = report.select("source", "target_share", "available_tokens", "quota_tokens", "mixed_tokens", F.when(everything > 0, F.col("mixed_tokens") / everything).alias("actual_share"), F.coalesce("passes", F.lit(0)).alias("passes"))
    return mixed, report
