"""Filling containers of fixed capacity with pages, mixed to target proportions.

Pages are spread over shards by hash, so that no shard depends on a hot source;
only ids and token counts travel. A shard keeps a queue per source. For every
window of containers, deficit round-robin takes pages from the queues: each
source earns its share of the window's tokens, spends it on whole pages, and
carries all that is left, or overspent, to the next windows. The credit a shard
starts with is what the shards before it owe by their contents (a prefix sum over
shards, in groups of ``GROUP``). The pages of a window go best-fit, longest first, into the containers
still open. Only a page longer than the capacity is divided: into full containers
and one rest, which is an item like any other.

Every page is packed; once the targeted sources are used up, the others follow.

Defined results: a null text has no tokens and, like an empty one, takes a place
but no space. A source without a target, or a null one, has share zero. Repeated
rows are packed each. No documents give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Tokens of a shard, containers of a window, and the part of a container that may stay free when it is closed.
SHARD_TOKENS, WINDOW, SLACK = 2_000_000, 64, 0.01
#: Shards whose debts are summed in one go.
GROUP = 4096
SCHEMA = "pack_name string, container_id long, doc_id long, source string, piece int, piece_start long, n_tokens long"


def windows(source: np.ndarray, size: np.ndarray, share: np.ndarray, credit: np.ndarray, budget: int):
    """Rows of each window, by deficit round-robin over the queues of the sources."""
    queues = [np.flatnonzero(source == s).tolist()[::-1] for s in range(len(share))]
    sizes = size.tolist()
    credit = credit.astype(float).copy()
    while any(queues):
        live = np.array([bool(q) for q in queues])
        credit[~live] = 0.0
        own = np.where(live, share, 0.0)
        if own.sum() <= 0:
            own = live.astype(float)
        own = own / own.sum()
        credit += own * budget
        taken, room = [], float(budget)
        while room > 0:
            before = len(taken)
            for s in np.flatnonzero(own > 0).tolist():
                q = queues[s]
                while q and sizes[q[-1]] <= credit[s] and room > 0:
                    i = q.pop()
                    taken.append(i)
                    credit[s] -= sizes[i]
                    room -= sizes[i]
            live = np.array([bool(q) for q in queues])
            open_ = np.flatnonzero(live & (own > 0))
            if not len(open_) or room <= 0:
                break
            spare = np.where(live, 0.0, np.maximum(credit, 0.0))
            if spare.sum() > 0:
                # What an emptied source cannot spend goes to the others by their shares.
                credit[~live] = 0.0
                credit[open_] += spare.sum() * own[open_] / own[open_].sum()
            elif len(taken) == before:
                # No head fits its credit: the source nearest to affording its head overdraws.
                s = max(open_.tolist(), key=lambda k: credit[k] - sizes[queues[k][-1]])
                i = queues[s].pop()
                taken.append(i)
                credit[s] -= sizes[i]
                room -= sizes[i]
        yield np.array(taken, np.int64)


def pack(source: np.ndarray, tokens: np.ndarray, share: np.ndarray, credit: np.ndarray, capacity: int, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Container, row, piece, start and tokens of every piece of the pages of a shard."""
    box, row, piece, start, size = [], [], [], [], []
    used = 0
    open_: list[tuple[int, int]] = []  # (free tokens, container), sorted
    for taken in windows(source, tokens, share, credit, capacity * window):
        items = []
        for i in taken.tolist():
            n, p = int(tokens[i]), 0
            if n > capacity:
                while n - p * capacity >= capacity:
                    box.append(used), row.append(i), piece.append(p), start.append(p * capacity), size.append(capacity)
                    used += 1
                    p += 1
                if n == p * capacity:
                    continue
            items.append((n - p * capacity, i, p))
        items.sort(key=lambda x: (-x[0], x[1]))
        for n, i, p in items:
            at = bisect_left(open_, (n, -1))
            if at < len(open_):
                free, b = open_.pop(at)
            else:
                free, b = capacity, used
                used += 1
            box.append(b), row.append(i), piece.append(p), start.append(p * capacity), size.append(n)
            insort(open_, (free - n, b))
        cut = bisect_left(open_, (int(capacity * SLACK) + 1, -1))
        del open_[:cut]
    return tuple(np.array(x, np.int64) for x in (box, row, piece, start, size))


def pack_documents(sized: DataFrame, targets: DataFrame, packs: dict[str, int], shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all pages with their containers, for each named capacity.

    ``sized`` holds ``doc_id, source, n_tokens`` and should be cheap to read
    twice; ``targets`` holds ``source, target_share``, one small row per source.
    """
    if any(c < 1 for c in packs.values()):
        raise ValueError("a capacity must be positive")
    shares = {r["source"]: float(r["target_share"] or 0) for r in targets.where("source IS NOT NULL").select("source", "target_share").collect()}
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    rows = sized.select("doc_id", "source", "n_tokens").withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "n_tokens"), F.lit(shards)).cast("long"))
    # What each source is owed after the shards before this one; shards x sources small numbers.
    held = rows.groupBy("shard", "source").agg(F.sum("n_tokens").alias("t"))
    # As many targets as sources were collected above.
    goals = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(x).alias("share")) for s, x in shares.items()]) if shares else F.array().cast("array<struct<source:string,share:double>>")
    whole = held.groupBy("shard").agg(F.sum("t").alias("all"))
    grid = whole.select("shard", "all", F.explode(goals).alias("g")).select("shard", "all", "g.*")
    owed = grid.join(held.where("source IS NOT NULL"), ["shard", "source"], "left").withColumn("owed", F.col("share") * F.col("all") - F.coalesce("t", F.lit(0)))
    owed = materialise(owed.select("shard", "source", "owed", F.floor(F.col("shard") / GROUP).alias("group")), "owed")
    groups = owed.groupBy("group", "source").agg(F.sum("owed").alias("owed"))
    groups = groups.withColumn("before", F.coalesce(F.sum("owed").over(Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("owed")
    before = Window.partitionBy("group", "source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = owed.withColumn("within", F.coalesce(F.sum("owed").over(before), F.lit(0.0))).join(groups, ["group", "source"])
    carry = carry.select(F.col("shard").alias("to_shard"), "source", (F.col("within") + F.col("before")).alias("credit"))

    def fill(docs: pd.DataFrame, owed: pd.DataFrame) -> pd.DataFrame:
        # A fixed order by hash: the queues are mixed, and a task run twice gives the same rows.
        h = pd.util.hash_array(docs["doc_id"].fillna(-1).to_numpy(np.int64))
        docs = docs.iloc[np.lexsort((docs["n_tokens"], h))].reset_index(drop=True)
        names = docs["source"].astype(object).where(docs["source"].notna(), None)
        code, seen = pd.factorize(names, use_na_sentinel=False)
        share = np.array([shares.get(s, 0.0) if isinstance(s, str) else 0.0 for s in seen])
        was = dict(zip(owed["source"], owed["credit"]))
        credit = np.array([was.get(s, 0.0) if isinstance(s, str) else 0.0 for s in seen])
        tokens, shard = docs["n_tokens"].to_numpy(np.int64), int(docs["shard"].iloc[0]) if len(docs) else 0
        out = []
        for name, capacity in packs.items():
            box, row, piece, start, size = pack(code, tokens, share, credit, capacity)
            part = docs[["doc_id", "source"]].iloc[row].reset_index(drop=True)
            out.append(part.assign(pack_name=name, container_id=(shard << 32) + box, piece=piece.astype(np.int32), piece_start=start, n_tokens=size))
        cols = ["pack_name", "container_id", "doc_id", "source", "piece", "piece_start", "n_tokens"]
        return pd.concat(out)[cols]

    return rows.groupBy("shard").cogroup(carry.groupBy("to_shard")).applyInPandas(fill, SCHEMA)


def check_report(packed: DataFrame, sized: DataFrame, packs: dict[str, int]) -> DataFrame:
    """Per capacity: pages packed, whether each came whole, overfull containers, pages divided without need."""
    cap = F.element_at(F.create_map(*[x for n, c in packs.items() for x in (F.lit(n), F.lit(c))]), F.col("pack_name"))
    boxes = packed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("pack_name").agg(F.sum((F.col("t") > cap).cast("long")).alias("overfull"))
    # Rows of the same page and source count together on both sides.
    pages = packed.groupBy("pack_name", "doc_id", "source").agg(F.sum("n_tokens").alias("t"), F.sum((F.col("piece") == 0).cast("long")).alias("k"), F.max("piece").alias("last"))
    sizes = sized.groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("rows"), F.max("n_tokens").alias("longest")).withColumnsRenamed({"doc_id": "d_", "source": "s_"})
    j = pages.join(sizes, F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("source").eqNullSafe(F.col("s_")), "left")
    same = F.coalesce((F.col("t") == F.col("size")) & (F.col("k") == F.col("rows")), F.lit(False))
    out = j.groupBy("pack_name").agg(F.sum("k").alias("pages"), F.min(same).alias("whole"), F.sum(((F.col("last") > 0) & (F.col("longest") <= cap)).cast("long")).alias("divided"))
    return out.join(boxes, "pack_name")


def fill_report(packed: DataFrame, packs: dict[str, int]) -> DataFrame:
    """Containers, tokens and used share of the space per capacity."""
    cap = F.element_at(F.create_map(*[x for n, c in packs.items() for x in (F.lit(n), F.lit(c))]), F.col("pack_name"))
    boxes = packed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("t"))
    return boxes.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")).withColumn("used", F.col("tokens") / (F.col("containers") * cap))
