"""Spatial partitioning: exact cut points of codes, parts by cuts, and tile pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..session import materialise

RANGES = 64


def values_at(df: DataFrame, value: Column, ranks: Callable[[int], list[int]], unique: bool = False) -> list:
    """Values at 0-based positions of the sorted order, without sorting all rows in one place.

    ``ranks`` names the positions for a number of values. Values are counted once;
    approximate quantiles cut them into ranges, and only ranges that hold a wanted
    position are sorted, each by itself.
    """
    v = df.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    counts = materialise(v.withColumn("c", F.lit(1).cast("long")) if unique else v, "counts")
    head = counts.agg(F.sum("c").alias("n"), F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts")).first()
    if not head["n"]:
        return []
    counts = counts.withColumn("p", part_of(F.col("v"), sorted(set(head["cuts"]))))
    before, wanted, at = {}, {}, 0
    for r in counts.groupBy("p").agg(F.sum("c").alias("c")).orderBy("p").collect():
        before[r["p"]] = at
        for k in ranks(head["n"]):
            if at <= k < at + r["c"]:
                wanted[k] = r["p"]
        at += r["c"]
    inner = counts.where(F.col("p").isin(list(set(wanted.values()))))
    inner = inner.withColumn("upto", F.sum("c").over(Window.partitionBy("p").orderBy("v")))
    asked = df.sparkSession.createDataFrame([(k, p, k - before[p]) for k, p in wanted.items()], "rank long, p int, off long")
    hits = inner.join(F.broadcast(asked), "p").where((F.col("off") < F.col("upto")) & (F.col("off") >= F.col("upto") - F.col("c")))
    return [r["v"] for r in hits.orderBy("rank").collect()]


def cut_points(df: DataFrame, code: Column, cuts: int, sample: int | None = None, unique: bool = False, seed: int = 0) -> list[int]:
    """``cuts`` values that part the sorted codes into ``cuts + 1`` even groups.

    ``sample`` bounds how many rows are looked at, chosen at random; None takes all.
    """
    c = df.select(code.alias("v")).where("v IS NOT NULL")
    if sample is not None and (n := c.count()) > sample:
        c = c.sample(sample / n, seed)
    return values_at(c, F.col("v"), lambda n: [(i + 1) * n // (cuts + 1) for i in range(cuts)], unique)


def part_of(code: Column, cuts: list) -> Column:
    """Number of the part: the first cut that is not below the code; a null code has none."""
    if len(cuts) > 16:
        # A chain of so many branches outgrows generated code.
        return F.when(code.isNotNull(), F.size(F.filter(F.lit(list(cuts)), lambda c: c < code)))
    out = F.lit(len(cuts))
    if cuts:
        chain = F.when(code <= cuts[0], 0)
        for i, c in enumerate(cuts[1:], 1):
            chain = chain.when(code <= c, i)
        out = F.when(code.isNotNull(), chain.otherwise(len(cuts)))
    return out


def in_parts(part: Column, bits: int) -> Column:
    """Whether a part's bit is set."""
    return F.call_function("shiftright", F.lit(bits).cast("long"), part.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def pair_code(a_x: Column, a_y: Column, b_x: Column, b_y: Column, levels: int) -> Column:
    """Code of two cells, four bits a level (first cell, second cell), as two ordered longs.

    The upper long holds the first 15 levels.
    """
    low = max(0, levels - 15)
    mask = F.lit((1 << low) - 1).cast("long")

    def half(cut) -> Column:
        out = F.lit(0).cast("long")
        for place, v in enumerate((b_x, b_y, a_x, a_y)):
            wide = codes.spread_by_four(cut(v.cast("long")))
            out = out.bitwiseOR(F.shiftleft(wide, place) if place else wide)
        return out

    lower = half(lambda v: v.bitwiseAND(mask)) if low else F.lit(0).cast("long")
    return F.struct(half(lambda v: F.shiftright(v, low) if low else v).alias("hi"), lower.alias("lo"))


def pair_part(code: Column, cuts: list[tuple[int, int]]) -> Column:
    """Number of the part of a pair code, given cuts as (hi, lo)."""
    below = [((code["hi"] > hi) | ((code["hi"] == hi) & (code["lo"] > lo))).cast("int") for hi, lo in cuts]
    return sum(below, F.lit(0))


def tile_pair_part(a_x: Column, a_y: Column, b_x: Column, b_y: Column, levels: int, parts: list[list[tuple[int, int, int, int, int, int]]]) -> Column:
    """The first part one of whose tile pairs ``(z1, x1, y1, z2, x2, y2)`` holds both cells, else null."""
    out = F.lit(None).cast("int")
    for i, tiles in reversed(list(enumerate(parts))):
        hit = F.lit(False)
        for z1, x1, y1, z2, x2, y2 in tiles:
            inside = (F.shiftright(a_x, levels - z1) == x1) & (F.shiftright(a_y, levels - z1) == y1)
            hit = hit | (inside & (F.shiftright(b_x, levels - z2) == x2) & (F.shiftright(b_y, levels - z2) == y2))
        out = F.when(hit, i).otherwise(out)
    return out


def read_tile_pairs(text: str) -> list[list[tuple[int, ...]]]:
    """Parts of tile pairs from lines of six numbers; ``next`` starts another part."""
    out: list[list[tuple[int, ...]]] = [[]]
    for line in text.splitlines():
        if line.strip() == "next":
            out.append([])
        elif line.strip():
            out[-1].append(tuple(int(v) for v in line.split()))
    return out
