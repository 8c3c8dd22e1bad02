"""Points near other points, and points inside regions.

Regions: a trapezoidal decomposition. The longitudes of all region vertices, and
of crossings between borders, cut the plane into slabs; inside a slab borders do
not cross, so they are ordered by latitude. A point finds its slab by binary
search and then its place among the slab's borders by binary search; the gap
between two borders knows the regions that cover it (even-odd rule per region,
so holes and parts come for free). Slabs are built per longitude stripe on the
executors. Up to ``BROADCAST_BYTES`` of finished slabs go to every executor and
points are located without a shuffle; beyond it points are grouped with their
stripe, in groups of about ``GROUP`` points: only stripes with more are split by
salt, and their slabs repeated.

Near points: an equi-join on grid cells three radii wide, whose columns follow
the latitude, wrap at the antimeridian and become one near the poles. Cells with
many points are salted.

Defined results: a point with a null or NaN part, latitude beyond 90, longitude
beyond 180, or exactly (0, 0), is no location and gives no row. A point exactly
on a border counts for the side above it, and to the east of a vertical one.
Regions whose text is null or holds no ring give nothing. Repeated rows of
``points_in_regions`` give repeated results; ``near_pairs`` counts each id once.
"""

from __future__ import annotations

import math
import pickle
import re
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

EARTH_M = 6_371_000.0
BROADCAST_BYTES, GROUP = 64 << 20, 500_000
STRIPE_DEG = 1.0
CLOSE = 1e-9
_RING = re.compile(r"\(([^()]+)\)")


def is_location(lat: Column, lon: Column) -> Column:
    """Whether a coordinate pair names a place."""
    good = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(good, F.lit(False))


def rings_of(wkt: str | None) -> list[np.ndarray]:
    """Rings of a POLYGON or MULTIPOLYGON text as arrays of (lon, lat)."""
    out = []
    for text in _RING.findall(wkt or ""):
        ring = np.array([[float(v) for v in p.split()[:2]] for p in text.split(",")])
        if len(ring) >= 3:
            out.append(ring if (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]]))
    return out


def _y_at(e: np.ndarray, x: float | np.ndarray) -> np.ndarray:
    return e[:, 1] + (x - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])


class Slabs:
    """Ordered slabs of one longitude stripe ``[west, east)``.

    An id may come with several regions; a point in any of them is in the id once.
    """

    def __init__(self, regions: list[tuple[int, list[np.ndarray]]], west: float, east: float):
        parts, owner = [], []
        for part, (_, rings) in enumerate(regions):
            for r in rings:
                e = np.hstack([r[:-1], r[1:]])
                e = e[e[:, 0] != e[:, 2]]
                e = np.where((e[:, 0] < e[:, 2])[:, None], e, e[:, [2, 3, 0, 1]])
                e = e[(e[:, 0] < east) & (e[:, 2] > west)]
                parts.append(e)
                owner += [part] * len(e)
        edges = np.vstack(parts) if parts else np.zeros((0, 4))
        own = np.array(owner, np.int64)
        self.regions = regions
        self.sets: list[np.ndarray] = [np.zeros(0, np.int64)]
        seen = {(): 0}
        xs = np.unique(np.clip(edges[:, [0, 2]], west, east)) if len(edges) else np.zeros(0)
        starts, offs, chosen, gaps = [], [0], [], []
        for a, b in zip(xs[:-1], xs[1:]):
            here = np.flatnonzero((edges[:, 0] <= a) & (edges[:, 2] >= b))
            cuts = [a, *self._crossings(edges[here], a, b), b]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                order = here[np.argsort(_y_at(edges[here], (lo + hi) / 2), kind="stable")]
                inside: set[int] = set()
                gap = [0]
                for part in own[order].tolist():
                    inside ^= {part}
                    key = tuple(sorted({regions[p][0] for p in inside}))
                    if key not in seen:
                        seen[key] = len(self.sets)
                        self.sets.append(np.array(key, np.int64))
                    gap.append(seen[key])
                starts.append(lo)
                chosen.append(order)
                offs.append(offs[-1] + len(order))
                gaps += gap
        self.start = np.array([*starts, xs[-1]]) if starts else np.zeros(0)
        self.off = np.array(offs, np.int64)
        self.edge = edges[np.concatenate(chosen)] if chosen else edges
        self.gap = np.array(gaps, np.int64)
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.flat = np.concatenate(self.sets)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]

    @staticmethod
    def _crossings(e: np.ndarray, a: float, b: float) -> list[float]:
        """Longitudes strictly inside (a, b) at which two borders cross."""
        ya, yb = _y_at(e, a), _y_at(e, b)
        order = np.argsort(ya, kind="stable")
        if (np.diff(yb[order]) >= 0).all():
            return []
        d0, d1 = ya[:, None] - ya[None, :], yb[:, None] - yb[None, :]
        i, j = np.nonzero(np.triu(d0 * d1 < 0, 1))
        t = d0[i, j] / (d0[i, j] - d1[i, j])
        x = np.unique(a + t * (b - a))
        return x[(x > a) & (x < b)].tolist()

    def locate(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point in a region: its position in the input and a region id."""
        if len(self.start) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slab = np.searchsorted(self.start, x, side="right") - 1
        pos = np.flatnonzero((slab >= 0) & (slab < len(self.start) - 1))
        slab, x, y = slab[pos], x[pos], y[pos]
        base = self.off[slab]
        lo, hi = np.zeros(len(pos), np.int64), self.off[slab + 1] - base
        near = np.full(len(pos), np.inf)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            e = self.edge[base[live] + mid]
            gap = _y_at(e, x[live]) - y[live]
            near[live] = np.minimum(near[live], np.abs(gap))
            under = gap <= 0
            lo[live] = np.where(under, mid + 1, lo[live])
            hi[live] = np.where(under, hi[live], mid)
        found = self.gap[base + slab + lo]
        n = self.size[found]
        rows = np.repeat(np.arange(len(pos)), n)
        first = np.repeat(self.at[found] - np.concatenate([[0], np.cumsum(n)])[:-1], n) if len(n) else n
        ids = self.flat[first + np.arange(len(rows))]
        if (tight := near < CLOSE).any():
            keep = ~tight[rows]
            more = [(p, rid) for p in np.flatnonzero(tight) for rid in self._exactly(x[p], y[p])]
            rows = np.concatenate([rows[keep], np.array([p for p, _ in more], np.int64)])
            ids = np.concatenate([ids[keep], np.array([r for _, r in more], np.int64)])
        return pos[rows], ids

    def _exactly(self, x: float, y: float) -> list[int]:
        """Regions of a point that lies all but on a border, in rational numbers."""
        px, py, out = Fraction(repr(float(x))), Fraction(repr(float(y))), []
        for rid, rings in self.regions:
            odd = False
            for ring in rings:
                for (x1, y1), (x2, y2) in zip(ring[:-1].tolist(), ring[1:].tolist()):
                    if (x1 <= x) != (x2 <= x):
                        fx1, fy1, fx2, fy2 = (Fraction(repr(v)) for v in (x1, y1, x2, y2))
                        odd ^= fy1 + (px - fx1) * (fy2 - fy1) / (fx2 - fx1) <= py
            if odd and rid not in out:
                out.append(rid)
        return out


def region_slabs(regions: DataFrame, region_id: str, wkt: str, stripe_deg: float = STRIPE_DEG) -> DataFrame:
    """``(stripe, slabs)``: the slabs of each longitude stripe, built on the executors."""

    def stripes(it):
        for pdf in it:
            rid, text, at = [], [], []
            for i, w in zip(pdf["rid"], pdf["wkt"]):
                rings = rings_of(w)
                if rings:
                    x = np.concatenate([r[:, 0] for r in rings])
                    for s in range(math.floor(x.min() / stripe_deg), math.floor(x.max() / stripe_deg) + 1):
                        rid.append(i), text.append(w), at.append(s)
            yield pd.DataFrame({"stripe": np.array(at, np.int64), "rid": np.array(rid, np.int64), "wkt": pd.Series(text, dtype=object)})

    def build(key, pdf):
        # Sorted and unique, so that a region listed twice counts once; other texts of the same id are further regions of it.
        own = sorted(set(zip(pdf["rid"].tolist(), pdf["wkt"])))
        slabs = Slabs([(i, rings_of(w)) for i, w in own], key[0] * stripe_deg, (key[0] + 1) * stripe_deg)
        return pd.DataFrame({"stripe": [key[0]], "slabs": [pickle.dumps(slabs)]})

    named = regions.where(F.col(region_id).isNotNull()).select(F.col(region_id).cast("long").alias("rid"), F.col(wkt).cast("string").alias("wkt"))
    return named.mapInPandas(stripes, "stripe long, rid long, wkt string").groupBy("stripe").applyInPandas(build, "stripe long, slabs binary")


def _locate_batch(slabs: dict[int, Slabs], x: np.ndarray, y: np.ndarray, stripe_deg: float) -> tuple[np.ndarray, np.ndarray]:
    stripe = np.floor(x / stripe_deg).astype(np.int64)
    order = np.argsort(stripe, kind="stable")
    names, first = np.unique(stripe[order], return_index=True)
    rows, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, lo, hi in zip(names.tolist(), first, [*first[1:], len(order)]):
        if s in slabs:
            at = order[lo:hi]
            p, r = slabs[s].locate(x[at], y[at])
            rows.append(at[p])
            ids.append(r)
    return np.concatenate(rows), np.concatenate(ids)


def points_in_regions(points: DataFrame, key: str, kinds: dict[str, tuple[str, str]], regions: DataFrame, region_id: str, wkt: str, stripe_deg: float = STRIPE_DEG, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(kind, key_a, key_b)``: region ids and point keys, for each kind of point of a row.

    ``kinds`` maps a kind to its latitude and longitude columns.
    """
    spark = points.sparkSession
    slabs = materialise(region_slabs(regions, region_id, wkt, stripe_deg), "slabs")
    size = slabs.agg(F.coalesce(F.sum(F.length("slabs")), F.lit(0))).first()[0]
    cols = [F.col(key).cast("long").alias("k")]
    for i, (lat, lon) in enumerate(kinds.values()):
        cols += [F.when(is_location(F.col(lat), F.col(lon)), F.col(c).cast("double")).alias(f"{n}{i}") for n, c in (("y", lat), ("x", lon))]
    flat = points.select(*cols)
    names = list(kinds)
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key_a", T.LongType()), T.StructField("key_b", T.LongType())])
    if size <= broadcast_bytes:
        small = spark.sparkContext.broadcast({r["stripe"]: bytes(r["slabs"]) for r in slabs.collect()})

        def locate(batches):
            own = {s: pickle.loads(b) for s, b in small.value.items()}  # noqa: S301 - made by this module
            for b in batches:
                keys = b.column(0)
                for i, kind in enumerate(names):
                    y, x = (b.column(1 + 2 * i + j).to_numpy(zero_copy_only=False) for j in (0, 1))
                    good = np.flatnonzero(~np.isnan(x))
                    rows, ids = _locate_batch(own, x[good], y[good], stripe_deg)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows)), pa.array(ids), keys.take(pa.array(good[rows]))], names=["kind", "key_a", "key_b"])

        return flat.mapInArrow(locate, schema)

    one = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"y{i}").alias("y"), F.col(f"x{i}").alias("x")) for i, k in enumerate(names)]))
    long = flat.select("k", one.alias("p")).select("k", "p.*").where("x IS NOT NULL").withColumn("stripe", F.floor(F.col("x") / stripe_deg))
    # At most one row to a stripe, so no more than the globe has stripes.
    crowds = materialise(long.groupBy("stripe").count().select("stripe", F.ceil(F.col("count") / GROUP).cast("int").alias("salts")), "crowds")
    long = long.join(F.broadcast(crowds), "stripe").withColumn("salt", F.pmod(F.xxhash64("k", "kind", "x", "y"), F.col("salts")).cast("int")).drop("salts")
    copies = slabs.join(F.broadcast(crowds), "stripe").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def cell(pts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if len(own) and len(pts):
            index = pickle.loads(own["slabs"].iloc[0])  # noqa: S301 - made by this module
            rows, ids = index.locate(pts["x"].to_numpy(), pts["y"].to_numpy())
            return pd.DataFrame({"kind": pts["kind"].to_numpy()[rows], "key_a": ids, "key_b": pts["k"].to_numpy()[rows]})
        return pd.DataFrame({"kind": pd.Series(dtype=object), "key_a": pd.Series(dtype="int64"), "key_b": pd.Series(dtype="int64")})

    return long.groupBy("stripe", "salt").cogroup(copies.groupBy("stripe", "salt")).applyInPandas(cell, schema)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


class Grid:
    """Grid cells for a radius; every place within it of a point lies in ``cells_around``."""

    def __init__(self, radius_m: float, widths: float = 3.0):
        self.radius = radius_m
        self.sin = math.sin(min(radius_m / EARTH_M, math.pi / 2))
        self.reach = math.degrees(radius_m / EARTH_M) * (1 + 1e-6)
        self.high = self.reach * widths
        self.widths = widths

    def _row(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.high)

    def _span(self, lat: Column) -> Column:
        """Half width in degrees of longitude of the circle around a latitude."""
        cap = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(self.sin) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))))) * (1 + 1e-6)
        return F.when(F.abs(lat) + self.reach >= 90, F.lit(180.0)).otherwise(cap)

    def _columns(self, row: Column) -> Column:
        far = F.greatest(F.abs(row * self.high - 90), F.abs((row + 1) * self.high - 90)) + self.reach
        return F.when(far >= 90, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360 / (self.widths * self._span(far))))).cast("long")

    @staticmethod
    def _key(row: Column, col: Column) -> Column:
        return row * (1 << 32) + col

    def cell(self, lat: Column, lon: Column) -> Column:
        row = self._row(lat)
        n = self._columns(row)
        return self._key(row, F.pmod(F.floor(F.pmod(lon, F.lit(360.0)) * n / 360).cast("long"), n))

    def cells_around(self, lat: Column, lon: Column) -> Column:
        east = F.pmod(lon, F.lit(360.0))

        def of_row(row: Column) -> Column:
            n, span = self._columns(row), self._span(lat)
            a, b = F.floor((east - span) * n / 360).cast("long"), F.floor((east + span) * n / 360).cast("long")
            cols = F.when(b - a >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.sequence(a, b))
            return F.transform(cols, lambda c: self._key(row, F.pmod(c, n)))

        rows = F.sequence(self._row(F.greatest(lat - self.reach, F.lit(-90.0))), self._row(F.least(lat + self.reach, F.lit(90.0))))
        return F.array_distinct(F.flatten(F.transform(rows, of_row)))


def near_pairs(points: DataFrame, key: str, lat: str, lon: str, radius_m: float, hot: int = 4000) -> DataFrame:
    """``(key_a, key_b)``: ids of different points at most ``radius_m`` apart, smaller first.

    Cells with more than ``hot`` points are salted: their points are split and
    the points looking at them repeated, so that no task holds a whole cell.
    """
    grid = Grid(radius_m)
    p = points.where(is_location(F.col(lat), F.col(lon)) & F.col(key).isNotNull())
    p = p.select(F.col(key).cast("long").alias("k"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x")).distinct()
    home = p.withColumn("cell", grid.cell(F.col("y"), F.col("x")))
    crowds = home.groupBy("cell").count().where(F.col("count") > hot).select("cell", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    a = home.join(crowds, "cell", "left").select("cell", F.pmod(F.xxhash64("k"), parts).cast("int").alias("salt"), F.col("k").alias("ka"), F.col("y").alias("ya"), F.col("x").alias("xa"))
    b = p.select("k", "y", "x", F.explode(grid.cells_around(F.col("y"), F.col("x"))).alias("cell")).join(crowds, "cell", "left")
    b = b.select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.col("k").alias("kb"), F.col("y").alias("yb"), F.col("x").alias("xb"))
    close = haversine_m(F.col("ya"), F.col("xa"), F.col("yb"), F.col("xb")) <= radius_m
    pairs = a.join(b, ["cell", "salt"]).where((F.col("ka") < F.col("kb")) & (F.abs(F.col("ya") - F.col("yb")) <= grid.reach) & close)
    # One id may stand at several points; its pair then counts once.
    return pairs.select(F.col("ka").alias("key_a"), F.col("kb").alias("key_b")).distinct()
