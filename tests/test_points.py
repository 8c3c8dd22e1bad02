import math
import random

import pytest

from prismcube.operators import points, snap


def meters(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1, h)))


def cloud(seed):
    r = random.Random(seed)
    centres = [(0.3, 0.2), (52.0, 179.9998), (52.0, -179.9998), (89.9995, 10.0), (89.9995, -170.0), (-89.9999, 0.0), (-33.0, 151.0)]
    pts = []
    for i in range(420):
        y, x = r.choice(centres)
        y = max(-90.0, min(90.0, y + r.gauss(0, 0.0008)))
        x = x + r.gauss(0, 0.0008) / max(0.01, math.cos(math.radians(y)))
        pts.append((i, y, (x + 180) % 360 - 180))
    return pts


@pytest.mark.parametrize("hot", [4000, 5])
def test_near_pairs_like_brute_force(spark, hot):
    pts = cloud(1)
    df = spark.createDataFrame([*pts, *pts[:50], (999, None, 1.0), (998, 0.0, 0.0), (997, 91.0, 0.0), (996, 5.0, float("nan")), (None, 52.0, 179.9998)], "id long, lat double, lon double")
    got = {tuple(r) for r in points.near_pairs(df, "id", "lat", "lon", 100.0, hot=hot).collect()}
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and meters(a[1:], b[1:]) <= 100}
    assert got == want and len(want) > 500


REGIONS = [
    (1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"),
    (2, "MULTIPOLYGON (((2 2, 6 1, 5 5, 2 2)), ((-3 -3, -1 -3, -2 -1, -3 -3)))"),
    (3, "POLYGON ((1.5 1.5, 2.5 1.5, 2.5 2.5, 1.5 2.5, 1.5 1.5))"),
    (4, None),
    (5, "POLYGON EMPTY"),
]


def inside(wkt, x, y):
    odd = False
    for ring in points.rings_of(wkt):
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
            if (x1 <= x) != (x2 <= x):
                odd ^= bool(y1 + (x - x1) * (y2 - y1) / (x2 - x1) <= y)
    return odd


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_regions_like_brute_force(spark, limit):
    r = random.Random(2)
    pts = [(i, r.uniform(-4, 6), r.uniform(-4, 7)) for i in range(3000)] + [(9001, 1.0, 2.0), (9002, 4.0, 2.0), (9003, 2.0, 0.0)]
    rows = [*pts, pts[0], (9100, None, 1.0), (9101, 0.0, 0.0), (9102, 95.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, lat double, lon double")
    zones = spark.createDataFrame([*REGIONS, REGIONS[0]], "zone_id int, ring string")
    got = sorted(tuple(x) for x in points.points_in_regions(df, "k", {"p": ("lat", "lon")}, zones, "zone_id", "ring", broadcast_bytes=limit).collect())
    want = sorted(("p", z, k) for k, y, x in [*pts, pts[0]] for z, w in REGIONS if inside(w, x, y))
    assert got == want


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_regions_of_one_id_in_several_rows(spark, limit):
    rows = [(7, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"), (7, "POLYGON ((0 1, 2 1, 2 3, 0 3, 0 1))"), (7, "POLYGON ((0 1, 2 1, 2 3, 0 3, 0 1))")]
    zones = spark.createDataFrame(rows, "zone_id int, ring string")
    df = spark.createDataFrame([(1, 0.5, 1.1), (2, 1.5, 1.1), (3, 2.5, 1.1), (4, 3.5, 1.1), (5, 1.0, 1.1)], "k long, lat double, lon double")
    got = sorted(tuple(x) for x in points.points_in_regions(df, "k", {"p": ("lat", "lon")}, zones, "zone_id", "ring", broadcast_bytes=limit).collect())
    assert got == [("p", 7, 1), ("p", 7, 2), ("p", 7, 3), ("p", 7, 5)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, lat double, lon double")
    zones = spark.createDataFrame([], "zone_id int, ring string")
    some = spark.createDataFrame([(1, 1.0, 1.0)], "id long, lat double, lon double")
    assert points.near_pairs(none, "id", "lat", "lon", 100.0).count() == 0
    assert points.points_in_regions(some, "id", {"p": ("lat", "lon")}, zones, "zone_id", "ring").count() == 0
    assert points.points_in_regions(none, "id", {"p": ("lat", "lon")}, spark.createDataFrame(REGIONS, zones.schema), "zone_id", "ring").count() == 0


@pytest.mark.parametrize("first", [None, 5.0])
def test_nearest_like_brute_force(spark, first):
    pts = cloud(3)
    pts += [(1000 + i, *pts[0][1:]) for i in range(30)]
    loc = spark.createDataFrame(pts, "id long, lat double, lon double")
    ask = pts[:80]
    q = spark.createDataFrame(ask, "query_id long, lat double, lon double")
    got = sorted((r["query_id"], r["rank"], round(r["distance_m"], 4)) for r in snap.nearest(q, loc, 200.0, 7, first_m=first).collect())
    want = []
    for i, *a in ask:
        hits = sorted(round(meters(a, b), 4) for _, *b in pts if meters(a, b) <= 200)
        want += [(i, k + 1, m) for k, m in enumerate(hits[:7])]
    assert got == sorted(want)
