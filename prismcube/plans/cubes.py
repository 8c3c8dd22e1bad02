"""Queries of the cube engine on the supplied tables, each with its SQL equivalent."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import parts, snap
from ..session import scratch, table
from ..sources import readers
from ..streaming import live
from . import cube as C
from . import poly, snaplang
from . import targets as T
from .lang import Engine, build_from_map
from .query import Query, cross_filter, series, top_n
from .registry import Catalog

catalog = Catalog()

DAY, HOUR = 86_400, 3_600
E_BASE, O_BASE = 1_704_067_200, 788_918_400
LAT, LON = "((event_id * 37) % 17000) / 100e0 - 84.995e0", "((event_id * 91) % 36000) / 100e0 - 179.995e0"


# ---- cubes


def _raw_events(spark: SparkSession, d: str) -> DataFrame:
    ip = F.concat(F.lit("10."), (F.col("event_id") % 256).cast("string"), F.lit("."), F.expr("CAST((event_id DIV 256) % 256 AS STRING)"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    return table(spark, d, "events").withColumns({"lat": F.expr(LAT), "lon": F.expr(LON), "gx": F.expr("user_id % 16"), "gy": F.expr("event_id % 16"), "ip": ip})


_DIMS = {
    "location": C.quadtree("location", "lat", "lon", 10, f32=False),
    "type": C.categorical("type", "event_type"),
    "time": C.time_bins("time", "ts", 10, E_BASE, HOUR),
    "hour": C.hours("hour", "ts"),
    "weekday": C.weekdays("weekday", "ts"),
    "grid": C.grid("grid", "gx", "gy", 4),
    "slippy": C.grid("slippy", "gx", "gy", 4, slippy=True),
    "ip": C.address("ip", "ip", 8),
}
_MEASURES = [C.count(), C.product("value", "value", scale=2), C.product("value2", "value", "value", scale=4)]


def events(spark: SparkSession, d: str, *dims: str, measures=_MEASURES, raw: DataFrame | None = None, keep=None) -> C.Cube:
    raw = _raw_events(spark, d) if raw is None else raw
    # In the order of the schema, whatever order is asked for.
    own = [s for n, s in _DIMS.items() if n in dims]
    return C.Cube.build(raw, own or [_DIMS["type"]], measures, "events", F.col("event_id"), keep)


def orders(spark: SparkSession, d: str, raw: DataFrame | None = None) -> C.Cube:
    raw = table(spark, d, "orders") if raw is None else raw
    dims = [C.time_bins("time", "o_orderdate", 12, O_BASE, DAY), C.categorical("priority", "o_orderpriority"), C.categorical("status", "o_orderstatus")]
    return C.Cube.build(raw, dims, [C.count(), C.product("price", "o_totalprice", scale=2)], "orders", F.col("o_orderkey"))


def lineitem(spark: SparkSession, d: str) -> C.Cube:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    raw = table(spark, d, "lineitem").join(o, "l_orderkey").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    dims = [C.time_bins("time", "l_shipdate", 12, O_BASE, DAY), C.categorical("flag", "l_returnflag"), C.categorical("status", "l_linestatus")]
    m = [C.count(), C.product("qty", "l_quantity", scale=2), C.product("net", "l_extendedprice", "net", scale=0), C.duration("days", "o_orderdate", "l_shipdate", DAY, scale=3), C.duration("days2", "o_orderdate", "l_shipdate", DAY, 2, scale=3)]
    return C.Cube.build(raw, dims, m, "lineitem", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


# ---- SQL

_HILBERT = "h0 AS (SELECT *, ((10 * 16777216 + (event_id % 256) * 65536) >> 16) AS t, 0 AS ipx, 0 AS ipy FROM e0)" + "".join(
    f""", h{k + 1} AS (SELECT * EXCLUDE (t, ipx, ipy, rx, ry, mx, my), t >> 2 AS t, CASE WHEN ry = 0 THEN my ELSE ipx END + {1 << k} * rx AS ipx, CASE WHEN ry = 0 THEN mx ELSE ipy END + {1 << k} * ry AS ipy
      FROM (SELECT *, CASE WHEN rx = 1 THEN {(1 << k) - 1} - ipx ELSE ipx END AS mx, CASE WHEN rx = 1 THEN {(1 << k) - 1} - ipy ELSE ipy END AS my
      FROM (SELECT *, xor(t & 1, rx) AS ry FROM (SELECT *, (t >> 1) & 1 AS rx FROM h{k}))))"""
    for k in range(8)
)
_E = f"""WITH e00 AS (SELECT *, {LAT} AS lat, {LON} AS lon FROM events),
 ids AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS ty FROM events GROUP BY event_type),
 e0 AS (SELECT e00.*, ty, CAST(floor((lon / 180 + 1) / 2 * 1024) AS BIGINT) AS x, CAST(floor((ln(tan(lat * pi() / 360 + pi() / 4)) / pi() + 1) / 2 * 1024) AS BIGINT) AS y,
   (epoch_us(ts) // 1000000 - {E_BASE}) // 3600 AS t0, user_id % 16 AS gx, event_id % 16 AS gy, CAST(round(value * 100) AS BIGINT) AS v, CAST(round(value * value * 10000) AS BIGINT) AS v2
   FROM e00 JOIN ids USING (event_type)),
 e AS (SELECT * RENAME (t0 AS tb) FROM e0)"""
_C, _V, _V2 = 'CAST(count(*) AS DOUBLE) AS "count"', "CAST(sum(v) AS DOUBLE) / 100 AS value", "CAST(sum(v2) AS DOUBLE) / 10000 AS value2"
_ALL = f"{_C}, {_V}, {_V2}"


def _path(x: str, y: str, levels: int, depth: int) -> str:
    return "concat_ws(':', " + ", ".join(f"(({x} >> {levels - 1 - i}) & 1) + 2 * (({y} >> {levels - 1 - i}) & 1)" for i in range(depth)) + ")"


def _binary(c: str, levels: int, depth: int) -> str:
    return "concat_ws(':', " + ", ".join(f"({c} >> {levels - 1 - i}) & 1" for i in range(depth)) + ")"


def _q(select: str, where: str = "true", by: str = "", source: str = "e") -> str:
    having = "" if by else " HAVING count(*) > 0"
    return f"{_E} SELECT {select} FROM {source} WHERE {where}" + (f" GROUP BY {by}" if by else having)


def _add(name: str, dims: list[str], bind, sql: str | None, select: tuple[str, ...] = ("count", "value", "value2")) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return bind(Query((events(spark, d, *dims),))).select(*select).table()

    catalog.add(name, run, sql)


# ---- slices, dives and aggregates

_add("total", ["type"], lambda q: q, _q(_ALL))
_add("select_measures", ["type"], lambda q: q.b("type", T.Dive(1)), _q(f"CAST(ty AS VARCHAR) AS type, {_V}", by="ty"), ("value",))
_add("dive_type", ["type"], lambda q: q.b("type", T.Dive(1)), _q(f"CAST(ty AS VARCHAR) AS type, {_ALL}", by="ty"))
_add("dive_type_name", ["type"], lambda q: q.b("type", T.Dive(1), "name"), _q(f"event_type AS type, {_ALL}", by="event_type"))
_add("path_slice", ["type"], lambda q: q.b("type", T.Path((2,))), _q(_ALL, "ty = 2"))
_add("alias_slice", ["type"], lambda q: q.b("type", T.Name("click")), _q(_ALL, "event_type = 'click'"))
_add("pathagg", ["type"], lambda q: q.b("type", T.PathAgg((T.Path((0,)), T.Name("view")))), f"{_E} SELECT CAST(sum(w) AS DOUBLE) AS \"count\", CAST(sum(w * v) AS DOUBLE) / 100 AS value, CAST(sum(w * v2) AS DOUBLE) / 10000 AS value2 FROM (SELECT *, CAST(ty = 0 AS BIGINT) + CAST(event_type = 'view' AS BIGINT) AS w FROM e) WHERE w > 0")
_OVER = '{e} SELECT {key}CAST(sum(w) AS DOUBLE) AS "count", CAST(sum(w * v) AS DOUBLE) / 100 AS value, CAST(sum(w * v2) AS DOUBLE) / 10000 AS value2 FROM (SELECT *, {w} AS w FROM e) WHERE w > 0 {by}'
_add("pathagg_overlap", ["location"], lambda q: q.b("location", T.PathAgg((T.Path((0,)), T.Path((0, 3)), T.Path((0,)), T.Path((2, 1))))), _OVER.format(e=_E, key="", by="", w=f"CASE WHEN {_path('x', 'y', 10, 1)} = '0' THEN 2 ELSE 0 END + CASE WHEN {_path('x', 'y', 10, 2)} IN ('0:3', '2:1') THEN 1 ELSE 0 END"))
_add("dive_location_d3", ["location"], lambda q: q.b("location", T.Dive(3)), _q(f"{_path('x', 'y', 10, 3)} AS location, {_ALL}", by=_path("x", "y", 10, 3)))
_add("dive_below_path", ["location"], lambda q: q.b("location", T.Dive(2, T.Path((2, 1)))), _q(f"{_path('x', 'y', 10, 4)} AS location, {_ALL}", f"{_path('x', 'y', 10, 2)} = '2:1'", _path("x", "y", 10, 4)))
_add("dive_below_alias", ["type"], lambda q: q.b("type", T.Dive(0, T.Name("error"))), _q(f"CAST(ty AS VARCHAR) AS type, {_ALL}", "event_type = 'error'", "ty"))
_add("dive_list", ["location"], lambda q: q.b("location", T.DiveList((T.Dive(2, T.Path((1,))), T.Dive(1, T.Path((1, 2))), T.Dive(3, T.Path(()))))), _OVER.format(e=_E, key=f"{_path('x', 'y', 10, 3)} AS location, ", by=f"GROUP BY {_path('x', 'y', 10, 3)}", w=f"1 + CASE WHEN {_path('x', 'y', 10, 1)} = '1' THEN 1 ELSE 0 END + CASE WHEN {_path('x', 'y', 10, 2)} = '1:2' THEN 1 ELSE 0 END"))
_add("dive_too_deep", ["type"], lambda q: q.b("type", T.Dive(2)), _q(f"CAST(ty AS VARCHAR) AS type, {_ALL}", "false", "ty"))
_add("tile2d_slice", ["location"], lambda q: q.b("location", T.Tile(3, 2, 5)), _q(_ALL, "x >> 7 = 2 AND y >> 7 = 5"))
_add("img2d_slice", ["location"], lambda q: q.b("location", T.Tile(3, 2, 2, image=True)), _q(_ALL, "x >> 7 = 2 AND y >> 7 = 5"))
_add("tile2d_range", ["location"], lambda q: q.b("location", T.TileRange(4, (9, 11, 3, 6))), _q(_ALL, "x >> 6 BETWEEN 3 AND 9 AND y >> 6 BETWEEN 6 AND 11"))
_add("img2d_range", ["location"], lambda q: q.b("location", T.TileRange(4, (3, 4, 9, 9), image=True)), _q(_ALL, "x >> 6 BETWEEN 3 AND 9 AND 15 - (y >> 6) BETWEEN 4 AND 9"))
_add("img_hint", ["location"], lambda q: q.b("location", T.Dive(4), "img3"), _q(f"(x >> 6) & 7 AS location_x, 7 - ((y >> 6) & 7) AS location_y, {_ALL}", by="x >> 6, y >> 6"))
_add("tile_hint", ["location"], lambda q: q.b("location", T.Dive(5), "tile5"), _q(f"x >> 5 AS location_x, y >> 5 AS location_y, {_ALL}", by="x >> 5, y >> 5"))
_add("viewport_tiles", ["location"], lambda q: q.b("location", T.Dive(3, T.Tile(4, 9, 6, image=True)), "img3"), _q(f"(x >> 3) & 7 AS location_x, 7 - ((y >> 3) & 7) AS location_y, {_ALL}", "x >> 6 = 9 AND y >> 6 = 9", "x >> 3, y >> 3"))
_add("xy_dive", ["grid"], lambda q: q.b("grid", T.Dive(2), "tile2"), _q(f"gx >> 2 AS grid_x, gy >> 2 AS grid_y, {_ALL}", by="gx >> 2, gy >> 2"))
_add("xy_slippy_dive", ["slippy"], lambda q: q.b("slippy", T.Dive(4), "tile4"), _q(f"gx AS slippy_x, 15 - gy AS slippy_y, {_ALL}", by="gx, gy"))
_add("ip_hilbert", ["ip"], lambda q: q.b("ip", T.Dive(8), "tile8"), f"{_E}, {_HILBERT} SELECT CAST(ipx AS BIGINT) AS ip_x, CAST(255 - ipy AS BIGINT) AS ip_y, {_ALL} FROM h8 GROUP BY ipx, ipy")
_add("hour_dive", ["hour"], lambda q: q.b("hour", T.Dive(1)), _q(f"CAST(hour(ts) AS VARCHAR) AS hour, {_ALL}", by="hour(ts)"))
_add("weekday_dive", ["weekday"], lambda q: q.b("weekday", T.Dive(1)), _q(f"CAST(dayofweek(ts) AS VARCHAR) AS weekday, {_ALL}", by="dayofweek(ts)"))
_add("time_bin_encode", ["time"], lambda q: q.b("time", T.Dive(10)), _q(f"{_binary('tb', 10, 10)} AS time, {_ALL}", by="tb"))
_add("time_hint", ["time"], lambda q: q.b("time", T.Dive(7), "time"), _q(f"make_timestamp(CAST({E_BASE} + (tb >> 3) * 28800 AS BIGINT) * 1000000) AS time, {_ALL}", by="tb >> 3"))
_add("binding_order", ["type", "location"], lambda q: q.b("type", T.Dive(1), "name").b("location", T.Dive(1)).b("type", T.Path((0,))), _q(f"{_path('x', 'y', 10, 1)} AS location, event_type AS type, {_ALL}", by=f"{_path('x', 'y', 10, 1)}, event_type"))

# ---- sequences

_add("interval", ["time"], lambda q: q.b("time", T.Interval(100, 250)), _q(_ALL, "tb >= 100 AND tb < 250"))
_add("intseq_type", ["type", "time"], lambda q: q.b("type", T.Dive(1), "name").b("time", T.IntSeq(0, 24, 30)), _q(f"event_type AS type, tb // 24 AS time, {_ALL}", "tb < 720", "event_type, tb // 24"))
_add("intseq_stride_gap", ["time"], lambda q: q.b("time", T.IntSeq(10, 5, 20, 24)), _q(f"(tb - 10) // 24 AS time, {_ALL}", "tb >= 10 AND (tb - 10) // 24 < 20 AND (tb - 10) % 24 < 5", "(tb - 10) // 24"))


def _buckets(base: int, width: int, n: int, stride: int, grow: int = 0) -> str:
    return f"e JOIN (SELECT unnest(range({n})) AS i) ON tb >= {base} + i * {stride - grow} AND tb < {base} + i * {stride} + {width}"


_add("intseq_overlap", ["time"], lambda q: q.b("time", T.IntSeq(10, 48, 20, 24)), _q(f"i AS time, {_ALL}", by="i", source=_buckets(10, 48, 20, 24)))
_add("intseq_stride_zero", ["time"], lambda q: q.b("time", T.IntSeq(10, 48, 3, 0)), _q(f"i AS time, {_ALL}", by="i", source=_buckets(10, 48, 3, 0)))
_add("intseqagg", ["time"], lambda q: q.b("time", T.IntSeq(24, 24, 7, None, loop=False)), _q(_ALL, "tb >= 24 AND tb < 192"))
_T0 = E_BASE + 5 * DAY
_add("timeseries", ["type", "time"], lambda q: q.b("time", T.TimeSeries(_T0, DAY, 10, DAY)).b("type", T.Dive(1), "name"), _q(f"event_type AS type, (tb - 120) // 24 AS time, {_ALL}", "tb >= 120 AND tb < 360", "event_type, (tb - 120) // 24"))
_add("ctimeseries", ["time"], lambda q: q.b("time", T.TimeSeries(_T0, DAY, 10, 2 * DAY, cumulative=True)), _q(f"i AS time, {_ALL}", by="i", source=_buckets(120, 24, 10, 48, 48)))
_add("timeseriesagg", ["time"], lambda q: q.b("time", T.TimeSeries(_T0, 2 * DAY, 10, DAY, loop=False)), _q(_ALL, source=_buckets(120, 48, 10, 24)))

# ---- masks and regions

_add("mask", ["location"], lambda q: q.b("location", T.Mask.parse("020<<11<<<3<<")), _q(_ALL, f"{_path('x', 'y', 10, 3)} IN ('0:2:0', '0:1:1') OR {_path('x', 'y', 10, 1)} = '3'"))


def _box(z: int, x0: int, y0: int, x1: int, y1: int) -> poly.Poly:
    """The polygon of whole cells from (x0, y0) to (x1, y1), exclusive, a hair inside of their borders."""
    import math

    n, eps = 1 << z, 1e-9
    lon = lambda v: v / n * 360 - 180
    lat = lambda v: math.degrees(2 * math.atan(math.exp((v / n * 2 - 1) * math.pi)) - math.pi / 2)
    a, b, c, e = lat(y0) + eps, lon(x0) + eps, lat(y1) - eps, lon(x1) - eps
    return poly.Poly(((a, b), (a, e), (c, e), (c, b)))


_A, _B = _box(5, 6, 9, 20, 21), _box(5, 14, 5, 26, 17)
_IN_A, _IN_B = "(x >> 5 BETWEEN 6 AND 19 AND y >> 5 BETWEEN 9 AND 20)", "(x >> 5 BETWEEN 14 AND 25 AND y >> 5 BETWEEN 5 AND 16)"
for _n, _shape, _where in (
    ("region_poly", _A, _IN_A),
    ("poly_union", poly.Combined("union", (_A, _B)), f"{_IN_A} OR {_IN_B}"),
    ("poly_intersection", poly.Combined("intersection", (_A, _B)), f"{_IN_A} AND {_IN_B}"),
    ("poly_diff", poly.Combined("diff", (_A, _B)), f"{_IN_A} AND NOT {_IN_B}"),
    ("poly_symdiff", poly.Combined("symdiff", (_A, _B)), f"{_IN_A} <> {_IN_B}"),
    ("poly_complement", poly.Combined("complement", (_A,)), f"NOT {_IN_A}"),
):
    _add(_n, ["location"], lambda q, s=_shape: q.b("location", T.Region(5, s)), _q(_ALL, _where))

# ---- measures

_add("measure_product", ["hour"], lambda q: q.b("hour", T.Dive(1)), _q(f"CAST(hour(ts) AS VARCHAR) AS hour, {_V2}", by="hour(ts)"), ("value2",))
_LI = """WITH l AS (SELECT *, CAST(round(l_quantity * 100) AS BIGINT) AS q, l_extendedprice * (l_extendedprice * (1 - l_discount)) AS n,
  (epoch_us(l_shipdate) // 1000000 - epoch_us(o_orderdate) // 1000000) / 86400 AS dd FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE epoch_us(l_shipdate) // 1000000 >= 788918400)"""


@catalog.query("duration", f"{_LI} SELECT l_returnflag AS flag, CAST(count(*) AS DOUBLE) AS \"count\", CAST(sum(q) AS DOUBLE) / 100 AS qty, CAST(sum(CAST(round(dd * 1000) AS BIGINT)) AS DOUBLE) / 1000 AS days FROM l GROUP BY 1")
def duration(spark: SparkSession, d: str) -> DataFrame:
    return Query((lineitem(spark, d),)).b("flag", T.Dive(1), "name").select("count", "qty", "days").table()


@catalog.query("duration2", f"{_LI} SELECT l_linestatus AS status, CAST(sum(CAST(round(dd * dd * 1000) AS BIGINT)) AS DOUBLE) / 1000 AS days2 FROM l GROUP BY 1")
def duration2(spark: SparkSession, d: str) -> DataFrame:
    return Query((lineitem(spark, d),)).b("status", T.Dive(1), "name").select("days2").table()


@catalog.query("row_bitset", _q("CAST(ty AS VARCHAR) AS type, CAST(sum(CASE WHEN event_id < 50 THEN CAST(1 AS BIGINT) << CAST(event_id AS INTEGER) ELSE 0 END) AS DOUBLE) AS bits", by="ty"))
def row_bitset(spark: SparkSession, d: str) -> DataFrame:
    row = F.when(F.col("event_id") < 50, F.col("event_id")).otherwise(F.lit(-1))
    return Query((events(spark, d, "type", measures=[C.row_bitset("bits", row)]),)).b("type", T.Dive(1)).table()


@catalog.query("mean", _q('event_type AS type, CAST(sum(v) AS DOUBLE) / 100 / count(*) AS value', by="event_type"))
def mean(spark: SparkSession, d: str) -> DataFrame:
    q = Query((events(spark, d, "type"),)).b("type", T.Dive(1), "name")
    return (q.select("value") / q.select("count")).table()


@catalog.query("stddev", _q("event_type AS type, sqrt(CAST(sum(v2) AS DOUBLE) / 10000 / count(*) - (CAST(sum(v) AS DOUBLE) / 100 / count(*)) * (CAST(sum(v) AS DOUBLE) / 100 / count(*))) AS stddev", by="event_type"))
def stddev(spark: SparkSession, d: str) -> DataFrame:
    q = Query((events(spark, d, "type"),)).b("type", T.Dive(1), "name")
    m = q.select("value") / q.select("count")
    return (q.select("value2") / q.select("count") - m * m).table().select("type", F.sqrt("value2").alias("stddev"))


# ---- algebra

_SIDES = """ , a AS (SELECT x >> 5 AS px, y >> 5 AS py, CAST(count(*) AS DOUBLE) AS l FROM e WHERE event_type = 'click' GROUP BY 1, 2),
 b AS (SELECT x >> 5 AS px, y >> 5 AS py, CAST(count(*) AS DOUBLE) AS r FROM e WHERE event_type = 'purchase' GROUP BY 1, 2) """
for _n, _op, _v in (
    ("add", "+", "coalesce(l + r, l, r)"),
    ("sub", "-", "coalesce(l - r, l, -r)"),
    ("mul", "*", "coalesce(l * r, 0)"),
    ("div", "/", "CASE WHEN r IS NULL THEN 'nan'::DOUBLE WHEN l IS NULL THEN 0 ELSE l / r END"),
):

    def _equal(spark: SparkSession, d: str, op=_op) -> DataFrame:
        q = Query((events(spark, d, "type", "location"),)).b("location", T.Dive(5), "tile5").select("count")
        a, b = q.b("type", T.Name("click")), q.b("type", T.Name("purchase"))
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[op].table()

    catalog.add(f"algebra_equal_{_n}", _equal, f"{_E}{_SIDES} SELECT px AS location_x, py AS location_y, {_v} AS \"count\" FROM a FULL JOIN b USING (px, py)")


@catalog.query("algebra_coarser", f"{_E} , a AS (SELECT x >> 8 AS px, y >> 8 AS py, sum(v) / 100 AS l FROM e WHERE event_type = 'click' AND x < 700 GROUP BY 1, 2), b AS (SELECT x >> 6 AS px, y >> 6 AS py, sum(v) / 100 AS r FROM e GROUP BY 1, 2) SELECT b.px AS location_x, b.py AS location_y, CASE WHEN l IS NULL THEN 0 ELSE CAST(l AS DOUBLE) / r END AS value FROM b LEFT JOIN a ON b.px >> 2 = a.px AND b.py >> 2 = a.py")
def algebra_coarser(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d, "type", "location")
    a = Query((C.Cube(c.df.where(codes.cell_x(c.code("location")) < 700), c.schema),)).b("type", T.Name("click")).b("location", T.Dive(2), "tile2").select("value")
    return (a / Query((c,)).b("location", T.Dive(4), "tile4").select("value")).table()


@catalog.query("algebra_finer", f"{_E} , a AS (SELECT x >> 6 AS px, y >> 6 AS py, sum(v) / 100 AS l FROM e GROUP BY 1, 2), b AS (SELECT x >> 8 AS px, y >> 8 AS py, sum(v) / 100 AS r FROM e GROUP BY 1, 2) SELECT a.px AS location_x, a.py AS location_y, CAST(l AS DOUBLE) / r AS value FROM a JOIN b ON a.px >> 2 = b.px AND a.py >> 2 = b.py")
def algebra_finer(spark: SparkSession, d: str) -> DataFrame:
    q = Query((events(spark, d, "location"),)).select("value")
    return (q.b("location", T.Dive(4), "tile4") / q.b("location", T.Dive(2))).table()


@catalog.query("algebra_scalar_share", _q('event_type AS type, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM e) AS "count"', by="event_type"))
def algebra_scalar_share(spark: SparkSession, d: str) -> DataFrame:
    q = Query((events(spark, d, "type"),)).select("count")
    return (q.b("type", T.Dive(1), "name") / q).table()


@catalog.query("measure_op_number", _q('event_type AS type, CAST(count(*) AS DOUBLE) * 3 - 7 AS "count"', by="event_type"))
def measure_op_number(spark: SparkSession, d: str) -> DataFrame:
    return (Query((events(spark, d, "type"),)).b("type", T.Dive(1), "name").select("count") * 3 - 7).table()


@catalog.query("number_op_measure", _q('event_type AS type, 100000 / (1 + CAST(count(*) AS DOUBLE)) AS "count"', by="event_type"))
def number_op_measure(spark: SparkSession, d: str) -> DataFrame:
    return (100000 / (1 + Query((events(spark, d, "type"),)).b("type", T.Dive(1), "name").select("count"))).table()


@catalog.query(
    "two_cube_ratio",
    f"""WITH o AS (SELECT (epoch_us(o_orderdate) // 1000000 - {O_BASE}) // 2592000 AS i, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT (epoch_us(l_shipdate) // 1000000 - {O_BASE}) // 2592000 AS i, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT i AS time, CASE WHEN o.n IS NULL THEN 'nan'::DOUBLE WHEN l.n IS NULL THEN 0 ELSE CAST(l.n AS DOUBLE) / o.n END AS "count" FROM l FULL JOIN o USING (i) WHERE i >= 0 AND i < 90""",
)
def two_cube_ratio(spark: SparkSession, d: str) -> DataFrame:
    months = T.TimeSeries(O_BASE, 30 * DAY, 90, 30 * DAY)
    a, b = Query((lineitem(spark, d),)), Query((orders(spark, d),))
    return (a.b("time", months).select("count") / b.b("time", months).select("count")).table()


@catalog.query("multipart_sum", _q(f"event_type AS type, {_ALL}", by="event_type"))
def multipart_sum(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw_events(spark, d)
    first = events(spark, d, "type", raw=raw.where("event_id % 3 = 0"))
    more = [C.Cube.build(raw.where(f"event_id % 3 = {i}"), [_DIMS["type"]], _MEASURES, "events", F.col("event_id"), start=first.schema) for i in (1, 2)]
    return Query((C.Cube(first.df, more[-1].schema), *more)).b("type", T.Dive(1), "name").table()


# ---- partitioning

_Z = " + ".join(f"((x >> {i}) & 1) * {1 << 2 * i} + ((y >> {i}) & 1) * {1 << 2 * i + 1}" for i in range(10))
_CUTS = f"{_E}, z AS (SELECT {_Z} AS z FROM e), s AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS k, count(*) OVER () AS n FROM z), c AS (SELECT i, z AS cut FROM s JOIN (SELECT unnest(range(7)) AS i) ON k = (i + 1) * n // 8)"


@catalog.query("qpart_cuts", f"{_CUTS} SELECT i AS part, CAST(cut AS BIGINT) AS cut FROM c")
def qpart_cuts(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d, "location")
    cuts = parts.cut_points(c.df, c.code("location"), 7)
    return spark.createDataFrame(list(enumerate(cuts)), "part long, cut long")


@catalog.query("qpart_counts", f"{_CUTS} SELECT p AS part, count(*) AS n FROM (SELECT z, (SELECT count(*) FROM c WHERE cut < z) AS p FROM z) GROUP BY 1")
def qpart_counts(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d, "location")
    part = parts.part_of(c.code("location"), parts.cut_points(c.df, c.code("location"), 7))
    return c.df.groupBy(part.cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@catalog.query("qpart_kept", f"{_CUTS} SELECT count(*) AS n FROM (SELECT z, (SELECT count(*) FROM c WHERE cut < z) AS p FROM z) WHERE (37 >> p) & 1 = 1")
def qpart_kept(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d, "location")
    part = parts.part_of(c.code("location"), parts.cut_points(c.df, c.code("location"), 7))
    return c.df.where(parts.in_parts(part, 37)).agg(F.count(F.lit(1)).alias("n"))


_PAIR = " + ".join(f"(((gx >> {i}) & 1) + 2 * ((gy >> {i}) & 1)) * {4 << 4 * i} + (((hx >> {i}) & 1) + 2 * ((hy >> {i}) & 1)) * {1 << 4 * i}" for i in range(4))
_PSQL = f"{_E}, h AS (SELECT *, (event_id // 16) % 16 AS hx, (event_id // 256) % 16 AS hy FROM e), p AS (SELECT *, {_PAIR} AS z FROM h)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _raw_events(spark, d).withColumns({"hx": F.expr("(event_id DIV 16) % 16"), "hy": F.expr("(event_id DIV 256) % 16")})


@catalog.query("qpart2_counts", f"{_PSQL} SELECT CAST(z >= 20000 AS BIGINT) * CAST(z > 20000 AS BIGINT) + CAST(z > 50000 AS BIGINT) AS part, count(*) AS n FROM p GROUP BY 1")
def qpart2_counts(spark: SparkSession, d: str) -> DataFrame:
    code = parts.pair_code(F.col("gx"), F.col("gy"), F.col("hx"), F.col("hy"), 4)
    return _pairs(spark, d).withColumn("c", code).groupBy(parts.pair_part(F.col("c"), [(20000, 0), (50000, 0)]).cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@catalog.query("tpart2_counts", f"{_PSQL} SELECT CASE WHEN gx >> 3 = 0 AND gy >> 3 = 0 AND hx >> 2 = 1 AND hy >> 2 = 2 THEN 0 WHEN gx >> 3 = 1 AND gy >> 3 = 0 THEN 1 END AS part, count(*) AS n FROM p GROUP BY 1")
def tpart2_counts(spark: SparkSession, d: str) -> DataFrame:
    listed = parts.read_tile_pairs("1 0 0 2 1 2\nnext\n1 1 0 0 0 0\n")
    part = parts.tile_pair_part(F.col("gx"), F.col("gy"), F.col("hx"), F.col("hy"), 4, listed)
    return _pairs(spark, d).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@catalog.query("csv_col_distinct", "SELECT DISTINCT p_brand FROM part")
def csv_col_distinct(spark: SparkSession, d: str) -> DataFrame:
    return readers.distinct_values(table(spark, d, "part"), "p_brand")


@catalog.query("row_range", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 250 OFFSET 100")
def row_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows by position: the range is the feature."""
    return readers.row_range(table(spark, d, "events"), ["event_id"], 100, 250).select("event_id", "event_type")


# ---- aliases, schema and statistics

_ALIASES = "click\tview\tvisit\nsignup\tpurchase\tdeal\n"
_TREE = "@hierarchy\nsoft\n\tclick\tlook\n\tview\tsee\nhard\n\tsignup\tpurchase\tdeal\n"


@catalog.query("alias_table", _q(f"CASE WHEN event_type IN ('click', 'view') THEN 'visit' ELSE 'deal' END AS type, {_ALL}", "event_type <> 'error'", "1"))
def alias_table(spark: SparkSession, d: str) -> DataFrame:
    c = C.Cube.build(_raw_events(spark, d), [C.categorical("type", "event_type", alias_text=_ALIASES)], _MEASURES)
    return Query((c,)).b("type", T.Dive(1), "name").table()


@catalog.query("hierarchy_alias", _q(f"CASE WHEN event_type IN ('click', 'view') THEN 'soft' ELSE 'hard' END AS type, {_ALL}", "event_type <> 'error'", "1"))
def hierarchy_alias(spark: SparkSession, d: str) -> DataFrame:
    c = C.Cube.build(_raw_events(spark, d), [C.categorical("type", "event_type", 2, 2, _TREE)], _MEASURES)
    return Query((c,)).b("type", T.Dive(1), "name").table()


@catalog.query("category_ids", f"{_E} SELECT event_type AS value, ty AS id FROM ids")
def category_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.category_table(table(spark, d, "events"), F.col("event_type"), F.col("event_id"), 256)


@catalog.query("category_overflow", _q(_ALL, "ty < 4"))
def category_overflow(spark: SparkSession, d: str) -> DataFrame:
    c = C.Cube.build(_raw_events(spark, d), [C.categorical("type", "event_type", 1, 2)], _MEASURES, order=F.col("event_id"))
    return Query((c,)).table()


@catalog.query(
    "schema_table",
    "SELECT * FROM (VALUES ('orders', 'time', 'index', 1, 12, 'temporal|788918400_86400s', 0), ('orders', 'priority', 'index', 8, 1, 'categorical', (SELECT CAST(count(DISTINCT o_orderpriority) AS INTEGER) FROM orders)), ('orders', 'status', 'index', 8, 1, 'categorical', (SELECT CAST(count(DISTINCT o_orderstatus) AS INTEGER) FROM orders)), ('orders', 'count', 'measure', NULL, NULL, 'u32', NULL), ('orders', 'price', 'measure', NULL, NULL, 'f64', NULL)) t(cube, name, role, bits, levels, kind, aliases)",
)
def schema_table(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).describe()


@catalog.query("cube_stats", _q("count(*) AS num_rows, count(DISTINCT (x, y, ty, tb)) AS num_bins"))
def cube_stats(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "location", "type", "time").stats()


@catalog.query("time_bounds", _q("min(tb) AS first_bin, max(tb) AS last_bin"))
def time_bounds(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "time").bounds("time")


@catalog.query("saved_cube", _q(f"event_type AS type, tb // 24 AS time, {_ALL}", "tb < 720", "event_type, tb // 24"))
def saved_cube(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "cube")
    events(spark, d, "type", "time").save(path)
    return Query((C.Cube.load(spark, path),)).b("type", T.Dive(1), "name").b("time", T.IntSeq(0, 24, 30)).table()


@catalog.query("rollup", _q(f"{_path('x', 'y', 10, 3)} AS location, event_type AS type, {_ALL}", by=f"{_path('x', 'y', 10, 3)}, event_type"))
def rollup(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d, "location", "type").rollup({"location": 4, "type": 1})
    return Query((c,)).b("location", T.Dive(3)).b("type", T.Dive(1), "name").table()


@catalog.query("saved_rollup", _q(f"{_path('x', 'y', 10, 4)} AS location, event_type AS type, {_ALL}", f"{_path('x', 'y', 10, 2)} = '2:1' AND event_type <> 'view'", f"{_path('x', 'y', 10, 4)}, event_type"))
def saved_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Answered by a stored rollup, filters included."""
    path = scratch(spark, "cube")
    events(spark, d, "location", "type", "time").rollup({"location": 4, "type": 1}).save(path)
    q = Query((C.Cube.load(spark, path),)).b("location", T.Dive(2, T.Path((2, 1))))
    return q.b("type", T.DiveList(tuple(T.Dive(0, T.Name(n)) for n in ("click", "purchase", "error", "signup") if n in q.cubes[0].schema.dim("type").alias.inputs)), "name").table()


@catalog.query("multipart_own_ids", _q(f"event_type AS type, {_ALL}", by="event_type"))
def multipart_own_ids(spark: SparkSession, d: str) -> DataFrame:
    """Parts that number their categories each in its own way: names decide."""
    raw, paths = _raw_events(spark, d), []
    for i, part in enumerate((raw.where("event_id % 3 = 1"), raw.where("event_id % 3 <> 1"))):
        paths.append(scratch(spark, "part"))
        C.Cube.build(part, [_DIMS["type"]], _MEASURES, "events", F.col("event_id") * (-1) ** i).save(paths[-1])
    return Query((C.Cube.load(spark, *paths),)).b("type", T.Dive(1), "name").table()


@catalog.query("stream_cube", _q(f"event_type AS type, {_ALL}", by="event_type"))
def stream_cube(spark: SparkSession, d: str) -> DataFrame:
    """The cube grown from a stream of files, then queried."""
    like = events(spark, d, "type")
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    out, mark = scratch(spark, "live"), scratch(spark, "mark")
    live.grow(stream, lambda b: C.Cube.build(b, [_DIMS["type"]], _MEASURES, start=like.schema), out, mark).awaitTermination()
    return Query((live.snapshot(spark, out, like),)).b("type", T.Dive(1), "name").table()


# ---- snap

_PLACE = "CAST(((k * 37) % 17000) / 100e0 - 84.995e0 AS DOUBLE) AS lat, CAST(((k * 91) % 36000) / 100e0 - 179.995e0 AS DOUBLE) AS lon"
_RADIUS_M, _NEAREST = 150_000.0, 5


def _locates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey AS k").selectExpr("k AS id", *re.split(r", (?=CAST)", _PLACE))


def _objects(spark: SparkSession, d: str) -> DataFrame:
    tags = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select((F.col("c_custkey") % 97).alias("g"), "c_custkey", tags.alias("tags")).select(F.col("c_custkey").alias("id"), "tags", F.array("c_custkey", F.col("g") + 1).alias("locate_ids"))


_SNAP = f"""WITH l AS (SELECT k AS id, {_PLACE} FROM (SELECT c_custkey AS k FROM customer)), q AS (SELECT k AS query_id, {_PLACE} FROM (SELECT s_suppkey * 7 AS k FROM supplier)),
 j AS (SELECT query_id, id, 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(l.lat - q.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(q.lat)) * pow(sin(radians(l.lon - q.lon) / 2), 2)))) AS m FROM q JOIN l ON abs(l.lat - q.lat) < 1.4),
 r AS (SELECT query_id, id, m, row_number() OVER (PARTITION BY query_id ORDER BY round(m, 3), id) AS rank FROM j WHERE m <= {_RADIUS_M})"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "supplier").selectExpr("s_suppkey * 7 AS k").selectExpr("k AS query_id", *re.split(r", (?=CAST)", _PLACE))
    return snap.nearest(q, _locates(spark, d), _RADIUS_M, _NEAREST)


@catalog.query("snap_radius_knn", f"{_SNAP} SELECT query_id, id, round(m, 1) AS distance_m FROM r WHERE rank <= {_NEAREST}")
def snap_radius_knn(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("query_id", "id", F.round("distance_m", 1).alias("distance_m"))


_OBJ = "o AS (SELECT c_custkey AS id, c_mktsegment AS s, CAST(c_nationkey AS VARCHAR) AS n, unnest(list_distinct([c_custkey, c_custkey % 97 + 1])) AS loc FROM customer)"


@catalog.query("snap_filter_kv", f"{_SNAP}, {_OBJ} SELECT o.id AS object_id, count(DISTINCT r.id) AS places FROM r JOIN o ON r.id = o.loc WHERE rank <= {_NEAREST} AND (s = 'BUILDING' OR s = 'MACHINERY') AND NOT n = '3' GROUP BY 1")
def snap_filter_kv(spark: SparkSession, d: str) -> DataFrame:
    tag = (snap.kv("segment", "BUILDING") + snap.v("MACHINERY")) * ~snap.kv("nation", "3") * snap.k("segment")
    return snap.by_object(_found(spark, d), _objects(spark, d), tag).select("object_id", F.size("locate_ids").cast("long").alias("places"))


@catalog.query("snap_support", f"WITH {_OBJ} SELECT loc AS id FROM o WHERE s = 'BUILDING' AND loc IN (SELECT c_custkey FROM customer) GROUP BY 1 HAVING count(DISTINCT id) BETWEEN 2 AND 40")
def snap_support(spark: SparkSession, d: str) -> DataFrame:
    return snap.supported(_locates(spark, d), _objects(spark, d), snap.kv("segment", "BUILDING"), 2, 40).select("id")


@catalog.query("snap_points", f"{_SNAP} SELECT query_id AS k, round(l.lat, 3) AS lat, round(l.lon, 3) AS lon FROM r JOIN l USING (id) WHERE rank = 1")
def snap_points(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "supplier").selectExpr("s_suppkey * 7 AS k").selectExpr("k", *re.split(r", (?=CAST)", _PLACE))
    return snap.snap_points(q, "k", "lat", "lon", _locates(spark, d), _RADIUS_M).select("k", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))


_LANG = "snap.loc(12.5,-30,-41,75.25,0.5,179.9).radius(900000).max(7).filter((kv('segment','BUILDING')+v('MACHINERY'))*not(kv('nation','3')))"
_LANG_SQL = f"""WITH {_OBJ}, l AS (SELECT k AS id, {_PLACE} FROM (SELECT c_custkey AS k FROM customer)), q AS (SELECT * FROM (VALUES (0, 12.5, -30.0), (1, -41.0, 75.25), (2, 0.5, 179.9)) t(query_id, qlat, qlon)),
 ok AS (SELECT DISTINCT loc FROM o WHERE (s = 'BUILDING' OR s = 'MACHINERY') AND NOT n = '3'),
 j AS (SELECT query_id, l.id, 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(l.lat - qlat) / 2), 2) + cos(radians(l.lat)) * cos(radians(qlat)) * pow(sin(radians(l.lon - qlon) / 2), 2)))) AS m FROM q CROSS JOIN l JOIN ok ON ok.loc = l.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(m, 3), id) AS rank FROM j WHERE m <= 900000)"""


@catalog.query("snap_language", f"{_LANG_SQL} SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, id, round(m, 1) AS distance_m, (SELECT count(DISTINCT o.id) FROM o WHERE loc = r.id AND (s = 'BUILDING' OR s = 'MACHINERY') AND NOT n = '3') AS matching FROM r WHERE rank <= 7")
def snap_language(spark: SparkSession, d: str) -> DataFrame:
    got = snaplang.answer(_LANG, _locates(spark, d), _objects(spark, d))
    return got.select("query_id", "rank", "id", F.round("distance_m", 1).alias("distance_m"), F.size("objects").cast("long").alias("matching"))


@catalog.query("snap_objects_all", f"{_LANG_SQL} SELECT o.id AS object_id, count(*) AS locates FROM r JOIN o ON o.loc = r.id WHERE rank <= 7 GROUP BY 1")
def snap_objects_all(spark: SparkSession, d: str) -> DataFrame:
    got = snaplang.answer(_LANG + ".order('objects_all')", _locates(spark, d), _objects(spark, d))
    return got.select("object_id", F.size("locates").cast("long").alias("locates"))


# ---- clients


@catalog.query("client_topn", f"{_E}, s AS (SELECT x >> 8 AS px, y >> 8 AS py, count(*) AS n FROM e WHERE event_type IN ('click', 'view') GROUP BY 1, 2), t AS (SELECT px, py FROM s ORDER BY n DESC, {' + '.join(f'((px >> {i}) & 1) * {1 << 2 * i} + ((py >> {i}) & 1) * {1 << 2 * i + 1}' for i in range(2))} LIMIT 4) SELECT x >> 8 AS location_x, y >> 8 AS location_y, {_C} FROM e JOIN t ON x >> 8 = px AND y >> 8 = py WHERE event_type = 'click' GROUP BY 1, 2")
def client_topn(spark: SparkSession, d: str) -> DataFrame:
    """The best of several series: the number of keys is the feature."""
    q = Query((events(spark, d, "location", "type"),)).b("location", T.Dive(2), "tile2").select("count")
    return top_n([q.b("type", T.Name(n)).result() for n in ("click", "view")], 4)[0]


_CLIENT = f"{_E}{_SIDES} SELECT px AS location_x, py AS location_y, {{f}}(coalesce(l, 0), coalesce(r, 0)) AS value FROM a FULL JOIN b USING (px, py) WHERE {{f}}(coalesce(l, 0), coalesce(r, 0)) <> 0"
for _n, _op, _f in (("max", "||", "greatest"), ("min", "&&", "least")):

    def _client(spark: SparkSession, d: str, op=_op) -> DataFrame:
        q = Query((events(spark, d, "type", "location"),)).b("location", T.Dive(5), "tile5").select("count")
        return series(q.b("type", T.Name("click")).result(), q.b("type", T.Name("purchase")).result(), op)

    catalog.add(f"client_{_n}", _client, _CLIENT.format(f=_f))


@catalog.query("cross_filter", _q(f"event_type AS type, {_C}", "hour(ts) = 9 AND tb < 240", "event_type"))
def cross_filter_type(spark: SparkSession, d: str) -> DataFrame:
    """The view of types: all other selections hold, its own does not."""
    q = Query((events(spark, d, "type", "time", "hour"),)).select("count")
    chosen = {"type": (T.Name("click"), ""), "hour": (T.Path((9,)), ""), "time": (T.Interval(0, 240), "")}
    return cross_filter(q, chosen, {"type": (T.Dive(1), "name"), "hour": (T.Dive(1), "")})["type"].table()


@catalog.query("drill_through", f"{_E} SELECT event_id, user_id FROM e WHERE x >> 7 = 2 AND y >> 7 = 5 AND event_type IN ('click', 'error') AND tb BETWEEN 100 AND 499")
def drill_through(spark: SparkSession, d: str) -> DataFrame:
    q = Query((events(spark, d, "location", "type", "time", keep=["event_id", "user_id"]),))
    q = q.b("location", T.Tile(3, 2, 5)).b("type", T.PathAgg((T.Name("click"), T.Name("error")))).b("time", T.Interval(100, 500))
    return q.rows().select("event_id", "user_id")


@catalog.query("cumulative_window", f"{_E}, d AS (SELECT tb // 24 AS time, count(*) AS n FROM e WHERE tb < 720 GROUP BY 1) SELECT time, CAST(sum(n) OVER (ORDER BY time) AS DOUBLE) AS total FROM d")
def cumulative_window(spark: SparkSession, d: str) -> DataFrame:
    t = Query((events(spark, d, "time"),)).b("time", T.IntSeq(0, 24, 30)).select("count").table()
    # At most one row per bucket, 30 in all.
    return t.select("time", F.sum("count").over(Window.orderBy("time")).alias("total"))


@catalog.query("tile_mosaic", _q(f"x >> 4 AS col, 63 - (y >> 4) AS row, {_C}", "x >> 7 BETWEEN 2 AND 3 AND y >> 7 BETWEEN 4 AND 5", "x >> 4, y >> 4"))
def tile_mosaic(spark: SparkSession, d: str) -> DataFrame:
    """Four tiles as one picture: one filter and one group-by."""
    q = Query((events(spark, d, "location"),)).select("count")
    tiles = T.DiveList(tuple(T.Dive(3, T.Tile(3, x, y, image=True)) for x in (2, 3) for y in (2, 3)))
    t = q.b("location", tiles, "img6").table()
    return t.select(F.col("location_x").alias("col"), F.col("location_y").alias("row"), "count")


@catalog.query("cell_bounds", "SELECT x, round(x / 8 * 360 - 180, 6) AS west, round(degrees(2 * atan(exp((x / 8 * 2 - 1) * pi())) - pi() / 2), 6) AS south FROM (SELECT DISTINCT event_id % 8 AS x FROM events)")
def cell_bounds(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").select((F.col("event_id") % 8).alias("x")).distinct()
    b = codes.cell_bounds(F.lit(3), F.col("x"), F.col("x"))
    return c.select("x", F.round(b["west"], 6).alias("west"), F.round(b["south"], 6).alias("south"))


@catalog.query("time_text", "SELECT case_id, received_at, epoch_us(strptime(time, '%Y/%m/%d %H:%M:%S')) // 1000000 AS second FROM crimes WHERE try_strptime(time, '%Y/%m/%d %H:%M:%S') IS NOT NULL")
def time_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crimes").select("case_id", "received_at", codes.parse_time(F.col("time")).alias("second")).where("second IS NOT NULL")


# ---- languages

_MAP = f"""
# location from derived coordinates
index_dimension('location', input('lat', 'lon'), latlon(10));
index_dimension('type', input('event_type'), categorical());
index_dimension('time', input('ts'), time(10, '2024-01-01T00:00:00', 3600, 0));
index_dimension('hour', input('ts'), hour());
measure_dimension('count', input(), u32);
measure_dimension('users', input('user_id'), u64);
measure_dimension('pairs', input('user_id', 'event_id'), s64);
"""


@catalog.query("map_language", _q('CAST(hour(ts) AS VARCHAR) AS hour, CAST(count(*) AS DOUBLE) AS "count", CAST(sum(user_id) AS DOUBLE) AS users, CAST(sum(user_id * event_id) AS DOUBLE) AS pairs', "event_type = 'click'", "hour(ts)"))
def map_language(spark: SparkSession, d: str) -> DataFrame:
    c = build_from_map(_MAP, _raw_events(spark, d), "events", F.col("event_id"))
    return Engine().add("events", c).table("q(events.b('type', 'click').b('hour', dive(1)))")


_TEXT = "x = ev.b('location', dive(2), 'tile2').select('count'); { q((x.b('type','click') + 2*3) / (x.b('type', pathagg('view','error')) - 1)) };"


@catalog.query(
    "query_language",
    f"""{_E}, a AS (SELECT x >> 8 AS px, y >> 8 AS py, CAST(count(*) AS DOUBLE) + 6 AS l FROM e WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT x >> 8 AS px, y >> 8 AS py, CAST(count(*) AS DOUBLE) - 1 AS r FROM e WHERE event_type IN ('view', 'error') GROUP BY 1, 2)
    SELECT px AS location_x, py AS location_y, CASE WHEN r IS NULL THEN 'nan'::DOUBLE WHEN l IS NULL THEN 0 WHEN r = 0 THEN CASE WHEN l > 0 THEN 'inf'::DOUBLE WHEN l < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE l / r END AS "count" FROM a FULL JOIN b USING (px, py)""",
)
def query_language(spark: SparkSession, d: str) -> DataFrame:
    return Engine().add("ev", events(spark, d, "location", "type")).table(_TEXT)


@catalog.query("intseq", _q(f"event_type AS type, tb // 24 AS time, {_C}", "tb < 720", "event_type, tb // 24"))
def intseq(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: a series of days per type, asked in the query language."""
    return Engine().add("events", events(spark, d, "type", "time")).table("q(events.b('type',dive(1),'name').b('time',intseq(0,24,30)).select('count'))")
