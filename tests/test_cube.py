"""Golden micro-fixtures, algebra, languages, polygons and storage of cubes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from prismcube.__main__ import open_cubes
from prismcube.functions import codes
from prismcube.operators import parts, snap
from prismcube.plans import cube as C
from prismcube.plans import poly
from prismcube.plans import targets as T
from prismcube.plans.lang import Engine, SyntaxProblem, TypeProblem, build_from_map, syntax_tree
from prismcube.plans.query import Key, Query, Result, combine
from prismcube.plans.schema import AliasError, CubeSchema, QueryError, ResultError, TimeAlignmentError
from prismcube.plans.timetext import second_of
from prismcube.sources import readers
from prismcube.streaming import live

CRIMES = [
    ("2013/12/06 18:25:00", "NARCOTICS", 41.8789661034259, -87.72673345412568), ("2013/12/06 18:26:00", "CRIMINAL DAMAGE", 41.76836587673295, -87.68836274472295),
    ("2013/12/06 18:29:00", "THEFT", 41.810564946613454, -87.6753212816967), ("2013/12/06 18:30:00", "THEFT", 41.94189139041086, -87.65095594008946),
]
MAP = """
index_dimension('location', input('lat','lon'), latlon(25)); # place
index_dimension('type', input('type'), categorical());
index_dimension('time', input('time'), time(16, '2009-01-01T00:00:00-05:00', 3600, 5*60));
measure_dimension('count', input(), f32);
"""


@pytest.fixture(scope="module")
def crimes(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(CRIMES)], "i long, time string, type string, lat double, lon double")
    return build_from_map(MAP, df, "crimes", F.col("i"), keep=["i"])


@pytest.fixture(scope="module")
def engine(spark, crimes):
    grid = spark.createDataFrame([(0, 3), (1, 1), (2, 2), (3, 3), (3, 0), (4, 0), (-1, 2)], "x int, y int")
    g = C.Cube.build(grid, [C.grid("location", "x", "y", 2)], [C.count()], "x")
    return Engine().add("x", g).add("crimes", crimes)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_golden_grid(engine):
    assert rows(engine.table("{q(x.b('location',tile2d_range(2,0,0,1,2)))}")) == [(1.0,)]
    assert rows(engine.table("q(x.b('location',img2d_range(2,0,0,1,2)))")) == [(2.0,)]
    assert rows(engine.table("q(x)")) == [(5.0,)]
    assert rows(engine.table("q(x.b('location',dive(1)))")) == [("0", 1.0), ("1", 1.0), ("2", 1.0), ("3", 2.0)]
    assert rows(engine.table("q(x.b('location',dive(2),'tile2'))")) == [(0, 3, 1.0), (1, 1, 1.0), (2, 2, 1.0), (3, 0, 1.0), (3, 3, 1.0)]
    assert rows(engine.table("q(x.b('location',dive(2),'img2'))")) == [(0, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0), (3, 0, 1.0), (3, 3, 1.0)]


def test_golden_crimes(engine):
    assert rows(engine.table("q(crimes.b('type',dive(1)))")) == [("0", 1.0), ("1", 1.0), ("2", 2.0)]
    assert rows(engine.table("q(crimes.b('type',dive(1),'name'))")) == [("CRIMINAL DAMAGE", 1.0), ("NARCOTICS", 1.0), ("THEFT", 2.0)]
    assert rows(engine.table("q(crimes.b('type','THEFT'))")) == [(2.0,)]
    got = rows(engine.table("q(crimes.b('type','NARCOTICS').b('location',dive(11)))"))
    assert got == [("2:1:2:0:0:0:0:1:3:2:0", 1.0)]
    assert rows(engine.table("q(crimes.b('type','NARCOTICS').b('location',dive(11),'tile11'))")) == [(524, 1286, 1.0)]
    assert rows(engine.table("q(crimes.b('time',timeseries('2013-12-06T18:00:00-05:00',3600,2,3600)))")) == [(0, 4.0)]
    assert rows(engine.table("q(crimes.b('time',timeseries('2013-12-06T13:00:00-05:00',3600,20,3600)))")) == [(5, 4.0)]


def test_same_path_in_three_ways(crimes):
    d = crimes.schema.dim("location")
    assert T.Path((2, 1, 2)).where(d) == T.Tile(3, 2, 5).where(d) == T.Tile(3, 2, 2, image=True).where(d)


def test_paper_sums(spark):
    p = [(42.102908, -73.242842, "Android", 1), (29.617161, -81.636398, "iPhone", 2), (-21.527420, 32.493101, "iPhone", 4), (26.014051, 75.120052, "Android", 8), (-22.698453, 145.080990, "iPhone", 16), (86.0, 0.0, "Android", 32), (1.0, None, "Android", 64)]
    df = spark.createDataFrame(p, "latitude double, longitude double, device string, id int")
    c = C.Cube.build(df, [C.quadtree("place", "latitude", "longitude", 20), C.categorical("device", "device")], [C.product("id", "id", storage="u32")])
    assert rows(Query((c,)).b("device", T.Dive(1), "name").table()) == [("Android", 9.0), ("iPhone", 22.0)]
    assert rows(Query((c,)).table()) == [(31.0,)]


def test_dimension_order_does_not_matter(spark, crimes):
    n = crimes.stats().first()["num_bins"]
    turned = C.Cube(crimes.df, CubeSchema(crimes.schema.dims[::-1], crimes.schema.measures))
    assert turned.stats().first()["num_bins"] == n == 4


def table(spark, keys, data, depth=1, dim="k"):
    k = [Key(dim, "path", 2, depth)] if keys else []
    df = spark.createDataFrame(data, "k_k long, v_0 double" if keys else "v_0 double")
    return Result(df, k, ["m"], {})


def test_algebra(spark):
    a, b = table(spark, 1, [(0, 10.0), (1, 20.0)]), table(spark, 1, [(1, 4.0), (2, 5.0)])
    want = {"+": (10, 24, 5), "-": (10, 16, -5), "*": (0, 80, 0), "/": (math.nan, 5, 0)}
    for op, w in want.items():
        got = [r["v_0"] for r in combine(a, b, op).df.orderBy("k_k").collect()]
        assert all(x == y or math.isnan(x) and math.isnan(y) for x, y in zip(got, w)), op
    t = table(spark, 0, [(30.0,)])
    assert [r["v_0"] for r in (a / t).df.orderBy("k_k").collect()] == [10 / 30, 20 / 30]
    assert [r["v_0"] for r in (t / a).df.orderBy("k_k").collect()] == [3.0, 1.5]
    none = table(spark, 0, [])
    assert [r["v_0"] for r in (a + none).df.orderBy("k_k").collect()] == [10.0, 20.0]
    assert [r["v_0"] for r in (t * t).df.collect()] == [900.0]
    deep = table(spark, 1, [(0, 1.0), (3, 2.0), (5, 4.0), (9, 8.0)], 2)
    assert {r["k_k"]: r["v_0"] for r in (a + deep).df.collect()} == {0: 11.0, 3: 12.0, 5: 24.0, 9: 8.0}
    assert {r["k_k"]: r["v_0"] for r in (deep - a).df.collect()} == {0: -9.0, 3: -8.0, 5: -16.0, 9: 8.0}
    zero = table(spark, 1, [(0, 0.0), (1, 0.0)])
    assert [r["v_0"] for r in (a / zero).df.collect()] == [math.inf, math.inf]
    with pytest.raises(ResultError):
        combine(a, Result(b.df.withColumnRenamed("k_k", "k_z"), [Key("z", "path", 2, 1)], ["m"], {}), "+")


def test_errors(engine, crimes):
    for text, kind in (("q(crimes.b('type','NOPE'))", AliasError), ("q(crimes.b('nodim',dive(1)))", QueryError), ("q(crimes", SyntaxProblem), ("q(crimes.b('type',dive('x')))", TypeProblem), ("crimes.b('type',dive(1));;q(1)", TypeProblem),
                       ("q(crimes.b('time',timeseries('2013-12-06T18:30:00-05:00',3600,2,3600)))", TimeAlignmentError), ("q(crimes.b('location',dive_list(dive(1),dive(2))))", QueryError), ("q(crimes.select('count').select('count'))", QueryError), ("q(x.b('location',tile2d_range(2,0,0,4,2)))", QueryError)):
        with pytest.raises(kind):
            engine.table(text)
    loose = Engine(strict=False).add("crimes", crimes)
    assert rows(loose.table("q(crimes.b('nodim',dive(1)))")) == [(4.0,)]


def test_language(engine):
    assert rows(engine.table("a = crimes.b('type',pathagg('THEFT','NARCOTICS')); q((a + 2*3 - -1)/2)")) == [(5.0,)]
    assert rows(engine.table("q(24*60/crimes.b('type',p(2)))")) == [(720.0,)]
    assert "call q" in syntax_tree("q(a.b('x',dive(1)))")
    assert engine.render("version()") == "4"
    text = engine.render("format('csv');format('psv');q(x.b('location',dive(1)));format('text');q(x)")
    assert text.split("\n")[:2] == ["location|count", "0|1.000000"]
    assert '"numrows": 4' in engine.render("q(x.b('location',dive(1)))")
    assert "temporal" in engine.render("format('text');schema()")
    assert isinstance(engine.render("format('bin');q(x)"), bytes)
    assert engine.render("format('text');q(x.b('location',dive(2)))").split("\n")[1].split() == ["0,3", "1.000000"]


def test_times():
    base = 946684800
    for text, want in (("2000-01-01T00:00:00-06:00", base + 21600), ("2000-01-01T00:00:00.125-06:00", base + 21600), ("2000-01-01T00:00-06", base + 21600), ("2000-01-01T00", base), ("2000-01-01", base), ("2000", base), ("01/01/2000 12:00 AM", base), ("2000-01-01@01:00Z", base + 3600), ("2000/01/01 12:30:05 pm", base + 45005)):
        assert second_of(text) == want, text
    for bad in ("x", "2000-13-01", "2000-01-01 13:00 PM", "2000-02-30"):
        with pytest.raises(QueryError):
            second_of(bad)


def test_time_column_like_literals(spark):
    texts = ["2000-01-01T00:00:00-06:00", "2000-01-01", "2016", "2013/12/06 18:25:00", "09/06/2016 11:51 PM", "2016-12-09@23:00Z", "2013-12-21T00:00-06", "2000-01-01T00", "12/31/1999 12:00 am"]
    df = spark.createDataFrame([(t,) for t in [*texts, "junk", "2016-02-30", "2016-01-01 13:00 PM", None]], "t string")
    got = [r[0] for r in df.select(codes.parse_time(F.col("t"))).collect()]
    assert got == [second_of(t) for t in texts] + [None] * 4


def test_masks():
    assert poly.mask_paths("020<<11<<<3<<") == [(0, 2, 0), (0, 1, 1), (3,)]
    assert poly.mask_paths("<") == [()]
    assert poly.mask_paths("01") == []
    tree = poly.Poly.parse("10,10,10,40,40,40,40,10").cover(6)
    paths = {tuple(p) for p in poly.mask_paths(poly.mask_text(tree))}
    assert {(len(p), int("".join(map(str, p)), 4)) for p in paths} == set(poly.cells(tree))


def test_polygon_sets():
    r = random.Random(4)
    shapes = [poly.Poly(tuple((r.uniform(-70, 70), r.uniform(-170, 170)) for _ in range(5))) for _ in range(6)]
    flat = lambda t: {c << 2 * (6 - d) | k for d, c in poly.cells(t) for k in range(4 ** (6 - d))}
    for a, b in zip(shapes[::2], shapes[1::2]):
        x, y = flat(a.cover(6)), flat(b.cover(6))
        op = lambda o: flat(poly.Combined(o, (a, b)).cover(6))  # noqa: B023, E731
        assert op("union") == x | y and op("intersection") == x & y and op("diff") == x - y and op("symdiff") == x ^ y
        assert flat(poly.Combined("complement", (a,)).cover(6)) == set(range(4**6)) - x
    with pytest.raises(QueryError):
        poly.Poly.parse("1,2,3")


def test_hilbert_walk_visits_neighbours(spark):
    df = spark.range(0, 256).select(F.concat((F.col("id") % 256).cast("string"), F.lit(".0.0.0")).alias("ip"), "id")
    got = df.select("id", codes.hilbert_ip(F.col("ip"), 4).alias("c")).select("id", codes.cell_x(F.col("c"), 4).alias("x"), codes.cell_y(F.col("c"), 4).alias("y")).orderBy("id").collect()
    assert len({(r["x"], r["y"]) for r in got}) == 256
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(got, got[1:]))
    bad = spark.createDataFrame([("1.2.3",), ("256.1.1.1",), ("a.b.c.d",), (None,)], "ip string").select(codes.hilbert_ip(F.col("ip"), 4).alias("c")).collect()
    assert all(r["c"] is None for r in bad)


def test_codes_round_trip(spark):
    df = spark.range(0, 500).select((F.col("id") * 4_294_967 % (1 << 31)).alias("x"), (F.col("id") * 999_983 % (1 << 31)).alias("y"))
    m = df.select("x", "y", codes.morton(F.col("x"), F.col("y")).alias("c")).select("x", "y", codes.cell_x(F.col("c")).alias("a"), codes.cell_y(F.col("c")).alias("b"))
    assert m.where("x <> a OR y <> b").count() == 0


def test_save_load_parts_and_rollup(spark, crimes, tmp_path):
    crimes.save(f"file://{tmp_path}/a")
    c = C.Cube.load(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/a")
    assert rows(Query((c,)).b("type", T.Dive(1), "name").table()) == [("CRIMINAL DAMAGE", 2.0), ("NARCOTICS", 2.0), ("THEFT", 4.0)]
    assert "THEFT|4.000000" in open_cubes(spark, [f"c=@{tmp_path}/a:{tmp_path}/a"]).render("format('psv');q(c.b('type',dive(1),'name'))")
    assert CubeSchema.from_json(crimes.schema.to_json()) == crimes.schema
    r = crimes.rollup({"type": 1, "location": 5})
    q = Query((r,)).b("location", T.Dive(3))
    assert rows(q.table()) == rows(Query((crimes,)).b("location", T.Dive(3)).table())
    assert r.best({"location": 3})[1] == {"type": 1, "location": 5}


def test_stream_and_compact(spark, crimes, tmp_path):
    src = spark.createDataFrame([(i, *r) for i, r in enumerate(CRIMES)], "i long, time string, type string, lat double, lon double")
    src.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    dims = [C.categorical("type", "type")]
    like = C.Cube.build(src, dims, [C.count()], order=F.col("i"))
    live.grow(stream, lambda b: C.Cube.build(b, dims, [C.count()], start=like.schema), f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    want = [("CRIMINAL DAMAGE", 1.0), ("NARCOTICS", 1.0), ("THEFT", 2.0)]
    assert rows(Query((live.snapshot(spark, f"{tmp_path}/out", like),)).b("type", T.Dive(1), "name").table()) == want
    live.compact(spark, f"{tmp_path}/out", like, f"{tmp_path}/one")
    assert rows(Query((C.Cube(spark.read.parquet(f"{tmp_path}/one"), like.schema),)).b("type", T.Dive(1), "name").table()) == want


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x ""y"", z"\n2,w\n')
    assert rows(readers.read_csv(spark, f"{tmp_path}/a.csv", header=True)) == [("1", 'x "y", z'), ("2", "w")]
    assert readers.read_csv(spark, f"{tmp_path}/a.csv").columns == ["c1", "c2"]
    assert readers.header_of(spark, f"{tmp_path}/a.csv") == ["a", "b"]
    (tmp_path / "b.psv").write_text("1\x012\n")
    assert rows(readers.read_csv(spark, f"{tmp_path}/b.psv", "0x01", ["p", "q"])) == [("1", "2")]
    assert readers.separator("\\t") == "\t"
    (tmp_path / "m.xml").write_text('<osm><node id="1" lat="1.0" lon="2.0"><tag k="amenity" v="inn"/></node><node id="2" lat="1.5" lon="2.5"/><way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="residential"/></way><way id="8"><nd ref="9"/><tag k="highway" v="primary"/></way><way id="9"><nd ref="1"/><tag k="highway" v="proposed"/></way><way id="7"><nd ref="2"/><tag k="highway" v="track"/></way><cell id="5"><nd ref="2"/><tag k="name" v="c"/></cell><way id="6"><nd ref="2"/><tag k="highway" v="raceway"/></way></osm>')
    locates, objects = readers.read_map_extract(spark, f"{tmp_path}/m.xml", nodes=True)
    assert rows(locates) == [(1, 1.0, 2.0), (2, 1.5, 2.5)]
    got = {r["id"]: (r["tags"], r["locate_ids"]) for r in objects.collect()}
    assert got == {7: ({"highway": "residential"}, [1, 2]), 6: ({"highway": "raceway"}, [2]), 10**15 + 1: ({"amenity": "inn"}, [1])}
    assert {r["id"] for r in readers.read_map_extract(spark, f"{tmp_path}/m.xml", roads=False, cells=True)[1].collect()} == {5}
    (tmp_path / "c.csv").write_text('1,"x\ny"\n2,z\n')
    assert rows(readers.read_csv(spark, f"{tmp_path}/c.csv", breaks=True)) == [("1", "x\ny"), ("2", "z")]
    q = spark.createDataFrame([(1, 1.0, 2.0001)], "query_id long, lat double, lon double")
    near = snap.nearest(q, snap.supported(locates, objects, snap.kv("highway", "residential")), 100.0)
    assert [(r["id"], len(r["objects"])) for r in snap.with_objects(near, objects, snap.k("highway")).collect()] == [(1, 1)]


def test_pair_codes(spark):
    df = spark.createDataFrame([(5, 9, 3, 12), (1 << 19, 7, 2, 1 << 18)], "a int, b int, c int, d int")
    for levels in (20, 4):
        for r in df.where("a < 16" if levels == 4 else "true").select("*", parts.pair_code(F.col("a"), F.col("b"), F.col("c"), F.col("d"), levels).alias("p")).collect():
            want = sum(((r["a"] >> i & 1) * 4 + (r["b"] >> i & 1) * 8 + (r["c"] >> i & 1) + (r["d"] >> i & 1) * 2) << 4 * i for i in range(levels))
            low = 4 * max(0, levels - 15)
            assert (r["p"]["hi"], r["p"]["lo"]) == (want >> low, want & (1 << low) - 1)


def test_wrapping_and_rejected_rows(spark):
    df = spark.createDataFrame([(0,), (10,), (70,), (-5,)], "t long").withColumn("t", F.timestamp_seconds("t"))
    c = C.Cube.build(df, [C.time_bins("t", "t", 3, 0, 10)], [C.count()])
    assert rows(Query((c,)).b("t", T.Dive(3)).table()) == [("0:0:0", 1.0), ("0:0:1", 1.0), ("1:1:1", 1.0)]
    with pytest.raises(ValueError):
        C.Cube.build(df, [], [C.count()])


@pytest.mark.parametrize("n", [9_999, 10_000, 10_001])
def test_repeated_paths_count_as_often_as_listed(spark, crimes, n):
    q = Query((crimes,)).b("type", T.PathAgg((T.Path((0,)),) * n + (T.Path((1,)),)))
    assert rows(q.table()) == [(float(n + 1),)]


def test_listed_cells_in_many_ranges(spark):
    df = spark.range(4096).withColumn("x", F.col("id") % 64).withColumn("y", F.expr("id DIV 64"))
    c = C.Cube.build(df, [C.grid("p", "x", "y", 6)], [C.count()])
    r = random.Random(5)
    cells = [(z, r.randrange(4**z)) for z in [r.randrange(0, 7) for _ in range(300)]]
    paths = tuple(T.Path(tuple(k >> 2 * (z - 1 - i) & 3 for i in range(z))) for z, k in cells)
    assert rows(Query((c,)).b("p", T.PathAgg(paths)).table()) == [(float(sum(4 ** (6 - z) for z, _ in cells)),)]
    few = paths[:5]
    assert rows(Query((c,)).b("p", T.PathAgg(few)).table()) == [(float(sum(4 ** (6 - z) for z, _ in cells[:5])),)]


def test_ranges_reach_the_scan(spark, crimes, tmp_path):
    crimes.save(f"file://{tmp_path}/a")
    c = C.Cube.load(spark, f"file://{tmp_path}/a")
    targets = [T.Path((1, 2)), T.Tile(3, 2, 5), T.Dive(2, T.Path((1,))), T.PathAgg((T.Path((1,)), T.Path((2, 1)))), T.DiveList((T.Dive(1, T.Path((1,))), T.Dive(0, T.Path((2, 1))))), T.Mask(frozenset({(2, 5), (3, 60)})), T.TileRange(4, (3, 4, 9, 9))]
    for t in targets:
        plan = Query((c,)).b("location", t).result().df._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters") :].split("]")[0]
        assert "GreaterThanOrEqual(d_location" in pushed, (t, pushed)


def test_parts_with_their_own_numbers(spark, tmp_path):
    def part(values, n):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
        C.Cube.build(df, [C.categorical("v", "v", 2)], [C.count()], order=F.col("i")).rollup({"v": 1}).save(f"file://{tmp_path}/{n}")
        return f"file://{tmp_path}/{n}"

    c = C.Cube.load(spark, part("XXX", "a"), part("YX", "b"))
    assert rows(Query((c,)).b("v", T.Dive(1), "name").table()) == [("X", 4.0), ("Y", 1.0)] and len(c.rollups) == 1
    assert rows(Query((c,)).b("v", T.Name("Y")).table()) == [(1.0,)]
    with pytest.raises(QueryError):
        C.Cube.load(spark, f"file://{tmp_path}/a", part("PQRS", "c"))


def test_stored_rollups_serve_filters(spark, crimes, tmp_path):
    crimes.rollup({"type": 1, "location": 5}).save(f"file://{tmp_path}/r")
    c = C.Cube.load(spark, f"file://{tmp_path}/r")
    q = Query((c,)).b("location", T.Dive(2, T.Path((2,)))).b("type", T.Name("THEFT"))
    assert all("rollup-0" in f for f in q.result().df.inputFiles())
    assert rows(q.table()) == rows(Query((crimes,)).b("location", T.Dive(2, T.Path((2,)))).b("type", T.Name("THEFT")).table())


def test_snap_requests(spark):
    from prismcube.plans import snaplang

    locates = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, 20.0005), (3, 10.0, 20.0009)], "id long, lat double, lon double")
    objects = spark.createDataFrame([(7, {"highway": "road"}, [1, 2]), (8, {"building": "yes"}, [2, 3])], "id long, tags map<string,string>, locate_ids array<bigint>")
    ask = "snap.loc(10,20,50,60).radius(100)"
    got = {(r["query_id"], r["id"]): [o["object_id"] for o in r["objects"]] for r in snaplang.answer(ask, locates, objects).collect()}
    assert got == {(0, 1): [7], (0, 2): [7, 8], (0, 3): [8]}
    road = ask + ".filter(k('highway')*not(v('path'))).max(2)"
    assert [(r["object_id"], [x["id"] for x in r["locates"]]) for r in snaplang.answer(road + ".order('objects')", locates, objects).collect()] == [(7, [1, 2])]
    assert sorted(r["object_id"] for r in snaplang.answer(road + ".order('objects_all')", locates, objects).collect()) == [7, 8]
    assert {r["id"] for r in snaplang.answer(ask + ".support(2,-1)", locates, objects).collect()} == {2}
    assert snaplang.render(ask + ".max(1).format('json')", locates, objects).startswith('[{"query_id":0,"lat":10.0')
    assert snaplang.render(ask, locates, objects).splitlines()[0].startswith("query_id\tlat\tlon\trank\tid")
    for bad in ("snap.radius(3)", "snap.loc(1)", "snap.loc(1,2).max(0)", "snap.loc(1,2).radius(-1)", "snap.loc(1,2).order('x')", "snap.loc(1,2)+3"):
        with pytest.raises(QueryError):
            snaplang.parse(bad)


def test_crowded_cells_and_places(spark, monkeypatch):
    monkeypatch.setattr(snap, "CROWD", 5)
    r = random.Random(8)
    at = [(i, 10 + r.random() / 500, 20 + r.random() / 500) for i in range(60)] + [(100 + i, 10.0, 20.0) for i in range(20)]
    q = [(i, 10 + (i % 3) / 1000, 20.0) for i in range(12)] + [(99, None, 1.0)]
    got = snap.nearest(spark.createDataFrame(q, "query_id long, lat double, lon double"), spark.createDataFrame(at, "id long, lat double, lon double"), 80.0, 4).collect()

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = [(i, n) for i, a, b in q if a is not None for _, n in sorted((metres(a, b, c, d), n) for n, c, d in at if metres(a, b, c, d) <= 80)[:4]]
    assert sorted((x["query_id"], x["id"]) for x in got) == sorted(want)
