"""Delimited files, map extracts and row ranges as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

_SEPARATORS = {"\\t": "\t", "tab": "\t"}
#: Kinds of road that count as one (fixed values of the public map project).
HIGHWAYS = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "motorway_link", "trunk_link", "primary_link", "secondary_link",
    "tertiary_link", "living_street", "pedestrian", "track", "bus_guideway", "escape", "raceway", "road", "footway", "bridleway", "steps", "path",
)


def separator(text: str) -> str:
    """A character, ``\\t``, or a byte as ``0x01``."""
    if text in _SEPARATORS:
        return _SEPARATORS[text]
    if text.lower().startswith("0x"):
        return chr(int(text, 16))
    if len(text) != 1:
        raise ValueError(f"{text!r} is no separator")
    return text


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool | list[str] = False, breaks: bool = False) -> DataFrame:
    """All columns as text. ``header``: the first line, given names, or none (``c1, c2, ...``).

    ``breaks``: fields may hold line breaks; a file is then read by one task.
    """
    reader = spark.read.options(sep=separator(sep), quote='"', escape='"', multiLine=breaks, header=header is True)
    df = reader.csv(path)
    if isinstance(header, list):
        return df.toDF(*header)
    return df if header else df.toDF(*[f"c{i + 1}" for i in range(len(df.columns))])


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Names in the first line of another file."""
    line = spark.read.text(path).first()
    return [x.strip('"') for x in line[0].split(separator(sep))] if line else []


def row_range(df: DataFrame, order: list[str], offset: int, count: int) -> DataFrame:
    """``count`` rows from a 0-based ``offset`` on, in the given order (ties as they come).

    Rows are sorted by ranges; only the sizes of the ranges come to the driver, and
    only rows of the ranges that hold wanted places are numbered, range by range.
    """
    ranged = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before, at, wanted = {}, 0, []
    for r in ranged.groupBy("__range").count().orderBy("__range").collect():
        before[r["__range"]] = at
        if at < offset + count and at + r["count"] > offset:
            wanted.append(r["__range"])
        at += r["count"]
    start = F.lit(0).cast("long")
    for k in wanted:
        start = F.when(F.col("__range") == k, before[k]).otherwise(start)
    place = start + F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    rows = ranged.where(F.col("__range").isin(wanted)).withColumn("__place", place)
    return rows.where((F.col("__place") >= offset) & (F.col("__place") < offset + count)).drop("__range", "__place")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


_TAGS = T.ArrayType(T.StructType([T.StructField("_k", T.StringType()), T.StructField("_v", T.StringType())]))


def _tags(c: str) -> Column:
    pairs = F.coalesce(F.col(c), F.array().cast(_TAGS))
    # The first of repeated keys holds.
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, t: F.when(F.map_contains_key(m, t["_k"]), m).otherwise(F.map_concat(m, F.create_map(t["_k"], t["_v"]))))


def read_map_extract(spark: SparkSession, path: str, roads: bool = True, buildings: bool = False, nodes: bool = False, cells: bool = False) -> tuple[DataFrame, DataFrame]:
    """Locates and objects of a map file in XML: nodes as places, ways as objects.

    A way counts if it is a road of a known kind, or a building; with ``nodes``
    tagged nodes are objects of their own, with ``cells`` elements of that name count
    like ways. The first of ways with the same id holds; a way that refers to an unknown node is dropped.
    """
    if not (roads or buildings or nodes or cells):
        raise ValueError("nothing is asked for")
    node = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_lat", T.DoubleType()), T.StructField("_lon", T.DoubleType()), T.StructField("tag", _TAGS)])
    ref = T.ArrayType(T.StructType([T.StructField("_ref", T.LongType())]))
    way = T.StructType([T.StructField("_id", T.LongType()), T.StructField("nd", ref), T.StructField("tag", _TAGS)])
    places = spark.read.format("xml").option("rowTag", "node").schema(node).load(path)
    locates = places.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).where("id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").dropDuplicates(["id"])
    ways = spark.read.format("xml").option("rowTag", "way").schema(way).load(path).withColumn("cell", F.lit(False))
    if cells:
        ways = ways.unionByName(spark.read.format("xml").option("rowTag", "cell").schema(way).load(path).withColumn("cell", F.lit(True)))
    ways = ways.withColumn("at", F.monotonically_increasing_id()).select(F.col("_id").alias("id"), _tags("tag").alias("tags"), F.col("nd._ref").alias("refs"), "at", "cell")
    want = F.col("cell")
    if roads:
        want = want | F.coalesce(F.element_at("tags", "highway").isin(*HIGHWAYS), F.lit(False))
    if buildings:
        want = want | F.map_contains_key("tags", "building")
    ways = ways.where(want).groupBy("id").agg(F.min_by(F.struct("tags", "refs"), "at").alias("w")).select("id", "w.tags", "w.refs")
    known = locates.select(F.col("id").alias("ref"), F.lit(1).alias("ok"))
    bad = ways.select("id", F.explode("refs").alias("ref")).join(known, "ref", "left_anti").select("id").distinct()
    objects = ways.join(bad, "id", "left_anti").select("id", "tags", F.col("refs").alias("locate_ids"))
    if nodes:
        own = places.select((F.col("_id") + 10**15).alias("id"), _tags("tag").alias("tags"), F.array("_id").alias("locate_ids")).where(F.size("tags") > 0)
        objects = objects.unionByName(own)
    return locates, objects
