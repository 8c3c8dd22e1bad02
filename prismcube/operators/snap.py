"""Nearest locates within a radius, with predicates on the objects at them.

``locates`` holds ``id, lat, lon``; ``objects`` holds ``id, tags
(map<string,string>), locate_ids (array<bigint>)``. Candidates come from grid
cells by an equi-join, never from all pairs.

Defined results: places that are no location are left out; equal distances are
broken by id; an object listed twice at a locate counts once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .points import Grid, haversine_m, is_location


@dataclass(frozen=True)
class Tag:
    """A predicate on the tags of an object; composes with ``*`` (and), ``+`` (or) and ``~`` (not)."""

    test: object

    def column(self, tags: Column) -> Column:
        return F.coalesce(self.test(tags), F.lit(False))

    def __mul__(self, o: Tag) -> Tag:
        return Tag(lambda t: self.column(t) & o.column(t))

    def __add__(self, o: Tag) -> Tag:
        return Tag(lambda t: self.column(t) | o.column(t))

    def __invert__(self) -> Tag:
        return Tag(lambda t: ~self.column(t))


def k(key: str) -> Tag:
    return Tag(lambda t: F.map_contains_key(t, key))


def v(value: str) -> Tag:
    return Tag(lambda t: F.array_contains(F.map_values(t), value))


def kv(key: str, value: str) -> Tag:
    return Tag(lambda t: F.element_at(t, key) == value)


def supported(locates: DataFrame, objects: DataFrame, tag: Tag | None, least: int = 0, most: int = -1) -> DataFrame:
    """Locates whose number of matching objects lies in [least, most]; -1 leaves a side open.

    With a predicate a locate without a match never passes.
    """
    at = objects.select("id", "tags", F.explode(F.array_distinct("locate_ids")).alias("loc"))
    if tag is not None:
        at = at.where(tag.column(F.col("tags")))
    n = at.groupBy("loc").agg(F.countDistinct("id").alias("n"))
    j = locates.join(n.withColumnRenamed("loc", "id"), "id", "inner" if tag is not None else "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if least >= 0:
        j = j.where(F.col("n") >= least)
    return (j.where(F.col("n") <= most) if most != -1 else j).drop("n")


#: Locates of a cell beyond which it is parted.
CROWD = 4000


def _within(places: DataFrame, locates: DataFrame, radius_m: float, most: int) -> DataFrame:
    """Up to ``most`` nearest of the locates within a radius of each place, by one equi-join on cells.

    A crowded cell is parted by a hash of its locates, and the places that look at it are repeated.
    """
    grid = Grid(radius_m)
    home = locates.select("id", "y", "x", grid.cell(F.col("y"), F.col("x")).alias("cell"))
    crowds = home.groupBy("cell").count().where(F.col("count") > CROWD).select("cell", F.ceil(F.col("count") / CROWD).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    home = home.join(crowds, "cell", "left").withColumn("salt", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    look = places.select("lat", "lon", F.explode(grid.cells_around(F.col("lat"), F.col("lon"))).alias("cell")).join(crowds, "cell", "left")
    look = look.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
    hits = look.join(home, ["cell", "salt"]).where(F.abs(F.col("lat") - F.col("y")) <= grid.reach).withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)
    # Each task keeps the first of its ranks before they meet.
    rank = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("distance_m", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most).select("lat", "lon", "id", "distance_m", "rank")


def nearest(queries: DataFrame, locates: DataFrame, radius_m: float = 100.0, most: int = 1000, first_m: float | None = None) -> DataFrame:
    """``query_id, id, distance_m, rank``: the nearest locates within the radius of each query point.

    ``queries`` holds ``query_id, lat, lon``; places asked for by several queries are
    looked up once. Of locates at the same place only the ``most`` with the least ids
    can be among the nearest. With ``first_m`` the search starts at that radius, and only queries that do not find
    ``most`` locates go on to four times the radius; so a crowded place costs no
    more than a lonely one. It pays where some places are crowded and ``most`` is small.
    """
    places = locates.where(is_location(F.col("lat"), F.col("lon"))).select("id", F.col("lat").cast("double").alias("y"), F.col("lon").cast("double").alias("x"))
    same = F.row_number().over(Window.partitionBy("y", "x").orderBy("id"))
    places = places.withColumn("same", same).where(F.col("same") <= most).drop("same")
    asked = queries.where(is_location(F.col("lat"), F.col("lon"))).select("query_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    left = asked.select("lat", "lon").distinct()
    answers = lambda found: asked.join(found, ["lat", "lon"]).select("query_id", "id", "distance_m", "rank")
    radii = [radius_m]
    while first_m and radii[-1] / 4 >= first_m:
        radii.append(radii[-1] / 4)
    if len(radii) == 1:
        return answers(_within(left, places, radius_m, most))
    places = materialise(places, "places")
    out = None
    for r in reversed(radii):
        found = _within(left, places, r, most)
        if r < radius_m:
            found = materialise(found, "near")
            done = found.where(F.col("rank") == most).select("lat", "lon")
            left = materialise(left.join(done, ["lat", "lon"], "left_anti"), "left")
            found = found.join(done, ["lat", "lon"], "left_semi")
        out = found if out is None else out.unionByName(found)
    return answers(out)


def with_objects(found: DataFrame, objects: DataFrame, tag: Tag | None = None, every: bool = False) -> DataFrame:
    """Found locates with the matching objects at them (``every``: all objects) nested."""
    at = objects if tag is None or every else objects.where(tag.column(F.col("tags")))
    at = at.select(F.struct(F.col("id").alias("object_id"), "tags").alias("o"), F.explode(F.array_distinct("locate_ids")).alias("id"))
    return found.join(at.groupBy("id").agg(F.collect_list("o").alias("objects")), "id", "left")


def by_object(found: DataFrame, objects: DataFrame, tag: Tag | None = None, every: bool = False) -> DataFrame:
    """Matching objects (``every``: all objects) at found locates, with those locates nested."""
    at = objects if tag is None or every else objects.where(tag.column(F.col("tags")))
    at = at.select(F.col("id").alias("object_id"), F.explode(F.array_distinct("locate_ids")).alias("id"))
    return found.join(at, "id").groupBy("object_id").agg(F.array_sort(F.collect_set("id")).alias("locate_ids"))


def snap_points(df: DataFrame, key: str, lat: str, lon: str, locates: DataFrame, radius_m: float) -> DataFrame:
    """Rows with ``lat, lon`` replaced by the nearest locate's; rows without one within the radius are dropped."""
    q = df.select(F.col(key).alias("query_id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    best = nearest(q, locates, radius_m, 1).join(locates.select("id", F.col("lat").alias("__y"), F.col("lon").alias("__x")), "id").select(F.col("query_id").alias(key), "__y", "__x")
    return df.join(best, key).withColumns({lat: F.col("__y"), lon: F.col("__x")}).drop("__y", "__x")


def all_of(*tags: Tag) -> Tag:
    return reduce(lambda a, b: a * b, tags)
