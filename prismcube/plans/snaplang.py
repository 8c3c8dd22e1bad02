"""Requests for nearest locates: ``snap.loc(40.5, -78.3).radius(100).max(5).filter(k('highway')).order('objects')``.

Places are pairs of latitude and longitude. ``filter`` takes tag predicates: ``k``,
``v`` and ``kv``, combined by ``*`` (and), ``+`` (or) and ``not(...)``; ``support`` the
least and most matching objects of a locate (-1 leaves a side open); ``order`` is
``locates``, ``objects`` or ``objects_all``; ``format`` is ``text`` or ``json``.

Defined results: without ``radius`` 100 m hold, without ``max`` 1000 locates. With
``order('locates')`` each found locate nests its matching objects, with
``'objects'`` each matching object its found locates, with ``'objects_all'`` each
object at them. A later call of the same part takes the place of an earlier one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import snap
from .lang import NUM, Parser, Registry, TypeProblem
from .schema import QueryError


@dataclass(frozen=True)
class Part:
    """One part of a request and its value."""

    name: str
    value: object


@dataclass(frozen=True)
class Request:
    loc: tuple[tuple[float, float], ...] = ()
    radius: float = 100.0
    max: int = 1000
    filter: snap.Tag | None = None
    support: tuple[int, int] | None = None
    order: str = "locates"
    format: str = "text"


functions = Registry()
_on = functions.on


@_on("loc", NUM, many=True)
def _loc(*x):
    if len(x) % 2:
        raise QueryError("loc takes pairs of latitude and longitude")
    return Part("loc", tuple((float(a), float(b)) for a, b in zip(x[::2], x[1::2])))


@_on("radius", NUM)
def _radius(r):
    if r < 0:
        raise QueryError("a radius is not negative")
    return Part("radius", float(r))


@_on("max", int)
def _max(n):
    if n <= 0:
        raise QueryError("at least one locate is asked for")
    return Part("max", n)


def _choice(name: str, *known: str):
    def choose(text: str) -> Part:
        if text not in known:
            raise QueryError(f"{name} is one of {known}")
        return Part(name, text)

    _on(name, str)(choose)


_choice("order", "locates", "objects", "objects_all")
_choice("format", "text", "json")
_on("k", str)(snap.k)
_on("v", str)(snap.v)
_on("kv", str, str)(snap.kv)
_on("not", snap.Tag)(lambda t: ~t)
_on("filter", snap.Tag)(lambda t: Part("filter", t))
_on("support", int, int)(lambda low, high: Part("support", (low, high)))


def _value(node):
    if node.kind in ("num", "str"):
        return node.value
    if node.kind == "id" and node.value == "snap":
        return Request()
    args = [_value(a) for a in node.args]
    if node.kind == "call":
        return functions.call(node.value, args)
    if node.kind == "op" and node.value == "neg" and isinstance(args[0], NUM):
        return -args[0]
    if node.kind == "op" and len(args) == 2:
        a, b = args
        if node.value == "." and isinstance(a, Request) and isinstance(b, Part):
            return replace(a, **{b.name: b.value})
        if node.value in "*+" and isinstance(a, snap.Tag) and isinstance(b, snap.Tag):
            return a * b if node.value == "*" else a + b
    raise TypeProblem(f"{node.kind} {node.value} does not belong here")


def parse(text: str) -> Request:
    statements = Parser(text).statements()
    out = _value(statements[0]) if len(statements) == 1 else None
    if not isinstance(out, Request) or not out.loc:
        raise QueryError("a request is snap.loc(...) and parts of it")
    return out


def answer(text: str | Request, locates: DataFrame, objects: DataFrame) -> DataFrame:
    """Found locates with their objects, or objects with their locates, as the request orders.

    ``locates``: ``query_id, lat, lon, rank, id, distance_m, objects``; otherwise
    ``object_id, tags, locates``, the latter sorted by query and rank.
    """
    q = parse(text) if isinstance(text, str) else text
    if q.support is not None or q.filter is not None:
        # With a predicate alone a locate needs one matching object.
        low, high = q.support or (1, -1)
        locates = snap.supported(locates, objects, q.filter, low, high)
    asked = locates.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(q.loc)], "query_id long, lat double, lon double")
    found = snap.nearest(asked, locates, q.radius, q.max).join(asked.select("query_id", "lat", "lon"), "query_id")
    if q.order == "locates":
        out = snap.with_objects(found, objects, q.filter)
        return out.select("query_id", "lat", "lon", "rank", "id", "distance_m", F.array_sort(F.coalesce("objects", F.array().cast("array<struct<object_id:bigint,tags:map<string,string>>>")), lambda a, b: (a["object_id"] - b["object_id"]).cast("int")).alias("objects"))
    at = objects if q.filter is None or q.order == "objects_all" else objects.where(q.filter.column(F.col("tags")))
    at = at.select(F.col("id").alias("object_id"), "tags", F.explode(F.array_distinct("locate_ids")).alias("id"))
    nested = F.array_sort(F.collect_list(F.struct("query_id", "rank", "id", "distance_m"))).alias("locates")
    # Maps are no keys of groups: any one of an object's equal tags holds.
    return found.join(at, "id").groupBy("object_id").agg(F.first("tags").alias("tags"), nested)


def render(text: str, locates: DataFrame, objects: DataFrame) -> str:
    """The answer as ``text`` (a line a row, parts divided by tabs) or ``json`` (an array). It is made for few places."""
    q = parse(text)
    df = answer(q, locates, objects)
    keys = ["query_id", "rank"] if q.order == "locates" else ["object_id"]
    lines = [r["line"] for r in df.orderBy(*keys).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line")).collect()] if q.format == "json" else None
    if lines is not None:
        return "[" + ",\n".join(lines) + "]\n"
    cols = [F.to_json(c) if t.startswith(("array", "map")) else F.col(c).cast("string") for c, t in df.dtypes]
    rows = df.orderBy(*keys).select(F.concat_ws("\t", *cols).alias("line")).collect()
    return "\t".join(df.columns) + "\n" + "".join(r["line"] + "\n" for r in rows)
