"""Cubes: encoded rows with a schema, and what builds, stores and unites them.

A cube is a DataFrame of one long per index dimension and one whole number per
measure. It is not pre-aggregated for every combination of prefixes: a query is
a filter and a group-by over prefixes, which Spark answers from Parquet that is
laid out by the codes of its first dimensions. Rollups may be stored beside it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from .schema import Alias, CubeSchema, IndexDim, Measure, QueryError, parse_alias_text

MEASURE = "m_"
DIM = "d_"
LONGEST = {"s32": "bigint", "u32": "bigint", "s64": "bigint", "u64": "bigint", "f32": "double", "f64": "double"}


@dataclass
class DimSpec:
    """How a dimension comes from the columns of the input."""

    name: str
    bits: int
    levels: int
    encode: Callable[[DataFrame], Column] | None
    hint: str = ""
    base: int | None = None
    width: int | None = None
    #: A categorical dimension: the text column, an alias table, or ids by first appearance.
    category: str | None = None
    alias_text: str | None = None


@dataclass
class MeasureSpec:
    """How a measure comes from the columns of the input: None counts, several multiply."""

    name: str
    value: Callable[[DataFrame], Column] | None
    storage: str = "u32"
    scale: int = 0


def category_table(df: DataFrame, value: Column, order: Column, most: int) -> DataFrame:
    """``value, id`` of categories in order of first appearance, those beyond ``most`` left out.

    The number of categories is bounded by ``most``; only their first places are sorted.
    """
    first = df.select(value.alias("value"), order.alias("at")).where("value IS NOT NULL").groupBy("value").agg(F.min("at").alias("at"))
    few = first.orderBy("at", "value").limit(most)
    return few.select("value", (F.row_number().over(Window.orderBy("at", "value")) - 1).cast("long").alias("id"))


def first_categories(df: DataFrame, wanted: dict[str, tuple[str, int]], order: Column) -> dict[str, list[str]]:
    """Categories of several dimensions in order of first appearance, by one pass.

    ``wanted`` maps a dimension to its column and how many categories it can hold,
    which bounds what comes to the driver.
    """
    if not wanted:
        return {}
    each = F.array(*[F.struct(F.lit(n).alias("d"), F.col(c).cast("string").alias("value"), F.lit(most).cast("long").alias("most")) for n, (c, most) in wanted.items()])
    flat = df.select(order.alias("at"), each.alias("x")).select("at", F.explode("x").alias("x")).select("at", "x.*").where("value IS NOT NULL")
    first = flat.groupBy("d", "value", "most").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("d").orderBy("at", "value"))
    few = first.withColumn("k", place).where((F.col("k") <= max(m for _, m in wanted.values())) & (F.col("k") <= F.col("most")))
    out: dict[str, list[str]] = {n: [] for n in wanted}
    for r in few.orderBy("d", "k").collect():
        out[r["d"]].append(r["value"])
    return out


def merged(schemas: list[CubeSchema]) -> tuple[CubeSchema, list[dict[str, dict[int, int]]]]:
    """The schema of several parts, and per part and dimension what numbers change.

    Names of the last level are numbered anew where a part gave a number to
    another name; where names of inner levels differ the parts do not fit.
    """
    out = CubeSchema.from_json(schemas[0].to_json())
    moves: list[dict[str, dict[int, int]]] = [{}]
    for s in schemas[1:]:
        if [(d.name, d.bits, d.levels, d.base, d.width) for d in s.dims] != [(d.name, d.bits, d.levels, d.base, d.width) for d in out.dims] or s.measures != out.measures:
            raise QueryError("parts of different schemas")
        move: dict[str, dict[int, int]] = {}
        for d, e in zip(out.dims, s.dims):
            place = {n: k for (depth, k), n in d.alias.names.items() if depth == d.levels}
            # Numbers that either part has in use, named or not, are not given away.
            free = max([k for (depth, k) in (*d.alias.names, *e.alias.names) if depth == d.levels], default=-1) + 1
            change: dict[int, int] = {}
            for (depth, k), n in sorted(e.alias.names.items()):
                if depth < d.levels:
                    if d.alias.names.get((depth, k), n) != n:
                        raise QueryError(f"parts name the paths of {d.name} differently")
                    d.alias.add(depth, k, n)
                    continue
                to = place.get(n)
                if to is None:
                    to = k
                    if (depth, k) in d.alias.names:
                        to, free = free, free + 1
                        if to >= 1 << d.bits * d.levels:
                            raise QueryError(f"{d.name} cannot hold the categories of all parts")
                    place[n] = to
                    d.alias.add(depth, to, n)
                if to != k:
                    change[k] = to
            if change and any(depth < d.levels for depth, _ in (*d.alias.names, *e.alias.names)):
                raise QueryError(f"parts name the paths of {d.name} differently")
            for i, (depth, k) in e.alias.inputs.items():
                d.alias.inputs.setdefault(i, (depth, change.get(k, k) if depth == d.levels else k))
            if change:
                move[d.name] = change
        moves.append(move)
    return out, moves


def _renumbered(df: DataFrame, schema: CubeSchema, move: dict[str, dict[int, int]], depths: dict[str, int] | None) -> DataFrame:
    """Rows of a part with the numbers of the merged schema."""
    for n, change in move.items():
        if depths is not None and depths.get(n, 0) == 0:
            continue
        c = DIM + n
        to = df.sparkSession.createDataFrame(list(change.items()), f"{c} long, to_ long")
        df = df.join(F.broadcast(to) if len(change) <= 100_000 else to, c, "left").withColumn(c, F.coalesce("to_", c)).drop("to_")
    return df


@dataclass
class Cube:
    """Encoded rows and their schema."""

    df: DataFrame
    schema: CubeSchema
    #: Coarser copies: depth per dimension to DataFrame of prefixes and sums.
    rollups: list[tuple[dict[str, int], DataFrame]] = field(default_factory=list)

    @staticmethod
    def build(df: DataFrame, dims: list[DimSpec], measures: list[MeasureSpec], name: str = "cube", order: Column | None = None, keep: list[str] | None = None, start: CubeSchema | None = None) -> Cube:
        """Encode a table; rows with any invalid dimension or measure are dropped.

        ``order`` fixes what "first" means for category ids (by default the order
        of reading); ``keep`` names input columns for drill-through; ``start`` is
        the schema of an earlier part, whose category ids hold.
        """
        if not dims or not measures:
            raise ValueError("a cube has at least one index and one measure dimension")
        order = F.monotonically_increasing_id() if order is None else order
        out, schema = df, []
        size = lambda s: (1 << s.bits * s.levels) + (len(start.dim(s.name).alias.inputs) if start else 0)
        found = first_categories(df, {s.name: (s.category, size(s)) for s in dims if s.category and s.alias_text is None}, order)
        for s in dims:
            dim = IndexDim(s.name, s.bits, s.levels, s.hint, s.base, s.width)
            if s.category is None:
                out = out.withColumn(DIM + s.name, s.encode(df))
            else:
                most = 1 << s.bits * s.levels
                if s.alias_text is not None:
                    dim.alias = parse_alias_text(s.alias_text, s.bits, s.levels)
                    pairs = [(k, v[1]) for k, v in dim.alias.inputs.items() if v[0] == s.levels]
                else:
                    old = start.dim(s.name).alias if start else Alias()
                    pairs = [(k, v[1]) for k, v in old.inputs.items()]
                    known = {k for k, _ in pairs}
                    for value in found[s.name]:
                        if value not in known and len(pairs) < most:
                            pairs.append((value, len(pairs)))
                    for k, i in pairs:
                        dim.alias.add(s.levels, i, k)
                out = out.withColumn("__c", F.col(s.category).cast("string"))
                ids = df.sparkSession.createDataFrame(pairs or [("", -1)], "__c string, __id long")
                out = out.join(F.broadcast(ids) if len(pairs) <= 100_000 else ids, "__c", "left").withColumnRenamed("__id", DIM + s.name).drop("__c")
            schema.append(dim)
        for m in measures:
            v = F.lit(1) if m.value is None else m.value(df)
            whole = F.round(v * 10**m.scale).try_cast("long") if m.scale or m.storage[0] == "f" else v.try_cast("long")
            out = out.withColumn(MEASURE + m.name, whole if m.scale else (v.cast("double") if m.storage[0] == "f" else whole))
        cols = [*(DIM + d.name for d in schema), *(MEASURE + m.name for m in measures)]
        out = out.dropna(subset=cols).select(*cols, *(keep or []))
        return Cube(out, CubeSchema(schema, [Measure(m.name, m.storage, m.scale) for m in measures], name))

    def code(self, dim: str) -> Column:
        return F.col(DIM + dim)

    def _layout(self, by: list[str]) -> Column:
        """A number whose order keeps rows near that are near in each dimension: their first bits in turn."""
        if len(by) > 5:
            raise ValueError("rows are laid out by five dimensions at most")
        n, out = min(20, 62 // len(by)), F.lit(0).cast("long")
        for place, name in enumerate(reversed(by)):
            d = self.schema.dim(name)
            down = d.bits * d.levels - n
            first = F.shiftright(self.code(name), down) if down >= 0 else F.shiftleft(self.code(name), -down)
            # Binary digits read in base 2**k stand k places apart.
            out = out.bitwiseOR(F.shiftleft(F.conv(F.bin(first), 2 ** len(by), 10).cast("long"), place))
        return out

    def save(self, path: str, parts: int | None = None, by: list[str] | None = None) -> None:
        """Parquet laid out by dimensions (the first two by default), the schema and the rollups beside it."""
        by = [d.name for d in self.schema.dims[:2]] if by is None else by
        order = [self._layout(by), *(DIM + n for n in by)] if len(by) > 1 else [DIM + by[0]]
        df = self.df.repartitionByRange(parts, order[0]) if parts else self.df.repartitionByRange(order[0])
        df.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
        spark = self.df.sparkSession
        lines = [(self.schema.to_json(),), (json.dumps([d for d, _ in self.rollups]),)]
        for i, (_, r) in enumerate(self.rollups):
            keys = [c for c in r.columns if c.startswith(DIM)]
            (r.repartitionByRange(keys[0]).sortWithinPartitions(*keys) if keys else r.coalesce(1)).write.mode("overwrite").parquet(f"{path}/rollup-{i}")
        spark.createDataFrame(lines, "schema string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")

    @staticmethod
    def load(spark: SparkSession, *paths: str, preload: bool = False) -> Cube:
        """One or more parts; categories that parts number differently are brought to one numbering."""
        cubes = []
        for p in paths:
            lines = sorted((r[0] for r in spark.read.text(f"{p}/schema").collect()), key=lambda x: x.startswith("["))
            df = spark.read.parquet(f"{p}/rows")
            depths = json.loads(lines[1]) if len(lines) > 1 else []
            cubes.append(Cube(df.cache() if preload else df, CubeSchema.from_json(lines[0]), [(d, spark.read.parquet(f"{p}/rollup-{i}")) for i, d in enumerate(depths)]))
        return cubes[0].union(*cubes[1:])

    def union(self, *others: Cube) -> Cube:
        """Parts seen as one cube. Names decide: a category has one number, whatever number a part gave it.

        Rollups that all parts hold at the same depths are kept.
        """
        if not others:
            return self
        schema, moves = merged([self.schema, *(o.schema for o in others)])
        parts = [_renumbered(c.df, schema, m, None) for c, m in zip((self, *others), moves)]
        df = parts[0]
        for o in parts[1:]:
            df = df.unionByName(o)
        rollups = []
        for depths, _ in self.rollups:
            same = [[r for d, r in c.rollups if d == depths][:1] for c in (self, *others)]
            # A prefix that ends inside of a renumbered category says nothing about it.
            whole = all(n not in depths or depths[n] in (0, schema.dim(n).levels) for m in moves for n in m)
            if all(same) and whole:
                r = [_renumbered(x[0], schema, m, depths) for x, m in zip(same, moves)]
                one = r[0]
                for x in r[1:]:
                    one = one.unionByName(x)
                rollups.append((depths, one))
        return Cube(df, schema, rollups)

    def sum_of(self, m: Measure, weight: Column | None = None) -> Column:
        c = F.col(MEASURE + m.name)
        return F.sum(c if weight is None else c * weight).alias(MEASURE + m.name)

    def rollup(self, depths: dict[str, int]) -> Cube:
        """This cube with a stored aggregate of prefixes; dimensions not named are summed out."""
        keys = [codes.prefix(self.code(n), self.schema.dim(n).bits, self.schema.dim(n).levels, d).alias(DIM + n) for n, d in depths.items()]
        df = self.df.groupBy(*keys).agg(*[self.sum_of(m) for m in self.schema.measures])
        return replace(self, rollups=[*self.rollups, (depths, df)])

    def best(self, needs: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
        """The coarsest stored rows that hold the depths a query needs, and their depths."""
        fit = [(sum(d.values()), d, df) for d, df in self.rollups if all(d.get(n, 0) >= k for n, k in needs.items())]
        if fit:
            _, d, df = min(fit, key=lambda x: x[0])
            return df, d
        return self.df, {d.name: d.levels for d in self.schema.dims}

    def stats(self) -> DataFrame:
        """Rows, distinct finest bins and sums of measures."""
        dims = [DIM + d.name for d in self.schema.dims]
        bins = self.df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
        return bins.agg(F.sum("n").alias("num_rows"), F.count(F.lit(1)).alias("num_bins"))

    def bounds(self, dim: str) -> DataFrame:
        """Least and greatest populated bin."""
        return self.df.agg(F.min(DIM + dim).alias("first_bin"), F.max(DIM + dim).alias("last_bin"))

    def describe(self) -> DataFrame:
        """The schema as a table."""
        rows = [(self.schema.name, d.name, "index", d.bits, d.levels, d.hint, len(d.alias.names)) for d in self.schema.dims]
        rows += [(self.schema.name, m.name, "measure", None, None, m.storage, None) for m in self.schema.measures]
        return self.df.sparkSession.createDataFrame(rows, "cube string, name string, role string, bits int, levels int, kind string, aliases int")


def quadtree(name: str, lat: str, lon: str, levels: int, f32: bool = True) -> DimSpec:
    return DimSpec(name, 2, levels, lambda df: codes.latlon(df[lat], df[lon], levels, f32), "spatial")


def grid(name: str, x: str, y: str, levels: int, slippy: bool = False) -> DimSpec:
    return DimSpec(name, 2, levels, lambda df: codes.xy(df[x], df[y], levels, slippy), "spatial")


def address(name: str, column: str, levels: int) -> DimSpec:
    return DimSpec(name, 2, levels, lambda df: codes.hilbert_ip(df[column], levels), "spatial:ip")


def _is_text(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("string", "varchar", "char")


def time_bins(name: str, column: str, levels: int, base: int, width: int, add_minutes: int = 0, unix: bool = False) -> DimSpec:
    def encode(df: DataFrame) -> Column:
        c = df[column]
        second = codes.unix_text(c) if unix else codes.parse_time(c) if _is_text(df, column) else codes.seconds(c)
        return codes.time_bin(second, base, width, levels, add_minutes)

    return DimSpec(name, 1, levels, encode, f"temporal|{base}_{width}s", base, width)


def _clock(df: DataFrame, column: str) -> Column:
    """The written clock of a text, or the timestamp itself."""
    if not _is_text(df, column):
        return df[column]
    plain = F.regexp_replace(df[column], r"(?:Z|[-+][0-9]{2}(?::?[0-9]{2})?)\s*\z", "")
    return F.timestamp_seconds(codes.parse_time(F.when(df[column].rlike("[T@ ][0-9]"), plain).otherwise(df[column])))


def hours(name: str, column: str) -> DimSpec:
    return DimSpec(name, 5, 1, lambda df: codes.hour_label(_clock(df, column)), "categorical")


def weekdays(name: str, column: str) -> DimSpec:
    return DimSpec(name, 3, 1, lambda df: codes.weekday_label(_clock(df, column)), "categorical")


def categorical(name: str, column: str, bits: int = 8, levels: int = 1, alias_text: str | None = None) -> DimSpec:
    return DimSpec(name, bits, levels, None, "categorical", category=column, alias_text=alias_text)


def count(name: str = "count", storage: str = "u32") -> MeasureSpec:
    return MeasureSpec(name, None, storage)


def product(name: str, *columns: str, storage: str = "f64", scale: int = 0) -> MeasureSpec:
    """The column, or the product of several; a repeated one is a square."""

    def value(df: DataFrame) -> Column:
        out = df[columns[0]]
        for c in columns[1:]:
            out = out * df[c]
        return out

    return MeasureSpec(name, value, storage, scale)


def duration(name: str, start: str, end: str, unit: float = 1, power: int = 1, storage: str = "f64", scale: int = 0) -> MeasureSpec:
    """(end - start) in units of seconds, or its square."""

    def second(df: DataFrame, c: str) -> Column:
        return codes.parse_time(df[c]) if _is_text(df, c) else codes.seconds(df[c])

    def value(df: DataFrame) -> Column:
        d = (second(df, end) - second(df, start)) / unit
        return d * d if power == 2 else d

    return MeasureSpec(name, value, storage, scale)


def row_bitset(name: str, row: Column) -> MeasureSpec:
    """One bit per row number, 0 to 61; other rows have none. The sum names the set of rows."""
    return MeasureSpec(name, lambda _: F.when(row.between(0, 61), F.call_function("shiftleft", F.lit(1).cast("long"), row.cast("int"))).otherwise(F.lit(0).cast("long")), "u64")
