"""Queries over cubes and arithmetic between their results.

``Query`` binds targets to dimensions of one or more cubes (parts of one source)
and compiles to a single filter and group-by. ``Result`` is a DataFrame whose key
columns are described, so that tables can be aligned: keys equal (full outer
join), coarser or finer (prefix join), or none (a scalar).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from .cube import MEASURE, Cube
from .schema import IndexDim, QueryError, ResultError
from .targets import Target

INF = float("inf")


@dataclass(frozen=True)
class Key:
    """A key column: a path of a depth, or the number of a loop bucket."""

    dim: str
    kind: str
    bits: int = 0
    depth: int = 0
    hint: str = ""

    @property
    def column(self) -> str:
        return f"k_{self.dim}"


def _divide(a: Column, b: Column) -> Column:
    """IEEE division."""
    zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def _combine(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        return _divide(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def _lonely(op: str, a: Column | None, b: Column | None) -> Column:
    """Value of a cell that only one side has."""
    if b is None:
        return {"+": a, "-": a, "*": F.lit(0.0), "/": F.lit(float("nan"))}[op]
    return {"+": b, "-": -b, "*": F.lit(0.0), "/": F.lit(0.0)}[op]


@dataclass
class Result:
    """Key columns, one row per key, and numeric columns named by measures."""

    df: DataFrame
    keys: list[Key]
    measures: list[str]
    dims: dict[str, IndexDim]

    def _v(self, i: int) -> str:
        return f"v_{i}"

    def _number(self, n: float, op: str, first: bool) -> Result:
        lit = F.lit(float(n))
        cols = [(_combine(op, lit, F.col(self._v(i))) if first else _combine(op, F.col(self._v(i)), lit)).alias(self._v(i)) for i in range(len(self.measures))]
        return replace(self, df=self.df.select(*[k.column for k in self.keys], *cols))

    def _op(self, other: Result | float, op: str) -> Result:
        return self._number(other, op, False) if isinstance(other, (int, float)) else combine(self, other, op)

    def __add__(self, o):
        return self._op(o, "+")

    def __sub__(self, o):
        return self._op(o, "-")

    def __mul__(self, o):
        return self._op(o, "*")

    def __truediv__(self, o):
        return self._op(o, "/")

    def __radd__(self, n):
        return self._number(n, "+", True)

    def __rsub__(self, n):
        return self._number(n, "-", True)

    def __rmul__(self, n):
        return self._number(n, "*", True)

    def __rtruediv__(self, n):
        return self._number(n, "/", True)

    def table(self, paths: str = "text", ordered: bool = False) -> DataFrame:
        """Key columns as their hints say, then the measures.

        Without a hint a path is labels joined by ``:`` (``paths="array"`` for an
        array) and a loop a number; ``imgN`` and ``tileN`` give x and y, ``name``
        the alias, ``time`` the start of a bin.
        """
        df, cols = self.df, []
        for k in self.keys:
            c = F.col(k.column)
            kind = k.hint.rstrip("0123456789")
            if k.kind == "loop":
                cols.append(c.alias(k.dim))
            elif kind in ("img", "tile"):
                n = int(k.hint[len(kind) :] or k.depth)
                low = (1 << min(n, k.depth)) - 1
                x, y = (f(c, k.depth).bitwiseAND(F.lit(low).cast("long")) for f in (codes.cell_x, codes.cell_y))
                cols += [x.alias(f"{k.dim}_x"), ((low - y) if kind == "img" else y).alias(f"{k.dim}_y")]
            elif kind == "name":
                rows = [(p, n) for (d, p), n in self.dims[k.dim].alias.names.items() if d == k.depth]
                names = self.df.sparkSession.createDataFrame(rows or [(-1, "")], f"{k.column} long, `n_{k.dim}` string")
                df = df.join(F.broadcast(names) if len(rows) <= 100_000 else names, k.column, "left")
                cols.append(F.coalesce(F.col(f"n_{k.dim}"), codes.path_text(c, k.bits, k.depth)).alias(k.dim))
            elif kind == "time" and self.dims[k.dim].base is not None:
                d = self.dims[k.dim]
                second = d.base + c * 2 ** (d.levels - k.depth) * d.width
                epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
                cols.append((epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))).alias(k.dim))
            else:
                cols.append((codes.path_array if paths == "array" else codes.path_text)(c, k.bits, k.depth).alias(k.dim))
        names, seen = [], {}
        for m in self.measures:
            seen[m] = seen.get(m, 0) + 1
            names.append(m if seen[m] == 1 else f"{m}_{seen[m]}")
        if ordered and self.keys:
            df = df.orderBy(*[k.column for k in self.keys])
        return df.select(*cols, *[F.col(self._v(i)).alias(n) for i, n in enumerate(names)])


def _align(a: Result, b: Result) -> str:
    """equal, coarser or finer, as the keys of ``a`` stand to those of ``b``."""
    left, right = {k.dim: k for k in a.keys}, {k.dim: k for k in b.keys}

    def within(small: dict[str, Key], big: dict[str, Key]) -> bool:
        return all(n in big and k.kind == big[n].kind and k.bits == big[n].bits and (k.depth == big[n].depth if k.kind == "loop" else k.depth <= big[n].depth) for n, k in small.items())

    if within(left, right) and within(right, left):
        return "equal"
    if within(left, right):
        return "coarser"
    if within(right, left):
        return "finer"
    raise ResultError(f"keys {sorted(left)} and {sorted(right)} do not fit")


def combine(a: Result, b: Result, op: str) -> Result:
    """Column-by-column arithmetic of aligned tables.

    A cell that only one side has is kept by ``+``, kept or negated by ``-``, 0
    for ``*``, and NaN (left only) or 0 (right only) for ``/``. Where either
    first column is NaN, the first result is NaN and the others keep the left
    side's values.
    """
    if len(a.measures) != len(b.measures):
        raise ResultError("tables of different numbers of measures")
    n, how = len(a.measures), _align(a, b)
    big, small = (b, a) if how == "coarser" else (a, b)
    left = a.df.select(*[F.col(k.column).alias(f"a_{k.dim}") for k in a.keys], *[F.col(f"v_{i}").alias(f"av_{i}") for i in range(n)], F.lit(True).alias("a_"))
    right = b.df.select(*[F.col(k.column).alias(f"b_{k.dim}") for k in b.keys], *[F.col(f"v_{i}").alias(f"bv_{i}") for i in range(n)], F.lit(True).alias("b_"))
    side, other = ("b", "a") if how == "coarser" else ("a", "b")
    deep = {k.dim: k for k in big.keys}
    if not small.keys and how != "equal":
        # A scalar: one row at most, read as a subquery.
        lone, many = (left, right) if how == "coarser" else (right, left)
        joined = many.withColumns({c: lone.select(c).scalar() for c in lone.columns})
    elif not small.keys:
        joined = left.withColumn("j_", F.lit(1)).join(right.withColumn("j_", F.lit(1)), "j_", "full_outer")
    else:
        conds = []
        for k in small.keys:
            d = deep[k.dim]
            c = F.col(f"{side}_{k.dim}")
            if k.kind == "path" and d.depth > k.depth:
                c = F.shiftright(c, k.bits * (d.depth - k.depth))
            conds.append(c == F.col(f"{other}_{k.dim}"))
        cond = conds[0]
        for c in conds[1:]:
            cond = cond & c
        x, y = (right, left) if how == "coarser" else (left, right)
        joined = x.join(y, cond, "full_outer" if how == "equal" else "left")
    keys = [F.coalesce(F.col(f"{side}_{k.dim}"), *([F.col(f"{other}_{k.dim}")] if how == "equal" else [])).alias(k.column) for k in big.keys]
    both, no_b = F.col("a_") & F.col("b_"), F.col("b_").isNull()
    broken = F.coalesce(F.isnan("av_0") | F.isnan("bv_0"), F.lit(False)) if n else F.lit(False)
    vals = []
    for i in range(n):
        l, r = F.col(f"av_{i}"), F.col(f"bv_{i}")
        out = F.when(both & broken, F.lit(float("nan")) if i == 0 else l).when(both, _combine(op, l, r)).when(no_b, _lonely(op, l, None)).otherwise(_lonely(op, None, r))
        vals.append(out.alias(f"v_{i}"))
    return Result(joined.select(*keys, *vals), big.keys, a.measures, a.dims | b.dims)


@dataclass
class Query:
    """A source with bindings: compiled when a result is asked for."""

    cubes: tuple[Cube, ...]
    bindings: tuple[tuple[str, Target, str], ...] = ()
    selection: tuple[str, ...] | None = None
    strict: bool = True

    def b(self, dim: str, target: Target, hint: str = "") -> Query:
        """Bind a target to a dimension; the first binding of a dimension holds."""
        return replace(self, bindings=(*self.bindings, (dim, target, hint)))

    def select(self, *measures: str) -> Query:
        if self.selection is not None:
            raise QueryError("measures are already selected")
        return replace(self, selection=measures)

    def without(self, dim: str) -> Query:
        return replace(self, bindings=tuple(x for x in self.bindings if x[0] != dim))

    def _bound(self) -> dict[str, tuple[Target, str]]:
        out: dict[str, tuple[Target, str]] = {}
        for name, target, hint in self.bindings:
            if self.strict or any(d.name == name for d in self.cubes[0].schema.dims):
                self.cubes[0].schema.dim(name)
                out.setdefault(name, (target, hint))
        return out

    def rows(self) -> DataFrame:
        """The base rows that the bindings let through, not aggregated."""
        whole = self.cubes[0].union(*self.cubes[1:])
        df = whole.df
        for name, (target, _) in self._bound().items():
            for f in target.compile(whole.schema.dim(name), whole.code(name)).filters:
                df = df.where(f)
        return df

    def result(self) -> Result:
        whole = self.cubes[0].union(*self.cubes[1:])
        schema, bound = whole.schema, self._bound()
        if self.selection is not None:
            by = {m.name: m for m in schema.measures}
            if missing := [m for m in self.selection if m not in by]:
                raise QueryError(f"no measure {missing}")
            measures = [by[m] for m in self.selection]
        else:
            measures = schema.measures
        df = whole.df
        if whole.rollups:
            # A rollup serves if filters and keys of every bound dimension only look at a prefix that it holds.
            needs = {}
            for name, (target, _) in bound.items():
                c = target.compile(schema.dim(name), whole.code(name))
                needs[name] = schema.dim(name).levels if c.level is None else c.level
            df, depths = whole.best(needs)
            pads = {f"d_{n}": F.shiftleft(F.col(f"d_{n}"), schema.dim(n).bits * (schema.dim(n).levels - d)) for n, d in depths.items() if d < schema.dim(n).levels and f"d_{n}" in df.columns}
            df = df.withColumns(pads) if pads else df
        keys, exprs, weight, explode, running = [], [], None, [], None
        for dim in schema.dims:
            if dim.name not in bound:
                continue
            target, hint = bound[dim.name]
            c = target.compile(dim, whole.code(dim.name))
            for f in c.filters:
                df = df.where(f)
            if c.weight is not None:
                weight = c.weight if weight is None else weight * c.weight
            if c.kind:
                k = Key(dim.name, "path" if c.kind == "path" else "loop", dim.bits, c.depth if c.kind == "path" else 0, hint)
                keys.append(k)
                exprs.append(c.key.alias(k.column))
                if c.kind == "loops":
                    explode.append(k.column)
                elif c.kind == "running":
                    running = [*(running or []), (k.column, c.depth)]
        grouped = df.select(*exprs, *[(F.col(MEASURE + m.name) if weight is None else F.col(MEASURE + m.name) * weight).alias(MEASURE + m.name) for m in measures])
        again = [F.sum(MEASURE + m.name).alias(MEASURE + m.name) for m in measures]
        names = [k.column for k in keys]
        out = grouped.groupBy(*names).agg(*again)
        # Sliding and running buckets are spread after rows with the same buckets have met.
        for c in explode:
            out = out.withColumn(c, F.explode(c))
        for c, n in running or []:
            out = out.withColumn(c, F.explode(F.sequence(F.col(c), F.lit(n - 1).cast("long"))))
        if explode or running:
            out = out.groupBy(*names).agg(*again)
        vals = [(F.col(MEASURE + m.name).cast("double") / 10**m.scale).alias(f"v_{i}") for i, m in enumerate(measures)]
        out = out.select(*names, *vals)
        if not keys:
            out = out.where(F.col("v_0").isNotNull()) if measures else out
        return Result(out, keys, [m.name for m in measures], {d.name: d for d in schema.dims})

    def table(self, **kw) -> DataFrame:
        return self.result().table(**kw)

    def __add__(self, o):
        return self.result() + as_result(o)

    def __sub__(self, o):
        return self.result() - as_result(o)

    def __mul__(self, o):
        return self.result() * as_result(o)

    def __truediv__(self, o):
        return self.result() / as_result(o)

    def __radd__(self, n):
        return n + self.result()

    def __rsub__(self, n):
        return n - self.result()

    def __rmul__(self, n):
        return n * self.result()

    def __rtruediv__(self, n):
        return n / self.result()


def as_result(x):
    return x.result() if isinstance(x, Query) else x


def cross_filter(base: Query, selections: dict[str, tuple[Target, str]], views: dict[str, tuple[Target, str]]) -> dict[str, Result]:
    """One result per view: the view's own target, and the selections of all others."""
    out = {}
    for name, (target, hint) in views.items():
        q = base.b(name, target, hint)
        for other, (sel, h) in selections.items():
            if other != name:
                q = q.b(other, sel, h)
        out[name] = q.result()
    return out


def top_n(results: list[Result], n: int) -> list[DataFrame]:
    """Tables cut to the ``n`` keys with the greatest first measure summed over all tables; ties by key."""
    names = [k.column for k in results[0].keys]
    everything = results[0].df.select(*names, "v_0")
    for r in results[1:]:
        everything = everything.unionByName(r.df.select(*names, "v_0"))
    best = everything.groupBy(*names).agg(F.sum("v_0").alias("s")).orderBy(F.desc("s"), *names).limit(n).select(*names)
    return [replace(r, df=r.df.join(best, names, "left_semi")).table() for r in results]


def series(a: Result, b: Result, op: str) -> DataFrame:
    """Client arithmetic of series: outer join, NaN as 0, ``||`` the greater, ``&&`` the lesser; zero and infinite rows go."""
    names = [k.column for k in a.keys]
    l, r = a.df.select(*names, F.col("v_0").alias("l")), b.df.select(*names, F.col("v_0").alias("r"))
    j = l.join(r, names, "full_outer").fillna(0.0, ["l", "r"])
    x, y = F.col("l"), F.col("r")
    v = F.greatest(x, y) if op == "||" else F.least(x, y) if op == "&&" else _combine(op, x, y)
    v = F.when(F.isnan(v), 0.0).otherwise(v)
    out = j.withColumn("v_0", v).where((F.col("v_0") != 0) & (F.abs("v_0") != INF))
    return replace(a, df=out.select(*names, "v_0"), measures=["value"]).table()

