"""Query targets: what a query wants of one dimension.

A target compiles, for a code column, to filters, a weight (how often a row
counts), and a key: a prefix of the code or the numbers of loop buckets.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import codes
from . import poly
from .schema import IndexDim, QueryError, TimeAlignmentError, number_of


@dataclass
class Compiled:
    """Effect of a target on the rows of a cube."""

    filters: list[Column] = field(default_factory=list)
    weight: Column | None = None
    key: Column | None = None
    #: "path" with the depth, "loop", "loops" (an array of numbers) or "running" with the count.
    kind: str | None = None
    depth: int = 0
    #: Deepest level that filters, weight and key look at; None is the dimension's last.
    level: int | None = None


class Target:
    def compile(self, dim: IndexDim, code: Column) -> Compiled:
        raise NotImplementedError


#: Most ranges of codes in a filter; cells in more ranges are tested by prefix behind ranges that cover them.
RANGES = 4


def _pfx(dim: IndexDim, code: Column, depth: int) -> Column:
    return codes.prefix(code, dim.bits, dim.levels, depth)


def _below(dim: IndexDim, depth: int, k: int) -> tuple[int, int]:
    """First and last code below a path."""
    s = dim.bits * (dim.levels - depth)
    return k << s, ((k + 1) << s) - 1


def _within(code: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a code lies in one of the ranges, in a form that a scan can skip by."""
    out = F.lit(False)
    for i, (lo, hi) in enumerate(ranges):
        test = (code >= lo) & (code <= hi)
        out = test if i == 0 else out | test
    return out


def _segments(dim: IndexDim, paths: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint ranges of codes below the paths, in order, with how many of the paths each lies below."""
    steps: Counter[int] = Counter()
    for (depth, k), times in Counter(paths).items():
        lo, hi = _below(dim, depth, k)
        steps[lo] += times
        steps[hi + 1] -= times
    out, at, weight = [], 0, 0
    for x in sorted(steps):
        if weight:
            if out and out[-1][1] == at - 1 and out[-1][2] == weight:
                out[-1] = (out[-1][0], x - 1, weight)
            else:
                out.append((at, x - 1, weight))
        at, weight = x, weight + steps[x]
    return out


def _cover(segments: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """At most ``RANGES`` ranges that hold the segments: joined where the gaps between are least."""
    if not segments:
        return []
    gaps = sorted(range(1, len(segments)), key=lambda i: segments[i][0] - segments[i - 1][1], reverse=True)
    starts = sorted([0, *gaps[: RANGES - 1]])
    return [(segments[a][0], segments[b - 1][1]) for a, b in zip(starts, [*starts[1:], len(segments)])]


def _listed(dim: IndexDim, code: Column, paths: list[tuple[int, int]]) -> tuple[list[Column], Column | None]:
    """Filters of the codes below any of the paths, and how many each lies below where that differs."""
    segments = _segments(dim, paths)
    once = all(w == 1 for _, _, w in segments)
    near = [_within(code, _cover(segments))]
    if len(segments) <= RANGES:
        if once:
            return near, None
        weight = F.lit(0)
        for w in sorted({w for _, _, w in segments}):
            weight = F.when(_within(code, [(a, b) for a, b, x in segments if x == w]), w).otherwise(weight)
        return near, weight
    groups: dict[tuple[int, int], list[int]] = {}
    for (depth, k), times in Counter(paths).items():
        groups.setdefault((depth, times), []).append(k)
    weight = F.lit(0)
    for (depth, times), ks in groups.items():
        hit = F.lit(True) if depth == 0 else _pfx(dim, code, depth).isin(ks)
        weight = weight + F.when(hit, times).otherwise(0)
    return [*near, weight > 0], None if once else weight


@dataclass
class Path(Target):
    """A slice: the rows below one path."""

    labels: tuple[int, ...]

    def where(self, dim: IndexDim) -> tuple[int, int]:
        if len(self.labels) > dim.levels:
            raise QueryError(f"path {self.labels} is deeper than {dim.name}")
        return len(self.labels), number_of(self.labels, dim.bits)

    def compile(self, dim: IndexDim, code: Column) -> Compiled:
        depth, k = self.where(dim)
        return Compiled([_within(code, [_below(dim, depth, k)])] if depth else [], level=depth)


@dataclass
class Name(Path):
    """A slice by alias."""

    name: str

    def __init__(self, name: str):
        self.name = name

    def where(self, dim: IndexDim) -> tuple[int, int]:
        return dim.alias.find(self.name)


@dataclass
class Tile(Path):
    """A slice by quadtree cell; ``image`` counts y from the top."""

    z: int
    x: int
    y: int
    image: bool = False

    def __init__(self, z: int, x: int, y: int, image: bool = False):
        if not (0 <= x < 1 << z and 0 <= y < 1 << z):
            raise QueryError("tile outside of its level")
        self.z, self.x, self.y, self.image = z, x, y, image

    def where(self, dim: IndexDim) -> tuple[int, int]:
        if dim.bits != 2 or self.z > dim.levels:
            raise QueryError(f"{dim.name} has no such tile")
        return self.z, poly.interleave(self.x, (1 << self.z) - 1 - self.y if self.image else self.y)


@dataclass
class TileRange(Target):
    """All cells of a rectangle of corners, in any order, summed."""

    z: int
    corners: tuple[int, int, int, int]
    image: bool = False

    def compile(self, dim: IndexDim, code: Column) -> Compiled:
        n = 1 << self.z
        x0, y0, x1, y1 = self.corners
        if dim.bits != 2 or self.z > dim.levels or not all(0 <= v < n for v in self.corners):
            raise QueryError(f"{dim.name} has no such tiles")
        if self.image:
            y0, y1 = n - 1 - y0, n - 1 - y1
        k = dim.levels - self.z
        lo, hi = poly.interleave(min(x0, x1), min(y0, y1)), poly.interleave(max(x0, x1), max(y0, y1))
        # The range of codes lets a scan skip row groups; the cells decide. Bits of x and
        # y keep their order where they stand in the code, so they are not gathered.
        near = code.between(lo << 2 * k, ((hi + 1) << 2 * k) - 1)
        tests = [near]
        for v, w, shift in ((x0, x1, 0), (y0, y1, 1)):
            mask = poly.interleave(n - 1, 0) << 2 * k + shift
            low, high = (poly.interleave(u, 0) << 2 * k + shift for u in (min(v, w), max(v, w)))
            tests.append(code.bitwiseAND(F.lit(mask).cast("long")).between(low, high))
        return Compiled(tests, level=self.z)


@dataclass
class Dive(Target):
    """One row per populated descendant ``depth`` levels below a path."""

    depth: int
    below: Path | None = None

    def compile(self, dim: IndexDim, code: Column) -> Compiled:
        at, k = self.below.where(dim) if self.below else (0, 0)
        total = at + self.depth
        if total > dim.levels:
            return Compiled([F.lit(False)], key=code, kind="path", depth=dim.levels)
        return Compiled([_within(code, [_below(dim, at, k)])] if at else [], key=_pfx(dim, code, total), kind="path", depth=total, level=total)


@dataclass
class DiveList(Target):
    """Several dives that reach the same depth; overlaps count repeatedly."""

    dives: tuple[Dive, ...]

    def compile(self, dim: IndexDim, code: Column) -> Compiled:
        at = [d.below.where(dim) if d.below else (0, 0) for d in self.dives]
        depths = {a + d.depth for (a, _), d in zip(at, self.dives)}
        if len(depths) != 1:
            raise QueryError("dives of different depths")
        total = depths.pop()
        if total > dim.levels:
            return Compiled([F.lit(False)], key=code, kind="path", depth=dim.levels)
        filters, weight = _listed(dim, code, at)
        return Compiled(filters, weight, _pfx(dim, code, total), "path", total, total)


@dataclass
class PathAgg(Target):
    """The sum over listed paths; repeated and nested ones count repeatedly."""

    paths: tuple[Path, ...]

    def compile(self, dim: IndexDim, code: Column) -> Compiled:
        at = [p.where(dim) for p in self.paths]
        return Compiled(*_listed(dim, code, at), level=max((d for d, _ in at), default=0))


@dataclass
class Mask(Target):
    """The sum over the set of paths of a push/pop text, or of given cells."""

    cells: frozenset[tuple[int, int]]

    @staticmethod
    def parse(text: str, bits: int = 2) -> Mask:
        return Mask(frozenset((len(p), number_of(p, bits)) for p in poly.mask_paths(text)))

    def compile(self, dim: IndexDim, code: Column) -> Compiled:
        cells = [c for c in self.cells if c[0] <= dim.levels]
        return Compiled(*_listed(dim, code, cells), level=max((d for d, _ in cells), default=0))


@dataclass
class Region(Target):
    """The sum over the quadtree cover of a shape at a level."""

    level: int
    shape: poly.Shape

    def compile(self, dim: IndexDim, code: Column) -> Compiled:
        if dim.bits != 2:
            raise QueryError(f"{dim.name} is no map")
        return Mask(frozenset(self.shape.cells(min(self.level, dim.levels)))).compile(dim, code)


@dataclass
class Interval(Target):
    """The sum over the bins of [first, end)."""

    first: int
    end: int

    def compile(self, dim: IndexDim, code: Column) -> Compiled:
        return Compiled([(code >= self.first) & (code < self.end)])


@dataclass
class IntSeq(Target):
    """Buckets [base + i * stride, + width), numbered; ``loop`` false sums them."""

    base: int
    width: int
    count: int
    stride: int | None = None
    loop: bool = True
    running: bool = False

    def compile(self, dim: IndexDim, code: Column) -> Compiled:
        stride = self.width if self.stride is None else self.stride
        if self.width < 1 or self.count < 1 or stride < 0:
            raise QueryError("an empty sequence")
        off = code - self.base
        if self.running:
            # A row enters bucket i once its end, width + i * stride, has passed it.
            first = F.when(off < self.width, F.lit(0).cast("long"))
            if stride:
                first = first.otherwise(F.floor((off - self.width) / stride) + 1)
            keep = [off >= 0, off < self.width + (self.count - 1) * stride]
            if self.loop:
                return Compiled(keep, key=first, kind="running", depth=self.count)
            return Compiled(keep, self.count - first)
        if stride == 0:
            inside = [off >= 0, off < self.width]
            if not self.loop:
                return Compiled(inside, F.lit(self.count))
            return Compiled(inside, key=F.sequence(F.lit(0).cast("long"), F.lit(self.count - 1).cast("long")), kind="loops")
        last = F.least(F.floor(off / stride), F.lit(self.count - 1).cast("long"))
        keep = [off >= 0, off < self.width + (self.count - 1) * stride]
        if stride >= self.width:
            keep.append(off - last * stride < self.width)
            return Compiled(keep, key=last, kind="loop") if self.loop else Compiled(keep)
        first = F.greatest(F.floor((off - self.width) / stride) + 1, F.lit(0).cast("long"))
        if self.loop:
            return Compiled(keep, key=F.sequence(first, last), kind="loops")
        return Compiled(keep, last - first + 1)


@dataclass
class TimeSeries(Target):
    """A sequence in calendar seconds: ``cumulative`` grows each bucket from the start."""

    base: int
    width: int
    count: int
    stride: int | None = None
    loop: bool = True
    cumulative: bool = False

    def compile(self, dim: IndexDim, code: Column) -> Compiled:
        if dim.base is None or dim.width is None:
            raise QueryError(f"{dim.name} is no time")
        stride = self.width if self.stride is None else self.stride
        if (self.base - dim.base) % dim.width or self.width % dim.width or stride % dim.width:
            raise TimeAlignmentError("base, width and stride must be multiples of the bin width")
        return IntSeq((self.base - dim.base) // dim.width, self.width // dim.width, self.count, stride // dim.width, self.loop, self.cumulative).compile(dim, code)
