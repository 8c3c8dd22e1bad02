"""Shapes on the Mercator square as sets of quadtree cells.

A cover is a tree: True (all of the square), False (none), or four children in
label order. Set operations work on trees, so their cost follows the border.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from ..functions.codes import MAX_LAT
from .schema import QueryError

Tree = bool | tuple


def interleave(x: int, y: int) -> int:
    out, i = 0, 0
    while x >> i or y >> i:
        out |= (x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1
        i += 1
    return out


def mask_paths(text: str) -> list[tuple[int, ...]]:
    """Paths listed by a push/pop text: what stands on the stack at a ``<`` after a push, or at its start."""
    stack: list[int] = []
    out: list[tuple[int, ...]] = []
    fresh = True
    for c in text:
        if c == "<":
            if fresh:
                out.append(tuple(stack))
            if stack:
                stack.pop()
            fresh = False
        elif "0" <= c <= "9":
            stack.append(ord(c) - ord("0"))
            fresh = True
        else:
            raise QueryError(f"mask has {c!r}")
    return out


def mask_text(tree: Tree) -> str:
    """The push/pop text of a cover."""
    if tree is True:
        return "<"
    if tree is False:
        return ""

    def below(t: Tree) -> str:
        return "".join(str(i) + ("" if c is True else below(c)) + "<" for i, c in enumerate(t) if c is not False)

    return below(tree)


def _join(children: tuple) -> Tree:
    if all(c is True for c in children):
        return True
    return False if all(c is False for c in children) else children


def complement(a: Tree) -> Tree:
    return (not a) if isinstance(a, bool) else tuple(complement(c) for c in a)


def union(a: Tree, b: Tree) -> Tree:
    if a is True or b is True:
        return True
    if a is False or b is False:
        return b if a is False else a
    return _join(tuple(map(union, a, b)))


def intersection(a: Tree, b: Tree) -> Tree:
    if a is False or b is False:
        return False
    if a is True or b is True:
        return b if a is True else a
    return _join(tuple(map(intersection, a, b)))


def difference(a: Tree, b: Tree) -> Tree:
    return intersection(a, complement(b))


def symmetric(a: Tree, b: Tree) -> Tree:
    if isinstance(a, bool):
        return complement(b) if a else b
    if isinstance(b, bool):
        return complement(a) if b else a
    return _join(tuple(map(symmetric, a, b)))


def cells(tree: Tree, depth: int = 0, code: int = 0) -> Iterator[tuple[int, int]]:
    """(depth, prefix) of the largest full cells."""
    if tree is True:
        yield depth, code
    elif tree is not False:
        for i, c in enumerate(tree):
            yield from cells(c, depth + 1, code << 2 | i)


class Shape:
    """Something with a cover at each level."""

    def cover(self, level: int) -> Tree:
        raise NotImplementedError

    def cells(self, level: int) -> Iterable[tuple[int, int]]:
        return cells(self.cover(level))


@dataclass
class Poly(Shape):
    """A contour of (lat, lon) points; inside is where it winds a non-zero number of times.

    A cell belongs to the cover if its interior meets the interior of the polygon.
    """

    points: tuple[tuple[float, float], ...]

    @staticmethod
    def parse(text: str) -> Poly:
        v = [float(x) for x in text.split(",")]
        if len(v) % 2 or len(v) < 6:
            raise QueryError("a polygon takes pairs of numbers, three at least")
        points = tuple(zip(v[::2], v[1::2]))
        if any(abs(a) > MAX_LAT or abs(o) > 180 for a, o in points):
            raise QueryError("a point lies outside of the map")
        return Poly(points)

    def cover(self, level: int) -> Tree:
        p = np.array([[(lon / 180 + 1) / 2, (math.log(math.tan(lat * math.pi / 360 + math.pi / 4)) / math.pi + 1) / 2] for lat, lon in self.points])
        edges = np.hstack([p, np.roll(p, -1, axis=0)]) * (1 << level)
        edges = edges[(edges[:, :2] != edges[:, 2:]).any(axis=1)]
        return _cover(edges, edges, 0, 0, 1 << level)


def _crosses(e: np.ndarray, x: float, y: float, s: float) -> np.ndarray:
    """Which edges meet the open square from (x, y) of side s."""
    lo, hi = np.zeros(len(e)), np.ones(len(e))
    ok = np.ones(len(e), bool)
    for k, a in ((0, x), (1, y)):
        p, d = e[:, k], e[:, k + 2] - e[:, k]
        flat = d == 0
        ok &= ~flat | ((p > a) & (p < a + s))
        with np.errstate(divide="ignore", invalid="ignore"):
            t0, t1 = (a - p) / d, (a + s - p) / d
        lo = np.where(flat, lo, np.maximum(lo, np.minimum(t0, t1)))
        hi = np.where(flat, hi, np.minimum(hi, np.maximum(t0, t1)))
    return ok & (lo < hi)


def _winds(e: np.ndarray, x: float, y: float) -> bool:
    up = (e[:, 1] <= y) & (e[:, 3] > y)
    down = (e[:, 1] > y) & (e[:, 3] <= y)
    left = (e[:, 2] - e[:, 0]) * (y - e[:, 1]) - (x - e[:, 0]) * (e[:, 3] - e[:, 1])
    return int((up & (left > 0)).sum()) != int((down & (left < 0)).sum())


def _cover(edges: np.ndarray, near: np.ndarray, x: float, y: float, s: float) -> Tree:
    near = near[_crosses(near, x, y, s)]
    if not len(near):
        return _winds(edges, x + s / 2, y + s / 2)
    if s <= 1:
        # A border runs through: the polygon's inside lies on one side of it within the cell.
        return True
    h = s / 2
    return _join(tuple(_cover(edges, near, x + (i & 1) * h, y + (i >> 1) * h, h) for i in range(4)))


@dataclass
class Combined(Shape):
    """A set operation over the covers of shapes, from left to right."""

    op: str
    parts: tuple[Shape, ...]

    def cover(self, level: int) -> Tree:
        trees = [p.cover(level) for p in self.parts]
        if self.op == "complement":
            return complement(trees[0])
        out = trees[0]
        do = {"union": union, "intersection": intersection, "symdiff": symmetric, "diff": difference}[self.op]
        for t in trees[1:]:
            out = do(out, t)
        return out
