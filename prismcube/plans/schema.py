"""Cube schemas: index dimensions, measures and alias tables, with a JSON form."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


def number_of(labels: list[int] | tuple[int, ...], bits: int) -> int:
    """Prefix of a path of labels."""
    out = 0
    for x in labels:
        if not 0 <= x < 1 << bits:
            raise ValueError(f"label {x} does not fit {bits} bits")
        out = out << bits | x
    return out


@dataclass
class Alias:
    """Names of paths of one dimension: (depth, prefix) to name, and inputs to paths."""

    names: dict[tuple[int, int], str] = field(default_factory=dict)
    inputs: dict[str, tuple[int, int]] = field(default_factory=dict)

    def add(self, depth: int, pfx: int, name: str) -> None:
        self.names.setdefault((depth, pfx), name)
        self.inputs.setdefault(name, (depth, pfx))

    def find(self, name: str) -> tuple[int, int]:
        if name not in self.inputs:
            raise AliasError(name)
        return self.inputs[name]


class QueryError(ValueError):
    """A query that cannot be answered."""


class AliasError(QueryError):
    """An alias that no path has."""


class ResultError(QueryError):
    """Result tables whose keys do not fit each other."""


class TimeAlignmentError(QueryError):
    """A time series that does not fall on the bins."""


@dataclass
class IndexDim:
    """A rooted tree of ``levels`` levels, each of ``bits`` bits."""

    name: str
    bits: int
    levels: int
    hint: str = ""
    #: Base second, bin width in seconds and zone offset in minutes of a time dimension.
    base: int | None = None
    width: int | None = None
    alias: Alias = field(default_factory=Alias)

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= 8 or self.levels < 1 or self.bits * self.levels > 62:
            raise ValueError(f"dimension {self.name} does not fit a long")


@dataclass
class Measure:
    """A numeric column that is always summed, kept as whole units of ``10**-scale``."""

    name: str
    storage: str = "f64"
    scale: int = 0


@dataclass
class CubeSchema:
    dims: list[IndexDim]
    measures: list[Measure]
    name: str = "cube"

    def dim(self, name: str) -> IndexDim:
        for d in self.dims:
            if d.name == name:
                return d
        raise QueryError(f"cube {self.name} has no dimension {name}")

    def to_json(self) -> str:
        dims = []
        for d in self.dims:
            row = asdict(d) | {"alias": {"names": [[k[0], k[1], v] for k, v in d.alias.names.items()], "inputs": [[k, *v] for k, v in d.alias.inputs.items()]}}
            dims.append(row)
        return json.dumps({"name": self.name, "index_dimensions": dims, "measure_dimensions": [asdict(m) for m in self.measures]})

    @staticmethod
    def from_json(text: str) -> CubeSchema:
        raw = json.loads(text)
        dims = []
        for d in raw["index_dimensions"]:
            a = d.pop("alias")
            dims.append(IndexDim(**d, alias=Alias({(x, y): n for x, y, n in a["names"]}, {n: (x, y) for n, x, y in a["inputs"]})))
        return CubeSchema(dims, [Measure(**m) for m in raw["measure_dimensions"]], raw["name"])


def parse_alias_text(text: str, bits: int, levels: int) -> Alias:
    """An alias table from tab-separated lines.

    Plain form: inputs, then the name of their common path; paths are numbered in
    order. After a first line ``@hierarchy``, the number of leading tabs is the
    depth: a name of an inner node, or on the last level inputs and a name.
    """
    out = Alias()
    lines = [x for x in text.splitlines() if x.strip()]
    if lines and lines[0].strip() == "@hierarchy":
        at: list[int] = []
        used: dict[tuple[int, ...], int] = {}
        for line in lines[1:]:
            depth = len(line) - len(line.lstrip("\t"))
            if depth >= levels or depth > len(at):
                raise ValueError(f"line {line!r} is too deep")
            at = at[:depth]
            label = used.get(tuple(at), 0)
            if label >= 1 << bits:
                raise ValueError(f"more than {1 << bits} nodes below one")
            used[tuple(at)] = label + 1
            at.append(label)
            *ins, name = line.strip("\t").split("\t")
            pfx = number_of(at, bits)
            out.add(depth + 1, pfx, name)
            for i in ins:
                out.inputs.setdefault(i, (depth + 1, pfx))
        return out
    for line in lines:
        *ins, name = line.split("\t")
        if name not in out.inputs:
            if len(out.names) >= 1 << bits * levels:
                raise ValueError("more names than the dimension holds")
            out.add(levels, len(out.names), name)
        for i in ins:
            out.inputs.setdefault(i, out.inputs[name])
    return out
