"""Result tables as JSON, aligned text, CSV, PSV or Arrow; rows in key order.

A rendered result is a table for a person or a client: it comes to the driver.
"""

from __future__ import annotations

import io
import json

import pyarrow as pa

from .query import Result
from .schema import CubeSchema, QueryError


def render(r: Result, style: str = "json") -> str | bytes:
    df = r.table(ordered=True)
    if style == "bin":
        sink = io.BytesIO()
        t = df.toArrow()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        return sink.getvalue()
    n = len(r.measures)
    rows = [tuple(x) for x in df.collect()]
    keys, values = df.columns[: len(df.columns) - n], df.columns[len(df.columns) - n :]
    if style == "json":
        index = []
        at = 0
        for k in r.keys:
            kind = k.hint.rstrip("0123456789")
            if kind in ("img", "tile"):
                index.append({"name": k.dim, "hint": k.hint, "values_per_row": 2, "values": [v for x in rows for v in x[at : at + 2]]})
                at += 2
                continue
            col = [x[at] for x in rows]
            at += 1
            if k.kind == "loop":
                index.append({"name": k.dim, "hint": "none", "values_per_row": 1, "values": col})
            elif kind == "name":
                index.append({"name": k.dim, "hint": "name", "values_per_row": 1, "values": col})
            elif kind == "time":
                index.append({"name": k.dim, "hint": "time", "values_per_row": 1, "values": [str(v) for v in col]})
            else:
                index.append({"name": k.dim, "hint": "none", "values_per_row": k.depth, "values": [int(v) for t in col for v in t.split(":") if t]})
        measures = [{"name": c, "values": [float(f"{x[len(keys) + i]:f}") for x in rows]} for i, c in enumerate(values)]
        return json.dumps({"type": "table", "numrows": len(rows), "index_columns": index, "measure_columns": measures})
    cells = [[*(str(v) for v in x[: len(keys)]), *(f"{v:f}" for v in x[len(keys) :])] for x in rows]
    head = [*keys, *values]
    if style in ("csv", "psv"):
        sep = "," if style == "csv" else "|"
        return "\n".join(sep.join(x) for x in [head, *cells])
    if style == "text":
        cells = [[*(v.replace(":", ",") for v in x[: len(keys)]), *x[len(keys) :]] for x in cells]
        wide = [max(len(x[i]) for x in [head, *cells]) for i in range(len(head))]
        return "\n".join(" ".join(v.rjust(w) for v, w in zip(x, wide)) for x in [head, *cells])
    raise QueryError(f"no format {style}")


def render_schema(schemas: dict[str, CubeSchema], style: str = "json") -> str:
    if style == "json":
        return json.dumps([{"alias": a} | json.loads(s.to_json()) for a, s in schemas.items()])
    sep = {"csv": ",", "psv": "|", "text": " "}.get(style)
    if sep is None:
        raise QueryError(f"no format {style}")
    rows = [sep.join(map(str, (a, "index", d.name, d.bits, d.levels, d.hint))) for a, s in schemas.items() for d in s.dims]
    return "\n".join([*rows, *(sep.join((a, "measure", m.name, m.storage)) for a, s in schemas.items() for m in s.measures)])
