"""Runs queries beside their SQL on the small tables and reports differences."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings taxi fleets zones crimes paper bug4e mix_targets pack_sizes".split()
DATA = "/root/testdata"


def connection(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{DATA}/{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def compare(spark, name, run, sql, sf="sf0.01"):
    """Message of the first difference, or an empty text."""
    df = run(spark, f"{DATA}/{sf}")
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = connection(sf).execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    if mine != theirs:
        a, b = [r for r in mine if r not in set(theirs)][:4], [r for r in theirs if r not in set(mine)][:4]
        return f"{len(mine)} rows against {len(theirs)}; only Spark {a}; only SQL {b}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF", "sf0.01")
    qs, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    for n, run in qs.items():
        if wanted and not any(n.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            said = compare(spark, n, run, sqls[n], sf) if n in sqls else f"no SQL, {run(spark, f'{DATA}/{sf}').count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__} {str(e)[:1500]}"
        print(f"{n}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
