"""``python -m prismcube REQUEST ALIAS=PATH[:PATH...] ...``: answer one request over stored cubes.

An ``@`` before the first path keeps the cube in memory.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans.cube import Cube
from .plans.lang import Engine


def open_cubes(spark: SparkSession, sources: list[str]) -> Engine:
    engine = Engine()
    for s in sources:
        alias, _, paths = s.partition("=")
        engine.add(alias, Cube.load(spark, *paths.lstrip("@").split(":"), preload=paths.startswith("@")))
    return engine


def main(args: list[str]) -> None:
    if len(args) < 2:
        sys.exit(__doc__)
    spark = SparkSession.builder.appName("prismcube").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = open_cubes(spark, args[1:]).render(args[0])
    if isinstance(out, bytes):
        sys.stdout.buffer.write(out)
    else:
        print(out)


if __name__ == "__main__":
    main(sys.argv[1:])
