"""Cubes that answer while they grow, with Structured Streaming.

Each micro-batch is encoded, summed to its finest bins and appended to a folder
named by the batch, so that a repeated batch replaces its own files. Sums of
sums are right, so a reader may unite the folders at any time; ``compact``
merges them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cube import MEASURE, Cube


def finest(cube: Cube) -> DataFrame:
    """Rows with the same bins summed."""
    dims = [c for c in cube.df.columns if not c.startswith(MEASURE)]
    return cube.df.groupBy(*dims).agg(*[cube.sum_of(m) for m in cube.schema.measures])


def grow(stream: DataFrame, encode: Callable[[DataFrame], Cube], path: str, checkpoint: str, trigger: dict | None = None):
    """Start the query that appends a stream to the cube at ``path``."""

    def add(batch: DataFrame, number: int) -> None:
        finest(encode(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def snapshot(spark, path: str, like: Cube) -> Cube:
    """The cube as it stands, for a schema known from ``like``."""
    return Cube(spark.read.option("basePath", path).parquet(path).drop("batch"), like.schema)


def compact(spark, path: str, like: Cube, out: str) -> None:
    """All batches summed to one folder."""
    finest(snapshot(spark, path, like)).write.mode("overwrite").parquet(out)


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per key and tumbling window with a watermark, for streams of raw rows."""
    t = F.col(ts).cast("timestamp")
    return stream.withColumn(ts, t).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("count"))
