"""Spatial selections and stream-static joins for Structured Streaming. All are stateless, so any output mode and checkpoint works."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.operators.select import circle_filter, range_filter
from terrella.plans.grid import SLACK, neighbours, prefixed, valid


def stream_range(stream: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    return range_filter(stream, low, high)


def stream_circle(stream: DataFrame, centre: Sequence[float], r: float) -> DataFrame:
    return circle_filter(stream, centre, r)


def stream_distance_join(stream: DataFrame, static: DataFrame, r: float) -> DataFrame:
    """Pairs of stream and static points within ``r`` (over 0). The static side is dealt to cells, so the stream meets it by an equi-join."""
    if r <= 0:
        raise ValueError("r must be positive")
    width = r * (1 + SLACK)
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    l = valid(prefixed(stream, "l_"), "l_x", "l_y").withColumns({"cx__": cell("l_x"), "cy__": cell("l_y")})
    q = valid(prefixed(static, "r_"), "r_x", "r_y").withColumn("c__", F.explode(neighbours(cell("r_x"), cell("r_y")))).withColumns({"cx__": F.col("c__.cx"), "cy__": F.col("c__.cy")}).drop("c__")
    apart = (F.col("l_x") - F.col("r_x")) * (F.col("l_x") - F.col("r_x")) + (F.col("l_y") - F.col("r_y")) * (F.col("l_y") - F.col("r_y"))
    return l.join(q, ["cx__", "cy__"]).where(apart <= r * r).withColumn("distance", F.sqrt(apart)).drop("cx__", "cy__")


def windowed_cells(stream: DataFrame, width: float, every: str = "10 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Points per grid cell and time window, with a watermark."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    return stream.withWatermark(time, late).groupBy(F.window(time, every), cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("n"))
