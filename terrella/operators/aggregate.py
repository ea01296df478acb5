"""Aggregations over points: histograms, capacity, heat maps, counts, packing, k-means and log matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrella.functions.curves import hilbert


def cell_histogram(df: DataFrame, width: float) -> DataFrame:
    """Points per grid cell, in order of the cells."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    return df.groupBy(cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("n")).orderBy("cx", "cy")


def capacity(df: DataFrame, width: float, payload: Column | None = None) -> DataFrame:
    """One row: bounds, points, cells, largest cell and longest payload."""
    cells = df.groupBy(F.floor(F.col("x") / width).alias("cx"), F.floor(F.col("y") / width).alias("cy")).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max(F.length(payload) if payload is not None else F.lit(0)).alias("b"))
    return cells.agg(F.min("x0").alias("xmin"), F.min("y0").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax"), F.sum("n").alias("points"), F.count("*").alias("cells"), F.max("n").alias("largest"), F.max("b").cast("long").alias("longest"))


def heatmap(df: DataFrame) -> DataFrame:
    """Points per whole-number location, halves rounded up."""
    near = lambda c: F.floor(F.col(c) + 0.5).cast("long").alias(c)
    return df.groupBy(near("x"), near("y")).agg(F.count("*").alias("n"))


def line_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are not empty, and distinct ones."""
    own = lines.where(F.col(column) != "").groupBy(column).agg(F.count("*").alias("n"))
    return own.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("lines"), F.count("*").alias("distinct_lines"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """Min, max, sum, count and mean of a column."""
    v = F.col(column)
    return df.agg(F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"), F.count(v).alias("n"), F.avg(v).alias("mean"))


def bad_records(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.agg(F.count_if(F.col(column).isNull()).alias("bad"))


def co_occurring(items: DataFrame, item: str, cell: str) -> DataFrame:
    """Per cell: how many items touch it, and the other cells that those items touch.

    An item's cells, as many as the grid has at most, are paired row by row and counted in each task first; no join.
    """
    own = items.groupBy(item).agg(F.collect_set(F.col(cell)).alias("cells"))
    pairs = own.select(F.explode("cells").alias("cell"), "cells").select("cell", F.explode("cells").alias("other")).groupBy("cell", "other").agg(F.count("*").alias("n"))
    same = F.col("other") == F.col("cell")
    return pairs.groupBy("cell").agg(F.max(F.when(same, F.col("n"))).alias("n"), F.array_sort(F.collect_list(F.when(~same, F.col("other")))).alias("others"))


def hilbert_loads(df: DataFrame, xmin: float, ymin: float, width: float, n: int = 256) -> DataFrame:
    """Points per Hilbert cell."""
    at = lambda c, o: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - o) / width))).cast("long")
    return df.groupBy(hilbert(at("x", xmin), at("y", ymin), n).alias("h")).agg(F.count("*").alias("n"))


def packed(loads: DataFrame, key: str, load: float, weight: str = "n", ranges: int = 64) -> DataFrame:
    """Sorted keys packed into consecutive partitions of about ``load``: running weight over the load.

    Running sums are taken within key ranges, and only the ranges' totals meet in one window.
    """
    cuts = loads.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: F.col(key) > c)) if cuts else F.lit(0)
    own = loads.withColumn("part__", part)
    totals = own.groupBy("part__").agg(F.sum(weight).alias("w__"))
    before = totals.select(F.col("part__").alias("p__"), F.coalesce(F.sum("w__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    inside = F.sum(weight).over(Window.partitionBy("part__").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    run = own.withColumn("in__", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), F.col("part__") == F.col("p__"))
    return run.withColumn("partition", F.floor((F.col("before__") + F.col("in__")) / load).cast("long")).drop("part__", "p__", "w__", "before__", "in__")


def kmeans_step(df: DataFrame, centroids: Sequence[tuple[float, float]]) -> DataFrame:
    """One step: each row's nearest centroid (the first on ties), then count, mean and dispersion of each cluster."""
    member = assigned(df, centroids)
    return member.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum("d2").alias("dispersion"))


def assigned(df: DataFrame, centroids: Sequence[tuple[float, float]]) -> DataFrame:
    """Rows with ``cluster`` and ``d2``: the nearest of the centroids, which are few and part of the expression."""
    options = [F.struct(((F.col("x") - float(a)) * (F.col("x") - float(a)) + (F.col("y") - float(b)) * (F.col("y") - float(b))).alias("d2"), F.lit(i).alias("cluster")) for i, (a, b) in enumerate(centroids)]
    return df.withColumn("c__", F.array_min(F.array(*options))).withColumns({"cluster": F.col("c__.cluster"), "d2": F.col("c__.d2")}).drop("c__")


def kmeans(df: DataFrame, k: int, seed: int = 1, rounds: int = 100, tolerance: float = 1e-4, restarts: int = 1) -> tuple[float, list[tuple[float, float]]]:
    """Lloyd's algorithm: dispersion and centroids of the best start. The driver holds k centroids."""
    best: tuple[float, list[tuple[float, float]]] | None = None
    for start in range(restarts):
        picked = df.where("x is not null and y is not null").select("x", "y").distinct().orderBy(F.xxhash64("x", "y", F.lit(seed + start)), "x", "y").limit(k).collect()
        centroids, last = [(r["x"], r["y"]) for r in picked], None
        for _ in range(rounds if centroids else 0):
            rows = kmeans_step(df, centroids).collect()
            total = sum(r["dispersion"] for r in rows)
            new = {r["cluster"]: (r["x"], r["y"]) for r in rows}
            centroids = [new.get(i, c) for i, c in enumerate(centroids)]
            if last is not None and abs(last - total) < tolerance:
                break
            last = total
        if best is None or (last or 0.0) < best[0]:
            best = (last or 0.0, centroids)
    return best or (0.0, [])


def load_matrix(log: DataFrame, part: str, step: str, steps: Sequence[int]) -> DataFrame:
    """Counts of each partition in each round, one column a round."""
    return log.groupBy(part).pivot(step, list(steps)).count().na.fill(0)


def key_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def by_location(df: DataFrame, value: str = "id") -> DataFrame:
    """Rows gathered by exact location: count and least id."""
    return df.groupBy("x", "y").agg(F.count("*").alias("n"), F.min(value).alias("first_id"))
