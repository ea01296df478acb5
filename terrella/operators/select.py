"""Spatial selections: boxes, circles, nearest neighbours and their combinations, as plain filters that reach the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrella.functions.geometry import Box, finite, squared_distance, squared_distance_nd

Predicate = Column | Callable[[DataFrame], Column]


def _predicate(df: DataFrame, where: Predicate | None) -> DataFrame:
    return df if where is None else df.where(where(df) if callable(where) and not isinstance(where, Column) else where)


def _squared(keys: Sequence[str], point: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for key, c in zip(keys, point, strict=True):
        total = total + (F.col(key) - float(c)) * (F.col(key) - float(c))
    return total


def _within(low: Sequence[float], high: Sequence[float], keys: Sequence[str]) -> Column:
    if len(low) != len(high) or len(low) != len(keys):
        raise ValueError("low, high and keys differ in length")
    if any(a > b for a, b in zip(low, high, strict=True)):
        raise ValueError("low must not exceed high")
    found = F.lit(True)
    for key, a, b in zip(keys, low, high, strict=True):
        found &= F.col(key).between(float(a), float(b))
    return found


def range_filter(df: DataFrame, low: Sequence[float], high: Sequence[float], keys: Sequence[str] = ("x", "y"), where: Predicate | None = None) -> DataFrame:
    """Rows whose keys lie between low and high in every dimension, and that pass ``where``."""
    return _predicate(df.where(_within(low, high, keys)), where)


def circle_filter(df: DataFrame, centre: Sequence[float], r: float, keys: Sequence[str] = ("x", "y"), where: Predicate | None = None) -> DataFrame:
    """Rows within ``r`` of the centre; the bounding box goes to the scan as well."""
    total = _squared(keys, centre)
    boxed = range_filter(df, [c - abs(r) for c in centre], [c + abs(r) for c in centre], keys)
    return _predicate(boxed.where(total <= r * r), where)


def circles_filter(df: DataFrame, circles: Sequence[tuple[float, float, float]]) -> DataFrame:
    """Rows inside all circles (x, y, r)."""
    for x, y, r in circles:
        df = circle_filter(df, (x, y), r)
    return df


def selective_range(df: DataFrame, low: Sequence[float], high: Sequence[float], most: float, keys: Sequence[str] = ("x", "y")) -> DataFrame:
    """``range_filter`` where at most the share ``most`` of all rows lies in the box, else no rows: a caller then scans instead."""
    inside = _within(low, high, keys)
    share = df.agg(F.avg(F.coalesce(inside, F.lit(False)).cast("double"))).scalar()
    return df.where(inside & (share <= most))


def knn_filter(df: DataFrame, point: Sequence[float], k: int, keys: Sequence[str] = ("x", "y"), id_col: str = "id", where: Predicate | None = None, keep_ties: bool = False, metric: Column | None = None) -> DataFrame:
    """The k rows nearest to the point, by distance and id, with ``distance``; ``where`` comes before ranking. ``keep_ties`` adds all rows as near as the k-th.

    ``metric`` is any distance in place of the Euclidean one; ``point`` is then not looked at.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    ranked = _predicate(df.where(finite(*keys)), where).withColumn("d__", _squared(keys, point) if metric is None else metric)
    best = ranked.orderBy("d__", id_col).limit(k)
    if keep_ties:
        best = ranked.where(F.col("d__") <= best.agg(F.max("d__")).scalar())
    return best.withColumn("distance", F.sqrt("d__") if metric is None else F.col("d__")).drop("d__")


def knn_filter_nd(df: DataFrame, point: Sequence[float], k: int, key: str, id_col: str) -> DataFrame:
    """``knn_filter`` for an array column of any dimension."""
    if k <= 0:
        raise ValueError("k must be positive")
    query = F.array(*[F.lit(float(v)) for v in point])
    near = df.where(F.col(key).isNotNull()).withColumn("d__", squared_distance_nd(F.col(key).cast("array<double>"), query))
    return near.orderBy("d__", id_col).limit(k).withColumn("distance", F.sqrt("d__")).drop("d__")


class Where:
    """A predicate over a base table that may hold nearest-neighbour conditions; each of those sees the whole base table.

    ``&``, ``|`` and ``~`` join conditions on the row itself, so rows stay a bag, and null and repeated ids are rows like any other. A nearest-neighbour condition is a
    comparison with the k-th row's distance and id, which a scalar subquery finds; rows that equal the k-th in both are all taken.
    """

    def __init__(self, condition: Callable[[DataFrame, str], Column]) -> None:
        self.condition = condition

    @classmethod
    def column(cls, condition: Column) -> Where:
        return cls(lambda df, key: condition)

    @classmethod
    def knn(cls, point: Sequence[float], k: int, keys: Sequence[str] = ("x", "y")) -> Where:
        if k <= 0:
            raise ValueError("k must be positive")

        def nearest_k(df: DataFrame, key: str) -> Column:
            place = F.struct(_squared(keys, point).alias("d"), F.col(key).alias("id"))
            kth = df.where(finite(*keys)).select(place.alias("p")).orderBy("p").limit(k).agg(F.max("p")).scalar()
            return finite(*keys) & (place <= kth)

        return cls(nearest_k)

    @classmethod
    def range(cls, low: Sequence[float], high: Sequence[float], keys: Sequence[str] = ("x", "y")) -> Where:
        return cls(lambda df, key: _within(low, high, keys))

    @classmethod
    def circle(cls, centre: Sequence[float], r: float, keys: Sequence[str] = ("x", "y")) -> Where:
        return cls(lambda df, key: _within([c - abs(r) for c in centre], [c + abs(r) for c in centre], keys) & (_squared(keys, centre) <= r * r))

    def __and__(self, other: Where) -> Where:
        return Where(lambda df, key: self.condition(df, key) & other.condition(df, key))

    def __or__(self, other: Where) -> Where:
        return Where(lambda df, key: F.coalesce(self.condition(df, key), F.lit(False)) | F.coalesce(other.condition(df, key), F.lit(False)))

    def __invert__(self) -> Where:
        return Where(lambda df, key: ~F.coalesce(self.condition(df, key), F.lit(False)))

    def apply(self, df: DataFrame, id_col: str = "id") -> DataFrame:
        return df.where(self.condition(df, id_col))


def text_range_filter(df: DataFrame, low: Sequence[float], high: Sequence[float], text: str, words: Sequence[str], exact: Sequence[str] = ()) -> DataFrame:
    """Rows in the box whose text holds one of the words in any case, or one of ``exact`` as written."""
    found = F.lit(False)
    for w in words:
        found |= F.contains(F.lower(F.col(text)), F.lit(w.lower()))
    for w in exact:
        found |= F.contains(F.col(text), F.lit(w))
    return range_filter(df, low, high).where(found)


def lookup(df: DataFrame, points: Sequence[tuple[float, float]]) -> DataFrame:
    """All rows at the exact locations."""
    found = F.lit(False)
    for x, y in points:
        found |= (F.col("x") == float(x)) & (F.col("y") == float(y))
    return df.where(found)


def multiget(df: DataFrame, keys: DataFrame) -> DataFrame:
    """All rows at the locations of another table."""
    return df.join(keys.select("x", "y").distinct(), ["x", "y"], "left_semi")


def nearest(df: DataFrame, point: Sequence[float]) -> DataFrame:
    return knn_filter(df, point, 1)


def count_in(df: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    return range_filter(df, low, high).agg(F.count("*").alias("n"))


def fold_in(df: DataFrame, low: Sequence[float], high: Sequence[float], *aggregates: Column) -> DataFrame:
    """Any aggregates over the rows in the box, folded in each task first."""
    return range_filter(df, low, high).agg(*aggregates)


def shapes_in(df: DataFrame, box: Box, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Rows whose own boxes meet the box."""
    return df.where(box.intersects(Box.of(float(low[0]), float(low[1]), float(high[0]), float(high[1]))))


def rank_of(df: DataFrame, column: str, value: float) -> DataFrame:
    """How many rows have a key of at most the value."""
    return df.where(F.col(column) <= value).agg(F.count("*").alias("rank"))


def bounds(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Bounds and count of the rows with coordinates."""
    return df.where(finite(x, y)).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"), F.count("*").alias("n"))


def occupied_cells(df: DataFrame, width: float) -> DataFrame:
    """Cells that hold data: a filter without false positives at cell level."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    return df.where(finite("x", "y")).select(cell("x").alias("cx"), cell("y").alias("cy")).distinct()


def boxes_with_data(boxes: DataFrame, df: DataFrame, box_id: str = "id") -> DataFrame:
    """Boxes that hold at least one point."""
    from terrella.operators.joins import range_join

    held = range_join(df.select("x", "y"), boxes).select(F.col(f"r_{box_id}").alias(box_id)).distinct()
    return boxes.join(held, box_id, "left_semi")


def occupied_share(boxes: DataFrame, df: DataFrame, width: float) -> DataFrame:
    """``boxes`` with ``p``: the share of a box's cells that hold data; 0 proves that a box is empty."""
    from terrella.plans.grid import covering

    spread = boxes.select("id", F.explode(covering(Box.of(), F.lit(width))).alias("c")).select("id", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"))
    hit = spread.join(occupied_cells(df, width).withColumn("one", F.lit(1)), ["cx", "cy"], "left")
    return boxes.join(hit.groupBy("id").agg((F.count("one") / F.count("*")).alias("p")), "id")


def top_by_key(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key in an order."""
    return df.withColumn("rn__", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn__") <= k).drop("rn__")


def distance_to(x: float, y: float) -> Column:
    return F.sqrt(squared_distance("x", "y", x, y))
