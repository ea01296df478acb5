"""Keyed spatial tables and named indexes: build, look up, change, persist, load, drop."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.functions.curves import cell, morton
from terrella.operators import select


@dataclass(frozen=True)
class Options:
    """Settings of indexes and joins."""

    cell: float = 500.0
    partitions: int | None = None
    storage: StorageLevel = field(default_factory=lambda: StorageLevel.MEMORY_AND_DISK)
    error_range: float = 150.0
    match_count: int = 3
    shifts: int = 2


def upsert(df: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("x", "y"), merge: Callable[[str, Column, Column], Column] | None = None, fresh: Callable[[str, Column], Column] | None = None) -> DataFrame:
    """Rows of ``changes`` replace those with equal keys, the others are added. ``merge`` makes a column's value from old and new, ``fresh`` from a new one."""
    rest = [c for c in df.columns if c not in keys]
    a, b = df.withColumn("old__", F.lit(True)), changes.select(*keys, *[F.col(c).alias(f"{c}__") for c in rest], F.lit(True).alias("new__"))
    both = a.join(b, list(keys), "full_outer")

    def value(c: str) -> Column:
        old, new = F.col(c), F.col(f"{c}__")
        added = fresh(c, new) if fresh else new
        changed = merge(c, old, new) if merge else new
        return F.when(F.col("new__").isNull(), old).when(F.col("old__").isNull(), added).otherwise(changed).alias(c)

    return both.select(*[F.col(k) for k in keys], *[value(c) for c in rest]).select(*df.columns)


def delete(df: DataFrame, keys: DataFrame, on: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Rows whose keys are not in the other table."""
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def clustered(df: DataFrame, width: float, partitions: int | None = None) -> DataFrame:
    """Rows with ``cell`` (Z order of 16-bit grid cells), range-partitioned and sorted by it."""
    at = lambda c: cell(c, width).bitwiseAND(F.lit(0xFFFF).cast("long"))
    keyed = df.withColumn("cell", morton(at("x"), at("y"), 16))
    spread = keyed.repartitionByRange(partitions, "cell") if partitions else keyed.repartitionByRange("cell")
    return spread.sortWithinPartitions("cell", "x", "y")


class SpatialFrame:
    """A point table (x, y and payload) that is clustered by grid cell."""

    def __init__(self, df: DataFrame, options: Options = Options()) -> None:  # noqa: B008
        self.options, self.df = options, clustered(df.drop("cell"), options.cell, options.partitions)

    def range(self, low, high, where=None) -> DataFrame:  # noqa: ANN001
        return select.range_filter(self.df, low, high, where=where)

    def knn(self, point, k: int, where=None) -> DataFrame:  # noqa: ANN001
        return select.knn_filter(self.df, point, k, where=where)

    def get(self, x: float, y: float) -> DataFrame:
        return select.lookup(self.df, [(x, y)])

    def multiget(self, keys: DataFrame) -> DataFrame:
        return select.multiget(self.df, keys)

    def put(self, changes: DataFrame, **how) -> SpatialFrame:  # noqa: ANN003
        return SpatialFrame(upsert(self.df.drop("cell"), changes, **how), self.options)

    def delete(self, keys: DataFrame) -> SpatialFrame:
        return SpatialFrame(delete(self.df, keys), self.options)


@dataclass
class Index:
    name: str
    kind: str
    columns: tuple[str, ...]
    df: DataFrame = field(repr=False)
    table: str | None = None


class IndexRegistry:
    """Named indexes of a session: a clustered and cached copy of a table.

    Kinds are ``rtree`` and ``quadtree`` (two numeric columns) and ``treemap``, ``hashmap`` and ``treap`` (one). All give the same
    answers; they differ in how rows are clustered. A name is used once.
    """

    KINDS = ("rtree", "quadtree", "treemap", "hashmap", "treap")

    def __init__(self, spark: SparkSession, options: Options = Options()) -> None:  # noqa: B008
        self.spark, self.options, self.indexes = spark, options, {}

    def create(self, df: DataFrame, kind: str, name: str, columns: tuple[str, ...], table: str | None = None) -> Index:
        if kind not in self.KINDS:
            raise ValueError(f"kind must be one of {self.KINDS}")
        if name in self.indexes:
            raise ValueError(f"index {name} has already been built")
        if (kind in ("rtree", "quadtree")) != (len(columns) >= 2):
            raise ValueError(f"{kind} takes {'two or more columns' if kind in ('rtree', 'quadtree') else 'one column'}")
        if len(columns) >= 2:
            at = lambda c: cell(c, self.options.cell).bitwiseAND(F.lit(0xFFFF).cast("long"))
            laid = df.withColumn("cell", morton(at(columns[0]), at(columns[1]), 16)).repartitionByRange("cell").sortWithinPartitions("cell")
        else:
            laid = df.repartition(columns[0]) if kind == "hashmap" else df.repartitionByRange(columns[0]).sortWithinPartitions(columns[0])
        index = Index(name, kind, tuple(columns), laid.persist(self.options.storage), table)
        self.indexes[name] = index
        if table:
            index.df.createOrReplaceTempView(table)
        return index

    def has(self, name: str) -> bool:
        return name in self.indexes

    def show(self) -> DataFrame:
        rows = [(i.name, i.kind, list(i.columns), i.table) for i in self.indexes.values()]
        return self.spark.createDataFrame(rows, "name string, kind string, columns array<string>, view string")

    def get(self, name: str) -> Index:
        return self.indexes[name]

    def drop(self, name: str) -> None:
        index = self.indexes.pop(name)
        index.df.unpersist()
        if index.table:
            self.spark.catalog.dropTempView(index.table)

    def drop_table(self, table: str) -> None:
        for name in [i.name for i in self.indexes.values() if i.table == table]:
            self.drop(name)

    def drop_column(self, column: str) -> None:
        for name in [i.name for i in self.indexes.values() if column in i.columns]:
            self.drop(name)

    def clear(self) -> None:
        for name in list(self.indexes):
            self.drop(name)

    def persist(self, name: str, path: str) -> None:
        """Write an index as Parquet, in its clustered order so that row groups can be skipped, with its description."""
        index = self.indexes[name]
        index.df.write.mode("overwrite").parquet(f"{path}/rows")
        about = json.dumps({"name": name, "kind": index.kind, "columns": index.columns, "table": index.table})
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    def load(self, path: str, name: str | None = None) -> Index:
        about = json.loads(self.spark.read.text(f"{path}/about").first()[0])
        name = name or about["name"]
        if name in self.indexes:
            raise ValueError(f"index {name} has already been built")
        index = Index(name, about["kind"], tuple(about["columns"]), self.spark.read.parquet(f"{path}/rows").persist(self.options.storage), about["table"])
        self.indexes[name] = index
        if index.table:
            index.df.createOrReplaceTempView(index.table)
        return index
