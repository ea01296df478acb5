"""Shared-folder tables, row keys and numbering used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrella.plans.written import written

#: Largest table, in bytes, that is handed to every executor.
BROADCAST_BYTES = 16 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="terrella-")  # executors that come later fetch it too
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := f"{folder}/terrella_workers.zip", "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


#: Write a table to the shared folder and read it back.
save = written


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given column names, lengthened where the table already has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where lambdas inside ``body`` use it again and again."""
    return F.transform(F.array(value), body)[0]


def with_rows(df: DataFrame, file_col: str = "_file", row_col: str = "_row") -> DataFrame:
    """Add two columns that name a row for good: file and row number for a file scan, else ids of a written copy."""
    try:
        return df.select("*", F.xxhash64("_metadata.file_path").alias(file_col), F.col("_metadata.row_index").alias(row_col))
    except AnalysisException:
        return save(df.select("*", F.lit(0).cast("long").alias(file_col), F.monotonically_increasing_id().alias(row_col)), "rows")


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table marked for broadcast if its counted rows stay within the limit, else the table as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str, rows: int, bucket_rows: int = 50_000, least: int = 64) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in hash-bucket order.

    A group is cut into buckets by a hash of the order columns, so a group that holds a third of all
    rows is sorted by many tasks; only the counts of the buckets meet. ``df`` must be a written table, ``rows`` its count.
    """
    n = max(least, -(-rows // bucket_rows))
    bucket, start, own = fresh(df, "_bucket", "_start", "_own")
    df = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(n)))
    sizes = df.groupBy(*groups, bucket).agg(F.count("*").alias(own))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(g).alias(f"{g}__") for g in groups], F.col(bucket).alias(f"{bucket}__"), F.coalesce(F.sum(own).over(before), F.lit(0)).alias(start))
    inside = F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*order)) - 1
    on = [F.col(g).eqNullSafe(F.col(f"{g}__")) for g in [*groups, bucket]]
    return df.withColumn(own, inside).join(starts, on).withColumn(name, (F.col(start) + F.col(own)).cast("long")).drop(bucket, start, own, *[f"{g}__" for g in groups], f"{bucket}__")
