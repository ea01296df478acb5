"""Written tables: where a plan's lineage ends, in the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark removes a query's shuffle files at the end of the query.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}
_swept: set[str] = set()
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of its own; a cluster gets an error."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (conf.get("spark.master", "") or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_dirs:
        folder = tempfile.mkdtemp(prefix="terrella-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dirs[application] = f"file://{folder}"
    return _own_dirs[application]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, in a folder of this application that goes when its JVM ends."""
    own = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/terrella/{own}"
    if own not in _swept:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        _swept.add(own)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, freed: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and survives a lost executor. With ``freed`` the shuffle files of the write go with its end, not when the driver collects its garbage."""
    path, conf = new_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_FREED, "false")
    conf.set(_FREED, "true" if freed else before)
    try:
        df.write.parquet(path)
    finally:
        conf.set(_FREED, before)
    for scope in _scopes:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths of the tables written inside, in order."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete written tables that no plan reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
