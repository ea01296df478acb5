"""Token counts as delta-maintained rollups.

A batch of signed changes is summed by source, language and tokenizer version and committed once under
its id: a second commit of an id changes nothing. Totals are the sums over committed batches; compaction
writes them down together with the ids that they hold.

A commit is the rename of a folder, which is one step on HDFS and local disks. A store that renames file by file needs a
committer of its own: there a broken commit may leave some of a batch's files. The driver lists the ids of all batches; their rows stay in
the cluster.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")
_SCHEMA = "source string, lang string, version string, docs long, tokens long"


def inserted(counts: DataFrame) -> DataFrame:
    """Changes that add every row of ``source``, ``lang``, ``version``, ``tokens``; null counts are 0."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Changes that take every row away."""
    return inserted(counts).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace counts by others, also under other keys: the old ones go, the new ones come."""
    return deleted(old).unionByName(inserted(new))


class Rollup:
    """Totals kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        files, at = self._files(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return [n for n in self._names("batches") if not n.startswith((".", "_"))]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; False if its id was committed before. The sums are written aside and renamed, so a broken attempt leaves no trace in the totals."""
        if not batch or batch.startswith((".", "_")) or "/" in batch:
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.batches():
            return False
        aside, path = f"{self.root}/aside/{uuid.uuid4().hex}", f"{self.root}/batches/{batch}"
        changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(aside)
        files, at = self._files(path)
        files.mkdirs(at.getParent())
        source = self._files(aside)[1]
        if not files.exists(at) and files.rename(source, at):
            nested = self._files(f"{path}/{source.getName()}")[1]
            if not files.exists(nested):
                return True
            files.delete(nested, True)  # another writer came first, and the rename went inside its folder
        else:
            files.delete(source, True)
        return False

    def _snapshot(self) -> tuple[str | None, set[str]]:
        for name in reversed(self._names("snapshots")):
            if "_SUCCESS" in self._names(f"snapshots/{name}/ids"):
                held = self.spark.read.schema("id string").parquet(f"{self.root}/snapshots/{name}/ids")
                return name, {r["id"] for r in held.collect()}
        return None, set()

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``version``, ``docs``, ``tokens`` over all committed batches; keys whose sums are zero are left out."""
        name, held = self._snapshot()
        paths = [f"{self.root}/batches/{b}" for b in self.batches() if b not in held] + ([f"{self.root}/snapshots/{name}/totals"] if name else [])
        parts = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return parts.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")

    def compact(self) -> None:
        """Write the totals down with the ids of the batches that they hold; the ids come last and make it valid."""
        ids = sorted(set(self.batches()) | self._snapshot()[1])
        if not ids:
            return
        path = f"{self.root}/snapshots/{len(self._names('snapshots')):08d}-{uuid.uuid4().hex}"
        name, held = self._snapshot()
        parts = [f"{self.root}/batches/{b}" for b in ids if b not in held] + ([f"{self.root}/snapshots/{name}/totals"] if name else [])
        self.spark.read.schema(_SCHEMA).parquet(*parts).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{path}/totals")
        self.spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.parquet(f"{path}/ids")


def token_rollup(rollup: Rollup, counts: DataFrame, gone: DataFrame, versions: Sequence[str]) -> DataFrame:
    """Load, revise and take down, each a batch, and give the totals.

    ``counts`` is a written table with ``id``, ``source``, ``lang``, ``estimate`` and a count column for each version; ``gone`` holds ``id``. The estimates are inserted first and revised to
    the exact counts; then the rows of ``gone`` are deleted. Null ids are never deleted; null sources and languages are keys of their own; repeated rows count each; an empty table leaves empty totals.
    """
    exact = counts.select("id", "source", "lang", F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(v).alias("tokens")) for v in versions])).alias("c")).select("id", "source", "lang", "c.*")
    guess = counts.select("source", "lang", F.explode(F.array(*[F.lit(v) for v in versions])).alias("version"), F.col("estimate").alias("tokens"))
    rollup.commit("load", inserted(guess))
    rollup.commit("revise", revised(guess, exact))
    rollup.commit("revise", revised(guess, exact))
    rollup.compact()
    rollup.commit("takedown", deleted(exact.join(gone.select("id").distinct(), "id", "left_semi")))
    return rollup.totals()
