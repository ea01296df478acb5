"""Sharding by sources whose first bytes are equal, by large dense ids, to many leaves, and against a brute-force tree."""

import random

from pyspark.sql import functions as F

from terrella.llm import sharding
from terrella.llm.queries import queries
from terrella.llm.sharding import _stepped, kd_shards, kd_tree
from terrella.llm.store import save


def test_sources_with_a_common_prefix_are_separated(spark, tmp_path):
    for k, kind in enumerate(("https://site_{:02d}", "domain{}")):
        rows = [(i, f"text {i:05d}", "en", kind.format(i * 7 % (20 - 10 * k)), 10) for i in range(2000)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        shards = {r.doc_id: r.shard for r in queries()["op1_kd_shards"](spark, f"{tmp_path}/{k}").collect()}
        left, right = ({s for i, *_, s, _ in rows if (shards[i] < 12) == side} for side in (True, False))
        assert sorted(shards) == list(range(2000)) and len(left & right) <= 1 and left and right


def test_dense_large_ids(spark):
    rows = spark.range(2000).select((F.lit(2**62) + F.col("id")).alias("doc_id"), F.lit("text").alias("text"))
    got = kd_shards(rows, {"doc_id": F.col("doc_id")}, 4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [500] * 4


def brute_tree(rows, shards):
    """Shards of (id, size, dims, tie) rows by exact weighted medians."""
    out, whole = {}, [max(1, max(r[2][i] for r in rows) - min(r[2][i] for r in rows)) for i in range(len(rows[0][2]))]

    def split(part, first, count):
        if count == 1 or not part:
            out.update((r[3], first) for r in part)
            return
        wide = [(max(r[2][i] for r in part) - min(r[2][i] for r in part)) / w for i, w in enumerate(whole)]
        dim, left = wide.index(max(wide)), count // 2
        part = sorted(part, key=lambda r: (r[2][dim], r[0], r[3]))
        want, below, at = sum(r[1] for r in part) * left / count, 0, 0
        while at < len(part) - 1 and below + part[at][1] < want:
            below, at = below + part[at][1], at + 1
        at += want - below > below + part[at][1] - want
        split(part[:at], first, left)
        split(part[at:], first + left, count - left)

    split(rows, 0, shards)
    return out


def test_tree_against_brute_force(spark):
    rng = random.Random(6)
    for shards, ties in ((7, 3), (5, 10**6)):
        rows = [(rng.randrange(ties), rng.randint(1, 50), (rng.randrange(4), rng.randint(-1000, 1000)), t) for t in range(60)]
        df = save(spark.createDataFrame([(i, s, *d, t) for i, s, d, t in rows], "id long, size long, d0 long, d1 long, tie long"), "rows")
        placed = df.withColumn("node", F.lit(0).cast("long"))
        for splits in kd_tree(df, 2, shards, tolerance=0.0):
            placed = _stepped(placed, splits, shards, 2)
        assert {r.tie: r.node for r in placed.collect()} == brute_tree(rows, shards)


def test_a_thousand_leaves_by_target_size(spark, monkeypatch):
    """Sizes stay near the target, and the tables written are a few for each of ten levels, however many leaves there are."""
    rows = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.expr("repeat('x', int(id * 31 % 190))").alias("text"))
    total, tables = rows.agg(F.sum(F.length("text") + 8)).first()[0], []
    monkeypatch.setattr(sharding, "save", lambda df, name: tables.append(name) or save(df, name))
    sizes = [r[1] for r in kd_shards(rows, {"source": F.col("source"), "doc_id": F.col("doc_id")}, target_bytes=total // 1000).groupBy("shard").agg(F.sum("size")).collect()]
    assert abs(len(sizes) - 1000) <= 1 and max(sizes) - min(sizes) < 1000 and len(tables) <= 60


def test_kept_columns_with_the_names_of_results(spark):
    rows = spark.createDataFrame([(1, "ab", 5, 7)], "doc_id long, text string, size long, slot long")
    got = kd_shards(rows, {"doc_id": F.col("doc_id")}, 2, keep=("doc_id", "size", "slot"))
    assert got.columns == ["doc_id", "size", "slot", "size_", "text_crc32", "shard", "slot_"] and got.first()["size_"] == 10
