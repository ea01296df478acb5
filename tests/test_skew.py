"""Plans on skewed data, measured by candidate pairs, and rows with null or repeated ids."""

import random

import pytest
from pyspark.sql import functions as F

from terrella.functions.geometry import Box
from terrella.operators import joins, select
from terrella.operators.select import Where
from terrella.plans.grid import box_point_pairs, knn_candidates, prefixed

from tests.test_spatial import brute_knn, points

K = 5


def clouds():
    rng = random.Random(11)
    normal = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(3000)]
    return {
        "normal": normal,
        "one outlier": [*normal, (1e6, 1e6)],
        "far outlier": [*normal, (-1e12, 3e11)],
        "two scales": [*normal, *((5e4 + rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for _ in range(3000))],
        "on a line": [(i * i / 7, 3.0) for i in range(2000)],
        "uniform": [(rng.random(), rng.random()) for _ in range(3000)],
        "one location": [*normal[:1500], *[(0.25, 0.25)] * 1500],
    }


@pytest.mark.parametrize("name", list(clouds()))
def test_candidates_stay_few(spark, name):
    rows = clouds()[name]
    df = points(spark, rows)
    pairs = knn_candidates(prefixed(df, "l_"), prefixed(df, "r_"), K)
    assert pairs.count() <= 20 * K * len(rows)


def test_knn_join_on_skew(spark):
    rng = random.Random(12)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(250)] + [(1e6, 1e6), (-1e9, 5.0)] + [(0.5, 0.5)] * 120 + [(7e3 + rng.gauss(0, 1e-4), 2.0) for _ in range(60)]
    far = [(rng.uniform(-2e6, 2e6), rng.uniform(-2e6, 2e6)) for _ in range(20)]
    for left, right, k in ((rows, rows, 4), (far, rows, 7), (rows, far, 3)):
        got = {(r.l_id, r.r_id, r["rank"]) for r in joins.knn_join(points(spark, left), points(spark, right), k).collect()}
        assert got == brute_knn(left, right, k)


def boxes(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, xmin double, ymin double, xmax double, ymax double")


def test_a_giant_box_leaves_the_others_alone(spark):
    """Candidate pairs: those of the small boxes and those of the giant ones, not all of them."""
    rng = random.Random(13)
    small = [(x, y, x + 1, y + 1) for x, y in ((rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(2000))]
    pts = points(spark, [(rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(2000)])
    box = Box.of("r_xmin", "r_ymin", "r_xmax", "r_ymax")

    def candidates(rows):
        plan = box_point_pairs(prefixed(boxes(spark, rows), "r_"), box, prefixed(pts, "l_"), "l_x", "l_y")
        return plan, plan.count()

    plan, n = candidates([*small, (-1e6, -1e6, 1e6, 1e6), (5, 5, 5, 5)])
    assert n == candidates(small)[1] + 2000
    joined = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in joined and "NestedLoop" not in joined
    from terrella.plans import grid

    levels = grid.levels_in(boxes(spark, [*small, (-1e6, -1e6, 1e6, 1e6)]).withColumn("lv", grid.level_of(Box.of(), -20)), "lv")
    assert levels[-1] >= 21 and levels[0] <= 1  # a unit box stays in cells of its own size


def test_semi_and_anti_join_of_null_and_repeated_ids(spark):
    pts = spark.createDataFrame([(None, 0.5, 0.5), (None, 5.0, 5.0), (1, 0.5, 0.5), (1, 5.0, 5.0), (2, None, 0.5)], "id long, x double, y double")
    one = boxes(spark, [(0, 0, 1, 1), (0, 0, 2, 2)])
    rows = lambda df: sorted((str(r.id), str(r.x)) for r in df.collect())
    assert rows(joins.semi_join(pts, one)) == [("1", "0.5"), ("None", "0.5")]
    assert rows(joins.semi_join(pts, one, anti=True)) == [("1", "5.0"), ("2", "None"), ("None", "5.0")]


def test_where_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, 1.0, 0.0), (1, 2.0, 0.0), (1, 9.0, 0.0), (2, 3.0, 0.0), (3, None, 0.0)], "id long, x double, y double")
    near = Where.knn((0, 0), 2)
    rows = lambda w: sorted(str(r.x) for r in w.apply(df).collect())
    assert rows(near) == ["1.0", "2.0"] and rows(~near) == ["3.0", "9.0", "None"]
    assert rows(near & Where.range((1.5, -1), (9, 1))) == ["2.0"] and rows(near | Where.circle((9, 0), 1)) == ["1.0", "2.0", "9.0"] and rows(~Where.column(F.col("id") == 1)) == ["1.0", "3.0", "None"]
    assert select.knn_filter(df, (0, 0), 2, keep_ties=True).count() == 2


def test_hot_cell_is_split(spark):
    """A distance join in which one cell holds a third of the rows: adaptive execution splits that partition."""
    own = {"adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.skewJoin.skewedPartitionFactor": "1.1", "autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "64"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for key, value in own.items():
        spark.conf.set(f"spark.sql.{key}", value)
    try:
        left = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1) * 1e6).alias("x"), (F.rand(2) * 0.1).alias("y"))
        right = spark.range(3_000).select("id", (F.col("id") * 300.0).alias("x"), F.lit(0.05).alias("y"))
        plan = joins.distance_join(left, right, 1.0).agg(F.count("*").alias("n"))
        assert plan.first()["n"] >= 20_000
        plan.collect()
        assert "skew" in plan._jdf.queryExecution().executedPlan().toString().lower()
    finally:
        for key in own:
            spark.conf.unset(f"spark.sql.{key}")
        spark.conf.set("spark.sql.shuffle.partitions", before)
