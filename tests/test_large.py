"""Plans and results that larger tables call for."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from terrella.functions import util
from terrella.operators import aggregate, etl, joins
from terrella.plans import lines as plan_lines
from terrella.plans.lines import nearest_lines
from terrella.plans.written import scratch
from terrella.queries import queries
from terrella.sources import parsers, writers

from tests.test_skew import boxes
from tests.test_spatial import points


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distance_join_is_no_broadcast_and_meets_places_once(spark):
    """Rows that share places, more of them than an array holds, give all their pairs; neither side is broadcast."""
    rows = [(i % 5, i % 3) for i in range(150)] + [(0.5, 0.5)] * 1500
    left, right = points(spark, rows), points(spark, rows[:160])
    found = joins.distance_join(left, right, 1.0)
    assert found.columns == ["l_id", "l_x", "l_y", "r_id", "r_x", "r_y", "distance"]
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows[:160]) if (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 1}
    got = [(r.l_id, r.r_id) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Broadcast" not in plan_of(found)


def test_box_aggregates_without_pairs_in_a_shuffle(spark):
    """Every box answers for itself, whatever its id, and points are aggregated before they meet the boxes' rows: no exchange but that of the results follows the join of the cells."""
    rows = [(i % 7, i % 5) for i in range(300)] + [(None, 1.0)]
    bounds = [(0, 0, 2, 2), (0, 0, 2, 2), (1, 1, 1, 1), (50, 50, 60, 60), (-9, -9, 99, 99)]
    ids = [None, 1, 1, 3, 4]
    own = spark.createDataFrame([(i, *map(float, b)) for i, b in zip(ids, bounds, strict=True)] + [(5, None, 0.0, 1.0, 1.0)], "id long, xmin double, ymin double, xmax double, ymax double")
    found = joins.range_join_aggregate(points(spark, rows), own, [F.count("l_id").alias("n"), F.coalesce(F.sum("l_x"), F.lit(-1.0)).alias("s"), F.min("l_x").alias("m")])
    inside = lambda b: [x for x, y in rows if x is not None and b[0] <= x <= b[2] and b[1] <= y <= b[3]]
    want = [(str(i), len(v), float(sum(v)) if v else -1.0, str(float(min(v)) if v else None)) for i, b in zip(ids, bounds, strict=True) for v in [inside(b)]] + [("5", 0, -1.0, "None")]
    assert sorted((str(r.id), r.n, r.s, str(r.m)) for r in found.collect()) == sorted(want)
    assert found.columns == ["id", "xmin", "ymin", "xmax", "ymax", "n", "s", "m"]


def test_range_join_meets_places_once(spark):
    """Points that share a place and boxes that share bounds give all their pairs; dealt boxes are not broadcast."""
    rng = random.Random(7)
    rows = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(400)] + [(3, 3)] * 1200
    bounds = [(x, y, x + w, y + w) for x, y, w in ((rng.randint(0, 9), rng.randint(0, 9), rng.choice((0, 1, 6))) for _ in range(4)) for _ in range(3)]
    found = joins.range_join(points(spark, rows), boxes(spark, bounds))
    got = [(r.l_id, r.r_id) for r in found.collect()]
    want = {(i, j) for i, (x, y) in enumerate(rows) for j, b in enumerate(bounds) if b[0] <= x <= b[2] and b[1] <= y <= b[3]}
    assert len(got) == len(want) and set(got) == want
    assert found.columns == ["l_id", "l_x", "l_y", "r_id", "r_xmin", "r_ymin", "r_xmax", "r_ymax"]
    assert "Broadcast" not in plan_of(found)


def test_fixed_decimals_as_in_sql(spark):
    """The scaled double decides, as in DuckDB."""
    values = [1028.995, 1195.995, 1039.995, 1117.995, 0.125, -0.125, 2.5, 0.0, None, *[i + 0.995 for i in range(1000, 1400)]]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "x double").select(util.fixed("x").cast("string").alias("v")).collect()]
    want = [duckdb.execute("SELECT CAST(CAST(CAST(? AS DOUBLE) AS DECIMAL(12,2)) AS VARCHAR)", [v]).fetchone()[0] for v in values]
    assert got == want


def test_number_text_as_in_sql(spark):
    values = [4e-4, 2e-4, 1e-4, 12e-5, 9.5e-5, 1e-5, 1.5e-10, 0.0, -0.0, -4e-4, 23.371199999999998, 1e7, 12345678.5, 123456789012345.0, 1e16, 2.5e120, None]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "x double").select(util.number_text("x").alias("v")).collect()]
    assert got == [duckdb.execute("SELECT CAST(CAST(? AS DOUBLE) AS VARCHAR)", [v]).fetchone()[0] for v in values]


def test_osm_polygons_of_small_degrees(spark):
    nodes = spark.createDataFrame([(1, 4e-4, 2.4), (2, 62.5, 4.0)], "node long, lon double, lat double")
    ways = spark.createDataFrame([(7, 0, 1), (7, 1, 2)], "way long, place int, node long")
    assert etl.osm_polygons(nodes, ways).first().line == '7,"POLYGON((0.0004 2.4,62.5 4.0,))"'


def test_bad_records_counts_no_negative_zero(spark):
    lines = spark.createDataFrame([("1,-0.0,400.0",), ("2,1.0E-4,-0.0",), ("3,-0.01,0.0",), ("4, -5,1",), ("5,x,1",), ("6,3.5,0.0",)], "value string")
    parsed = lines.select(parsers.parser("three_part_line")(F.col("value")).alias("p"))
    assert aggregate.bad_records(parsed, "p").first().bad == 3


def test_range_join_collect(spark):
    """The ids that each box holds, from arrays of points and not from pairs in rows."""
    rng = random.Random(8)
    rows = [(rng.randint(0, 9), rng.random() * 9) for _ in range(300)] + [(3, 3)] * 2500 + [(None, 2.0)]
    bounds = [(0, 0, 4, 4), (0, 0, 4, 4), (3, 3, 3, 3), (70, 70, 80, 80), (-50, -50, 50, 50)]
    found = joins.range_join_collect(points(spark, rows), boxes(spark, bounds))
    want = {j: [i for i, (x, y) in enumerate(rows) if x is not None and b[0] <= x <= b[2] and b[1] <= y <= b[3]] for j, b in enumerate(bounds)}
    assert {r.id: r.held for r in found.collect()} == want


def test_zknn_join_ranks_in_the_ranges(spark):
    """Only the k best of a shift leave a range, with all columns as they were; ties go to the least id."""
    left = spark.createDataFrame([(2**60 + 1, 0.5, 0.5, None), (7, 3.0, 3.0, 2**60 + 3)], "id long, x double, y double, more long")
    right = spark.createDataFrame([(f"r{i:02}", 0.5, 0.5) for i in range(6)] + [("s", 3.0, 3.5), ("t", 90.0, 90.0)], "id string, x double, y double")
    found = joins.zknn_join(left, right, 2, spare=4)
    got = sorted((r.l_id, r.l_more, r["rank"], r.r_id, r.distance) for r in found.collect())
    assert got[0] == (7, 2**60 + 3, 1, "s", 0.5)
    assert got[2:] == [(2**60 + 1, None, 1, "r00", 0.0), (2**60 + 1, None, 2, "r01", 0.0)]
    assert "CoGroup" in plan_of(found)


def lines_of(spark, rows):
    return spark.createDataFrame([(f"l{i}", [(float(x), float(y)) if x is not None else (None, None) for x, y in c], False) for i, c in enumerate(rows)], "payload string, coords array<struct<x:double,y:double>>, area boolean")


def brute_lines(rows, places, k, error_range, limit):
    out = set()
    for px, py in places:
        found = []
        for i, c in enumerate(rows):
            own = [p for p in c if p[0] is not None]
            (x0, x1), (y0, y1) = ((min(v) - error_range, max(v) + error_range) for v in zip(*own, strict=True))
            d2 = []
            for a, b in [*zip(c, c[1:])] if len(c) > 1 else [(c[0], c[0])]:
                if a[0] is not None and b[0] is not None:
                    dx, dy = b[0] - a[0], b[1] - a[1]
                    n = dx * dx + dy * dy
                    t = max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / n)) if n else 0.0
                    d2.append((px - a[0] - t * dx) ** 2 + (py - a[1] - t * dy) ** 2)
            if d2 and x0 <= px <= x1 and y0 <= py <= y1 and min(d2) <= limit:
                found.append((min(d2), f"l{i}"))
        out |= {(px, py, name, round(d2, 9)) for d2, name in sorted(found)[:k]}
    return out


def test_nearest_lines_of_tiles_and_parts(spark):
    """Long and short lines, copies of lines, breaks, single coordinates, places with fewer than k lines: as by brute force, whatever the tiles, parts and steps."""
    rng = random.Random(14)
    at = lambda s: (rng.randint(0, s), rng.randint(0, s))
    rows = [[at(1000) for _ in range(rng.randint(2, 6))] for _ in range(40)] + [[(x, y), (x + 3, y + rng.randint(0, 4))] for x, y in (at(1000) for _ in range(40))]
    rows += [rows[3], rows[3], rows[50], [(10, 10)], [(0, 0), (5, 900), (None, None), (500, 3), (900, 3)], [(7, 7), (7, 7)], [(2e6, 5), (-2e6, 6)]]
    places = [at(1000) for _ in range(150)] + [(rng.randint(0, 1000), 400) for _ in range(150)] + [(10, 10), (-40, 500), (-500, 500), (1e6, 9), (3e6, 1)]
    where = spark.createDataFrame([(float(x), float(y)) for x, y in [*places, *places[:9]]] + [(None, 1.0), (float("nan"), 1.0)], "px double, py double")
    for limit, tile, part in ((None, 40, 60), (60.0, 100_000, 1_000_000)):
        found = nearest_lines(lines_of(spark, rows), where, 3, 50.0, limit, tile, part).collect()
        want = brute_lines(rows, places, 3, 50.0, limit * limit if limit else float("inf"))
        assert len(found) == len(want) and {(r.px, r.py, r.l_payload, round(r.d2, 9)) for r in found} == want


def test_map_matching_writes_no_cells(spark):
    """What is written and what crosses an exchange are lines and places, not the cells that segments pass."""
    rng = random.Random(15)
    rows = [[(rng.uniform(0, 1e5), rng.uniform(0, 1e5)) for _ in range(4)] for _ in range(50)]
    dots = spark.createDataFrame([(f"p{i}", [(rng.uniform(0, 1e5), rng.uniform(0, 1e5))], False) for i in range(400)], "payload string, coords array<struct<x:double,y:double>>, area boolean")
    with scratch() as paths:
        found = joins.match_knn(lines_of(spark, rows), dots, 3)
        assert found.where("size(matches) = 3").count() > 300
    assert sorted(p.rsplit("/", 1)[1].split("-")[0] for p in paths) == ["lines", "places"]
    assert sum(spark.read.parquet(p).count() for p in paths) == 450
    assert "CoGroup" in plan_of(found)


def test_distance_matching_writes_no_cells(spark):
    """A short distance and long segments: only lines and places are written."""
    rows = [[(0, i), (1e7, i + 0.5)] for i in range(30)]
    dots = spark.createDataFrame([(f"p{i}", [(i * 1e4, float(i % 30))], False) for i in range(300)], "payload string, coords array<struct<x:double,y:double>>, area boolean")
    with scratch() as paths:
        found = {r.payload: [(m.payload, round(m.distance, 6)) for m in r.matches] for r in joins.match_distance(lines_of(spark, rows), dots, 2, 0.4, 0.0).collect()}
    assert sorted(p.rsplit("/", 1)[1].split("-")[0] for p in paths) == ["lines", "places"]
    assert found["p0"] == [("l0", 0.0)] and found["p12"] == [("l12", 0.006)] and len(found["p299"]) == 1


def test_distance_matching_makes_no_more_parts_than_cores(spark, monkeypatch):
    """Each part of the lines gives candidates for all places: there are as many as keep the cores busy, or as the lines' size asks for."""
    tasks, spread = [], plan_lines._spread
    monkeypatch.setattr(plan_lines, "_spread", lambda spark, n: tasks.append(n) or spread(spark, n))
    rows = [[(0, i), (1e4, i + 0.5)] for i in range(20)]
    dots = spark.createDataFrame([(f"p{i}", [(i * 1e2, float(i % 20))], False) for i in range(90)], "payload string, coords array<struct<x:double,y:double>>, area boolean")
    found = {r.payload: [m.payload for m in r.matches] for r in joins.match_distance(lines_of(spark, rows), dots, 2, 0.4, 0.0).collect()}
    assert len(found) == 90 and found["p0"] == ["l0"] and found["p21"] == ["l1"] and tasks == [spark.sparkContext.defaultParallelism]


def test_match_lines_writes_no_cells(spark):
    """Lines of text of all points, matched or not, without a table of cells."""
    rows = [[(0, 5), (1e7, 5)], [(0, 9), (1e7, 9)]]
    dots = spark.createDataFrame([("a", [(3e6, 6.0)], False), ("b", [(3e6, 8.0)], False), ("c", [(3e6, 400.0)], False), ("d", [(None, 1.0)], False)], "payload string, coords array<struct<x:double,y:double>>, area boolean")
    with scratch() as paths:
        found = sorted(r.value for r in writers.match_lines(joins.match_distance(lines_of(spark, rows), dots, 3, 100.0)).collect())
    assert found == ["a,l0,l1", "b,l1,l0", "c", "d"]
    assert sum(spark.read.parquet(p).count() for p in paths) == 5  # two lines and three places


def test_places_of_unlike_distances(monkeypatch):
    """Places in rows, in clusters and far from all lines, level and upright segments, ties: bands and tree find what brute force finds, and few pairs are worked out."""
    rng = np.random.default_rng(16)
    n, m, k = 3_000, 4_000, 3
    x = np.concatenate([np.round(rng.uniform(-300, 1000, n), 2), 500 + rng.normal(size=n) * 0.01, [1e6, 5e8, 7.0]])
    y = np.concatenate([rng.integers(0, 9, n) * 100.0, 500 + rng.normal(size=n), [3.0, -5e8, 7.0]])
    ends = np.round(rng.uniform(0, 1000, (4, m)), 1)
    ends[3, :200] = ends[1, :200] = rng.integers(0, 9, 200) * 100.0
    ends[2, 200:300] = ends[0, 200:300]
    ends[:, 300:330] = ends[:, 330:360]
    ends[2:, 360:380] = ends[:2, 360:380]
    line, rank = np.repeat(np.arange(m // 2), 2), rng.permutation(m // 2)
    box = [f.reduceat(v, np.arange(0, m, 2)) + g for v, f, g in ((np.minimum(ends[0], ends[2]), np.minimum, -150), (np.minimum(ends[1], ends[3]), np.minimum, -150), (np.maximum(ends[0], ends[2]), np.maximum, 150), (np.maximum(ends[1], ends[3]), np.maximum, 150))]
    worked, used, meet = [], set(), plan_lines._Segments.meet
    monkeypatch.setattr(plan_lines._Segments, "meet", lambda self, s, *a: worked.append(len(s)) or meet(self, s, *a))
    for kind in (plan_lines._Bands, plan_lines._Tree):
        monkeypatch.setattr(kind, "met", lambda self, *a, kind=kind, met=kind.met: used.add(kind.__name__) or met(self, *a))
    for limit in (np.inf, 30.0**2):
        best = plan_lines._Places(x, y, k, limit)
        best.take(*ends, line, rank, *box)
        dx, dy = ends[2] - ends[0], ends[3] - ends[1]
        for i in [*range(0, 2 * n, 97), 2 * n, 2 * n + 1, 2 * n + 2]:
            long = np.where(dx * dx + dy * dy == 0, 1.0, dx * dx + dy * dy)
            t = np.clip(((x[i] - ends[0]) * dx + (y[i] - ends[1]) * dy) / long, 0.0, 1.0)
            d2 = np.minimum.reduceat((x[i] - ends[0] - t * dx) ** 2 + (y[i] - ends[1] - t * dy) ** 2, np.arange(0, m, 2))
            held = (box[0] <= x[i]) & (x[i] <= box[2]) & (box[1] <= y[i]) & (y[i] <= box[3]) & (d2 <= limit)
            want = sorted(zip(d2[held], rank[held]))[:k]
            assert [(d, c) for d, c in zip(best.d2[i], best.code[i]) if np.isfinite(d)] == want
    assert used == {"_Bands", "_Tree"}
    assert sum(worked) < 2 * len(x) * m / 20


def test_tasks_of_map_matching_are_spread(spark):
    """Few tasks, each of a tile and a part: no two in one partition while others are empty."""
    for tasks in (1, 3, 4, 7, 16):
        keys = plan_lines._spread(spark, tasks)
        at = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "task long").repartition(4, "task").select(F.spark_partition_id()).collect()]
        assert len(set(keys)) == tasks and max(at.count(i) for i in range(4)) == -(-tasks // 4)


def test_box_match_lines_writes_ids_before_the_join(spark):
    """An id becomes text once for its row, not once for each of its pairs."""
    plan = plan_of(queries()["box_match_lines"](spark, "/root/testdata/sf0.001"))
    assert "Join" in plan and "cast(" not in plan[: plan.index("Join")]


def test_knn_join_broadcasts_nothing_uncounted(spark, tmp_path):
    """Rows and cells come from files that are far smaller than they are: none is a broadcast. (Sixteen rows make no heavy cells, which are counted.)"""
    points(spark, [(i % 4, i // 4) for i in range(16)]).write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    found = joins.knn_join(df, df, 8)
    assert "Broadcast" not in plan_of(found)
    assert found.count() == 16 * 8


def test_written_lines_leave_no_shuffle_files(spark, monkeypatch):
    """What gathered the lines is gone from the disk once they are written, however seldom the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    new, plain = [], plan_lines.written

    def spied(*args, **named):
        before, was = held(), spark.conf.get(key)
        out = plain(*args, **named)
        new.append(held() - before)
        assert spark.conf.get(key) == was
        return out

    monkeypatch.setattr(plan_lines, "written", spied)
    at = F.struct((F.col("id") % 7).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    lines = spark.range(400).groupBy(F.concat(F.lit("l"), F.col("id") % 20).alias("payload")).agg(F.array_sort(F.collect_list(at)).alias("coords"))
    places = spark.createDataFrame([(1.0, 2.0), (3.0, 50.0)], "px double, py double")
    found = nearest_lines(lines, places, 2, 10.0, None).collect()
    assert len(found) == 4 and new == [set(), set()]
    spied(lines, "plain")
    assert new[-1]  # without the word they stay for a plan that may use them again
