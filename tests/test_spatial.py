"""Joins against brute force on hard inputs, and queries against their oracles."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from terrella import queries as registered
from terrella.functions import curves
from terrella.functions import geometry as G
from terrella.functions import raster
from terrella.operators import aggregate, compare, etl, frame, joins, select
from terrella.queries.tables import Tables
from terrella.sources import arguments, parsers, writers
from terrella.streaming import streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def points(spark, rows):
    return spark.createDataFrame([(i, float(x) if x is not None else None, float(y) if y is not None else None) for i, (x, y) in enumerate(rows)], "id long, x double, y double")


def brute_knn(left, right, k):
    out = set()
    for i, (x, y) in enumerate(left):
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, (a, b) in enumerate(right))[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(near)}
    return out


def cases():
    rng = random.Random(3)
    lattice = [(i % 7, i // 7) for i in range(49)]
    spread = [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(60)]
    hot = [(0, 0)] * 40 + [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(20)]
    far = [(1000 + i, 2000) for i in range(10)]
    return {"lattice": (lattice, lattice, 4), "spread": (spread, lattice, 3), "hot cell": (spread, hot, 7), "far left": (far, spread, 2), "more than there are": (lattice, far, 50), "one point": (spread, [(1, 1)] * 5, 3), "on a line": ([(i, 0) for i in range(30)], [(i * 2, 0) for i in range(30)], 3)}


@pytest.mark.parametrize("name", list(cases()))
def test_knn_join(spark, name):
    left, right, k = cases()[name]
    got = {(r.l_id, r.r_id, r.rank) for r in joins.knn_join(points(spark, left), points(spark, right), k).collect()}
    assert got == brute_knn(left, right, k)


def test_knn_join_edges(spark):
    some = points(spark, [(0, 0), (1, 1), (None, 2), (float("nan"), 0)])
    assert joins.knn_join(some, some.limit(0), 2).count() == 0
    assert joins.knn_join(some.limit(0), some, 2).count() == 0
    nested = {r.id: len(r.neighbours) for r in joins.knn_join_nested(some, some, 5).collect()}
    assert nested == {0: 2, 1: 2, 2: 0, 3: 0}
    with pytest.raises(ValueError):
        joins.knn_join(some, some, 0)


@pytest.mark.parametrize("r", [0.0, 0.1, 0.3, 0.7])
def test_distance_join_on_borders(spark, r):
    rows = [(i * 0.1, j * 0.1) for i in range(9) for j in range(8)] + [(-0.1, -0.2)]
    got = {(x.l_id, x.r_id) for x in joins.distance_join(points(spark, rows), points(spark, rows), r).collect()}
    assert got == {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) <= r * r}


def test_box_joins(spark):
    rng = random.Random(5)
    pts = [(rng.randint(-20, 20), rng.randint(-20, 20)) for _ in range(200)] + [(None, 1)]
    boxes = [(rng.randint(-20, 20), rng.randint(-20, 20), rng.choice([0, 1, 3, 30])) for _ in range(40)] + [(500, 500, 1)]
    frame_ = spark.createDataFrame([(i, float(x), float(y), float(x + w), float(y + w)) for i, (x, y, w) in enumerate(boxes)], "id long, xmin double, ymin double, xmax double, ymax double")
    want = {(i, j) for i, (x, y) in enumerate(pts) if x is not None for j, (a, b, w) in enumerate(boxes) if a <= x <= a + w and b <= y <= b + w}
    p = points(spark, pts)
    assert {(r.l_id, r.r_id) for r in joins.range_join(p, frame_).collect()} == want
    counts = {r.id: r.n for r in joins.range_join_aggregate(p, frame_, [F.count("l_id").alias("n")]).collect()}
    assert counts == {j: sum(b == j for _, b in want) for j in range(len(boxes))}
    inside = {i for i, _ in want}
    assert {r.id for r in joins.semi_join(p, frame_).collect()} == inside
    assert {r.id for r in joins.semi_join(p, frame_, anti=True).collect()} == set(range(len(pts))) - inside
    assert {r.id for r in select.boxes_with_data(frame_, p).collect()} == {j for _, j in want}


def test_shapes(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    seg = lambda *v: G.segment(*map(float, v))
    box = G.Box.of(0.0, 0.0, 4.0, 4.0)
    row = spark.range(1).select(
        G.polygon_contains(G.closed(ring), 2.0, 2.0).alias("inside"), G.polygon_contains(G.closed(ring), 4.0, 2.0).alias("border"), G.polygon_covers(G.closed(ring), 4.0, 2.0).alias("covered"), G.polygon_point_distance(G.closed(ring), 7.0, 8.0).alias("d"),
        G.segment_box_intersects(seg(1, 1, 2, 2), box).alias("within"), G.segments_intersect(seg(0, 0, 2, 2), seg(0, 2, 2, 0)).alias("cross"), G.segments_intersect(seg(0, 0, 1, 1), seg(2, 2, 3, 3)).alias("apart"), G.segments_distance(seg(0, 0, 1, 0), seg(0, 3, 1, 3)).alias("three"),
        G.segment_contains(seg(0, 0, 4, 4), 2.0, 2.0).alias("on"), G.min_distance(("circle", (10.0, 2.0, 1.0)), ("box", (0.0, 0.0, 4.0, 4.0))).alias("five"), G.intersects(("point", (4.0, 4.0)), ("polygon", (ring,))).alias("touch"),
        G.dominates(G.as_point(1.0, 2.0), G.as_point(1.0, 3.0)).alias("dom"), G.distance_nd(G.as_point(0.0, 0.0, 0.0), G.as_point(1.0, 2.0, 2.0)).alias("nd"), G.from_wkt(F.lit("POLYGON ((0 0, 4 0, 4 4))")).alias("wkt"),
    ).first()
    assert (row.inside, row.border, row.covered, row.d) == (True, False, True, 5.0)
    assert (row.within, row.cross, row.apart, row.three, row.on, row.five, row.touch, row.dom, row.nd) == (True, True, False, 3.0, True, 5.0, True, True, 3.0)
    assert [tuple(c) for c in row.wkt] == [(0, 0), (4, 0), (4, 4)]
    assert spark.range(1).select(ring.alias("ring")).select((G.from_wkb(G.to_wkb(F.col("ring"))) == F.col("ring")).alias("same")).first().same


def test_map_matching(spark):
    lines = spark.createDataFrame([("b", [(0.0, 0.0), (10.0, 0.0)]), ("a", [(0.0, 2.0), (10.0, 2.0)]), ("far", [(0.0, 900.0), (10.0, 900.0)])], "payload string, coords array<struct<x:double,y:double>>")
    set1, set2 = parsers.shapes(lines, "line"), parsers.shapes(spark.createDataFrame([("p", 5.0, 1.0), ("q", 5.0, 0.0), ("alone", 5000.0, 0.0)], "payload string, x double, y double"), "point")
    got = {r.payload: [(m.payload, m.distance) for m in r.matches] for r in joins.match_knn(set1, set2, 2).collect()}
    assert got == {"p": [("a", 1.0), ("b", 1.0)], "q": [("b", 0.0), ("a", 2.0)], "alone": []}
    near = {r.payload: [m.payload for m in r.matches] for r in joins.match_distance(set1, set2, 3, 0.5).collect()}
    assert near == {"p": [], "q": ["b"], "alone": []}
    assert {r.payload: [m.payload for m in r.matches] for r in joins.match_range(set1, set2).collect()} == {"p": [], "q": ["b"], "alone": []}


def test_zknn_recall(spark):
    """The registered query against the exact join; and ranges that are cut small give what one range gives."""
    got = {(r.l_id, r.r_id) for r in registered.queries()["zknn_join"](spark, SF).collect()}
    tables = Tables(spark, SF)
    want = {(r.l_id, r.r_id) for r in joins.knn_join(tables.customer(), tables.order(), 5).collect()}
    assert len(got & want) / len(want) >= 0.9
    rng = random.Random(2)
    rows = [(rng.random(), rng.random()) for _ in range(200)] + [(0.5, 0.5)] * 50
    df = points(spark, rows)
    whole, cut = ({(r.l_id, r.r_id, r["rank"]) for r in joins.zknn_join(df, df, 3, range_rows=n).collect()} for n in (10**6, 40))
    assert whole == cut


def test_knn_join_nd_in_blocks(spark):
    rng = random.Random(4)
    data = [[rng.choice((0.0, 1.0, rng.random())) for _ in range(6)] for _ in range(200)] + [[0.5] * 6] * 5 + [[0.1, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(data)), "id long, v array<double>").repartition(3)
    got = {(r.query, r.id, r["rank"]) for r in joins.knn_join_nd(df.where("id % 7 = 0 or id = 206"), df, 4, "v", "v", "id", "id", block_bytes=500).collect()}
    want = set()
    for q, v in enumerate(data):
        if (q % 7 == 0 or q == 206) and None not in v:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), i) for i, w in enumerate(data) if None not in w and len(w) == len(v))[:4]
            want |= {(q, i, n) for n, (_, i) in enumerate(near, 1)}
    assert got == want


def test_distance_join_in_four_dimensions(spark):
    rng = random.Random(5)
    rows = [tuple(rng.choice((0.0, 0.3, rng.random())) for _ in range(4)) for _ in range(120)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a double, b double, c double, d double")
    for r in (0.0, 0.3):
        got = {(x.l_id, x.r_id) for x in joins.distance_join(df, df, r, ("a", "b", "c", "d")).collect()}
        assert got == {(i, j) for i, p in enumerate(rows) for j, q in enumerate(rows) if sum((s - t) * (s - t) for s, t in zip(p, q, strict=True)) <= r * r}


def test_map_matching_against_all_pairs(spark):
    """Lines far and near, several parts, points with few lines about them: cell by cell as by brute force."""
    rng = random.Random(9)
    lines = [(f"l{i}", [(x, y), (x + rng.uniform(-900, 900), y + rng.uniform(-900, 900)), (x + rng.uniform(-90, 90), y)]) for i, (x, y) in enumerate((rng.uniform(0, 5000), rng.uniform(0, 5000)) for _ in range(60))]
    dots = [(f"p{i}", rng.uniform(-300, 5300), rng.uniform(-300, 5300)) for i in range(80)] + [("far", 1e7, 1e7)]
    set1 = parsers.shapes(spark.createDataFrame(lines, "payload string, coords array<struct<x:double,y:double>>"), "line")
    set2 = parsers.shapes(spark.createDataFrame(dots, "payload string, x double, y double"), "point")

    def apart(p, coords):
        best = math.inf
        for (ax, ay), (bx, by) in zip(coords, coords[1:], strict=False):
            dx, dy = bx - ax, by - ay
            t = max(0.0, min(1.0, ((p[0] - ax) * dx + (p[1] - ay) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(p[0] - ax - t * dx, p[1] - ay - t * dy))
        return best

    inside = lambda p, coords: min(x for x, _ in coords) - 150 <= p[0] <= max(x for x, _ in coords) + 150 and min(y for _, y in coords) - 150 <= p[1] <= max(y for _, y in coords) + 150
    for k, limit in ((3, None), (2, 120.0), (50, None)):
        got = {r.payload: [(m.payload, round(m.distance, 6)) for m in r.matches] for r in joins.match_knn(set1, set2, k, max_distance=limit).collect()}
        want = {}
        for name, *p in dots:
            near = sorted((apart(p, c), n) for n, c in lines if inside(p, c))
            want[name] = [(n, round(d, 6)) for d, n in near if limit is None or d <= limit][:k]
        assert got == want


def test_rasters(spark):
    """Every cell that a dense walk along the shape meets is found, and no cell that is apart from it."""
    rng = random.Random(10)
    ways = [[(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(rng.randint(1, 4))] for _ in range(40)] + [[(0.0, 0.0), (0.0, 5.0)], [(1.0, 1.0), (4.0, 1.0)], [(3.0, 3.0)]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(ways)], "id long, coords array<struct<x:double,y:double>>")
    for r in df.select("id", raster.line_cells(F.col("coords"), 1.5).alias("cells")).collect():
        way, cells = ways[r.id], {(c.cx, c.cy) for c in r.cells}
        steps = [(a[0] + (b[0] - a[0]) * t / 3000, a[1] + (b[1] - a[1]) * t / 3000) for a, b in zip(way, way[1:] or way, strict=False) for t in range(3001)]
        assert {(math.floor(x / 1.5), math.floor(y / 1.5)) for x, y in steps} <= cells
        assert all(any(cx * 1.5 - 1e-2 <= x <= cx * 1.5 + 1.51 and cy * 1.5 - 1e-2 <= y <= cy * 1.5 + 1.51 for x, y in steps) for cx, cy in cells)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0.5, 0.5), (6.5, 0.5), (6.5, 2.5), (0.5, 2.5), (0.5, 0.5))])
    row = spark.range(1).select(raster.polygon_cells(ring, 1.0).alias("cells"), raster.hilbert_cells(ring, F.lit(True), 1.0, 4).alias("h")).first()
    assert {(c.cx, c.cy) for c in row.cells} == {(x, y) for x in range(7) for y in range(3)} and row.h == sorted(curves.hilbert_index(x, y, 4) for x in range(4) for y in range(3))


def test_parts_of_lines_and_rings(spark):
    wkt = lambda text: G.from_wkt(F.lit(text))
    row = spark.range(1).select(
        F.size(G.edges_of(wkt("MULTILINESTRING ((0 0, 1 0), (5 5, 6 5))"))).alias("edges"), G.polygon_covers(wkt("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))"), 4.0, 4.0).alias("hole"),
        G.polygon_point_distance(wkt("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))"), 4.0, 4.5).alias("apart"), F.size(G.edges_of(wkt("MULTIPOINT ((1 2), (3 4))"))).alias("points"), wkt("nothing").alias("none"),
    ).first()
    assert (row.edges, row.hole, row.apart, row.points, row.none) == (2, False, 1.0, 2, None)


def test_enumeration_of_ties_repeats(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(60)], "k long, v long").repartition(5)
    runs = [{r.v: r.n for r in etl.enumerated(df.repartition(n), "k").collect()} for n in (3, 7)]
    assert runs[0] == runs[1] and sorted(runs[0].values()) == list(range(1, 61))


def test_kmeans(spark):
    """Restarts give the best dispersion, and each row's cluster is its nearest centroid."""
    rng = random.Random(7)
    rows = [(cx + rng.gauss(0, 0.2), cy + rng.gauss(0, 0.2)) for cx, cy in ((0, 0), (8, 0), (0, 8), (8, 8)) for _ in range(25)]
    df = points(spark, rows)
    total, centroids = aggregate.kmeans(df, 4, seed=3, restarts=3)
    assert total <= aggregate.kmeans(df, 4, seed=3)[0] + 1e-9
    member = {r.id: (r.cluster, r.d2) for r in aggregate.assigned(df, centroids).collect()}
    for i, (x, y) in enumerate(rows):
        away = [(x - a) ** 2 + (y - b) ** 2 for a, b in centroids]
        assert member[i][0] == away.index(min(away))
    assert math.isclose(sum(d for _, d in member.values()), total, rel_tol=1e-6, abs_tol=1e-3)


def test_samples_and_generators(spark):
    df = points(spark, [(i % 10, i // 10) for i in range(100)] + [(3.0, float("nan"))])
    assert etl.sample_rows(df, 1000, 7).count() == 100 and etl.sample_rows(df, 30, 7).count() <= 30
    assert 0 < etl.sample_fraction(df, 0.5, 3, 7).count() < 101 and etl.sample_fraction(df, 0.5, 3, 7).rdd.getNumPartitions() == 7
    drawn = [r.i for r in spark.range(4000).select(etl.weighted_choice([1.0, 3.0], 5).alias("i")).collect()]
    assert set(drawn) == {0, 1} and 0.7 < sum(drawn) / len(drawn) < 0.8
    boxes = etl.random_boxes(spark, 50, 0.1, 3)
    assert boxes.where("xmax < xmin or ymax < ymin or xmax - xmin > 0.1").count() == 0 and abs(etl.random_points(spark, 2000, "gaussian", 2).agg(F.avg("x")).first()[0]) < 0.2


def test_hilbert(spark):
    cells = [(x, y) for x in range(8) for y in range(8)]
    df = spark.createDataFrame(cells, "x long, y long").withColumn("h", curves.hilbert("x", "y", 8))
    got = {(r.x, r.y): r.h for r in df.collect()}
    assert sorted(got.values()) == list(range(64)) and all(got[c] == curves.hilbert_index(*c, 8) for c in cells)
    path = sorted(got, key=got.get)
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))
    assert spark.range(1).select(curves.hilbert(F.lit(8), F.lit(0), 8).alias("h"), curves.hilbert(F.lit(-1), F.lit(0), 8).alias("g")).first() == (-1, -1)
    assert curves.box_ranges(-180, -90, 180, 90, 4) == [(0, 15)]


def test_registry(spark, tmp_path):
    registry = frame.IndexRegistry(spark)
    df = points(spark, [(i, i % 5) for i in range(50)])
    registry.create(df, "rtree", "a", ("x", "y"), "a_view")
    with pytest.raises(ValueError):
        registry.create(df, "rtree", "a", ("x", "y"))
    registry.persist("a", f"file://{tmp_path}/a")
    registry.load(f"file://{tmp_path}/a", "b")
    assert registry.has("a") and registry.get("b").df.count() == 50 and registry.show().count() == 2
    registry.drop_column("x")
    assert not registry.indexes
    own = frame.SpatialFrame(df)
    assert own.put(points(spark, [(0, 0), (7, 100)])).df.count() == 51 and own.delete(df.where("x < 10")).df.count() == 40 and own.get(3, 3).count() == 1


def test_comparison_of_equal_results(spark):
    lines = spark.createDataFrame([("k1;1.00000000,a;2.00000000,b",), ("k2",)], "value string")
    key = compare.read_results(lines)
    found = {r.label: r.n for r in compare.compared(key, key, 3).collect()}
    assert found["correct"] == found["total"] == 2 and found["mismatch"] == 0 and found["both_no_match"] == 1


def test_parsers(spark):
    lines = spark.createDataFrame([("a,1.5,2.5",), ("b,-1,2",), ("c,x,2",), ("d",), ("",)], "value string")
    assert [tuple(r) for r in parsers.points(lines, "three_part_line").collect()] == [(1.5, 2.5, "a")]
    assert parsers.points(lines, "rand_point").count() == 2
    with pytest.raises(ValueError):
        parsers.parser("nothing")
    bus = spark.createDataFrame([("T,40.5,-73.9,Rest",)], "value string")
    assert tuple(parsers.points(bus, "bus_point_WGS84").first()) == (-73.9, 40.5, "T,40.5,-73.9,Rest")
    assert arguments.parse([arguments.Argument("k", int, 3), arguments.Argument("on", bool)], ["-k", "4", "-on", "Yes"]) == {"k": 4, "on": True}
    nested = spark.createDataFrame([(1, [(0.5, 7)]), (2, [])], "id long, neighbours array<struct<distance:double,id:long>>")
    assert sorted(r.value for r in writers.knn_lines(nested).collect()) == ["1;0.50000000,7", "2"]


def test_projection_origin(spark):
    east, north = etl.to_state_plane(-74.0, 40 + 10 / 60)
    row = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    assert math.isclose(row.e, 984250.0, abs_tol=0.01) and math.isclose(row.n, 0.0, abs_tol=0.01)


def test_stream_static_join(spark, tmp_path):
    points(spark, [(0, 0), (5, 5), (9, 9)]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, x double, y double").parquet(f"{tmp_path}/in")
    joined = streams.stream_distance_join(stream, points(spark, [(0, 1), (5, 5)]), 1.0)
    query = joined.writeStream.format("memory").queryName("joined").option("checkpointLocation", f"{tmp_path}/check").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.l_id, r.r_id) for r in spark.table("joined").collect()} == {(0, 0), (1, 1)}


def _cell(value):
    return repr(value) if isinstance(value, float) else str(value)


FAST = "range_select circle_select knn_select knn_select_nd knn_keep_ties knn_and_range knn_or_circle not_knn text_range_filter box_measures circle_measures segment_measures segments morton_index utilities knn_join knn_self_join all_knn_join distance_join distance_self_join range_join_count poly_contains_join upsert_points delete_points attr_range_sql occupied_share kmeans_step compare_outputs knn_text_output osm_polygons enumerate_split co_occurring_cells spatiotemporal_match line_map_match_knn segment_tests shape_distances poly_distance line_range_join polygon_wkt line_cells polygon_cells parse_field_points parse_short_points street_lines wkt_points_boxes degree_lines read_results match_lines packing compare_report state_plane lonlat_hilbert".split()


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, name):
    df = registered.queries()[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = con.execute(registered.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(_cell(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect()) == want
