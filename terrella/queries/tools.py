"""Mutation, indexes, aggregates, comparison, text formats and ETL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.functions import curves
from terrella.functions.raster import hilbert_cells
from terrella.operators import aggregate, compare, etl, frame, joins, select
from terrella.plans.written import new_folder
from terrella.queries.selections import lonlat_sql, steps
from terrella.queries.shapes import LINE_CELLS
from terrella.queries.tables import Tables
from terrella.sources import parsers, writers

CENTROIDS = ((1000.0, 1000.0), (5000.0, 5000.0), (9000.0, 1000.0), (2000.0, 8000.0))


def _of(body):  # noqa: ANN001, ANN202
    return lambda spark, sf_dir: body(Tables(spark, sf_dir))


def _by_location(t: Tables) -> DataFrame:
    return t.part().groupBy("x", "y").agg(F.min("id").alias("v"))


def _changes(t: Tables) -> DataFrame:
    moved = _by_location(t).where("x <= 15").select("x", "y", (F.col("v") * 10).alias("v"))
    return moved.unionByName(_by_location(t).where("x > 40").select(F.col("x") + 1000, "y", "v").toDF("x", "y", "v"))


_LOC = ", loc AS (SELECT x, y, min(id) AS v FROM part_pts GROUP BY x, y), ch AS (SELECT x, y, v * 10 AS v FROM loc WHERE x <= 15 UNION ALL SELECT x + 1000, y, v FROM loc WHERE x > 40)"


def _index(t: Tables) -> DataFrame:
    registry = frame.IndexRegistry(t.spark)
    name = f"i{uuid.uuid4().hex}"
    registry.create(t.order(), "rtree", name, ("x", "y"))
    path = new_folder(t.spark, "index")
    registry.persist(name, path)
    registry.drop(name)
    return select.range_filter(registry.load(path).df, (1000, 1000), (4000, 5000)).drop("cell")


def _attribute(t: Tables) -> DataFrame:
    registry, view = frame.IndexRegistry(t.spark), f"v{uuid.uuid4().hex}"
    registry.create(t.customer(), "treemap", view, ("x",), view)
    found = t.spark.sql(f"SELECT id, x, y FROM {view} WHERE x > 1000 AND y <= 2000")
    registry.clear()  # the plan of the result holds; the cached copy and the view go
    return found


def _registry(t: Tables) -> DataFrame:
    registry = frame.IndexRegistry(t.spark)
    for kind, name, columns in (("rtree", "a", ("x", "y")), ("hashmap", "b", ("id",)), ("treap", "c", ("x",)), ("quadtree", "d", ("x", "y"))):
        registry.create(t.supplier(), kind, name, columns)
    registry.drop("d")
    registry.drop_column("id")
    shown = registry.show().select("name", "kind", F.array_join("columns", ",").alias("columns"))
    registry.clear()
    return shown


def _put_delete(t: Tables) -> DataFrame:
    own = frame.SpatialFrame(_by_location(t))
    return own.put(_changes(t)).delete(t.part().where("x between 20 and 30")).df.drop("cell")


_PUT = " SELECT * FROM (SELECT coalesce(l.x, c.x) AS x, coalesce(l.y, c.y) AS y, coalesce(c.v, l.v) AS v FROM loc l FULL JOIN ch c ON l.x = c.x AND l.y = c.y) u WHERE NOT EXISTS (SELECT 1 FROM part_pts p WHERE p.x BETWEEN 20 AND 30 AND p.x = u.x AND p.y = u.y)"


def _results(t: Tables) -> tuple[DataFrame, DataFrame]:
    near = joins.knn_join_nested(t.supplier(), t.customer(), 4)
    matches = F.transform("neighbours", lambda n: F.struct(F.format_string("%.8f", n["distance"]).alias("distance"), n["id"].cast("string").alias("id")))
    key = near.select(F.col("id").alias("key"), matches.alias("matches"))
    changed = near.where("x >= 0").select(F.col("id").alias("key"), matches.alias("matches")).select("key", F.when(F.col("key") % 10 == 1, F.slice("matches", 1, 2)).when(F.col("key") % 10 == 2, F.transform("matches", lambda m: F.struct(m["distance"].alias("distance"), F.concat(F.lit("x"), m["id"]).alias("id")))).when(F.col("key") % 10 == 4, F.transform("matches", lambda m: F.struct(F.lit("0.00000000").alias("distance"), m["id"].alias("id")))).otherwise(F.col("matches")).alias("matches"))
    return key, changed


_COMPARE_SQL = """, k AS (SELECT CASE WHEN x < 0 THEN -1 ELSE id % 10 END AS m FROM supplier_pts), c AS (SELECT count(*) AS total, count(*) FILTER (m = -1) AS only_in_key, count(*) FILTER (m = 1) AS undermatched, count(*) FILTER (m = 2) * 3 AS distance_only, count(*) FILTER (m NOT IN (-1, 1, 4)) AS correct, count(*) FILTER (m IN (-1, 1, 4)) AS mismatch FROM k),
r AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS place, unnest(['both_no_match', 'only_in_key', 'only_in_other', 'undermatched', 'overmatched', 'distance_only', 'correct', 'mismatch', 'total']) AS label, unnest([0, only_in_key, 0, undermatched, 0, distance_only, correct, mismatch, total]) AS n, total FROM c)
SELECT place, label, CAST(n AS BIGINT) AS n, round(n * 100.0::DOUBLE / total, 4) AS percent FROM r"""


_REPORT_SQL = _COMPARE_SQL[: _COMPARE_SQL.rindex("SELECT place")] + "SELECT array_to_string(list_transform(string_split(label, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || chr(9) || CAST(n AS VARCHAR) || chr(9) || printf('%.2f', round(n * 100.0::DOUBLE / total, 4)) AS tsv FROM r"


def _text(t: Tables) -> DataFrame:
    return writers.knn_lines(joins.knn_join_nested(t.supplier(), t.customer(), 3))


_TEXT_SQL = ", k AS (SELECT l.id, r.id AS rid, (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) AS d2 FROM supplier_pts l, customer_pts r), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, rid) AS rank FROM k) SELECT CAST(id AS VARCHAR) || ';' || string_agg(format('{:.8f},{}', sqrt(d2), rid), ';' ORDER BY rank) AS value FROM n WHERE rank <= 3 GROUP BY id"


def _parsed(t: Tables) -> DataFrame:
    lines = t.customer().select(F.concat_ws(",", F.concat(F.lit("Bus_"), F.col("id").cast("string")), F.col("x").cast("decimal(12,2)").cast("string"), F.col("y").cast("decimal(12,2)").cast("string")).alias("value"))
    return parsers.points(lines, "Three_Part_Line")


def _wkt(t: Tables) -> DataFrame:
    lines = etl.point_text(t.customer().select(F.col("x").cast("decimal(12,2)").alias("x"), F.col("y").cast("decimal(12,2)").alias("y")))
    return lines.withColumn("c", parsers.from_wkt("value")[0]).select("value", "c.x", "c.y")


def _osm(t: Tables) -> DataFrame:
    nodes = t.customer().select(F.format_string('<node id="%d" lat="%s" lon="%s"/>', "id", (F.col("y") / 1000).cast("string"), (F.col("x") / 100).cast("string")).alias("value"))
    ways = t.lines().select(F.concat(F.format_string('<way id="%d">', "id"), F.array_join(F.transform(F.sequence(F.lit(1), F.size("coords")), lambda i: F.concat(F.lit('<nd ref="'), (F.col("id") + i).cast("string"), F.lit('"/>'))), ""), F.when(F.col("id") % 2 == 0, '<tag k="building" v="yes"/>').otherwise('<tag k="highway" v="path"/>'), F.lit("</way>")).alias("value"))
    return etl.osm_polygons(etl.osm_nodes(nodes), etl.osm_ways(ways, "building"), (0.0, 0.0), (90.0, 90.0)).select("way", "line")


_OSM_SQL = ", w AS (SELECT id AS way, max(c) AS c FROM line_points WHERE c >= 2 AND id % 2 = 0 GROUP BY id), r AS (SELECT way, i AS place, way + i AS node FROM w, unnest(generate_series(1, c)) AS s(i)), j AS (SELECT way, place, CAST(p.x / 100 AS VARCHAR) || ' ' || CAST(p.y / 1000 AS VARCHAR) || ',' AS pair FROM r JOIN customer_pts p ON node = p.id WHERE p.x / 100 BETWEEN 0 AND 90 AND p.y / 1000 BETWEEN 0 AND 90) SELECT way, CAST(way AS VARCHAR) || ',\"POLYGON((' || string_agg(pair, '' ORDER BY place) || '))\"' AS line FROM j GROUP BY way"


def _kmeans(t: Tables) -> DataFrame:
    return aggregate.kmeans_step(t.customer(), CENTROIDS).select(F.col("cluster").cast("long").alias("cluster"), "n", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(F.col("dispersion") / 1e6, 3).alias("dispersion"))


_D2 = [f"(x - {a:.1f}::DOUBLE) * (x - {a:.1f}::DOUBLE) + (y - {b:.1f}::DOUBLE) * (y - {b:.1f}::DOUBLE)" for a, b in CENTROIDS]
_KMEANS_SQL = f", d AS (SELECT x, y, [{', '.join(_D2)}] AS ds FROM customer_pts), c AS (SELECT x, y, list_min(ds) AS d2, list_position(ds, list_min(ds)) - 1 AS cluster FROM d) SELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(sum(d2) / 1e6::DOUBLE, 3) AS dispersion FROM c GROUP BY cluster"


def _packing(t: Tables) -> DataFrame:
    loads = aggregate.hilbert_loads(t.order(), 0.0, 0.0, 640.0, 16)
    return aggregate.packed(loads, "h", 1000.0).groupBy("partition").agg(F.sum("n").alias("n"), F.count("*").alias("cells"))


def _co_occurring(t: Tables) -> DataFrame:
    cells = t.lines().select("id", F.explode(hilbert_cells(F.col("coords"), F.lit(False), 2500.0, 16)).alias("h"))
    return aggregate.co_occurring(cells, "id", "h").select(F.col("cell").alias("h"), "n", F.array_join(F.transform("others", lambda v: v.cast("string")), ",").alias("others"))


_CO_SQL = LINE_CELLS.format(w="2500.0::DOUBLE") + ", g AS (SELECT DISTINCT id, cx, cy FROM cells)" + steps(16).replace(" SELECT id, cx, cy, CASE", ", c AS (SELECT id, CASE", 1) + "), own AS (SELECT DISTINCT id, h FROM c WHERE h >= 0), p AS (SELECT DISTINCT a.h, b.h AS other FROM own a JOIN own b ON a.id = b.id WHERE a.h <> b.h) SELECT s.h, s.n, coalesce(q.others, '') AS others FROM (SELECT h, count(*) AS n FROM own GROUP BY h) s LEFT JOIN (SELECT h, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS others FROM p GROUP BY h) q ON s.h = q.h"


def _text_file(t: Tables) -> DataFrame:
    """Lines written as compressed text and read again."""
    path = new_folder(t.spark, "text")
    writers.write_lines(_text(t), path)
    return parsers.read_lines(t.spark, path)


def _state_plane(t: Tables) -> DataFrame:
    """Customers as degrees within a box around a station, projected."""
    at = t.customer().select("id", (F.col("x") / 1e5 - 74).alias("x"), (F.col("y") / 1e5 + 40.5).alias("y"))
    near = select.range_filter(at, (-74.0, 40.52), (-73.92, 40.59))
    return near.select("id", *[F.round(c, 3).alias(n) for n, c in zip(("east", "north"), etl.to_state_plane("x", "y"), strict=True)])


def _state_plane_sql() -> str:
    a, e, n, f, rho0 = etl.lambert_constants()
    d = lambda v: f"{v!r}::DOUBLE"
    own = f"pow(tan({d(math.pi / 4)} - radians(lat) / 2) / pow((1 - sin(radians(lat)) * {d(e)}) / (1 + sin(radians(lat)) * {d(e)}), {d(e / 2)}), {d(n)}) * {d(a * f)}"
    turn = f"(radians(lon) - {d(math.radians(-74.0))}) * {d(n)}"
    at = "(SELECT id, x / 1e5::DOUBLE - 74 AS lon, y / 1e5::DOUBLE + 40.5::DOUBLE AS lat FROM customer_pts)"
    return f"SELECT id, round(({own} * sin({turn}) + 300000) / {d(1200 / 3937)}, 3) AS east, round(({d(rho0)} - {own} * cos({turn})) / {d(1200 / 3937)}, 3) AS north FROM {at} WHERE lon BETWEEN -74.0::DOUBLE AND -73.92::DOUBLE AND lat BETWEEN 40.52::DOUBLE AND 40.59::DOUBLE"


_LOADS = ", l AS (SELECT greatest(0, least(15, CAST(floor(x / 640.0::DOUBLE) AS BIGINT))) AS cx, greatest(0, least(15, CAST(floor(y / 640.0::DOUBLE) AS BIGINT))) AS cy FROM order_pts), g AS (SELECT row_number() OVER () AS id, cx, cy FROM l)"
_PACKING_SQL = _LOADS + steps(16).replace(" SELECT id, cx, cy, CASE", ", c AS (SELECT CASE", 1) + "), k AS (SELECT h, count(*) AS n FROM c GROUP BY h), r AS (SELECT h, n, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k) SELECT CAST(floor(before / 1000.0::DOUBLE) AS BIGINT) AS partition, CAST(sum(n) AS BIGINT) AS n, count(*) AS cells FROM r GROUP BY 1"


def _lonlat(t: Tables) -> DataFrame:
    at = t.customer().select("id", curves.lonlat_hilbert(F.col("x") / 100, F.col("y") / 200, 64).alias("h"))
    lon, lat = curves.hilbert_lonlat("h", 64)
    return at.select("id", "h", lon.alias("lon"), lat.alias("lat"))


def _members(t: Tables) -> DataFrame:
    return aggregate.assigned(t.customer(), CENTROIDS).select("id", F.col("cluster").cast("long").alias("cluster"), F.round("d2", 4).alias("d2"))


def _matrix(t: Tables) -> DataFrame:
    log = t.event().select((F.col("id") % 16).alias("part"), F.hour("ts").alias("round"))
    return aggregate.load_matrix(log, "part", "round", range(4)).toDF("part", "r0", "r1", "r2", "r3")


QUERIES = {
    "attr_range_sql": (_of(_attribute), "SELECT id, x, y FROM customer_pts WHERE x > 1000 AND y <= 2000"),
    "index_persist_roundtrip": (_of(_index), "SELECT id, x, y FROM order_pts WHERE x BETWEEN 1000 AND 4000 AND y BETWEEN 1000 AND 5000"),
    "occupied_cell_filter": (_of(lambda t: select.boxes_with_data(t.boxes(), t.order()).select("id")), "SELECT id FROM supplier_boxes b WHERE EXISTS (SELECT 1 FROM order_pts o WHERE o.x BETWEEN xmin AND xmax AND o.y BETWEEN ymin AND ymax)"),
    "occupied_share": (_of(lambda t: select.occupied_share(t.boxes(), t.customer(), 400.0).select("id", F.round("p", 6).alias("p"))), ", g AS (SELECT b.id, cx, cy FROM supplier_boxes b, unnest(generate_series(CAST(floor(xmin / 400) AS BIGINT), CAST(floor(xmax / 400) AS BIGINT))) AS s(cx), unnest(generate_series(CAST(floor(ymin / 400) AS BIGINT), CAST(floor(ymax / 400) AS BIGINT))) AS q(cy)), o AS (SELECT DISTINCT CAST(floor(x / 400) AS BIGINT) AS cx, CAST(floor(y / 400) AS BIGINT) AS cy, 1 AS one FROM customer_pts) SELECT g.id, round(count(one)::DOUBLE / count(*)::DOUBLE, 6) AS p FROM g LEFT JOIN o ON g.cx = o.cx AND g.cy = o.cy GROUP BY g.id"),
    "upsert_points": (_of(lambda t: frame.upsert(_by_location(t), _changes(t))), _LOC + " SELECT coalesce(l.x, c.x) AS x, coalesce(l.y, c.y) AS y, coalesce(c.v, l.v) AS v FROM loc l FULL JOIN ch c ON l.x = c.x AND l.y = c.y"),
    "merge_points": (_of(lambda t: frame.upsert(_by_location(t), _changes(t), merge=lambda c, a, b: a + b, fresh=lambda c, b: -b)), _LOC + " SELECT coalesce(l.x, c.x) AS x, coalesce(l.y, c.y) AS y, CASE WHEN c.v IS NULL THEN l.v WHEN l.v IS NULL THEN -c.v ELSE l.v + c.v END AS v FROM loc l FULL JOIN ch c ON l.x = c.x AND l.y = c.y"),
    "delete_points": (_of(lambda t: frame.delete(t.part(), _changes(t))), _LOC + " SELECT id, x, y FROM part_pts p WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.x = p.x AND ch.y = p.y)"),
    "point_multiget": (_of(lambda t: select.multiget(t.part(), _changes(t)).select("id", "x", "y")), _LOC + " SELECT id, x, y FROM part_pts p WHERE EXISTS (SELECT 1 FROM ch WHERE ch.x = p.x AND ch.y = p.y)"),
    "capacity": (_of(lambda t: aggregate.capacity(t.order(), 500.0)), ", c AS (SELECT floor(x / 500) AS cx, floor(y / 500) AS cy, count(*) AS n FROM order_pts GROUP BY 1, 2) SELECT (SELECT min(x) FROM order_pts) AS xmin, (SELECT min(y) FROM order_pts) AS ymin, (SELECT max(x) FROM order_pts) AS xmax, (SELECT max(y) FROM order_pts) AS ymax, CAST(sum(n) AS BIGINT) AS points, count(*) AS cells, max(n) AS largest, 0::BIGINT AS longest FROM c"),
    "heatmap": (_of(lambda t: aggregate.heatmap(t.order())), "SELECT CAST(floor(x + 0.5::DOUBLE) AS BIGINT) AS x, CAST(floor(y + 0.5::DOUBLE) AS BIGINT) AS y, count(*) AS n FROM order_pts GROUP BY 1, 2"),
    "distinct_lines": (_of(lambda t: aggregate.line_counts(t.read("events").select(F.concat_ws(",", F.col("user_id").cast("string"), "event_type").alias("value")))), "SELECT count(*) AS lines, count(DISTINCT CAST(user_id AS VARCHAR) || ',' || event_type) AS distinct_lines FROM events"),
    "summary": (_of(lambda t: aggregate.summary(t.customer().withColumn("y", F.col("y").cast("long")), "y").withColumn("mean", F.round("mean", 6))), "SELECT min(CAST(y AS BIGINT)) AS least, max(CAST(y AS BIGINT)) AS most, CAST(sum(y) AS BIGINT) AS total, count(y) AS n, round(avg(y), 6) AS mean FROM customer_pts"),
    "bad_records": (_of(lambda t: aggregate.bad_records(t.customer().select(parsers.parser("three_part_line")(F.concat_ws(",", "id", "x", "y")).alias("p")), "p")), "SELECT count(*) AS bad FROM customer_pts WHERE x < 0 OR y < 0"),
    "log_matrix": (_of(_matrix), "SELECT id % 16 AS part, count(*) FILTER (hour(ts) = 0) AS r0, count(*) FILTER (hour(ts) = 1) AS r1, count(*) FILTER (hour(ts) = 2) AS r2, count(*) FILTER (hour(ts) = 3) AS r3 FROM event_pts GROUP BY 1"),
    "key_counts": (_of(lambda t: aggregate.key_counts(t.event(), "kind")), "SELECT kind, count(*) AS n FROM event_pts GROUP BY kind"),
    "by_location": (_of(lambda t: aggregate.by_location(t.part())), "SELECT x, y, count(*) AS n, min(id) AS first_id FROM part_pts GROUP BY x, y"),
    "co_occurring_cells": (_of(_co_occurring), _CO_SQL),
    "packing": (_of(_packing), _PACKING_SQL),
    "kmeans_step": (_of(_kmeans), _KMEANS_SQL),
    "compare_outputs": (_of(lambda t: compare.compared(*_results(t), 3)), _COMPARE_SQL),
    "compare_report": (_of(lambda t: compare.report_values(compare.report(compare.compared(*_results(t), 3)))), _REPORT_SQL),
    "kmeans_members": (_of(_members), f", d AS (SELECT id, [{', '.join(_D2)}] AS ds FROM customer_pts) SELECT id, CAST(list_position(ds, list_min(ds)) - 1 AS BIGINT) AS cluster, round(list_min(ds), 4) AS d2 FROM d"),
    "index_registry": (_of(_registry), "SELECT * FROM (VALUES ('a', 'rtree', 'x,y'), ('c', 'treap', 'x')) AS r(name, kind, columns)"),
    "frame_put_delete": (_of(_put_delete), _LOC + _PUT),
    "text_file": (_of(_text_file), _TEXT_SQL),
    "rank_buckets": (_of(lambda t: compare.rank_buckets(*_results(t))), "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN id % 10 = 2 OR x < 0 THEN 'no_match' ELSE '1' END AS bucket FROM supplier_pts) GROUP BY bucket"),
    "knn_text_output": (_of(_text), _TEXT_SQL),
    "parse_three_part_line": (_of(_parsed), "SELECT x, y, 'Bus_' || CAST(id AS VARCHAR) AS payload FROM customer_pts WHERE x >= 0 AND y >= 0"),
    "point_wkt": (_of(_wkt), "SELECT 'POINT(' || CAST(CAST(x AS DECIMAL(12,2)) AS VARCHAR) || ' ' || CAST(CAST(y AS DECIMAL(12,2)) AS VARCHAR) || ')' AS value, CAST(CAST(x AS DECIMAL(12,2)) AS DOUBLE) AS x, CAST(CAST(y AS DECIMAL(12,2)) AS DOUBLE) AS y FROM customer_pts"),
    "osm_polygons": (_of(_osm), _OSM_SQL),
    "enumerate_split": (_of(lambda t: etl.enumerate_split(t.order(), "id", name="Orders").select("id", "row_id")), "SELECT id, 'Orders_' || CASE WHEN n <= 1000000 THEN 'A_' || CAST(n AS VARCHAR) ELSE 'B_' || CAST(n - 1000000 AS VARCHAR) END AS row_id FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM order_pts)"),
    "prefix_records": (_of(lambda t: joins.prefix_records(t.read("part").select(F.col("p_type").alias("value")), t.read("customer").select(F.col("c_mktsegment").alias("value")), "M")), "SELECT 1 AS file, p_type AS value FROM part WHERE starts_with(p_type, 'M') UNION ALL SELECT 2 AS file, c_mktsegment AS value FROM customer WHERE starts_with(c_mktsegment, 'M')"),
    "extract_records": (_of(lambda t: etl.extract(t.order(), [1, 2, 3, 500, 70000])), "SELECT id, x, y FROM order_pts WHERE id IN (1, 2, 3, 500, 70000)"),
    "sample_locations": (_of(lambda t: etl.sample_rows(t.part(), 500, 7)), None),
    "line_boxes": (_of(lambda t: parsers.line_boxes(t.lines(), 150.0)), "SELECT id, min(x) - 150 AS xmin, min(y) - 150 AS ymin, max(x) + 150 AS xmax, max(y) + 150 AS ymax FROM line_points WHERE c >= 2 GROUP BY id"),
    "state_plane": (_of(_state_plane), _state_plane_sql()),
    "lonlat_hilbert": (_of(_lonlat), lonlat_sql(64)),
}
