"""Joins: nearest neighbours, distances, boxes, shapes and times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.operators import joins
from terrella.queries.tables import Tables
from terrella.sources import parsers


#: Shifts of the registered approximate join; its recall against the exact one is tested.
ZKNN_SHIFTS = 4


def _of(body):  # noqa: ANN001, ANN202
    return lambda spark, sf_dir: body(Tables(spark, sf_dir))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("l_id", "r_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


def _knn_sql(left: str, right: str, k: int, where: str = "TRUE", tag: str = "") -> str:
    return f"SELECT l_id, r_id, rank, round(sqrt(d2), 6) AS distance{tag} FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY d2, r_id) AS rank FROM (SELECT l.id AS l_id, r.id AS r_id, (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) AS d2 FROM {left} l, {right} r WHERE {where})) WHERE rank <= {k}"


def _nested(t: Tables) -> DataFrame:
    found = joins.knn_join_nested(t.supplier(), t.customer(), 4)
    return found.select("id", F.array_join(F.transform("neighbours", lambda n: n["id"].cast("string")), ",").alias("neighbours"))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("l_id", "r_id", F.round("distance", 6).alias("distance"))


def _collect(t: Tables) -> DataFrame:
    found = joins.range_join_collect(t.customer(), t.boxes())
    return found.select("id", F.array_join(F.col("held").cast("array<string>"), ",").alias("ids"))


def _aggregate(t: Tables, *aggregates) -> DataFrame:  # noqa: ANN002
    return joins.range_join_aggregate(t.customer(), t.boxes(), list(aggregates)).drop("xmin", "ymin", "xmax", "ymax")


def _polygons(t: Tables) -> DataFrame:
    shapes = t.polygons().select(F.col("id").alias("payload"), F.col("ring").alias("coords"), F.lit(True).alias("area"))
    points = parsers.shapes(t.customer().withColumnRenamed("id", "payload"), "point")
    from terrella.functions.geometry import polygon_contains

    near = joins.shape_pairs(shapes, points)
    return near.where(polygon_contains(F.col("l_coords"), F.col("r_coords")[0]["x"], F.col("r_coords")[0]["y"])).select(F.col("l_payload").alias("polygon"), F.col("r_payload").cast("long").alias("point"))


def line_sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    lines = parsers.shapes(t.lines().withColumnRenamed("id", "payload"), "line")
    return lines, parsers.shapes(t.customer().withColumnRenamed("id", "payload"), "point")


def _listed(df: DataFrame) -> DataFrame:
    return df.select(F.col("payload").cast("long").alias("point"), F.posexplode("matches").alias("place", "m")).select("point", (F.col("place") + 1).cast("long").alias("rank"), F.col("m.payload").alias("line"), F.round("m.distance", 4).alias("distance"))


LINE_MATCH = """, seg AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM line_segments WHERE x2 IS NOT NULL),
box AS (SELECT id, min(x) - 150 AS xmin, min(y) - 150 AS ymin, max(x) + 150 AS xmax, max(y) + 150 AS ymax FROM line_points WHERE c >= 2 GROUP BY id),
cand AS (SELECT b.id AS line, p.id AS point, p.x AS px, p.y AS py FROM box b, customer_pts p WHERE p.x BETWEEN xmin AND xmax AND p.y BETWEEN ymin AND ymax),
dist AS (SELECT line, point, min(ex * ex + ey * ey) AS d2 FROM (SELECT line, point, px - x1 - t * dx AS ex, py - y1 - t * dy AS ey FROM (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))) END AS t FROM cand JOIN seg ON line = id)) GROUP BY line, point),
ranked AS (SELECT point, row_number() OVER (PARTITION BY point ORDER BY d2, CAST(line AS VARCHAR)) AS rank, CAST(line AS VARCHAR) AS line, sqrt(d2) AS d FROM dist WHERE {where})
SELECT point, rank, line, round(d, 4) AS distance FROM ranked WHERE rank <= 3"""


def _times(t: Tables) -> DataFrame:
    e = t.event()
    pick = lambda kind: e.where(F.col("kind") == kind).select("id", "x", "y", "ts")
    stations = t.supplier().select("id", (F.col("x") / 2).alias("x"), (F.col("y") / 2).alias("y"))
    return joins.spatiotemporal_match(pick("click"), stations, pick("purchase"), 200.0, 300.0, 3_600.0).withColumn("minutes", F.round("minutes", 4))


_TIME_SQL = """, st AS (SELECT id, x / 2 - 200 AS xmin, x / 2 + 200 AS xmax, y / 2 - 300 AS ymin, y / 2 + 300 AS ymax FROM supplier_pts),
near AS (SELECT e.id, e.ts, e.kind, min(st.id) AS station FROM event_pts e JOIN st ON e.x BETWEEN xmin AND xmax AND e.y BETWEEN ymin AND ymax GROUP BY e.id, e.ts, e.kind)
SELECT a.id AS event, a.station, b.id AS other, round((epoch_us(b.ts) - epoch_us(a.ts))::DOUBLE / 60000000, 4) AS minutes FROM near a JOIN near b ON a.station = b.station AND a.kind = 'click' AND b.kind = 'purchase'
WHERE epoch_us(b.ts) - epoch_us(a.ts) > 0 AND epoch_us(b.ts) - epoch_us(a.ts) <= 3600000000"""

_INSIDE = "FROM customer_pts c WHERE {no} EXISTS (SELECT 1 FROM supplier_boxes b WHERE c.x BETWEEN xmin AND xmax AND c.y BETWEEN ymin AND ymax)"
_IN = "FROM supplier_boxes b LEFT JOIN customer_pts c ON c.x BETWEEN xmin AND xmax AND c.y BETWEEN ymin AND ymax GROUP BY b.id"
_DIST = "SELECT l.id AS l_id, r.id AS r_id, round(sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)), 6) AS distance FROM {l} l, {r} r WHERE (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) <= {r2}"


def _nd(t: Tables) -> DataFrame:
    e = t.read("embeddings")
    return joins.knn_join_nd(e.where("vec_id % 50 = 0"), e, 5, "embedding", "embedding", "vec_id", "vec_id").select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("distance", 5).alias("distance"))


def _solid(t: Tables) -> DataFrame:
    """Pairs that are near in the first four dimensions."""
    e = t.read("embeddings").select(F.col("vec_id").cast("long").alias("id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("abcd")])
    return _pairs(joins.distance_join(e, e, 0.1, ("a", "b", "c", "d")))


_SOLID_D2 = "(" + " + ".join(f"(l.{c} - r.{c}) * (l.{c} - r.{c})" for c in "abcd") + ")"
_SOLID_SQL = f", e AS (SELECT vec_id, {', '.join(f'embedding[{i}]::DOUBLE AS {c}' for i, c in enumerate('abcd', 1))} FROM embeddings) SELECT l.vec_id AS l_id, r.vec_id AS r_id, round(sqrt({_SOLID_D2}), 6) AS distance FROM e l, e r WHERE {_SOLID_D2} <= 0.1::DOUBLE * 0.1::DOUBLE"
_ND_SQL = """, p AS (SELECT q.vec_id AS query, d.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d2 FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0)
SELECT query, id, rank, round(sqrt(d2), 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, id) AS rank FROM p) WHERE rank <= 5"""

QUERIES = {
    "knn_join": (_of(lambda t: _flat(joins.knn_join(t.supplier(), t.customer(), 3))), _knn_sql("supplier_pts", "customer_pts", 3)),
    "knn_join_orders": (_of(lambda t: _flat(joins.knn_join(t.customer(), t.order(), 10))), _knn_sql("customer_pts", "order_pts", 10)),
    "knn_self_join": (_of(lambda t: _flat(joins.knn_join(t.part(), t.part(), 5))), _knn_sql("part_pts", "part_pts", 5)),
    "knn_join_nested": (_of(_nested), ", k AS (" + _knn_sql("supplier_pts", "customer_pts", 4) + ") SELECT l_id AS id, string_agg(CAST(r_id AS VARCHAR), ',' ORDER BY rank) AS neighbours FROM k GROUP BY l_id"),
    "all_knn_join": (_of(lambda t: joins.all_knn_join(t.supplier(), t.customer(), 3).select("side", "l_id", "r_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))), _knn_sql("supplier_pts", "customer_pts", 3, tag=", 'ab' AS side") + " UNION ALL " + _knn_sql("customer_pts", "supplier_pts", 3, tag=", 'ba' AS side")),
    "knn_join_filtered": (_of(lambda t: _flat(joins.knn_join(t.supplier(), t.customer_text(), 3, where=F.col("text") == "BUILDING"))), _knn_sql("supplier_pts", "customer_pts", 3, "r.text = 'BUILDING'")),
    "knn_join_nd": (_of(_nd), _ND_SQL),
    "zknn_join": (_of(lambda t: joins.zknn_join(t.customer(), t.order(), 5, shifts=ZKNN_SHIFTS).select("l_id", "r_id", "rank", "distance")), None),
    "distance_join": (_of(lambda t: _pairs(joins.distance_join(t.supplier(), t.customer(), 500.0))), _DIST.format(l="supplier_pts", r="customer_pts", r2=250000)),
    "distance_self_join": (_of(lambda t: _pairs(joins.distance_join(t.part(), t.part(), 3.0))), _DIST.format(l="part_pts", r="part_pts", r2=9)),
    "distance_join_orders": (_of(lambda t: joins.distance_join(t.order(), t.order(), 100.0).agg(F.count("*").alias("n"), F.count_distinct("l_id").alias("ids"))), ", p AS (" + _DIST.format(l="order_pts", r="order_pts", r2=10000) + ") SELECT count(*) AS n, count(DISTINCT l_id) AS ids FROM p"),
    "distance_join_nd": (_of(_solid), _SOLID_SQL),
    "zero_distance_join": (_of(lambda t: _pairs(joins.distance_join(t.part(), t.part(), 0.0))), "SELECT l.id AS l_id, r.id AS r_id, 0.0::DOUBLE AS distance FROM part_pts l JOIN part_pts r ON l.x = r.x AND l.y = r.y"),
    "semi_join_boxes": (_of(lambda t: joins.semi_join(t.customer(), t.boxes())), "SELECT id, x, y " + _INSIDE.format(no="")),
    "anti_join_boxes": (_of(lambda t: joins.semi_join(t.customer(), t.boxes(), anti=True)), "SELECT id, x, y " + _INSIDE.format(no="NOT")),
    "range_join": (_of(lambda t: joins.range_join(t.order(), t.boxes()).select("l_id", "r_id")), "SELECT o.id AS l_id, b.id AS r_id FROM order_pts o, supplier_boxes b WHERE o.x BETWEEN xmin AND xmax AND o.y BETWEEN ymin AND ymax"),
    "range_join_count": (_of(lambda t: _aggregate(t, F.count("l_id").alias("n"))), f"SELECT b.id, count(c.id) AS n {_IN}"),
    "range_join_orders_count": (_of(lambda t: joins.range_join_aggregate(t.order(), t.boxes(), [F.count("l_id").alias("n")]).select("id", "n")), f"SELECT b.id, count(c.id) AS n {_IN.replace('customer_pts', 'order_pts')}"),
    "range_join_sum": (_of(lambda t: _aggregate(t, F.coalesce(F.sum(F.round(F.col("l_x") * 100).cast("long")), F.lit(0)).alias("cents"), F.min("l_x").alias("least"))), f"SELECT b.id, CAST(coalesce(sum(CAST(round(c.x * 100) AS BIGINT)), 0) AS BIGINT) AS cents, min(c.x) AS least {_IN}"),
    "range_join_collect": (_of(_collect), f"SELECT b.id, coalesce(string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.id), '') AS ids {_IN}"),
    "poly_contains_join": (_of(_polygons), "SELECT p.id AS polygon, c.id AS point FROM nation_polys p, customer_pts c WHERE abs(c.x - cx) / 600 + abs(c.y - cy) / 900 < 1"),
    "line_map_match_knn": (_of(lambda t: _listed(joins.match_knn(*line_sets(t), k=3))), LINE_MATCH.format(where="TRUE")),
    "line_map_match_distance": (_of(lambda t: _listed(joins.match_distance(*line_sets(t), k=3, max_distance=100.0))), LINE_MATCH.format(where="d2 <= 10000")),
    "spatiotemporal_match": (_of(_times), _TIME_SQL),
}
