"""Selections, point lookups, cells, curves and scalar geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.functions import curves, util
from terrella.functions import geometry as G
from terrella.operators import aggregate, select
from terrella.operators.select import Where
from terrella.queries.tables import Tables
from terrella.sources import parsers

#: A fixed query point of 64 dimensions.
POINT_64 = [((i * 37) % 11 - 5) / 10 for i in range(64)]


def _of(body):  # noqa: ANN001, ANN202
    return lambda spark, sf_dir: body(Tables(spark, sf_dir))


def _box_measures(t: Tables) -> DataFrame:
    a = t.boxes().select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    fixed = G.Box.of(1000.0, 2000.0, 4000.0, 6000.0)
    box = G.Box.of("a_xmin", "a_ymin", "a_xmax", "a_ymax")
    cx, cy = box.centre()
    return a.select(
        F.col("a").alias("id"), box.intersects(fixed).alias("meets"), fixed.wraps(box).alias("wrapped"), box.contains(1500.0, 2500.0).alias("holds"), F.round(box.distance(fixed), 6).alias("apart"), F.round(box.gap(fixed), 6).alias("gap"),
        F.round(box.point_distance(0.0, 0.0), 6).alias("near"), F.round(box.farthest(0.0, 0.0), 6).alias("far"), F.round(box.area(), 4).alias("area"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"),
        F.round(box.intersection_area(fixed), 4).alias("common"), F.round(box.union(fixed).area(), 4).alias("joint"), F.round(box.overlap_ratio(fixed), 6).alias("ratio"), F.round(box.grown_area(fixed), 4).alias("grown"),
    )


_BOX_SQL = """, b AS (SELECT id, xmin, ymin, xmax, ymax, xmin <= 4000.0::DOUBLE AND 1000.0::DOUBLE <= xmax AND ymin <= 6000.0::DOUBLE AND 2000.0::DOUBLE <= ymax AS meets,
  greatest(1000.0::DOUBLE - xmax, xmin - 4000.0::DOUBLE, 0.0::DOUBLE) AS gx, greatest(2000.0::DOUBLE - ymax, ymin - 6000.0::DOUBLE, 0.0::DOUBLE) AS gy,
  greatest(0.0::DOUBLE - xmax, xmin, 0.0::DOUBLE) AS nx, greatest(0.0::DOUBLE - ymax, ymin, 0.0::DOUBLE) AS ny, greatest(abs(0 - xmin), abs(0 - xmax)) AS fx, greatest(abs(0 - ymin), abs(0 - ymax)) AS fy,
  (least(xmax, 4000.0::DOUBLE) - greatest(xmin, 1000.0::DOUBLE)) * (least(ymax, 6000.0::DOUBLE) - greatest(ymin, 2000.0::DOUBLE)) AS cut,
  (greatest(xmax, 4000.0::DOUBLE) - least(xmin, 1000.0::DOUBLE)) * (greatest(ymax, 6000.0::DOUBLE) - least(ymin, 2000.0::DOUBLE)) AS whole, (xmax - xmin) * (ymax - ymin) AS own FROM supplier_boxes)
SELECT id, meets, 1000 < xmin AND 2000 < ymin AND 4000 > xmax AND 6000 > ymax AS wrapped, 1500 BETWEEN xmin AND xmax AND 2500 BETWEEN ymin AND ymax AS holds,
  round(sqrt(gx * gx + gy * gy), 6) AS apart, round(least(gx, gy), 6) AS gap, round(sqrt(nx * nx + ny * ny), 6) AS near, round(sqrt(fx * fx + fy * fy), 6) AS far, round(own, 4) AS area, round((xmin + xmax) / 2, 6) AS cx, round((ymin + ymax) / 2, 6) AS cy,
  round(CASE WHEN meets THEN cut ELSE 0.0::DOUBLE END, 4) AS common, round(whole, 4) AS joint, round(CASE WHEN xmin < 4000 AND 1000 < xmax AND ymin < 6000 AND 2000 < ymax THEN cut / own ELSE 0.0::DOUBLE END, 6) AS ratio, round(whole - own, 4) AS grown FROM b"""


def _circle_measures(t: Tables) -> DataFrame:
    c, d, box = G.Circle.of("x", "y", 750.0), G.Circle.of(3000.0, 4000.0, 1000.0), G.Box.of(1000.0, 2000.0, 4000.0, 6000.0)
    return t.supplier().select("id", c.contains(3000.0, 4000.0).alias("holds"), c.intersects_box(box).alias("meets_box"), c.intersects_circle(d).alias("meets_circle"), F.round(c.point_distance(3000.0, 4000.0), 6).alias("to_point"), F.round(c.box_distance(box), 6).alias("to_box"), F.round(c.circle_distance(d), 6).alias("to_circle"), F.round(c.box().xmin, 6).alias("xmin"), F.round(c.box().ymax, 6).alias("ymax"))


_CIRCLE_SQL = """, c AS (SELECT id, x, y, (x - 3000) * (x - 3000) + (y - 4000) * (y - 4000) AS d2, greatest(1000.0::DOUBLE - x, x - 4000.0::DOUBLE, 0.0::DOUBLE) AS gx, greatest(2000.0::DOUBLE - y, y - 6000.0::DOUBLE, 0.0::DOUBLE) AS gy FROM supplier_pts)
SELECT id, d2 <= 562500 AS holds, sqrt(gx * gx + gy * gy) <= 750 AS meets_box, sqrt(d2) <= 1750 AS meets_circle, round(greatest(0.0::DOUBLE, sqrt(d2) - 750), 6) AS to_point, round(greatest(0.0::DOUBLE, sqrt(gx * gx + gy * gy) - 750), 6) AS to_box, round(greatest(0.0::DOUBLE, sqrt(d2) - 750 - 1000), 6) AS to_circle, round(x - 750, 6) AS xmin, round(y + 750, 6) AS ymax FROM c"""


def _segment_measures(t: Tables) -> DataFrame:
    cut = parsers.segments(t.lines())
    s = F.struct("x1", "y1", "x2", "y2")
    box, circle = G.segment_box(s), G.Circle.of(5000.0, 5000.0, 2000.0)
    return cut.select("id", "n", F.round(G.segment_point_distance(s, 5000.0, 5000.0), 6).alias("to_point"), G.segment_circle_intersects(s, circle).alias("meets_circle"), F.round(G.segment_circle_distance(s, circle), 6).alias("to_circle"), F.round(box.xmin, 6).alias("xmin"), F.round(box.ymax, 6).alias("ymax"))


_SEGMENT_SQL = """, s AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, 5000.0::DOUBLE - x1 AS px, 5000.0::DOUBLE - y1 AS py FROM line_segments WHERE x2 IS NOT NULL),
p AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (px * dx + py * dy) / (dx * dx + dy * dy))) END AS t FROM s),
d AS (SELECT *, (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy) AS d2 FROM p)
SELECT id, n, round(sqrt(d2), 6) AS to_point, d2 <= 4000000 AS meets_circle, round(greatest(0.0::DOUBLE, sqrt(d2) - 2000), 6) AS to_circle, round(least(x1, x2), 6) AS xmin, round(greatest(y1, y2), 6) AS ymax FROM d"""


def _hilbert(t: Tables) -> DataFrame:
    at = t.order().select("id", curves.cell("x", 40.0).alias("cx"), curves.cell("y", 40.0).alias("cy"))
    return at.select("id", "cx", "cy", curves.hilbert("cx", "cy", 256).alias("h"))


def _hilbert_roundtrip(t: Tables) -> DataFrame:
    h = _hilbert(t)
    x, y = curves.hilbert_decode("h", 256)
    return h.where("h >= 0").select("id", x.alias("cx"), y.alias("cy"), F.size(curves.hilbert_neighbours("h", 256)).cast("long").alias("around"))


def steps(n: int) -> str:
    """Hilbert index by one select for each bit."""
    out, size, prev = ", h0 AS (SELECT id, cx, cy, cx AS x, cy AS y, 0::BIGINT AS d FROM g)", n, 0
    while size > 1:
        half = size // 2
        prev += 1
        out += f""", h{prev} AS (SELECT id, cx, cy, CASE WHEN ry = 0 THEN fy ELSE mx END AS x, CASE WHEN ry = 0 THEN fx ELSE my END AS y, d + {half * half} * xor(3 * rx, ry) AS d FROM (
          SELECT *, CASE WHEN rx = 1 THEN {half - 1} - mx ELSE mx END AS fx, CASE WHEN rx = 1 THEN {half - 1} - my ELSE my END AS fy FROM (SELECT *, (x // {half}) % 2 AS rx, (y // {half}) % 2 AS ry, x % {half} AS mx, y % {half} AS my FROM h{prev - 1})))"""
        size = half
    return out + f" SELECT id, cx, cy, CASE WHEN cx < 0 OR cy < 0 OR cx >= {n} OR cy >= {n} THEN -1 ELSE d END::BIGINT AS h FROM h{prev}"


def lonlat_sql(n: int) -> str:
    """Hilbert index of degrees, and the middle of its cell."""
    cells = f", g AS (SELECT id, greatest(0, least({n - 1}, CAST(floor((x / 100 + 180) / 360 * {n}) AS BIGINT))) AS cx, greatest(0, least({n - 1}, CAST(floor((y / 200 + 90) / 180 * {n}) AS BIGINT))) AS cy FROM customer_pts)"
    indexed = steps(n).replace(" SELECT id, cx, cy, CASE", ", c AS (SELECT id, cx, cy, CASE", 1) + ")"
    return cells + indexed + f" SELECT id, h, (cx + 0.5::DOUBLE) / {n} * 360 - 180 AS lon, (cy + 0.5::DOUBLE) / {n} * 180 - 90 AS lat FROM c"


_CELLS = ", g AS (SELECT id, CAST(floor(x / 40.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 40.0::DOUBLE) AS BIGINT) AS cy FROM order_pts)"
_MORTON = _CELLS + " SELECT id, CAST(" + " + ".join(f"((((cx >> {b}) & 1) << {2 * b + 1}) + (((cy >> {b}) & 1) << {2 * b}))" for b in range(10)) + " AS BIGINT) AS z, cx, cy FROM g"


def _morton(t: Tables) -> DataFrame:
    at = t.order().select("id", curves.cell("x", 40.0).alias("gx"), curves.cell("y", 40.0).alias("gy")).withColumn("z", curves.morton("gx", "gy", 10))
    cx, cy = curves.morton_decode("z", 10)
    return at.select("id", "z", cx.alias("cx"), cy.alias("cy"))


def _utilities(t: Tables) -> DataFrame:
    both = util.spread("x", "y")
    return t.order().select("id", F.round(util.log_base(F.col("x"), 2.0), 6).alias("log2"), util.nth_index(F.col("x").cast("string"), ".", 1).cast("long").alias("dot"), util.half_up("x").alias("whole"), util.floor_text(util.fixed("x").cast("string")).alias("floored"), F.lit(util.size_bytes("1.5g")).alias("size"), both["least"].alias("least"), both["most"].alias("most"), both["apart"].alias("apart"))


def _lookup(t: Tables) -> DataFrame:
    """All parts at the locations of three of them."""
    at = t.part().where(F.col("id").isin(1, 7, 42)).select("x", "y").collect()
    return select.lookup(t.part(), [(r["x"], r["y"]) for r in at]).select("id", "x", "y")


_XYD = "(x - 5000) * (x - 5000) + (y - 4800) * (y - 4800)"

QUERIES = {
    "range_select": (_of(lambda t: select.range_filter(t.customer(), (0, 1000), (5000, 6000))), "SELECT id, x, y FROM customer_pts WHERE x BETWEEN 0 AND 5000 AND y BETWEEN 1000 AND 6000"),
    "circle_select": (_of(lambda t: select.circle_filter(t.customer(), (5000, 4800), 2000)), f"SELECT id, x, y FROM customer_pts WHERE {_XYD} <= 4000000"),
    "circles_and_select": (_of(lambda t: select.circles_filter(t.customer(), [(5000, 4800, 2000), (4000, 4000, 1500)])), f"SELECT id, x, y FROM customer_pts WHERE {_XYD} <= 4000000 AND (x - 4000) * (x - 4000) + (y - 4000) * (y - 4000) <= 2250000"),
    "circle_count": (_of(lambda t: select.circle_filter(t.customer(), (5000, 4800), 2000).agg(F.count("*").alias("n"))), f"SELECT count(*) AS n FROM customer_pts WHERE {_XYD} <= 4000000"),
    "knn_select": (_of(lambda t: select.knn_filter(t.customer(), (5000, 4800), 10).withColumn("distance", F.round("distance", 6))), f"SELECT id, x, y, round(sqrt({_XYD}), 6) AS distance FROM customer_pts ORDER BY {_XYD}, id LIMIT 10"),
    "knn_select_nd": (_of(lambda t: select.knn_filter_nd(t.read("embeddings"), POINT_64, 10, "embedding", "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))), ", e AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, [" + ", ".join(f"{v}::DOUBLE" for v in POINT_64) + "]), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) AS d2 FROM embeddings) SELECT vec_id, round(sqrt(d2), 6) AS distance FROM e ORDER BY d2, vec_id LIMIT 10"),
    "knn_keep_ties": (_of(lambda t: select.knn_filter(t.part(), (25, 1000), 7, keep_ties=True).select("id", "x", "y")), "SELECT id, x, y FROM (SELECT *, rank() OVER (ORDER BY (x - 25) * (x - 25) + (y - 1000) * (y - 1000)) AS r FROM part_pts) WHERE r <= 7"),
    "knn_and_range": (_of(lambda t: (Where.knn((5000, 4800), 50) & Where.range((4500, 4000), (9000, 9000))).apply(t.customer())), f"SELECT id, x, y FROM (SELECT *, row_number() OVER (ORDER BY {_XYD}, id) AS r FROM customer_pts) WHERE r <= 50 AND x BETWEEN 4500 AND 9000 AND y BETWEEN 4000 AND 9000"),
    "knn_or_circle": (_of(lambda t: (Where.knn((5000, 4800), 50) | Where.circle((2000, 2000), 500)).apply(t.customer())), f"SELECT id, x, y FROM (SELECT *, row_number() OVER (ORDER BY {_XYD}, id) AS r FROM customer_pts) WHERE r <= 50 OR (x - 2000) * (x - 2000) + (y - 2000) * (y - 2000) <= 250000"),
    "not_knn": (_of(lambda t: (~Where.knn((5000, 4800), 50)).apply(t.customer())), f"SELECT id, x, y FROM (SELECT *, row_number() OVER (ORDER BY {_XYD}, id) AS r FROM customer_pts) WHERE r > 50"),
    "two_knn_intersect": (_of(lambda t: (Where.knn((5000, 4800), 200) & Where.knn((5500, 5000), 200)).apply(t.customer())), f"SELECT id, x, y FROM (SELECT *, row_number() OVER (ORDER BY {_XYD}, id) AS r, row_number() OVER (ORDER BY (x - 5500) * (x - 5500) + (y - 5000) * (y - 5000), id) AS q FROM customer_pts) WHERE r <= 200 AND q <= 200"),
    "text_range_filter": (_of(lambda t: select.text_range_filter(t.customer_text(), (0, 0), (6000, 6000), "text", ("build", "auto"), ("MACH",))), "SELECT id, x, y, text FROM customer_pts WHERE x BETWEEN 0 AND 6000 AND y BETWEEN 0 AND 6000 AND (contains(lower(text), 'build') OR contains(lower(text), 'auto') OR contains(text, 'MACH'))"),
    "knn_filtered": (_of(lambda t: select.knn_filter(t.customer_text(), (5000, 4800), 10, where=F.col("text") == "BUILDING").select("id", F.round("distance", 6).alias("distance"))), f"SELECT id, round(sqrt({_XYD}), 6) AS distance FROM customer_pts WHERE text = 'BUILDING' ORDER BY {_XYD}, id LIMIT 10"),
    "nearest_one": (_of(lambda t: select.nearest(t.order(), (5000, 4800)).select("id")), f"SELECT id FROM order_pts ORDER BY {_XYD}, id LIMIT 1"),
    "key_rank": (_of(lambda t: select.rank_of(t.part(), "y", 1200.0)), "SELECT count(*) AS rank FROM part_pts WHERE y <= 1200"),
    "point_lookup": (_of(_lookup), "SELECT id, x, y FROM part_pts p WHERE EXISTS (SELECT 1 FROM part_pts q WHERE q.id IN (1, 7, 42) AND q.x = p.x AND q.y = p.y)"),
    "selective_range": (_of(lambda t: select.selective_range(t.customer(), (0, 1000), (2000, 4000), 0.5).withColumn("of", F.lit("few")).unionByName(select.selective_range(t.customer(), (-1000, 0), (10000, 9600), 0.5).withColumn("of", F.lit("many")))), "SELECT id, x, y, 'few' AS of FROM customer_pts WHERE x BETWEEN 0 AND 2000 AND y BETWEEN 1000 AND 4000"),
    "knn_metric": (_of(lambda t: select.knn_filter(t.customer(), (0, 0), 10, metric=F.abs(F.col("x") - 5000) + F.abs(F.col("y") - 4800)).withColumn("distance", F.round("distance", 6))), "SELECT id, x, y, round(abs(x - 5000) + abs(y - 4800), 6) AS distance FROM customer_pts ORDER BY abs(x - 5000) + abs(y - 4800), id LIMIT 10"),
    "fold_range": (_of(lambda t: select.fold_in(t.customer(), (0, 1000), (5000, 6000), F.count("*").alias("n"), F.max("id").alias("most"), F.sum(F.round(F.col("x") * 100).cast("long")).alias("cents"))), "SELECT count(*) AS n, max(id) AS most, CAST(sum(CAST(round(x * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer_pts WHERE x BETWEEN 0 AND 5000 AND y BETWEEN 1000 AND 6000"),
    "boxes_in_range": (_of(lambda t: select.shapes_in(t.boxes(), G.Box.of(), (1000, 2000), (4000, 6000))), "SELECT * FROM supplier_boxes WHERE xmin <= 4000 AND xmax >= 1000 AND ymin <= 6000 AND ymax >= 2000"),
    "mbr_stats": (_of(lambda t: select.bounds(t.order())), "SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, count(*) AS n FROM order_pts"),
    "cell_histogram": (_of(lambda t: aggregate.cell_histogram(t.order(), 500.0)), "SELECT CAST(floor(x / 500.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(y / 500.0::DOUBLE) AS BIGINT) AS cy, count(*) AS n FROM order_pts GROUP BY 1, 2"),
    "box_measures": (_of(_box_measures), _BOX_SQL),
    "circle_measures": (_of(_circle_measures), _CIRCLE_SQL),
    "segment_measures": (_of(_segment_measures), _SEGMENT_SQL),
    "segments": (_of(lambda t: parsers.segments(t.lines())), "SELECT id, n, x1, y1, x2, y2 FROM line_segments WHERE x2 IS NOT NULL"),
    "hilbert_index": (_of(_hilbert), _CELLS + steps(256)),
    "hilbert_roundtrip": (_of(_hilbert_roundtrip), _CELLS + " SELECT id, cx, cy, CAST(8 - 3 * ((cx IN (0, 255))::INTEGER + (cy IN (0, 255))::INTEGER) + ((cx IN (0, 255)) AND (cy IN (0, 255)))::INTEGER AS BIGINT) AS around FROM g WHERE cx BETWEEN 0 AND 255 AND cy BETWEEN 0 AND 255"),
    "morton_index": (_of(_morton), _MORTON),
    "utilities": (_of(_utilities), "SELECT id, round(ln(x) / ln(2.0::DOUBLE), 6) AS log2, CAST(instr(CAST(x AS VARCHAR), '.') - 1 AS BIGINT) AS dot, CAST(floor(x + 0.5::DOUBLE) AS BIGINT) AS whole, CAST(floor(CAST(x AS DECIMAL(12,2))) AS BIGINT) AS floored, 1500000000 AS size, least(x, y) AS least, greatest(x, y) AS most, abs(x - y) AS apart FROM order_pts"),
}
