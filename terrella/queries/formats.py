"""Line formats: every parser, readers of WKT and of results, and the writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrella.functions import geometry as G
from terrella.operators import compare, joins
from terrella.queries.matching import LINE_MATCH, line_sets
from terrella.queries.tables import Tables
from terrella.sources import parsers, writers


def _of(body):  # noqa: ANN001, ANN202
    return lambda spark, sf_dir: body(Tables(spark, sf_dir))


#: Codes of the parsers that read the n-th field: n, and whether coordinates must be positive, are swapped, and the line is lower-cased.
_FIELDS = {
    "tpep_point": (2, False, False, True), "tpep_point_WGS84": (2, False, False, True), "Taxi_Point": (5, True, False, True), "Taxi_Point_WGS84": (5, False, False, True), "Bus_Point": (1, False, False, True),
    "Bus_Point_Shifted": (1, False, False, True), "Bus_Point_WGS84": (1, False, True, False), "POI_NYC": (10, False, False, False),
}


def _decimal(c: Column) -> Column:
    return c.cast("decimal(12,2)").cast("string")


def _lines(t: Tables, head: Column, tail: Column) -> DataFrame:
    """Lines with a bad number in some and a missing field in others."""
    x = F.when(F.col("id") % 10 == 4, "x1").otherwise(_decimal(F.col("x")))
    return t.customer().select("id", F.concat(head, x, F.lit(","), _decimal(F.col("y")), F.when(F.col("id") % 10 == 3, "").otherwise(tail)).alias("value"))


_X, _Y = ["CAST(CAST({c} AS DECIMAL(12,2)) AS VARCHAR)".format(c=c) for c in "xy"]
_VALUE = f"{{head}} || CASE WHEN id % 10 = 4 THEN 'x1' ELSE {_X} END || ',' || {_Y} || CASE WHEN id % 10 = 3 THEN '' ELSE '{{tail}}' END"
_NUMBERS = "CAST(CAST(x AS DECIMAL(12,2)) AS DOUBLE) AS x, CAST(CAST(y AS DECIMAL(12,2)) AS DOUBLE) AS y"
_SWAPPED = "CAST(CAST(y AS DECIMAL(12,2)) AS DOUBLE) AS x, CAST(CAST(x AS DECIMAL(12,2)) AS DOUBLE) AS y"


def _fields(t: Tables) -> DataFrame:
    parts = [parsers.points(_lines(t, F.lit("Fa," * n), F.lit(",Rest")), code).withColumn("code", F.lit(code)) for code, (n, *_) in _FIELDS.items()]
    return reduce(DataFrame.unionByName, parts)


def _fields_sql() -> str:
    out = []
    for code, (n, positive, swap, lower) in _FIELDS.items():
        value = _VALUE.format(head=f"'{'Fa,' * n}'", tail=",Rest")
        out.append(f"SELECT {_SWAPPED if swap else _NUMBERS}, {f'lower({value})' if lower else value} AS payload, '{code}' AS code FROM customer_pts WHERE id % 10 NOT IN (3, 4){' AND x >= 0 AND y >= 0' if positive else ''}")
    return " UNION ALL ".join(out)


def _short(t: Tables) -> DataFrame:
    own = F.concat(F.col("id").cast("string"), F.lit(","))
    two = parsers.points(_lines(t, F.lit(""), F.lit(",more")), "OSM_Point_WGS84").withColumn("code", F.lit("osm"))
    return two.unionByName(parsers.points(_lines(t, own, F.lit(",more")), "Rand_Point").withColumn("code", F.lit("rand")))


_SHORT = f"SELECT {_NUMBERS}, {_VALUE.format(head=chr(39) * 2, tail=',more')} AS payload, 'osm' AS code FROM customer_pts WHERE id % 10 = 3 UNION ALL SELECT {_NUMBERS}, CAST(id AS VARCHAR) AS payload, 'rand' AS code FROM customer_pts WHERE id % 10 <> 4"


def _streets(t: Tables) -> DataFrame:
    """Segments of quoted line texts; every third line of four points or more comes in two parts."""
    pair = lambda c: F.concat_ws(" ", c["x"].cast("string"), c["y"].cast("string"))
    text = lambda c: F.array_join(F.transform(c, pair), ", ")
    two = F.concat(F.lit("MULTILINESTRING (("), text(F.slice("coords", 1, 2)), F.lit("), ("), text(F.slice("coords", F.lit(3), F.size("coords"))), F.lit("))"))
    one = F.concat(F.lit("LINESTRING ("), text(F.col("coords")), F.lit(")"))
    parted = (F.col("id") % 3 == 0) & (F.size("coords") >= 4)
    lines = t.lines().select(F.concat(F.col("id").cast("string"), F.lit(',"'), F.when(parted, two).otherwise(one), F.lit('"')).alias("value"))
    return parsers.segments(parsers.street_lines(lines)).withColumn("id", F.col("id").cast("long"))


_STREETS = "SELECT id, CASE WHEN id % 3 = 0 AND c >= 4 AND n > 2 THEN n - 1 ELSE n END AS n, x1, y1, x2, y2 FROM (SELECT s.*, p.c FROM line_segments s JOIN (SELECT id, max(c) AS c FROM line_points GROUP BY id) p ON s.id = p.id WHERE x2 IS NOT NULL) WHERE NOT (id % 3 = 0 AND c >= 4 AND n = 2)"


def _wkt(t: Tables) -> DataFrame:
    """Points and boxes of WKT texts."""
    at = t.customer().select(G.to_wkt(F.array(F.struct("x", "y")), "POINT").alias("value"))
    points = parsers.wkt_points(at.unionByName(t.spark.createDataFrame([("POINT EMPTY",), ("",), (None,)], "value string")))
    boxes = parsers.wkt_boxes(t.boxes().select(G.to_wkt(G.Box.of().ring()).alias("value")))
    none = F.lit(None).cast("double")
    return points.select("value", F.col("x").alias("xmin"), F.col("y").alias("ymin"), none.alias("xmax"), none.alias("ymax")).unionByName(boxes.withColumn("value", F.lit("box")))


_WKT = "SELECT '1' AS value, x AS xmin, y AS ymin, NULL::DOUBLE AS xmax, NULL::DOUBLE AS ymax FROM customer_pts UNION ALL SELECT 'box', xmin, ymin, xmax, ymax FROM supplier_boxes"


def _degrees(t: Tables) -> DataFrame:
    """Boxes from eight fields and tagged points from three."""
    n = lambda c: F.col(c).cast("decimal(12,6)").cast("string")
    at = t.boxes().select((F.col("xmin") / 100).alias("a"), (F.col("ymin") / 100).alias("b"), (F.col("xmax") / 100).alias("c"), (F.col("ymax") / 100).alias("d"))
    boxes = parsers.box_lines(at.select(F.concat_ws(",", n("a"), n("b"), F.lit("q"), F.lit("q"), n("c"), n("d")).alias("value")))
    texts = parsers.text_points(t.customer_text().select(F.concat_ws(",", n("y"), F.when(F.col("id") % 10 == 4, "x").otherwise(n("x")), F.lit("said"), "text").alias("value")))
    none = F.lit(None).cast("double")
    return boxes.withColumn("text", F.lit("box")).unionByName(texts.select(F.col("x").alias("xmin"), F.col("y").alias("ymin"), none.alias("xmax"), none.alias("ymax"), "text"))


_ROUND = ", ".join(f"CAST(CAST({c} / 100 AS DECIMAL(12,6)) AS DOUBLE) AS {c}" for c in ("xmin", "ymin", "xmax", "ymax"))
_DEGREES = f"SELECT *, 'box' AS text FROM (SELECT {_ROUND} FROM supplier_boxes) WHERE xmin BETWEEN -180 AND 180 AND xmax BETWEEN -180 AND 180 AND ymin BETWEEN -90 AND 90 AND ymax BETWEEN -90 AND 90 UNION ALL SELECT CAST(CAST(x AS DECIMAL(12,6)) AS DOUBLE), CAST(CAST(y AS DECIMAL(12,6)) AS DOUBLE), NULL::DOUBLE, NULL::DOUBLE, 'said,' || text FROM customer_pts WHERE id % 10 <> 4"


def _demo(t: Tables) -> DataFrame:
    pair = lambda c: F.concat_ws(" ", c["x"].cast("string"), c["y"].cast("string"))
    lines = parsers.demo_lines(t.lines().select(F.concat_ws(",", F.col("id").cast("string"), F.array_join(F.transform("coords", pair), ",")).alias("value")))
    last = F.element_at("coords", -1)
    cells = parsers.whole_cells(lines.select("payload", F.size("coords").cast("long").alias("c"), last["x"].alias("x"), last["y"].alias("y")))
    return cells.select(F.col("payload").cast("long").alias("id"), "c", "x", "y")


_DEMO = "SELECT id, c, floor(x) + 1 AS x, floor(y) + 1 AS y FROM line_points WHERE n = c AND c >= 2"


def _results(t: Tables) -> DataFrame:
    """Results written line by line and read again."""
    flat = joins.knn_join(t.supplier(), t.customer(), 3)
    lines = writers.knn_lines(writers.renested(flat))
    return compare.read_results(lines, key=lambda c: F.concat(F.lit("K"), c)).select("key", F.size("matches").cast("long").alias("n"), F.array_join(F.transform("matches", lambda m: F.concat_ws("/", m["id"], m["distance"])), ",").alias("matches"))


_RESULTS = ", k AS (SELECT l.id, r.id AS rid, (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) AS d2 FROM supplier_pts l, customer_pts r), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, rid) AS rank FROM k) SELECT 'K' || CAST(id AS VARCHAR) AS key, count(*) AS n, string_agg(CAST(rid AS VARCHAR) || '/' || format('{:.8f}', sqrt(d2)), ',' ORDER BY CAST(format('{:.8f}', sqrt(d2)) AS DOUBLE), CAST(rid AS VARCHAR)) AS matches FROM n WHERE rank <= 3 GROUP BY id"


def _match_lines(t: Tables) -> DataFrame:
    return writers.match_lines(joins.match_distance(*line_sets(t), k=3, max_distance=100.0))


_MATCH_LINES = LINE_MATCH.format(where="d2 <= 10000").replace("SELECT point, rank, line, round(d, 4) AS distance FROM ranked WHERE rank <= 3", "SELECT CAST(c.id AS VARCHAR) || coalesce(',' || l.lines, '') AS value FROM customer_pts c LEFT JOIN (SELECT point, string_agg(line, ',' ORDER BY rank) AS lines FROM ranked WHERE rank <= 3 GROUP BY point) l ON c.id = l.point")


def _box_lines(t: Tables) -> DataFrame:
    text = F.col("id").cast("string")  # once for a row, not for each of its pairs
    pairs = joins.range_join(t.customer().withColumn("id", text), t.boxes().withColumn("id", text))
    cx, cy = G.Box.of("r_xmin", "r_ymin", "r_xmax", "r_ymax").centre()
    return writers.box_match_lines(pairs, F.col("l_id"), F.col("r_id"), G.distance("l_x", "l_y", cx, cy), 400.0)


_BOX_LINES = "SELECT CAST(c.id AS VARCHAR) || ',' || CASE WHEN sqrt((c.x - (xmin + xmax) / 2) * (c.x - (xmin + xmax) / 2) + (c.y - (ymin + ymax) / 2) * (c.y - (ymin + ymax) / 2)) <= 400 THEN CAST(b.id AS VARCHAR) ELSE '' END AS value FROM customer_pts c JOIN supplier_boxes b ON c.x BETWEEN xmin AND xmax AND c.y BETWEEN ymin AND ymax"

def _typed(t: Tables) -> DataFrame:
    """Points, lines and rectangles as the map-matching reader makes them: bounds and number of coordinates."""
    kinds = {"point": t.customer(), "line": t.lines(), "rectangle": t.lines()}
    made = [parsers.matching_shapes(df, kind, "id", 150.0).withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    box = G.coords_box(F.col("coords"))
    return reduce(DataFrame.unionByName, made).select("kind", F.col("payload").cast("long").alias("id"), F.size("coords").cast("long").alias("c"), "area", box.xmin.alias("xmin"), box.ymax.alias("ymax"))


_TYPED = """SELECT 'point' AS kind, id, 1 AS c, FALSE AS area, floor(x) + 1 AS xmin, floor(y) + 1 AS ymax FROM customer_pts
UNION ALL SELECT 'line', id, count(*), FALSE, min(floor(x) + 1), max(floor(y) + 1) FROM line_points WHERE c >= 2 GROUP BY id
UNION ALL SELECT 'rectangle', id, 5, TRUE, min(x) - 150, max(y) + 150 FROM line_points WHERE c >= 2 GROUP BY id"""

QUERIES = {
    "typed_shapes": (_of(_typed), _TYPED),
    "parse_field_points": (_of(_fields), _fields_sql()),
    "parse_short_points": (_of(_short), _SHORT),
    "street_lines": (_of(_streets), _STREETS),
    "wkt_points_boxes": (_of(_wkt), _WKT),
    "degree_lines": (_of(_degrees), _DEGREES),
    "demo_lines": (_of(_demo), _DEMO),
    "read_results": (_of(_results), _RESULTS),
    "match_lines": (_of(_match_lines), _MATCH_LINES),
    "box_match_lines": (_of(_box_lines), _BOX_LINES),
}
