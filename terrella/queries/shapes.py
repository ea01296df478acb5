"""Predicates and distances of shapes, shape joins, texts of shapes and cells that shapes pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrella.functions import geometry as G
from terrella.functions.raster import hilbert_cells, line_cells, polygon_cells
from terrella.operators import joins
from terrella.queries.selections import steps
from terrella.queries.tables import Tables
from terrella.sources import parsers


def _of(body):  # noqa: ANN001, ANN202
    return lambda spark, sf_dir: body(Tables(spark, sf_dir))


def point_d2_sql(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Squared distance of a point and a segment."""
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    long = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {long} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / {long})) END)"
    ex, ey = f"({px} - {ax} - {t} * {dx})", f"({py} - {ay} - {t} * {dy})"
    return f"({ex} * {ex} + {ey} * {ey})"


def cross_sql(s: tuple[str, str, str, str], t: tuple[str, str, str, str]) -> str:
    """Whether two segments share a point."""
    turn = lambda a, b, cx, cy: f"sign(({b[0]} - {a[0]}) * ({cy} - {a[1]}) - ({b[1]} - {a[1]}) * ({cx} - {a[0]}))"
    on = lambda g, x, y: f"({x} BETWEEN least({g[0]}, {g[2]}) AND greatest({g[0]}, {g[2]}) AND {y} BETWEEN least({g[1]}, {g[3]}) AND greatest({g[1]}, {g[3]}))"
    a, b = turn(s[:2], s[2:], *t[:2]), turn(s[:2], s[2:], *t[2:])
    c, d = turn(t[:2], t[2:], *s[:2]), turn(t[:2], t[2:], *s[2:])
    touch = " OR ".join(f"({v} = 0 AND {on(g, *p)})" for v, g, p in ((a, s, t[:2]), (b, s, t[2:]), (c, t, s[:2]), (d, t, s[2:])))
    return f"(({a} * {b} < 0 AND {c} * {d} < 0) OR {touch})"


_S = ("x1", "y1", "x2", "y2")
_FIXED = ("0.0::DOUBLE", "0.0::DOUBLE", "9000.0::DOUBLE", "9000.0::DOUBLE")
_EDGES = [("2000.0::DOUBLE", "1000.0::DOUBLE", "6000.0::DOUBLE", "1000.0::DOUBLE"), ("6000.0::DOUBLE", "1000.0::DOUBLE", "6000.0::DOUBLE", "7000.0::DOUBLE"), ("6000.0::DOUBLE", "7000.0::DOUBLE", "2000.0::DOUBLE", "7000.0::DOUBLE"), ("2000.0::DOUBLE", "7000.0::DOUBLE", "2000.0::DOUBLE", "1000.0::DOUBLE")]


def _segment_tests(t: Tables) -> DataFrame:
    s, diagonal, box = F.struct(*_S), G.segment(0.0, 0.0, 9000.0, 9000.0), G.Box.of(2000.0, 1000.0, 6000.0, 7000.0)
    return parsers.segments(t.lines()).select("id", "n", G.segments_intersect(s, diagonal).alias("crosses"), F.round(G.segments_distance(s, diagonal), 6).alias("apart"), G.segment_box_intersects(s, box).alias("meets_box"), G.segment_contains(s, "x1", "y1").alias("starts"), G.segment_contains(s, F.col("x1") + 1, F.col("y1") + 2).alias("beside"))


_SEGMENT_TESTS = f"""SELECT id, n, {cross_sql(_S, _FIXED)} AS crosses,
  round(CASE WHEN {cross_sql(_S, _FIXED)} THEN 0.0::DOUBLE ELSE sqrt(least({point_d2_sql(*_FIXED[:2], *_S)}, {point_d2_sql(*_FIXED[2:], *_S)}, {point_d2_sql(*_S[:2], *_FIXED)}, {point_d2_sql(*_S[2:], *_FIXED)})) END, 6) AS apart,
  (x1 BETWEEN 2000 AND 6000 AND y1 BETWEEN 1000 AND 7000) OR (x2 BETWEEN 2000 AND 6000 AND y2 BETWEEN 1000 AND 7000) OR {" OR ".join(cross_sql(_S, e) for e in _EDGES)} AS meets_box,
  TRUE AS starts, (x2 - x1) * (y1 + 2 - y1) - (y2 - y1) * (x1 + 1 - x1) = 0 AND x1 + 1 BETWEEN least(x1, x2) AND greatest(x1, x2) AND y1 + 2 BETWEEN least(y1, y2) AND greatest(y1, y2) AS beside
  FROM line_segments WHERE x2 IS NOT NULL"""


def _point_tests(t: Tables) -> DataFrame:
    a = G.as_point("x", "y", F.col("id") % 7)
    return t.customer().select("id", G.dominates(a, G.as_point(5000.0, 4800.0, 3.0)).alias("below"), F.round(G.distance_nd(a, G.as_point(1.0, 2.0, 3.0)), 6).alias("apart"), G.shifted(a, 1.5)[2].alias("third"), G.finite("x", F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("y"))).alias("valid"))


def _distances(t: Tables) -> DataFrame:
    """Distances of all pairs of kinds around each supplier; a circle is its centre less the radius."""
    here = {"point": ("x", "y"), "segment": ("x", "y", F.col("x") + 300, F.col("y") + 400), "box": ("x", "y", F.col("x") + 500, F.col("y") + 500), "circle": ("x", "y", 250.0), "polygon": (G.Box.of("x", "y", F.col("x") + 200, F.col("y") + 700).ring(),)}
    there = {"point": (4000.0, 4000.0), "segment": (4000.0, 4000.0, 4500.0, 5000.0), "box": (3000.0, 3000.0, 5000.0, 5000.0), "circle": (4000.0, 4000.0, 500.0), "polygon": (G.Box.of(3500.0, 3500.0, 4500.0, 6000.0).ring(),)}

    def each(kinds: dict, name: str) -> Column:
        made = [(kind, *G.shape(*(("point", *v[:2]) if kind == "circle" else (kind, *v))), F.lit(v[2] if kind == "circle" else 0.0)) for kind, v in kinds.items()]
        return F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("coords"), area.alias("area"), r.alias("r")) for k, c, area, r in made])).alias(name)

    pairs = t.supplier().select("id", each(here, "one")).select("id", "one", each(there, "two"))
    apart = pairs.select("id", F.col("one.kind").alias("a"), F.col("two.kind").alias("b"), F.greatest(F.lit(0.0), G.geometry_distance(*(F.col(f"{s}.{c}") for s in ("one", "two") for c in ("coords", "area"))) - F.col("one.r") - F.col("two.r")).alias("d"))
    return apart.select("id", "a", "b", F.round("d", 6).alias("distance"), (F.col("d") == 0).alias("meets"))


def _kinds(x: str, y: str, sizes: dict[str, tuple[float, float]], r: float, source: str) -> str:
    """Edges of a point, segment, box, circle and polygon as rows: kind, edge, radius, and bounds if the kind has an inside."""
    out = []
    for kind, (ox, oy, w, h) in sizes.items():
        a, b, c, d = f"({x} + {ox})", f"({y} + {oy})", f"({x} + {ox + w})", f"({y} + {oy + h})"
        edges = [(a, b, a, b)] if kind in ("point", "circle") else [(a, b, c, d)] if kind == "segment" else [(a, b, c, b), (c, b, c, d), (c, d, a, d), (a, d, a, b)]
        out += [f"SELECT id, '{kind}' AS kind, {e[0]}::DOUBLE AS x1, {e[1]}::DOUBLE AS y1, {e[2]}::DOUBLE AS x2, {e[3]}::DOUBLE AS y2, {r if kind == 'circle' else 0}::DOUBLE AS r, {'TRUE' if kind in ('box', 'polygon') else 'FALSE'} AS area, {a}::DOUBLE AS ax, {b}::DOUBLE AS ay, {c}::DOUBLE AS bx, {d}::DOUBLE AS by FROM {source}" for e in edges]
    return " UNION ALL ".join(out)


_A, _B = [tuple(f"{t}.{c}" for c in _S) for t in "ab"]
_DISTANCES = f""", a AS ({_kinds("x", "y", {"point": (0, 0, 0, 0), "segment": (0, 0, 300, 400), "box": (0, 0, 500, 500), "circle": (0, 0, 0, 0), "polygon": (0, 0, 200, 700)}, 250, "supplier_pts")}),
b AS ({_kinds("0", "0", {"point": (4000, 4000, 0, 0), "segment": (4000, 4000, 500, 1000), "box": (3000, 3000, 2000, 2000), "circle": (4000, 4000, 0, 0), "polygon": (3500, 3500, 1000, 2500)}, 500, "(SELECT 0 AS id)")}),
d AS (SELECT a.id, a.kind AS a, b.kind AS b, a.r + b.r AS r, CASE WHEN (a.area AND b.ax BETWEEN a.ax AND a.bx AND b.ay BETWEEN a.ay AND a.by) OR (b.area AND a.ax BETWEEN b.ax AND b.bx AND a.ay BETWEEN b.ay AND b.by) OR {cross_sql(_A, _B)} THEN 0.0::DOUBLE
  ELSE least({point_d2_sql(*_A[:2], *_B)}, {point_d2_sql(*_A[2:], *_B)}, {point_d2_sql(*_B[:2], *_A)}, {point_d2_sql(*_B[2:], *_A)}) END AS d2 FROM a, b)
SELECT id, a, b, round(greatest(0.0::DOUBLE, sqrt(min(d2)) - max(r)), 6) AS distance, greatest(0.0::DOUBLE, sqrt(min(d2)) - max(r)) = 0 AS meets FROM d GROUP BY id, a, b"""


def _polygons(t: Tables) -> DataFrame:
    return t.polygons().select(F.col("id").cast("string").alias("payload"), F.col("ring").alias("coords"), F.lit(True).alias("area"))


def _near_polygons(t: Tables) -> DataFrame:
    points = parsers.shapes(t.customer().withColumnRenamed("id", "payload"), "point")
    return joins.shape_distance_join(_polygons(t), points, 700.0).select(F.col("l_payload").cast("long").alias("polygon"), F.col("r_payload").cast("long").alias("point"), F.round("distance", 4).alias("distance"))


_CORNERS = ", corner AS (SELECT id, cx, cy, unnest([cx - 600, cx, cx + 600, cx]) AS x1, unnest([cy, cy - 900, cy, cy + 900]) AS y1, unnest([cx, cx + 600, cx, cx - 600]) AS x2, unnest([cy - 900, cy, cy + 900, cy]) AS y2 FROM nation_polys)"
_NEAR_POLYGONS = _CORNERS + f""", d AS (SELECT e.id AS polygon, c.id AS point, min(CASE WHEN abs(c.x - cx) / 600 + abs(c.y - cy) / 900 <= 1 THEN 0.0::DOUBLE ELSE {point_d2_sql("c.x", "c.y", "e.x1", "e.y1", "e.x2", "e.y2")} END) AS d2 FROM corner e, customer_pts c GROUP BY e.id, c.id)
SELECT polygon, point, round(sqrt(d2), 4) AS distance FROM d WHERE d2 <= 490000"""


def _lines_in_polygons(t: Tables) -> DataFrame:
    """Lines that intersect each nation's polygon."""
    lines = parsers.shapes(t.lines().withColumnRenamed("id", "payload"), "line")
    found = joins.match_range(lines, _polygons(t))
    return found.select(F.col("payload").cast("long").alias("polygon"), F.size("matches").cast("long").alias("n"), F.array_join(F.transform("matches", lambda m: m["payload"]), ",").alias("lines"))


_E, _G = [tuple(f"{t}.{c}" for c in _S) for t in "eg"]
_LINES_IN_POLYGONS = _CORNERS + f""", hit AS (SELECT DISTINCT e.id AS polygon, g.id AS line FROM corner e, line_segments g WHERE g.x2 IS NOT NULL AND ({cross_sql(_E, _G)} OR (g.n = 1 AND abs(g.x1 - cx) / 600 + abs(g.y1 - cy) / 900 <= 1)))
SELECT p.id AS polygon, count(line) AS n, coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY CAST(line AS VARCHAR)), '') AS lines FROM nation_polys p LEFT JOIN hit ON p.id = polygon GROUP BY p.id"""


def _texts(t: Tables) -> DataFrame:
    ring = F.col("ring")
    hole = F.concat(F.lit("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 3))"))
    return t.polygons().select("id", G.to_wkt(ring).alias("wkt"), F.octet_length(G.to_wkb(ring)).cast("long").alias("bytes"), (G.from_wkb(G.to_wkb(ring)) == ring).alias("same"), (G.from_wkt(G.to_wkt(ring)) == ring).alias("parsed"), G.polygon_covers(G.from_wkt(hole), 1.0, 1.0).alias("solid"), G.polygon_covers(G.from_wkt(hole), 4.5, 3.5).alias("hole"), (G.to_wkt(G.closed(G.from_wkt(hole))) == "POLYGON ((0.0 0.0, 9.0 0.0, 9.0 9.0, 0.0 9.0, 0.0 0.0), (3.0 3.0, 6.0 3.0, 6.0 6.0, 3.0 3.0))").alias("rings"))


_AT = "CAST({x} AS VARCHAR) || ' ' || CAST({y} AS VARCHAR)"
_TEXTS = "SELECT id, 'POLYGON ((' || " + " || ', ' || ".join(_AT.format(x=x, y=y) for x, y in (("(cx - 600)", "cy"), ("cx", "(cy - 900)"), ("(cx + 600)", "cy"), ("cx", "(cy + 900)"), ("(cx - 600)", "cy"))) + " || '))' AS wkt, 93 AS bytes, TRUE AS same, TRUE AS parsed, TRUE AS solid, FALSE AS hole, TRUE AS rings FROM nation_polys"

#: Cells that segments pass, column by column; ``{w}`` is the width.
CELLS = """, o AS (SELECT {key}, CASE WHEN x1 > x2 THEN x2 ELSE x1 END AS x1, CASE WHEN x1 > x2 THEN y2 ELSE y1 END AS y1, CASE WHEN x1 > x2 THEN x1 ELSE x2 END AS x2, CASE WHEN x1 > x2 THEN y1 ELSE y2 END AS y2 FROM {source}),
col AS (SELECT *, (y2 - y1) / CASE WHEN x1 = x2 THEN 1.0::DOUBLE ELSE x2 - x1 END AS slope, least(y1, y2) AS low, greatest(y1, y2) AS high FROM o, unnest(generate_series(CAST(floor(x1 / {w}) AS BIGINT), CAST(floor(x2 / {w}) AS BIGINT))) AS s(cx)),
ab AS (SELECT *, CASE WHEN x1 = x2 THEN y1 ELSE greatest(low, least(high, y1 + slope * (greatest(x1, cx * {w}) - x1))) END AS a, CASE WHEN x1 = x2 THEN y2 ELSE greatest(low, least(high, y1 + slope * (least(x2, (cx + 1) * {w}) - x1))) END AS b FROM col),
cells AS (SELECT DISTINCT {key}, cx, cy FROM ab, unnest(generate_series(CAST(floor(least(a, b) / {w}) AS BIGINT), CAST(floor(greatest(a, b) / {w}) AS BIGINT))) AS s(cy))"""
LINE_CELLS = CELLS.replace("{key}", "id").replace("{source}", "line_segments WHERE x2 IS NOT NULL")
_POLYGON_CELLS = _CORNERS + CELLS.format(key="id", source="corner", w="70.0::DOUBLE") + """, box AS (SELECT id, cx AS mx, cy AS my, gx, gy FROM nation_polys, unnest(generate_series(CAST(floor((cx - 600) / 70) AS BIGINT), CAST(floor((cx + 600) / 70) AS BIGINT))) AS s(gx), unnest(generate_series(CAST(floor((cy - 900) / 70) AS BIGINT), CAST(floor((cy + 900) / 70) AS BIGINT))) AS q(gy))
SELECT id, cx, cy FROM cells UNION SELECT id, gx, gy FROM box WHERE abs((gx + 0.5::DOUBLE) * 70 - mx) / 600 + abs((gy + 0.5::DOUBLE) * 70 - my) / 900 <= 1"""


def _each(df: DataFrame, cells) -> DataFrame:  # noqa: ANN001
    return df.select("id", F.explode(cells).alias("c")).select("id", "c.cx", "c.cy")


QUERIES = {
    "segment_tests": (_of(_segment_tests), _SEGMENT_TESTS),
    "point_tests": (_of(_point_tests), "SELECT id, x <= 5000 AND y <= 4800 AND id % 7 <= 3 AS below, round(sqrt((x - 1) * (x - 1) + (y - 2) * (y - 2) + (id % 7 - 3) * (id % 7 - 3)), 6) AS apart, id % 7 + 1.5::DOUBLE AS third, id % 5 <> 0 AS valid FROM customer_pts"),
    "shape_distances": (_of(_distances), _DISTANCES),
    "poly_distance": (_of(_near_polygons), _NEAR_POLYGONS),
    "line_range_join": (_of(_lines_in_polygons), _LINES_IN_POLYGONS),
    "polygon_wkt": (_of(_texts), _TEXTS),
    "line_cells": (_of(lambda t: _each(t.lines(), line_cells(F.col("coords"), 500.0))), LINE_CELLS.format(w="500.0::DOUBLE") + " SELECT id, cx, cy FROM cells"),
    "polygon_cells": (_of(lambda t: _each(t.polygons(), polygon_cells(F.col("ring"), 70.0))), _POLYGON_CELLS),
    "hilbert_cells": (_of(lambda t: t.lines().select("id", F.explode(hilbert_cells(F.col("coords"), F.lit(False), 640.0, 16)).alias("h"))), LINE_CELLS.format(w="640.0::DOUBLE") + ", g AS (SELECT id, cx, cy FROM cells)" + steps(16).replace(" SELECT id, cx, cy, CASE", ", c AS (SELECT id, CASE", 1) + ") SELECT id, h FROM c WHERE h >= 0"),
}
