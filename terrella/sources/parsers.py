"""Line parsers: text lines to points, lines and boxes, as column expressions. Lines that do not parse give null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.functions.geometry import coords_box, edges_of, from_wkt


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _part(line: Column, i: int) -> Column:
    return F.try_element_at(F.split(line, ","), F.lit(i + 1))


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), F.trim(text).cast("double"))


def _point(x: Column, y: Column, payload: Column, good: Column) -> Column:
    return F.when(good & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"), payload.alias("payload")))


def xy_at(line: Column, n: int, swap: bool = False, lower: bool = True, positive: bool = False) -> Column:
    """Point from the fields after the n-th comma; a further field must follow. The first coordinate must begin with a digit or minus."""
    a, b = _part(line, n), _part(line, n + 1)
    good = (F.size(F.split(line, ",")) > n + 2) & F.coalesce(a.rlike("^[-0-9]"), F.lit(False))
    if positive:
        good &= ~F.contains(a, F.lit("-")) & ~F.contains(b, F.lit("-"))
    x, y = (_number(b), _number(a)) if swap else (_number(a), _number(b))
    return _point(x, y, F.lower(line) if lower else line, good)


def three_part(line: Column) -> Column:
    """``id,x,y`` without negative coordinates (-0.0 is none); the payload is the id."""
    x, y = _number(_part(line, 1)), _number(_part(line, 2))
    return _point(x, y, _part(line, 0), F.coalesce((x >= 0) & (y >= 0), F.lit(False)))


def random_point(line: Column) -> Column:
    return _point(_number(_part(line, 1)), _number(_part(line, 2)), _part(line, 0), F.lit(True))


def two_part(line: Column) -> Column:
    """``x,y`` and nothing else; the payload is the line."""
    return _point(_number(_part(line, 0)), _number(_part(line, 1)), line, F.size(F.split(line, ",")) == 2)


#: Point parsers by type code, compared without case.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "tpep_point": lambda c: xy_at(c, 2),
    "tpep_point_wgs84": lambda c: xy_at(c, 2),
    "taxi_point": lambda c: xy_at(c, 5, positive=True),
    "taxi_point_wgs84": lambda c: xy_at(c, 5),
    "bus_point": lambda c: xy_at(c, 1),
    "bus_point_shifted": lambda c: xy_at(c, 1),
    "bus_point_wgs84": lambda c: xy_at(c, 1, swap=True, lower=False),
    "poi_nyc": lambda c: F.when(c != "", xy_at(c, 10, lower=False)),
    "three_part_line": three_part,
    "osm_point_wgs84": two_part,
    "rand_point": random_point,
}


def parser(code: str) -> Callable[[Column], Column]:
    if code.lower() not in PARSERS:
        raise ValueError(f"no parser for {code}")
    return PARSERS[code.lower()]


def points(lines: DataFrame, code: str, column: str = "value") -> DataFrame:
    """``x``, ``y``, ``payload`` of the lines that parse."""
    return lines.select(parser(code)(F.col(column)).alias("p")).where("p is not null").select("p.*")


def street_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``id`` (before the first comma) and ``coords`` of quoted line texts."""
    return lines.select(F.substring_index(F.col(column), ",", 1).alias("id"), from_wkt(F.expr(f"substring(`{column}`, instr(`{column}`, ',') + 1)")).alias("coords")).where("coords is not null")


def segments(lines: DataFrame, id_col: str = "id", coords: str = "coords") -> DataFrame:
    """One row for each pair of consecutive coordinates, numbered from 1."""
    cut = lines.where(F.size(coords) > 1).select(id_col, F.posexplode(edges_of(F.col(coords))).alias("n", "s"))
    return cut.select(id_col, (F.col("n") + 1).cast("long").alias("n"), "s.*")


def wkt_points(lines: DataFrame, column: str = "value") -> DataFrame:
    """First coordinate of each text that parses, with the value "1"."""
    return lines.select(from_wkt(column)[0].alias("c")).where("c is not null").select("c.x", "c.y", F.lit("1").alias("value"))


def wkt_boxes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Boxes from the first and third corner of each ring."""
    got = lines.select(from_wkt(column).alias("c")).where("size(c) >= 3")
    return got.select(F.expr("least(c[0].x, c[2].x)").alias("xmin"), F.expr("least(c[0].y, c[2].y)").alias("ymin"), F.expr("greatest(c[0].x, c[2].x)").alias("xmax"), F.expr("greatest(c[0].y, c[2].y)").alias("ymax"))


def box_lines(lines: DataFrame, fields: tuple[int, int, int, int] = (0, 1, 4, 5), column: str = "value") -> DataFrame:
    """Boxes of degrees from four fields, rounded to six places; those outside the globe go."""
    got = lines.select(*[F.round(_number(_part(F.col(column), i)), 6).alias(n) for i, n in zip(fields, ("xmin", "ymin", "xmax", "ymax"), strict=True)])
    return got.where("xmin between -180 and 180 and xmax between -180 and 180 and ymin between -90 and 90 and ymax between -90 and 90")


def text_points(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lat,lon,text`` as x = lon, y = lat and the text, which may hold commas."""
    parts = F.split(F.col(column), ",", 3)
    return lines.select(_number(F.try_element_at(parts, F.lit(2))).alias("x"), _number(parts[0]).alias("y"), F.try_element_at(parts, F.lit(3)).alias("text")).where("x is not null and y is not null and text is not null")


def line_boxes(lines: DataFrame, error_range: float, id_col: str = "id", coords: str = "coords") -> DataFrame:
    """Bounds of lines grown by the range."""
    box = coords_box(F.col(coords), error_range)
    return lines.select(id_col, *[c.alias(n) for n, c in zip(("xmin", "ymin", "xmax", "ymax"), box, strict=True)])


def demo_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``payload`` and ``coords`` of ``id,x y,x y,...``."""
    parts = F.split(F.col(column), ",")
    pair = lambda p: F.struct(F.split(F.trim(p), " ")[0].cast("double").alias("x"), F.try_element_at(F.split(F.trim(p), " "), F.lit(2)).cast("double").alias("y"))
    return lines.select(parts[0].alias("payload"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), pair).alias("coords"))


def whole_cells(points: DataFrame) -> DataFrame:
    """Coordinates cut to whole numbers and raised by one."""
    return points.withColumns({c: F.floor(F.col(c)).cast("double") + 1 for c in ("x", "y")})


def matching_shapes(df: DataFrame, kind: str, payload: str = "payload", error_range: float = 0.0) -> DataFrame:
    """Shapes for map matching in whole numbers, as its reader makes them: coordinates of points (x, y) and lines are cut and raised by one; ``rectangle`` is a line's bounds grown by the range."""
    if kind == "point":
        return shapes(whole_cells(df), "point", payload)
    if kind == "line":
        cut = lambda v: F.floor(v).cast("double") + 1
        return shapes(df.withColumn("coords", F.transform("coords", lambda c: F.struct(cut(c["x"]).alias("x"), cut(c["y"]).alias("y")))), "line", payload)
    if kind == "rectangle":
        return shapes(line_boxes(df, error_range, payload), "box", payload)
    raise ValueError(f"no shapes of kind {kind}")


def shapes(df: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """``payload``, ``coords``, ``area`` for map matching, from points (x, y), boxes or coordinate lists."""
    from terrella.functions.geometry import shape

    values = {"point": ("x", "y"), "box": ("xmin", "ymin", "xmax", "ymax")}.get(kind, ("coords",))
    coords, area = shape(kind, *values)
    return df.select(F.col(payload).cast("string").alias("payload"), coords.alias("coords"), area.alias("area"))
