"""Planar geometry as native column expressions. Borders count as inside unless a function says otherwise.

A point is two columns, or an array for any number of dimensions; a box is four columns; a ring or line is an
``array<struct<x,y>>``; a segment is a struct ``x1, y1, x2, y2``. A coordinate of nulls is a break: it parts the rings of a
polygon (an inner ring is a hole) and the parts of a line, which no edge joins.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Value = Column | float | str


def col(v: Value) -> Column:
    """A column, a column's name, or a number as a double."""
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def finite(*values: Value) -> Column:
    """Whether all values are numbers: neither null, NaN nor infinite."""
    found = F.lit(True)
    for v in map(col, values):
        found &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return found


# Points


def squared_distance(x1: Value, y1: Value, x2: Value, y2: Value) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return dx * dx + dy * dy


def distance(x1: Value, y1: Value, x2: Value, y2: Value) -> Column:
    return F.sqrt(squared_distance(x1, y1, x2, y2))


def as_point(*columns: Value) -> Column:
    """Any numeric columns as an n-dimensional point."""
    return F.array(*[col(c).cast("double") for c in columns])


def squared_distance_nd(a: Value, b: Value) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def distance_nd(a: Value, b: Value) -> Column:
    """Distance of points of equal dimension; null where the dimensions differ."""
    return F.when(F.size(col(a)) == F.size(col(b)), F.sqrt(squared_distance_nd(a, b)))


def dominates(a: Value, b: Value) -> Column:
    """Whether ``a <= b`` in every dimension."""
    return F.forall(F.zip_with(col(a), col(b), lambda p, q: p <= q), lambda v: v)


def shifted(a: Value, by: Value) -> Column:
    return F.transform(col(a), lambda v: v + col(by))


# Boxes


class Box(NamedTuple):
    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column

    @classmethod
    def of(cls, xmin: Value = "xmin", ymin: Value = "ymin", xmax: Value = "xmax", ymax: Value = "ymax") -> Box:
        return cls(col(xmin), col(ymin), col(xmax), col(ymax))

    def contains(self, x: Value, y: Value) -> Column:
        return col(x).between(self.xmin, self.xmax) & col(y).between(self.ymin, self.ymax)

    def intersects(self, o: Box) -> Column:
        return (self.xmin <= o.xmax) & (o.xmin <= self.xmax) & (self.ymin <= o.ymax) & (o.ymin <= self.ymax)

    def wraps(self, o: Box) -> Column:
        """Whether the other box lies strictly inside."""
        return (self.xmin < o.xmin) & (self.ymin < o.ymin) & (self.xmax > o.xmax) & (self.ymax > o.ymax)

    def _gap(self, o: Box) -> tuple[Column, Column]:
        return F.greatest(o.xmin - self.xmax, self.xmin - o.xmax, F.lit(0.0)), F.greatest(o.ymin - self.ymax, self.ymin - o.ymax, F.lit(0.0))

    def distance(self, o: Box) -> Column:
        dx, dy = self._gap(o)
        return F.sqrt(dx * dx + dy * dy)

    def gap(self, o: Box) -> Column:
        """The smaller of the gaps along x and y."""
        return F.least(*self._gap(o))

    def point_distance(self, x: Value, y: Value) -> Column:
        return self.distance(Box(col(x), col(y), col(x), col(y)))

    def farthest(self, x: Value, y: Value) -> Column:
        dx = F.greatest(F.abs(col(x) - self.xmin), F.abs(col(x) - self.xmax))
        dy = F.greatest(F.abs(col(y) - self.ymin), F.abs(col(y) - self.ymax))
        return F.sqrt(dx * dx + dy * dy)

    def area(self) -> Column:
        return (self.xmax - self.xmin) * (self.ymax - self.ymin)

    def centre(self) -> tuple[Column, Column]:
        return (self.xmin + self.xmax) / 2, (self.ymin + self.ymax) / 2

    def union(self, o: Box) -> Box:
        return Box(F.least(self.xmin, o.xmin), F.least(self.ymin, o.ymin), F.greatest(self.xmax, o.xmax), F.greatest(self.ymax, o.ymax))

    def intersection(self, o: Box) -> Box:
        """The common box; it makes sense where the boxes intersect."""
        return Box(F.greatest(self.xmin, o.xmin), F.greatest(self.ymin, o.ymin), F.least(self.xmax, o.xmax), F.least(self.ymax, o.ymax))

    def intersection_area(self, o: Box) -> Column:
        return F.when(self.intersects(o), self.intersection(o).area()).otherwise(0.0)

    def grown_area(self, o: Box) -> Column:
        """Area that the box gains by taking in the other."""
        return self.union(o).area() - self.area()

    def overlap_ratio(self, o: Box) -> Column:
        """Common area over this box's area; 0 unless the boxes overlap strictly."""
        strict = (self.xmin < o.xmax) & (o.xmin < self.xmax) & (self.ymin < o.ymax) & (o.ymin < self.ymax)
        return F.when(strict, self.intersection(o).area() / self.area()).otherwise(0.0)

    def expanded(self, by: Value) -> Box:
        return Box(self.xmin - col(by), self.ymin - col(by), self.xmax + col(by), self.ymax + col(by))

    def ring(self) -> Column:
        corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        return F.array(corner(self.xmin, self.ymin), corner(self.xmax, self.ymin), corner(self.xmax, self.ymax), corner(self.xmin, self.ymax), corner(self.xmin, self.ymin))


# Circles


class Circle(NamedTuple):
    x: Column
    y: Column
    r: Column

    @classmethod
    def of(cls, x: Value = "x", y: Value = "y", r: Value = "r") -> Circle:
        return cls(col(x), col(y), col(r))

    def contains(self, x: Value, y: Value) -> Column:
        return squared_distance(self.x, self.y, x, y) <= self.r * self.r

    def intersects_box(self, b: Box) -> Column:
        return b.point_distance(self.x, self.y) <= self.r

    def intersects_circle(self, o: Circle) -> Column:
        return distance(self.x, self.y, o.x, o.y) <= self.r + o.r

    def point_distance(self, x: Value, y: Value) -> Column:
        return F.greatest(F.lit(0.0), distance(self.x, self.y, x, y) - self.r)

    def box_distance(self, b: Box) -> Column:
        return F.greatest(F.lit(0.0), b.point_distance(self.x, self.y) - self.r)

    def circle_distance(self, o: Circle) -> Column:
        return F.greatest(F.lit(0.0), distance(self.x, self.y, o.x, o.y) - self.r - o.r)

    def box(self) -> Box:
        return Box(self.x - self.r, self.y - self.r, self.x + self.r, self.y + self.r)


# Segments


def segment(x1: Value, y1: Value, x2: Value, y2: Value) -> Column:
    return F.struct(*[col(v).cast("double").alias(n) for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))])


def segment_point_squared(s: Column, x: Value, y: Value, compiled: bool = False) -> Column:
    """Squared distance from a segment: to the foot of the perpendicular, held within the segment. ``compiled`` suits rows, the other form lambdas."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    px, py = col(x) - s["x1"], col(y) - s["y1"]
    long = dx * dx + dy * dy
    t = F.when(long == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / F.when(long == 0, 1.0).otherwise(long))))
    if compiled:
        return (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)
    return let(t, lambda at: (px - at * dx) * (px - at * dx) + (py - at * dy) * (py - at * dy))


def segment_point_distance(s: Column, x: Value, y: Value) -> Column:
    return F.sqrt(segment_point_squared(s, x, y))


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _spans(s: Column, x: Column, y: Column) -> Column:
    return x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))


def segment_contains(s: Column, x: Value, y: Value) -> Column:
    return (_turn(s["x1"], s["y1"], s["x2"], s["y2"], col(x), col(y)) == 0) & _spans(s, col(x), col(y))


def segments_intersect(s: Column, t: Column) -> Column:
    """Whether two segments share a point: proper crossings by orientation, touching and collinear cases by containment."""
    a, b = _turn(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"]), _turn(s["x1"], s["y1"], s["x2"], s["y2"], t["x2"], t["y2"])
    c, d = _turn(t["x1"], t["y1"], t["x2"], t["y2"], s["x1"], s["y1"]), _turn(t["x1"], t["y1"], t["x2"], t["y2"], s["x2"], s["y2"])
    turns = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    touch = lambda v: ((v["a"] == 0) & _spans(s, t["x1"], t["y1"])) | ((v["b"] == 0) & _spans(s, t["x2"], t["y2"])) | ((v["c"] == 0) & _spans(t, s["x1"], s["y1"])) | ((v["d"] == 0) & _spans(t, s["x2"], s["y2"]))
    return let(turns, lambda v: ((v["a"] * v["b"] < 0) & (v["c"] * v["d"] < 0)) | touch(v))


def segments_squared(s: Column, t: Column) -> Column:
    ends = F.least(segment_point_squared(s, t["x1"], t["y1"]), segment_point_squared(s, t["x2"], t["y2"]), segment_point_squared(t, s["x1"], s["y1"]), segment_point_squared(t, s["x2"], s["y2"]))
    return F.when(segments_intersect(s, t), 0.0).otherwise(ends)


def segments_distance(s: Column, t: Column) -> Column:
    return F.sqrt(segments_squared(s, t))


def segment_circle_intersects(s: Column, c: Circle) -> Column:
    return segment_point_squared(s, c.x, c.y) <= c.r * c.r


def segment_circle_distance(s: Column, c: Circle) -> Column:
    return F.greatest(F.lit(0.0), segment_point_distance(s, c.x, c.y) - c.r)


def segment_box_distance(s: Column, b: Box) -> Column:
    edges = F.array_min(F.transform(edges_of(b.ring()), lambda e: segments_squared(s, e)))
    return F.when(b.contains(s["x1"], s["y1"]) | b.contains(s["x2"], s["y2"]), 0.0).otherwise(F.sqrt(edges))


def segment_box_intersects(s: Column, b: Box) -> Column:
    """Also true for a segment that lies wholly inside."""
    return segment_box_distance(s, b) == 0


def segment_box(s: Column) -> Box:
    return Box(F.least(s["x1"], s["x2"]), F.least(s["y1"], s["y2"]), F.greatest(s["x1"], s["x2"]), F.greatest(s["y1"], s["y2"]))


# Lines and rings


def edges_of(coords: Column) -> Column:
    """Consecutive segments, none over a break; a single coordinate gives one segment without length."""
    n = F.size(coords)
    pair = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    joined = F.zip_with(F.slice(coords, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(coords, F.lit(2), F.greatest(n - 1, F.lit(0))), pair)
    return F.when(n == 1, F.transform(coords, lambda c: pair(c, c))).otherwise(F.filter(joined, lambda e: e["x1"].isNotNull() & e["x2"].isNotNull()))


def has_breaks(coords: Column) -> Column:
    return F.exists(coords, lambda c: c["x"].isNull())


def closed(ring: Column) -> Column:
    """The ring with its first coordinate repeated at the end, and padded to four coordinates; several rings, which texts close, stay as they are."""
    first = ring[0]
    shut = F.when(has_breaks(ring), ring).when((first["x"] == F.element_at(ring, -1)["x"]) & (first["y"] == F.element_at(ring, -1)["y"]), ring).otherwise(F.concat(ring, F.array(first)))
    return F.concat(shut, F.array_repeat(first, F.greatest(F.lit(0), 4 - F.size(shut))))


def coords_box(coords: Column, by: Value = 0.0) -> Box:
    """Bounds of a coordinate list, grown by ``by``."""
    xs, ys = F.transform(coords, lambda c: c["x"]), F.transform(coords, lambda c: c["y"])
    return Box(F.array_min(xs) - col(by), F.array_min(ys) - col(by), F.array_max(xs) + col(by), F.array_max(ys) + col(by))


def on_boundary(ring: Column, x: Value, y: Value) -> Column:
    return F.exists(edges_of(ring), lambda e: segment_contains(e, x, y))


def _odd_crossings(ring: Column, x: Value, y: Value) -> Column:
    above = lambda e: (e["y1"] > col(y)) != (e["y2"] > col(y))
    left = lambda e: col(x) < (e["x2"] - e["x1"]) * (col(y) - e["y1"]) / F.when(e["y2"] == e["y1"], 1.0).otherwise(e["y2"] - e["y1"]) + e["x1"]
    return F.size(F.filter(edges_of(ring), lambda e: above(e) & left(e))) % 2 == 1


def polygon_contains(ring: Column, x: Value, y: Value) -> Column:
    """Whether the point is strictly inside a closed ring: the boundary is left out."""
    return ~on_boundary(ring, x, y) & _odd_crossings(ring, x, y)


def polygon_covers(ring: Column, x: Value, y: Value) -> Column:
    """As ``polygon_contains`` with the boundary."""
    return on_boundary(ring, x, y) | _odd_crossings(ring, x, y)


def polygon_point_distance(ring: Column, x: Value, y: Value) -> Column:
    return F.when(polygon_covers(ring, x, y), 0.0).otherwise(F.sqrt(F.array_min(F.transform(edges_of(ring), lambda e: segment_point_squared(e, x, y)))))


def lines_squared(a: Column, b: Column) -> Column:
    """Least squared distance of the edges of two coordinate lists; a list of one coordinate is a point."""
    to_point = lambda line, p: F.array_min(F.transform(edges_of(line), lambda s: segment_point_squared(s, p["x"], p["y"])))
    full = F.array_min(F.transform(edges_of(a), lambda s: F.array_min(F.transform(edges_of(b), lambda t: segments_squared(s, t)))))
    return F.when(F.size(b) == 1, to_point(a, b[0])).when(F.size(a) == 1, to_point(b, a[0])).otherwise(full)


def _inside(a: Column, a_area: Column, b: Column, b_area: Column) -> Column:
    return (a_area & polygon_covers(a, b[0]["x"], b[0]["y"])) | (b_area & polygon_covers(b, a[0]["x"], a[0]["y"]))


def geometry_squared(a: Column, a_area: Column, b: Column, b_area: Column) -> Column:
    """Least squared distance of two shapes; ``*_area`` says whether the coordinates are a closed ring with its inside."""
    return F.when(_inside(a, a_area, b, b_area), 0.0).otherwise(lines_squared(a, b))


def edge_squared(edge: Column, a: Column, a_area: Column, b: Column, b_area: Column) -> Column:
    """Squared distance of one edge of shape a to shape b; the least over all edges is ``geometry_squared``."""
    apart = F.when(F.size(b) == 1, segment_point_squared(edge, b[0]["x"], b[0]["y"], compiled=True)).otherwise(F.array_min(F.transform(edges_of(b), lambda t: segments_squared(edge, t))))
    return F.when(_inside(a, a_area, b, b_area), 0.0).otherwise(apart)


def geometry_distance(a: Column, a_area: Column, b: Column, b_area: Column) -> Column:
    return F.sqrt(geometry_squared(a, a_area, b, b_area))


def geometry_intersects(a: Column, a_area: Column, b: Column, b_area: Column) -> Column:
    """Whether two shapes share a point: edges that meet, or one inside the other."""
    return F.exists(edges_of(a), lambda s: F.exists(edges_of(b), lambda t: segments_intersect(s, t))) | _inside(a, a_area, b, b_area)


def polygon_circle_intersects(ring: Column, c: Circle) -> Column:
    return polygon_point_distance(ring, c.x, c.y) <= c.r


def polygon_circle_distance(ring: Column, c: Circle) -> Column:
    return F.greatest(F.lit(0.0), polygon_point_distance(ring, c.x, c.y) - c.r)


#: Kinds of shapes and how each becomes coordinates with or without an inside.
AREA = {"point": False, "segment": False, "line": False, "box": True, "polygon": True}


def shape(kind: str, *values: Value) -> tuple[Column, Column]:
    """Coordinates and inside flag of a shape of a known kind: point x, y; segment; box xmin, ymin, xmax, ymax; line or polygon coordinates."""
    at = lambda x, y: F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
    if kind == "box":
        return Box.of(*values).ring(), F.lit(True)
    coords = F.array(at(*values)) if kind == "point" else F.array(at(*values[:2]), at(*values[2:])) if kind == "segment" else closed(col(values[0])) if kind == "polygon" else col(values[0])
    return coords, F.lit(AREA[kind])


def min_distance(a: tuple[str, Sequence[Value]], b: tuple[str, Sequence[Value]]) -> Column:
    """Distance of any two shapes, circles too, given as kind and values."""
    if a[0] == "circle":
        x, y, r = map(col, a[1])
        return F.greatest(F.lit(0.0), min_distance(("point", (x, y)), b) - r)
    if b[0] == "circle":
        return min_distance(b, a)
    return geometry_distance(*shape(a[0], *a[1]), *shape(b[0], *b[1]))


def intersects(a: tuple[str, Sequence[Value]], b: tuple[str, Sequence[Value]]) -> Column:
    return min_distance(a, b) == 0


def to_wkt(coords: Column, kind: str = "POLYGON") -> Column:
    pair = lambda c: F.when(c["x"].isNull(), "|").otherwise(F.concat_ws(" ", c["x"].cast("string"), c["y"].cast("string")))
    body = F.replace(F.array_join(F.transform(coords, pair), ", "), F.lit(", |, "), F.lit("), ("))
    return {"POINT": F.concat(F.lit("POINT ("), body, F.lit(")")), "LINESTRING": F.concat(F.lit("LINESTRING ("), body, F.lit(")"))}.get(kind, F.concat(F.lit("POLYGON (("), body, F.lit("))")))


def from_wkt(text: Value) -> Column:
    """Coordinates of a WKT text, the rings or parts in turn with a break between them; a part of one coordinate among several counts twice. Null where the text holds no pair of numbers."""
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    found = F.regexp_extract_all(col(text), F.lit(r"\(([^()]*)\)"), F.lit(1))
    at = lambda p, i: F.split(p, r"\s+")[i].cast("double")
    coords = lambda part: F.transform(F.regexp_extract_all(part, F.lit(f"({number})\\s+({number})"), F.lit(0)), lambda p: F.struct(at(p, 0).alias("x"), at(p, 1).alias("y")))
    parts = F.filter(F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(col(text))), coords), lambda c: F.size(c) > 0)
    gap = F.array(F.lit(None).cast("struct<x:double,y:double>")).cast("array<struct<x:double,y:double>>")
    gap = F.transform(gap, lambda g: F.struct(g["x"].alias("x"), g["y"].alias("y")))
    several = F.flatten(F.transform(parts, lambda c, i: F.concat(F.when(i > 0, gap).otherwise(F.slice(gap, 1, 0)), F.when(F.size(c) == 1, F.concat(c, c)).otherwise(c))))
    return F.when(F.size(parts) > 1, several).when(F.size(parts) == 1, F.flatten(parts))


def to_wkb(coords: Column) -> Column:
    """Little-endian WKB of a polygon with one ring; packing bytes takes Arrow batches."""

    def packed(rings: pd.Series) -> pd.Series:
        out = []
        for ring in rings:
            flat = None if ring is None else [v for c in ring for v in (c["x"], c["y"])]
            out.append(None if flat is None else struct.pack(f"<BIII{len(flat)}d", 1, 3, 1, len(flat) // 2, *flat))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(packed, T.BinaryType())(coords)


def from_wkb(data: Value) -> Column:
    """Coordinates of the ring of such a WKB, of either byte order."""

    def unpacked(values: pd.Series) -> pd.Series:
        out = []
        for b in values:
            if b is None:
                out.append(None)
                continue
            order = "<" if b[0] else ">"
            flat = struct.unpack_from(f"{order}{2 * struct.unpack_from(order + 'I', b, 9)[0]}d", b, 13)
            out.append([{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2], strict=True)])
        return pd.Series(out, dtype=object)

    pair = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    return F.pandas_udf(unpacked, T.ArrayType(pair))(col(data))
