"""Grid cells and Hilbert indexes of lines and areas as native column expressions.

A cell holds the coordinates from its number times the width up to the next; what lies on a border belongs to the upper cell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrella.functions.curves import hilbert
from terrella.functions.geometry import Value, col, coords_box, edges_of, let, polygon_covers


def _at(v: Column, width: Column) -> Column:
    return F.floor(v / width).cast("long")


def _run(a: Column, b: Column) -> Column:
    """Whole numbers from a to b; none where b is below a."""
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def segment_cells(s: Column, width: Value) -> Column:
    """Cells that a segment passes, column by column: in each, those from where it enters to where it leaves."""
    w = col(width)
    turned = s["x1"] > s["x2"]
    pick = lambda a, b: F.when(turned, s[b]).otherwise(s[a])
    ends = F.struct(pick("x1", "x2").alias("x1"), pick("y1", "y2").alias("y1"), pick("x2", "x1").alias("x2"), pick("y2", "y1").alias("y2"))

    def cells(e: Column) -> Column:
        steep = e["x1"] == e["x2"]
        slope = (e["y2"] - e["y1"]) / F.when(steep, 1.0).otherwise(e["x2"] - e["x1"])
        low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
        held = lambda v: F.greatest(low, F.least(high, v))
        first, last = _at(e["x1"], w), _at(e["x2"], w)

        def column(cx: Column) -> Column:
            a = F.when(steep, e["y1"]).otherwise(held(e["y1"] + slope * (F.greatest(e["x1"], cx * w) - e["x1"])))
            b = F.when(steep, e["y2"]).otherwise(held(e["y1"] + slope * (F.least(e["x2"], (cx + 1) * w) - e["x1"])))
            down, up = _at(F.least(a, b), w), _at(F.greatest(a, b), w)
            return F.transform(_run(down, up), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

        return F.flatten(F.transform(_run(first, last), column))

    return let(ends, cells)


def line_cells(coords: Column, width: Value) -> Column:
    """Cells that a line passes, each once."""
    return F.array_distinct(F.flatten(F.transform(edges_of(coords), lambda s: segment_cells(s, width))))


def polygon_cells(ring: Column, width: Value) -> Column:
    """Cells that share a point with a closed ring's area: those that its edges pass and those whose middle it covers. An area reaches a cell without passing it only by covering it."""
    w, box = col(width), coords_box(ring)
    rows = lambda cx: F.transform(_run(_at(box.ymin, w), _at(box.ymax, w)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))
    every = F.flatten(F.transform(_run(_at(box.xmin, w), _at(box.xmax, w)), rows))
    inside = F.filter(every, lambda c: polygon_covers(ring, (c["cx"] + 0.5) * w, (c["cy"] + 0.5) * w))
    return F.array_distinct(F.concat(line_cells(ring, width), inside))


def shape_cells(coords: Column, area: Column, width: Value) -> Column:
    """Cells of any shape: a point's one, a line's, or an area's with its inside."""
    return F.when(area, polygon_cells(coords, width)).otherwise(line_cells(coords, width))


def hilbert_cells(coords: Column, area: Column, width: Value, n: int = 256) -> Column:
    """Sorted Hilbert indexes of a shape's cells in an n by n grid from the origin; cells outside the grid are left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(shape_cells(coords, area, width), lambda c: hilbert(c["cx"], c["cy"], n)), lambda h: h >= 0)))
