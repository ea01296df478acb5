"""Grid plans: cells, levels and candidate pairs that turn spatial joins into equi-joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrella.functions.geometry import Box, finite
from terrella.plans.written import written

#: Relative slack of bounds, against rounding in cell numbers and distances.
SLACK = 1e-9
#: Rows of one location that an array holds, about.
BUNCH = 1024
#: Finest level of the cells of the nearest-neighbour join: 2**44 cells in a row, well above the rounding of doubles.
FINEST = 44


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def valid(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows whose coordinates are numbers: rows with a null, NaN or infinite one never match."""
    return df.where(finite(x, y))


def neighbours(cx: Column, cy: Column, reach: int = 1) -> Column:
    """The cells around a cell, itself included."""
    span = range(-reach, reach + 1)
    return F.array(*[F.struct((cx + dx).alias("cx"), (cy + dy).alias("cy")) for dx in span for dy in span])


def bunched(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Rows with equal ``by`` columns in arrays ``name`` of about ``BUNCH`` rows at most, if half of the rows or more repeat another's; else the rows as they are.

    A join of places then meets each pair of them once, and ``unbunched`` writes out the pairs of rows. Rows equal in all columns share an array.
    """
    e = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.count("*"), F.sum("n"), F.max("n")).first()
    if not e[0] or e[1] < 2 * e[0]:
        return df
    parts = -(-e[2] // BUNCH)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(parts)) if parts > 1 else F.lit(0)
    return df.groupBy(*by, salt.alias("salt__")).agg(F.collect_list(F.struct(*df.columns)).alias(name)).drop("salt__")


def unbunched(pairs: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return pairs.drop(*by).select("*", F.inline(name)).drop(name) if name in pairs.columns else pairs


def covering(box: Box, width: Column) -> Column:
    """Cells of a width that a box touches."""
    at = lambda v: F.floor(v / width).cast("long")
    xs, ys = F.sequence(at(box.xmin), at(box.xmax)), F.sequence(at(box.ymin), at(box.ymax))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def least_level(df: DataFrame, box: Box) -> int:
    """The finest level whose cell numbers a double tells apart at these coordinates, from one aggregate."""
    most = df.agg(F.max(F.greatest(*[F.abs(c) for c in box]))).first()[0]
    return math.ceil(math.log2(most)) - 48 if most else -48


def level_of(box: Box, least: int, finer: int = 0) -> Column:
    """Level whose cells, ``2 ** level`` wide, are at least as large as the box: a box touches at most four cells of its level, whatever the others' sizes. Of levels that are ``finer`` by two it touches at most 25."""
    size = F.greatest(box.xmax - box.xmin, box.ymax - box.ymin)
    return F.greatest(F.lit(least), F.when(size <= 0, least).otherwise(F.ceil(F.log2(size)) - finer)).cast("int")


def levels_in(df: DataFrame, level: str) -> list[int]:
    """Levels in use: a few dozen at most, as each doubles the width."""
    return sorted(r[0] for r in df.select(level).distinct().collect())


def box_point_pairs(boxes: DataFrame, box: Box, points: DataFrame, x: str, y: str) -> DataFrame:
    """Each point with each box that holds it. A box is dealt to the cells of its own level, a quarter of its size, a point to one cell of every level in use.

    Cells of that size meet about twice the points that the box holds. The dealt boxes are more than Spark estimates, so they are never a broadcast.
    """
    spread, dealt = _dealt(boxes, box, points, x, y)
    return spread.join(dealt.hint("merge"), ["lv__", "cx__", "cy__"]).where(box.contains(x, y)).drop("lv__", "cx__", "cy__")


def box_array_pairs(boxes: DataFrame, box: Box, points: DataFrame) -> DataFrame:
    """``boxes`` columns and ``part``: for each box and each array of points (v, x, y) near it, the values v of those that it holds; none without any."""
    spread, dealt = _dealt(boxes, box, points, "x", "y")
    salt = F.pmod(F.xxhash64("v", "x", "y"), F.greatest(F.lit(1), F.ceil(F.col("n__") / BUNCH)))
    cell = ["lv__", "cx__", "cy__"]
    sizes = spread.groupBy(*cell).agg(F.count("*").alias("n__"))
    arrays = spread.join(sizes.hint("merge"), cell).groupBy(*cell, salt.alias("salt__")).agg(F.collect_list(F.struct("x", "y", "v")).alias("points__")).drop("salt__")
    held = F.filter("points__", lambda p: box.contains(p["x"], p["y"]))
    pairs = arrays.join(dealt.hint("merge"), cell).withColumn("held__", held).where(F.size("held__") > 0)
    return pairs.select(*boxes.columns, F.transform("held__", lambda p: p["v"]).alias("part"))


def _dealt(boxes: DataFrame, box: Box, points: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Points and boxes with the cells (lv__, cx__, cy__) in which they may meet."""
    boxes = boxes.where(finite(*box) & (box.xmin <= box.xmax) & (box.ymin <= box.ymax))
    leveled = boxes.withColumn("lv__", level_of(box, least_level(boxes, box), 2))
    used = levels_in(leveled, "lv__")
    dealt = leveled.withColumn("c__", F.explode(covering(box, F.pow(F.lit(2.0), F.col("lv__"))))).withColumns({"cx__": F.col("c__.cx"), "cy__": F.col("c__.cy")}).drop("c__")
    own = F.array(*[F.struct(F.lit(v).alias("lv"), F.floor(F.col(x) / 2.0**v).cast("long").alias("cx"), F.floor(F.col(y) / 2.0**v).cast("long").alias("cy")) for v in used]) if used else F.array().cast("array<struct<lv:int,cx:bigint,cy:bigint>>")
    near = valid(points, x, y)
    if used:  # points beyond all boxes have no cell; the others' cell numbers stay within those of the boxes
        e = boxes.agg(F.min(box.xmin), F.min(box.ymin), F.max(box.xmax), F.max(box.ymax)).first()
        near = near.where(F.col(x).between(e[0], e[2]) & F.col(y).between(e[1], e[3]))
    spread = near.withColumn("p__", F.explode(own)).withColumns({"lv__": F.col("p__.lv"), "cx__": F.col("p__.cx"), "cy__": F.col("p__.cy")}).drop("p__")
    return spread, dealt


def box_pairs(a: DataFrame, abox: Box, b: DataFrame, bbox: Box) -> DataFrame:
    """Each pair of rows whose boxes meet, once: it is found at the larger one's level, in the cell of the common box's lower corner."""
    a, b = a.where(finite(*abox)), b.where(finite(*bbox))
    least = max(least_level(a, abox), least_level(b, bbox))
    a, b = a.withColumn("alv__", level_of(abox, least)), b.withColumn("blv__", level_of(bbox, least))
    used = sorted({*levels_in(a, "alv__"), *levels_in(b, "blv__")})

    def dealt(df: DataFrame, box: Box, own: str) -> DataFrame:
        cells = [F.when(F.col(own) <= v, F.transform(covering(box, F.lit(2.0**v)), _tagged(v))).otherwise(F.array().cast("array<struct<lv:int,cx:bigint,cy:bigint>>")) for v in used]
        cells = cells or [F.array().cast("array<struct<lv:int,cx:bigint,cy:bigint>>")]
        return df.withColumn("c__", F.explode(F.concat(*cells))).withColumns({"lv__": F.col("c__.lv"), "cx__": F.col("c__.cx"), "cy__": F.col("c__.cy")}).drop("c__")

    width = F.pow(F.lit(2.0), F.col("lv__"))
    corner = (F.floor(F.greatest(abox.xmin, bbox.xmin) / width) == F.col("cx__")) & (F.floor(F.greatest(abox.ymin, bbox.ymin) / width) == F.col("cy__"))
    joined = dealt(a, abox, "alv__").join(dealt(b, bbox, "blv__"), ["lv__", "cx__", "cy__"])
    return joined.where((F.greatest("alv__", "blv__") == F.col("lv__")) & abox.intersects(bbox) & corner).drop("lv__", "cx__", "cy__", "alv__", "blv__")


def _tagged(level: int):  # noqa: ANN202
    return lambda c: F.struct(F.lit(level).alias("lv"), c["cx"].alias("cx"), c["cy"].alias("cy"))


def no_pairs(left: DataFrame, right: DataFrame, *more: T.StructField) -> DataFrame:
    """An empty table with the columns of both."""
    return left.sparkSession.createDataFrame([], T.StructType([*left.schema.fields, *right.schema.fields, *more]))


def _cells(df: DataFrame, p: str) -> DataFrame:
    """Occupied cells with counts and tight bounds."""
    ends = [g(f"{p}_{c}").alias(f"{p}{n}{c}") for c in "xy" for n, g in (("min", F.min), ("max", F.max))]
    return df.groupBy(f"{p}lv", f"{p}cx", f"{p}cy").agg(F.count("*").alias(f"{p}n"), *ends)


def _placed(df: DataFrame, p: str, x0: float, y0: float, side: float) -> DataFrame:
    """Rows with the numbers of their cells at the finest level (ix, iy)."""
    at = lambda c, o: F.least(F.floor((F.col(c) - F.lit(o)) / F.lit(side) * float(1 << FINEST)), F.lit((1 << FINEST) - 1)).cast("long")
    return df.withColumns({f"{p}ix": at(f"{p}_x", x0), f"{p}iy": at(f"{p}_y", y0)})


def _at_level(df: DataFrame, p: str, level: Column) -> DataFrame:
    return df.withColumn(f"{p}lv", level.cast("int")).withColumns({f"{p}c{c}": F.expr(f"shiftright({p}i{c}, {FINEST} - {p}lv)") for c in "xy"})


def _deepened(df: DataFrame, p: str, heavy: DataFrame) -> DataFrame:
    """Rows in heavy cells move to these cells' next level."""
    on = [F.col(f"{p}{c}") == F.col(f"h{c}") for c in ("lv", "cx", "cy")]
    moved = df.join(heavy, on, "left")
    return _at_level(moved, p, F.coalesce("next", f"{p}lv")).drop("hlv", "hcx", "hcy", "next")


def knn_candidates(left: DataFrame, right: DataFrame, k: int, right_id: str = "r_id", full: int | None = None) -> DataFrame:
    """Pairs of ``left`` (l_x, l_y) and ``right`` (r_x, r_y) rows that hold the k nearest of every left row.

    Right rows lie in the leaves of a quadtree: cells that are split until they hold at most ``full`` rows (2k by default), or one location. A heavy cell goes at
    once to the level that its own rows call for, so an outlier or a dense cluster takes a few rounds, whatever the extent. Left rows follow the same splits.
    The leaves are counted, level by level, in the cells above them. A left cell takes the finest level at which the nine
    cells around it hold k rows: they all lie within 2 * sqrt(2) widths, so no candidate is further than three cells away. Running counts over the
    candidate leaves tighten that bound. Only cells, not rows, take part until the two final equi-joins. Of rows at one location in a full leaf the k least
    ids take part. The driver sees extents, the levels in use and how many cells are heavy. Rows with their cells, and cells with those above them, are many times the files that Spark
    estimates sizes by, so only a counted table is ever a broadcast.
    """
    l, r = valid(left, "l_x", "l_y"), valid(right, "r_x", "r_y")
    e = r.agg(F.count("*"), F.min("r_x"), F.max("r_x"), F.min("r_y"), F.max("r_y")).first()
    f = l.agg(F.count("*"), F.min("l_x"), F.max("l_x"), F.min("l_y"), F.max("l_y")).first()
    if not e[0] or not f[0]:
        return no_pairs(l, r)
    full = full or 2 * k
    x0, y0 = min(e[1], f[1]), min(e[3], f[3])
    side = max(max(e[2], f[2]) - x0, max(e[4], f[4]) - y0) or 1.0
    l, r = _placed(l, "l", x0, y0, side), _placed(r, "r", x0, y0, side)
    start = F.lit(min(FINEST, max(0, round(math.log(max(1.0, e[0] / full), 4)))))
    l, r = _at_level(l, "l", start), _at_level(r, "r", start)
    wide = F.greatest(F.col("rmaxx") - F.col("rminx"), F.col("rmaxy") - F.col("rminy"))
    while True:
        cells = written(_cells(r, "r"), "cells")
        fit = F.floor(F.log2(F.lit(side) / wide * F.sqrt(F.col("rn") / F.lit(full / 2))))
        next_ = F.least(F.lit(FINEST), F.greatest(F.col("rlv") + 1, fit)).cast("int")
        heavy = cells.where((F.col("rn") > full) & (wide > 0) & (F.col("rlv") < FINEST)).select(F.col("rlv").alias("hlv"), F.col("rcx").alias("hcx"), F.col("rcy").alias("hcy"), next_.alias("next"))
        found = heavy.count()
        if not found:
            break
        heavy = F.broadcast(heavy) if found * 32 <= 16 << 20 else heavy.hint("merge")
        l, r = _deepened(l, "l", heavy), _deepened(r, "r", heavy)
    spots = cells.where((F.col("rn") > full) & (wide == 0)).select(F.col("rlv").alias("slv"), F.col("rcx").alias("scx"), F.col("rcy").alias("scy")).hint("merge")
    if not spots.isEmpty():  # the k least ids of each location that fills a leaf
        on = [F.col(f"r{c}") == F.col(f"s{c}") for c in ("lv", "cx", "cy")]
        first = F.row_number().over(Window.partitionBy("rlv", "rcx", "rcy").orderBy(right_id))
        r = r.join(spots, on, "left_anti").unionByName(r.join(spots, on, "left_semi").withColumn("i__", first).where(F.col("i__") <= k).drop("i__"))
        cells = cells.withColumn("rn", F.when(wide == 0, F.least(F.col("rn"), F.lit(k))).otherwise(F.col("rn")))
    used = levels_in(cells, "rlv")
    lcells = written(_cells(l, "l"), "left")
    above = lambda df, p: df.withColumn("v", F.explode(F.sequence(F.lit(0), F.col(f"{p}lv")))).withColumns({"px": F.expr(f"shiftright({p}cx, {p}lv - v)"), "py": F.expr(f"shiftright({p}cy, {p}lv - v)")})
    rstack, lstack = above(cells, "r"), above(lcells.select("llv", "lcx", "lcy"), "l")
    pyramid = rstack.groupBy("v", "px", "py").agg(F.sum("rn").alias("n"))
    around = lstack.select("v", F.col("px").alias("ox"), F.col("py").alias("oy")).distinct().withColumn("c", F.explode(neighbours(F.col("ox"), F.col("oy"))))
    held = around.select("v", "ox", "oy", F.col("c.cx").alias("px"), F.col("c.cy").alias("py")).join(pyramid.hint("merge"), ["v", "px", "py"]).groupBy("v", "ox", "oy").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
    chosen = lstack.join(held.select("v", F.col("ox").alias("px"), F.col("oy").alias("py")).hint("merge"), ["v", "px", "py"]).groupBy("llv", "lcx", "lcy").agg(F.max("v").alias("v"))
    reach_of = F.pow(F.lit(2.0), -F.col("v").cast("double")) * (side * 2 * math.sqrt(2) * (1 + SLACK)) + side * 2.0**-50
    placed = lcells.join(chosen.hint("merge"), ["llv", "lcx", "lcy"], "left").withColumn("bound", F.when(F.col("v").isNull(), float("inf")).otherwise(reach_of)).withColumn("v", F.coalesce("v", F.lit(0)))
    placed = placed.withColumns({"ox": F.expr("shiftright(lcx, llv - v)"), "oy": F.expr("shiftright(lcy, llv - v)")})
    below = placed.withColumn("c", F.explode(neighbours(F.col("ox"), F.col("oy"), 3))).withColumns({"px": F.col("c.cx"), "py": F.col("c.cy")}).drop("c").join(rstack.hint("merge"), ["v", "px", "py"]).drop("v", "px", "py")
    wider = placed.withColumn("rlv", F.explode(F.filter(F.array(*map(F.lit, used)), lambda u: u < F.col("v"))))
    run = lambda c: F.explode(F.sequence(F.expr(f"shiftright(o{c} - 3, v - rlv)"), F.expr(f"shiftright(o{c} + 3, v - rlv)")))
    over = wider.withColumn("rcx", run("x")).withColumn("rcy", run("y")).join(cells.hint("merge"), ["rlv", "rcx", "rcy"]).drop("v")
    both = below.select(*over.columns).unionByName(over) if len(used) > 1 else below
    a, b = Box.of("lminx", "lminy", "lmaxx", "lmaxy"), Box.of("rminx", "rminy", "rmaxx", "rmaxy")
    far_x, far_y = F.greatest(a.xmax - b.xmin, b.xmax - a.xmin), F.greatest(a.ymax - b.ymin, b.ymax - a.ymin)
    pairs = both.withColumns({"lo": a.distance(b), "hi": F.sqrt(far_x * far_x + far_y * far_y)}).where("lo <= bound")
    mine = Window.partitionBy("llv", "lcx", "lcy")
    order = mine.orderBy("hi", "rlv", "rcx", "rcy").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("enough", F.sum("rn").over(order) >= k).withColumn("limit", F.min(F.when(F.col("enough"), F.col("hi"))).over(mine))
    pairs = pairs.where(F.col("limit").isNull() | (F.col("lo") <= F.col("limit") * (1 + SLACK))).select("llv", "lcx", "lcy", "rlv", "rcx", "rcy", "limit", "rminx", "rminy", "rmaxx", "rmaxy")
    near = l.join(pairs.hint("merge"), ["llv", "lcx", "lcy"]).where(F.col("limit").isNull() | (b.point_distance("l_x", "l_y") <= F.col("limit") * (1 + SLACK)))
    gone = ["llv", "lcx", "lcy", "rlv", "rcx", "rcy", "lix", "liy", "rix", "riy", "limit", "rminx", "rminy", "rmaxx", "rmaxy"]
    return near.join(r.hint("merge"), ["rlv", "rcx", "rcy"]).drop(*gone)


def cuts_below(z: Column, cuts: list[int], before: int = 0) -> Column:
    """How many of the sorted cuts are less than a value: a tree of comparisons, not one for each cut."""
    if not cuts:
        return F.lit(before)
    middle = len(cuts) // 2
    return F.when(z > F.lit(cuts[middle]).cast("long"), cuts_below(z, cuts[middle + 1 :], before + middle + 1)).otherwise(cuts_below(z, cuts[:middle], before))
