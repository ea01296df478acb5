"""Spatial ETL: OSM to WKT, samples, enumeration, extraction, projection and generators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrella.functions.geometry import Value, col
from terrella.functions.util import number_text
from terrella.plans.written import written


def osm_nodes(elements: DataFrame, column: str = "value") -> DataFrame:
    """``node``, ``lon``, ``lat`` of OSM XML nodes, one element a row."""
    attr = lambda name: F.regexp_extract(F.col(column), rf'<node\b[^>]*\b{name}="([^"]*)"', 1)
    return elements.where(F.col(column).rlike(r"<node\b")).select(attr("id").cast("long").alias("node"), attr("lon").cast("double").alias("lon"), attr("lat").cast("double").alias("lat"))


def osm_ways(elements: DataFrame, tag: str, value: str = "*", column: str = "value") -> DataFrame:
    """``way``, ``place``, ``node`` of the ways that carry the tag, with any value for ``*``."""
    wanted = rf'<tag\s+k="{tag}"\s+v="{"[^" + chr(34) + "]*" if value == "*" else value}"'
    ways = elements.where(F.col(column).rlike(r"<way\b") & F.col(column).rlike(wanted))
    return ways.select(F.regexp_extract(F.col(column), r'<way\b[^>]*\bid="([^"]*)"', 1).cast("long").alias("way"), F.posexplode(F.regexp_extract_all(F.col(column), F.lit(r'<nd\s+ref="([^"]*)"'), F.lit(1))).alias("place", "ref")).select("way", "place", F.col("ref").cast("long").alias("node"))


def osm_polygons(nodes: DataFrame, ways: DataFrame, low: tuple[float, float] = (-180.0, -90.0), high: tuple[float, float] = (180.0, 90.0)) -> DataFrame:
    """``way`` and ``line``: the id and the quoted polygon text, a comma after every pair. Nodes that are missing or outside the box are skipped."""
    inside = nodes.where(F.col("lon").between(low[0], high[0]) & F.col("lat").between(low[1], high[1]))
    lists = ways.join(inside, "node").groupBy("way").agg(F.array_sort(F.collect_list(F.struct("place", number_text("lon").alias("lon"), number_text("lat").alias("lat")))).alias("c"))
    pairs = F.array_join(F.transform("c", lambda p: F.concat(p["lon"], F.lit(" "), p["lat"], F.lit(","))), "")
    return lists.select("way", F.concat(F.col("way").cast("string"), F.lit(',"POLYGON(('), pairs, F.lit('))"')).alias("line"))


def point_text(df: DataFrame, x: str = "x", y: str = "y", space: bool = False) -> DataFrame:
    """Points as WKT lines."""
    return df.select(F.concat(F.lit("POINT (" if space else "POINT("), F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"), F.lit(")")).alias("value"))


def sample_rows(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n random rows with coordinates, then one row for each location."""
    return df.where(~F.isnan("x") & ~F.isnan("y")).orderBy(F.rand(seed)).limit(n).dropDuplicates(["x", "y"])


def sample_fraction(df: DataFrame, fraction: float, seed: int = 1, partitions: int | None = None) -> DataFrame:
    picked = df.sample(fraction, seed)
    return picked.repartition(partitions) if partitions else picked


def enumerated(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """Rows with numbers from 1 in an order: range partitions, written once, are sorted by themselves, and only their counts meet. Rows with equal order columns come in the order of a hash of all columns, so a repeated run numbers them alike."""
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.withColumn("tie__", tie)
    parts = written(keyed.repartitionByRange(*order, "tie__").withColumn("part__", F.spark_partition_id()), "enumerated")
    sizes = parts.groupBy("part__").agg(F.count("*").alias("size__"))
    before = sizes.select(F.col("part__").alias("p__"), F.coalesce(F.sum("size__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    own = F.row_number().over(Window.partitionBy("part__").orderBy(*order, "tie__"))
    return parts.withColumn("own__", own).join(F.broadcast(before), F.col("part__") == F.col("p__")).withColumn(name, F.col("before__") + F.col("own__")).drop("part__", "p__", "own__", "before__", "tie__")


def enumerate_split(df: DataFrame, *order: str, name: str, half: int = 1_000_000) -> DataFrame:
    """Rows with ids ``name_A_n`` for the first ``half`` and ``name_B_n`` for all others, in order."""
    numbered = enumerated(df, *order)
    first = F.col("n") <= half
    return numbered.withColumn("row_id", F.concat(F.lit(name + "_"), F.when(first, "A").otherwise("B"), F.lit("_"), F.when(first, F.col("n")).otherwise(F.col("n") - half).cast("string")))


def extract(df: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    return df.where(F.col(id_col).isin(ids))


def random_points(spark: SparkSession, n: int, kind: str = "uniform", seed: int = 1) -> DataFrame:
    """``id``, ``x``, ``y``: uniform in the unit square, or standard normal."""
    draw = {"uniform": F.rand, "gaussian": F.randn}[kind]
    return spark.range(n).select("id", draw(seed).alias("x"), draw(seed + 1).alias("y"))


def random_boxes(spark: SparkSession, n: int, size: float, seed: int = 1) -> DataFrame:
    at = spark.range(n).select("id", F.rand(seed).alias("xmin"), F.rand(seed + 1).alias("ymin"), (F.rand(seed + 2) * size).alias("w"), (F.rand(seed + 3) * size).alias("h"))
    return at.select("id", "xmin", "ymin", (F.col("xmin") + F.col("w")).alias("xmax"), (F.col("ymin") + F.col("h")).alias("ymax"))


def weighted_choice(weights: list[float], seed: int = 1) -> Column:
    """Index drawn by weight: the first whose running sum passes a random number."""
    total, sums = sum(weights), []
    for w in weights:
        sums.append((sums[-1] if sums else 0.0) + w / total)
    draw = F.rand(seed)
    out = F.array(*[F.lit(s) for s in sums[:-1]])
    return F.aggregate(out, F.struct(draw.alias("r"), F.lit(0).alias("i")), lambda s, v: F.struct(s["r"].alias("r"), (s["i"] + (s["r"] >= v).cast("int")).alias("i")), lambda s: s["i"])


# Fixed values of the EPSG:2263 projection: GRS80 ellipsoid, two parallels, origin, false easting in US survey feet.
_A, _E = 6378137.0, math.sqrt(2 / 298.257222101 - (1 / 298.257222101) ** 2)
_PARALLELS, _ORIGIN, _EASTING, _FOOT = (40 + 40 / 60, 41 + 2 / 60), (-74.0, 40 + 10 / 60), 300000.0, 1200 / 3937


def lambert_constants() -> tuple[float, float, float, float, float]:
    """Semi-axis, eccentricity, and the cone's exponent, factor and radius at the origin."""
    m = lambda p: math.cos(p) / math.sqrt(1 - (_E * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - _E * math.sin(p)) / (1 + _E * math.sin(p))) ** (_E / 2)
    p1, p2 = map(math.radians, _PARALLELS)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    return _A, _E, n, f, _A * f * t(math.radians(_ORIGIN[1])) ** n


def to_state_plane(lon: Value, lat: Value) -> tuple[Column, Column]:
    """WGS84 degrees to EPSG:2263 feet: Lambert's conformal conic with two parallels, in closed form."""
    _, _, n, f, rho0 = lambert_constants()
    phi = F.radians(col(lat))
    own = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - F.sin(phi) * _E) / (1 + F.sin(phi) * _E), F.lit(_E / 2))
    rho, theta = F.pow(own, F.lit(n)) * (_A * f), (F.radians(col(lon)) - math.radians(_ORIGIN[0])) * n
    return (rho * F.sin(theta) + _EASTING) / _FOOT, (F.lit(rho0) - rho * F.cos(theta)) / _FOOT
