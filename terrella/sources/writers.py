"""Result lines and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def knn_lines(nested: DataFrame, payload: str = "id", neighbours: str = "neighbours") -> DataFrame:
    """``payload;distance,id;...`` with eight decimals, nearest first."""
    pairs = F.transform(neighbours, lambda n: F.format_string("%.8f,%s", n["distance"], n["id"].cast("string")))
    line = F.concat(F.col(payload).cast("string"), F.lit(";"), F.array_join(pairs, ";"))
    return nested.select(F.when(F.size(neighbours) > 0, line).otherwise(F.col(payload).cast("string")).alias("value"))


def renested(flat: DataFrame, left: str = "l_id", right: str = "r_id") -> DataFrame:
    """Flat join rows as one row per left id with ``neighbours``."""
    return flat.groupBy(F.col(left).alias("id")).agg(F.array_sort(F.collect_list(F.struct("distance", F.col(right).alias("id")))).alias("neighbours"))


def match_lines(matched: DataFrame) -> DataFrame:
    """``payload,match,match,...``."""
    return matched.select(F.concat_ws(",", F.col("payload"), F.transform("matches", lambda m: m["payload"])).alias("value"))


def box_match_lines(pairs: DataFrame, payload: Column, box_id: Column, distance: Column, limit: float) -> DataFrame:
    """One line per point and box: the box's id follows if it is near enough."""
    return pairs.select(F.concat(payload.cast("string"), F.lit(","), F.when(distance <= limit, box_id.cast("string")).otherwise("")).alias("value"))


def write_lines(lines: DataFrame, path: str, compression: str = "gzip") -> None:
    """Compressed text in place of what the folder held."""
    lines.write.mode("overwrite").option("compression", compression).text(path)
