"""Comparison of a nearest-neighbour result with a key result, with tolerance for ties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of the report, in order.
LABELS = ("both_no_match", "only_in_key", "only_in_other", "undermatched", "overmatched", "distance_only", "correct", "mismatch", "total")


def read_results(lines: DataFrame, column: str = "value", key: Callable[[Column], Column] | None = None) -> DataFrame:
    """``key`` and ``matches`` (distance text, id) of lines ``key;d1,id1;d2,id2``; lines are lower-cased and equal distances come in order of id."""
    parts = F.split(F.lower(F.col(column)), ";")
    own = key(parts[0]) if key else parts[0]
    pair = lambda p: F.struct(F.split(p, ",", 2)[0].alias("distance"), F.try_element_at(F.split(p, ",", 2), F.lit(2)).alias("id"))
    pairs = F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), pair), lambda m: F.length(m["distance"]) > 0)
    ordered = F.array_sort(F.transform(pairs, lambda m: F.struct(F.try_to_number(m["distance"], F.lit("9999999999.99999999")).cast("double").alias("d"), m["id"].alias("id"), m["distance"].alias("distance"))))
    return lines.select(own.alias("key"), F.transform(ordered, lambda m: F.struct(m["distance"].alias("distance"), m["id"].alias("id"))).alias("matches"))


def classified(key: DataFrame, other: DataFrame, count: int) -> DataFrame:
    """One row per key of either side with a 0/1 column for each label (``distance_only`` counts positions).

    Inputs have ``key`` and ``matches``. Distances are compared as text, position by position, for the first ``count``; another id at an equal distance is correct.
    """
    a = key.select("key", F.col("matches").alias("want"), F.lit(True).alias("in_key"))
    b = other.select(F.col("key").alias("key_b"), F.col("matches").alias("got"), F.lit(True).alias("in_other"))
    both = a.join(b, F.col("key").eqNullSafe(F.col("key_b")), "full_outer").withColumn("key", F.coalesce("key", "key_b"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    both = both.withColumns({"nw": F.when(F.col("in_key"), size("want")).otherwise(0), "ng": F.when(F.col("in_other"), size("got")).otherwise(0)})
    here = F.col("in_key").isNotNull() & F.col("in_other").isNotNull()
    both = both.withColumn("state", F.when(F.col("in_other").isNull(), "only_in_key").when(F.col("in_key").isNull(), "only_in_other").when((F.col("nw") == 0) & (F.col("ng") == 0), "both_no_match").when((F.col("ng") < count) & (F.col("ng") < F.col("nw")), "undermatched").otherwise("compared"))
    width = F.least(F.lit(count), "nw")
    pairs = F.zip_with(F.slice("want", F.lit(1), F.greatest(width, F.lit(0))), F.slice("got", F.lit(1), F.greatest(width, F.lit(0))), lambda w, g: F.when(~w["distance"].eqNullSafe(g["distance"]), 2).when(~w["id"].eqNullSafe(g["id"]), 1).otherwise(0))
    both = both.withColumn("codes", F.when(F.col("state") == "compared", pairs).otherwise(F.array().cast("array<int>")))
    equal = ~F.exists("codes", lambda c: c == 2)
    flag = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    compared = F.col("state") == "compared"
    return both.select(
        "key", flag(F.col("state") == "both_no_match").alias("both_no_match"), flag(F.col("state") == "only_in_key").alias("only_in_key"), flag(F.col("state") == "only_in_other").alias("only_in_other"),
        flag(F.col("state") == "undermatched").alias("undermatched"), flag(here & compared & (F.col("ng") > F.col("nw"))).alias("overmatched"),
        F.when(compared & equal, F.size(F.filter("codes", lambda c: c == 1))).otherwise(0).cast("long").alias("distance_only"),
        flag((F.col("state") == "both_no_match") | (compared & equal)).alias("correct"), flag((F.col("state") != "both_no_match") & ~(compared & equal)).alias("mismatch"), F.lit(1).cast("long").alias("total"),
    )


def compared(key: DataFrame, other: DataFrame, count: int) -> DataFrame:
    """``label``, ``n`` and ``percent`` of all keys, for every label."""
    sums = classified(key, other, count).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in LABELS])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("label"), F.col(c).alias("n"), F.col("total").alias("of")) for i, c in enumerate(LABELS)])).alias("r")
    return sums.select(rows).select("r.place", "r.label", "r.n", F.when(F.col("r.of") > 0, F.round(F.col("r.n") * 100.0 / F.col("r.of"), 4)).otherwise(0.0).alias("percent"))


def report(result: DataFrame) -> DataFrame:
    """One formatted line per label."""
    return result.orderBy("place").select(F.format_string("%s: %,d (%.2f%%)", F.initcap(F.replace("label", F.lit("_"), F.lit(" "))), "n", "percent").alias("line"))


def report_values(lines: DataFrame, column: str = "line") -> DataFrame:
    """Labels and numbers of report lines, tab-separated."""
    pattern = r"^([^:]+): ([0-9,]+) \(([0-9.]+)%\)$"
    part = lambda i: F.regexp_extract(F.col(column), pattern, i)
    return lines.where(F.col(column).rlike(pattern)).select(F.concat_ws("\t", part(1), F.replace(part(2), F.lit(","), F.lit("")), part(3)).alias("tsv"))


def rank_buckets(key: DataFrame, other: DataFrame) -> DataFrame:
    """How far down the other's list the key's first match stands, counted by bucket."""
    first = key.select("key", F.try_element_at("matches", F.lit(1))["id"].alias("id"), F.size("matches").alias("nw"))
    joined = first.join(other.select("key", "matches"), "key", "left").withColumn("at", F.when(F.col("id").isNotNull(), F.array_position(F.transform("matches", lambda m: m["id"]), F.col("id"))))
    bucket = F.when(F.col("nw") == 0, F.when(F.coalesce(F.size("matches"), F.lit(0)) == 0, "ok_no_match").otherwise("no_match")).when(F.col("at") == 1, "1").when(F.col("at") == 2, "2").when(F.col("at") == 3, "3").when(F.col("at").between(4, 6), "4-6").when(F.col("at").between(7, 9), "7-9").when(F.col("at") > 9, "10+").otherwise("no_match")
    return joined.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
