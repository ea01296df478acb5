"""Spatial tables derived from the relational ones, once for Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Derived tables of a folder; each reads only the columns that it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def customer(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_acctbal").cast("double").alias("x"), (F.col("c_nationkey") * 400).cast("double").alias("y"))

    def customer_text(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_acctbal").cast("double").alias("x"), (F.col("c_nationkey") * 400).cast("double").alias("y"), F.col("c_mktsegment").alias("text"))

    def supplier(self) -> DataFrame:
        return self.read("supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_acctbal").cast("double").alias("x"), (F.col("s_nationkey") * 400).cast("double").alias("y"))

    def part(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))

    def order(self) -> DataFrame:
        days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
        return self.read("orders").select(F.col("o_orderkey").cast("long").alias("id"), (F.col("o_totalprice").cast("double") / 50).alias("x"), (days * 4).cast("double").alias("y"))

    def event(self) -> DataFrame:
        return self.read("events").select(F.col("event_id").cast("long").alias("id"), (F.col("value").cast("double") * 20).alias("x"), (F.col("user_id") * 60).cast("double").alias("y"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))

    def boxes(self) -> DataFrame:
        return self.supplier().select("id", (F.col("x") - 500).alias("xmin"), (F.col("y") - 800).alias("ymin"), (F.col("x") + 500).alias("xmax"), (F.col("y") + 800).alias("ymax"))

    def polygons(self) -> DataFrame:
        cx, cy = (F.col("n_nationkey") * 400).cast("double"), (F.lit(9600) - F.col("n_nationkey") * 400).cast("double")
        at = lambda dx, dy: F.struct((cx + dx).alias("x"), (cy + dy).alias("y"))
        return self.read("nation").select(F.col("n_nationkey").cast("long").alias("id"), cx.alias("cx"), cy.alias("cy"), F.array(at(-600.0, 0.0), at(0.0, -900.0), at(600.0, 0.0), at(0.0, 900.0), at(-600.0, 0.0)).alias("ring"))

    def lines(self) -> DataFrame:
        days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
        at = F.struct(F.col("o_orderkey").alias("k"), (F.col("o_totalprice").cast("double") / 50).alias("x"), (days * 4).cast("double").alias("y"))
        own = self.read("orders").groupBy(F.col("o_custkey").cast("long").alias("id")).agg(F.array_sort(F.collect_list(at)).alias("c")).where("size(c) >= 2")
        return own.select("id", F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("coords"))


#: The same tables in DuckDB; every oracle begins with them.
WITH = """WITH customer_pts AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_acctbal AS DOUBLE) AS x, CAST(c_nationkey * 400 AS DOUBLE) AS y, c_mktsegment AS text FROM customer),
supplier_pts AS (SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_acctbal AS DOUBLE) AS x, CAST(s_nationkey * 400 AS DOUBLE) AS y FROM supplier),
part_pts AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part),
order_pts AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS cust, CAST(o_totalprice AS DOUBLE) / 50 AS x, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 4 AS DOUBLE) AS y FROM orders),
event_pts AS (SELECT CAST(event_id AS BIGINT) AS id, CAST(value AS DOUBLE) * 20 AS x, CAST(user_id * 60 AS DOUBLE) AS y, CAST(ts AS TIMESTAMP) AS ts, event_type AS kind FROM events),
supplier_boxes AS (SELECT id, x - 500 AS xmin, y - 800 AS ymin, x + 500 AS xmax, y + 800 AS ymax FROM supplier_pts),
nation_polys AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey * 400 AS DOUBLE) AS cx, CAST(9600 - n_nationkey * 400 AS DOUBLE) AS cy FROM nation),
line_points AS (SELECT cust AS id, x, y, row_number() OVER (PARTITION BY cust ORDER BY id) AS n, count(*) OVER (PARTITION BY cust) AS c FROM order_pts),
line_segments AS (SELECT id, n, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM line_points WHERE c >= 2 WINDOW w AS (PARTITION BY id ORDER BY n))
"""
