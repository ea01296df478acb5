"""Shards by k-d tree partitioning.

A node that is to hold several shards is split along its widest metadata dimension at the weighted
median of its rows' bytes (the weight left of the cut follows the shards on either side). The tree is a table:
each level's splits are rows, and every row of the input carries the number of its node in a written table that is
written anew for each level. Medians are found by histograms: a pass sums bytes by node and bin for all nodes of a
level, a window over a node's bins finds the one that the median falls in, and the next pass bins that again. All of this is
joins and sums; the driver sees the whole ranges of the dimensions and how many nodes are still without a cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from terrella.llm.store import BROADCAST_BYTES, fresh, numbered, save, small

#: Bins for each node and pass: at least the first number, at most the second, and no more than the third over all nodes if that leaves the first.
BINS = (512, 65_536, 1 << 20)
#: Bytes that a row of a level's tables takes in a broadcast, at most.
_NODE_BYTES = 256


def ranks(values: DataFrame) -> DataFrame:
    """``value`` and ``code``: the distinct strings of a table's only column, numbered from 0 in order. Range partitions are sorted by themselves."""
    distinct = values.toDF("value").where("value is not null").distinct()
    parts = save(distinct.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values")
    sizes = parts.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return save(parts.withColumn("own", own).join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("own")).cast("long").alias("code")), "ranks")


def _dims(n: int) -> Column:
    return F.array(*[F.col(f"d{i}") for i in range(n)])


def _held(table: DataFrame, nodes: int) -> DataFrame:
    """A table of at most so many nodes, for broadcast if these are few."""
    return F.broadcast(table) if nodes * _NODE_BYTES <= BROADCAST_BYTES else table


def _open_nodes(rows: DataFrame, nodes: DataFrame, many: int, n: int, whole: Mapping[str, float], unit: float) -> DataFrame:
    """The state of each node to be split: dimension, byte rank of the cut, and the interval of the dimension's values that the cut lies in."""
    names = [*(f"d{i}" for i in range(n)), "id", "tie"]
    stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(c).alias(f"{k}_{c}") for c in names for k, f in (("min", F.min), ("max", F.max))])
    wide = F.array(*[(F.col(f"max_d{i}").cast("double") - F.col(f"min_d{i}")) / F.lit(whole[f"d{i}"]) for i in range(n)])
    at = lambda k: F.element_at(F.array(*[F.col(f"{k}_d{i}") for i in range(n)]), F.col("dim"))
    found = stats.join(_held(nodes.where("shards > 1"), many), "node").withColumn("dim", F.array_position(wide, F.array_max(wide)).cast("int"))
    zero = F.lit(0).cast("long")
    return found.select(
        "node", "shards", "dim", (F.col("bytes").cast("double") * F.expr("shards div 2") / F.col("shards")).alias("want"), F.lit(unit).alias("unit"), zero.alias("below"), F.lit(0).alias("stage"), at("min").alias("low"), at("max").alias("high"),
        zero.alias("fixed0"), zero.alias("fixed1"), "min_id", "max_id", "min_tie", "max_tie", F.lit(False).alias("done"), F.lit(False).alias("inclusive"),
    )


def _narrowed(rows: DataFrame, state: DataFrame, many: int, n: int) -> DataFrame:
    """One pass: each node's interval shrinks to the bin that holds its median; a node is ``done`` once the cut is found.

    Rows are compared by the dimension, then by id, then by place: a stage for each, entered when one value is left of the last.
    """
    v = F.when(F.col("stage") == 0, F.element_at(_dims(n), F.col("dim"))).when(F.col("stage") == 1, F.col("id")).otherwise(F.col("tie"))
    here = ((F.col("stage") < 1) | (F.element_at(_dims(n), F.col("dim")) == F.col("fixed0"))) & ((F.col("stage") < 2) | (F.col("id") == F.col("fixed1")))
    bins_each = max(BINS[0], min(BINS[1], BINS[2] // many))
    width = F.expr(f"high div {bins_each} - low div {bins_each} + 1")
    near = rows.join(_held(state.where("not done"), many), "node").where(here).withColumn("v", v).where("v between low and high").withColumn("w", width)
    bins = near.groupBy("node", F.expr("v div w").alias("bin")).agg(F.min("v").alias("from"), F.max("v").alias("to"), F.sum("size").alias("weight"))
    order = Window.partitionBy("node").orderBy("from")
    run = bins.withColumns({"upto": F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)), "last": F.lead("from").over(order).isNull()})
    held = run.join(_held(state.where("not done"), many), "node").where((F.col("below") + F.col("upto") >= F.col("want")) | F.col("last"))
    median = held.groupBy("node").agg(F.min(F.struct("from", "to", "weight", "upto")).alias("m"))
    old = state.where("not done").join(median, "node")
    upto = F.col("below") + F.col("m.upto")
    one, low = F.col("m.from") == F.col("m.to"), F.col("m.from")
    cut = (F.col("m.weight") <= F.col("unit")) | (one & (F.col("stage") == 2))
    next_id, next_tie = ~cut & one & (F.col("stage") == 0), ~cut & one & (F.col("stage") == 1)
    inclusive = F.col("want") - (upto - F.col("m.weight")) > upto - F.col("want")
    found = old.select(
        "node", "shards", "dim", "want", "unit", (upto - F.col("m.weight")).alias("below"), F.when(next_id | next_tie, F.col("stage") + 1).otherwise(F.col("stage")).alias("stage"),
        F.when(cut, F.when(inclusive, F.col("m.to")).otherwise(low)).when(next_id, F.col("min_id")).when(next_tie, F.col("min_tie")).otherwise(low).alias("low"), F.when(next_id, F.col("max_id")).when(next_tie, F.col("max_tie")).otherwise(F.col("m.to")).alias("high"),
        F.when(next_id, low).otherwise(F.col("fixed0")).alias("fixed0"), F.when(next_tie, low).otherwise(F.col("fixed1")).alias("fixed1"), "min_id", "max_id", "min_tie", "max_tie", cut.alias("done"), (cut & inclusive).alias("inclusive"),
    )
    return found.unionByName(state.where("done"))


def _stepped(rows: DataFrame, splits: DataFrame, many: int, n: int) -> DataFrame:
    """The rows with ``node`` one level further down: the left child keeps the number, the right one is as many shards on. Nodes without a split stay."""
    key = [F.element_at(_dims(n), F.col("dim")), F.col("id"), F.col("tie")]
    upto = lambda v: (v < F.col("low")) | (F.col("inclusive") & (v == F.col("low")))
    within_id = F.when(F.col("stage") == 1, upto(key[1])).otherwise((key[1] < F.col("fixed1")) | ((key[1] == F.col("fixed1")) & upto(key[2])))
    left = F.when(F.col("stage") == 0, upto(key[0])).otherwise((key[0] < F.col("fixed0")) | ((key[0] == F.col("fixed0")) & within_id))
    moved = rows.join(_held(splits, many), "node", "left")
    return moved.withColumn("node", F.when(F.col("dim").isNull() | left, F.col("node")).otherwise(F.col("node") + F.expr("shards div 2"))).select(*rows.columns)


def kd_tree(rows: DataFrame, n: int, shards: int, tolerance: float = 2e-4) -> list[DataFrame]:
    """The tree as a table of splits for each level. ``rows`` is a written table with ``size``, ``id``, ``tie`` and ``n`` dimensions ``d0``.. as longs."""
    spark, levels = rows.sparkSession, []
    names = [*(f"d{i}" for i in range(n)), "id", "tie"]
    range_ = rows.agg(F.sum("size"), *[(F.max(c).cast("double") - F.min(c)).alias(c) for c in names[:n]]).first()
    if range_[0] is None:
        return []
    whole = {c: max(1.0, range_[c]) for c in names[:n]}
    zero = F.lit(0).cast("long")
    now = rows.select(*names, "size", zero.alias("node"))
    nodes = spark.range(1).select(zero.alias("node"), F.lit(shards).cast("long").alias("shards"))
    most, many = shards, 1  # shards of the largest node, and nodes of the level at most
    while most > 1:
        state = save(_open_nodes(now, nodes, many, n, whole, tolerance * range_[0] / shards), "open")
        while not state.where("not done").isEmpty():
            state = save(_narrowed(now, state, many, n), "narrowed")
        splits = state.select("node", "shards", "dim", "stage", "fixed0", "fixed1", "low", "inclusive")
        levels.append(splits)
        half = F.expr("shards div 2")
        nodes = splits.select("node", half.alias("shards")).unionByName(splits.select((F.col("node") + half).alias("node"), (F.col("shards") - half).alias("shards")))
        most = -(-most // 2)
        if most > 1:
            now = save(_stepped(now, splits, many, n), "level")
        many = min(shards, 2 * many)
    return levels


def kd_shards(df: DataFrame, dims: Mapping[str, Column], shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ("doc_id",), row_bytes: int = 8) -> DataFrame:
    """One row per input row: the ``keep`` columns, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    A row weighs its text in UTF-8 plus ``row_bytes``; a null text weighs ``row_bytes``. Splits go on until there are ``shards`` leaves, or as
    many as bring a leaf to ``target_bytes``. A string dimension counts by the rank of the whole string among the distinct ones. Nulls in a dimension or id sort first. Ties are cut by id, then by the row's
    place in the written table, so repeated rows and a hot source are split like any others. An empty table gives an empty result; fewer rows than
    shards leave shards empty. Other columns are ignored; a ``keep`` column named as one of the results stays, and the result gets a longer name
    (``size_``). Sizes differ by less than about a row and 0.1 % of a shard for each level of the tree.
    """
    n = len(dims)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")).alias("id"), (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[d.alias(f"d{i}") for i, d in enumerate(dims.values())], F.monotonically_increasing_id().alias("tie"))
    for i, d in enumerate(dims.values()):
        if isinstance(base.schema[f"d{i}"].dataType, StringType):
            codes = ranks(df.select(d))
            longest = codes.agg(F.max(F.octet_length("value"))).first()[0] or 0
            base = base.join(small(codes, 32 + longest), F.col(f"d{i}") == F.col("value"), "left").withColumn(f"d{i}", F.col("code")).drop("value", "code")
        else:
            base = base.withColumn(f"d{i}", F.col(f"d{i}").cast("long"))
    base = save(base.na.fill(-1, [f"d{i}" for i in range(n)]), "kd")
    total, rows = base.agg(F.sum("size"), F.count("*")).first()
    placed = base.withColumn("node", F.lit(0).cast("long"))
    for level, splits in enumerate(kd_tree(base, n, shards or max(1, round((total or 0) / (target_bytes or 1))))):
        placed = _stepped(placed, splits, 2**level, n)
    out = fresh(df.select(*keep), "size", "text_crc32", "shard", "slot")
    placed = save(placed.select(*[f"k{i}" for i in range(len(keep))], "id", "tie", "size", "text_crc32", F.col("node").cast("int").alias("shard")), "placed")
    slots = numbered(placed, ["shard"], [F.col("id"), F.col("tie")], "slot", rows)
    return slots.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(o) for c, o in zip(("size", "text_crc32", "shard", "slot"), out, strict=True)])
