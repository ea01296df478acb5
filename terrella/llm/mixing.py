"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks. In the ideal mixture all sources that have blocks left flow at once, each in proportion
to its weight. A block is released in the slot in which its flow begins and due by the end of the slot in which it ends;
one block is placed in each slot, earliest deadline first, so a source is never a whole block away from its share.
Weights are taken as the exact fractions that floats are. Where a source runs out, the flow of the others rises: with
sources in the order in which they run out, the ideal slots passed until a block's end are a sum over the sources that are gone
and a product over those that go on.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.llm.store import fresh, numbered, save, ship, small


def pfair(weights: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """``(task, block, slot, release, deadline)`` of one period of ``sum(weights)`` slots, earliest deadline first among the released."""
    period = sum(weights)
    release = lambda i, k: k * period // weights[i]
    due = lambda i, k: -(-(k + 1) * period // weights[i])
    waiting = [(0, i, 0) for i, w in enumerate(weights) if w]
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(i, k), i, k))
        deadline, i, k = heapq.heappop(ready)
        out.append((i, k, slot, release(i, k), deadline))
        if k + 1 < weights[i]:
            heapq.heappush(waiting, (release(i, k + 1), i, k + 1))
    return out


def schedule(blocks: Sequence[int], weights: Sequence[float]) -> Iterator[tuple[int, int, int, int, int]]:
    """``(task, block, slot, release, deadline)`` of every slot, for tasks of so many blocks with positive weights. Holds a few numbers for each task."""
    ratios = [float(w).as_integer_ratio() for w in weights]
    scale = max((d for _, d in ratios), default=1)
    exact = [n * (scale // d) for n, d in ratios]  # all d are powers of two
    order = sorted((i for i, n in enumerate(blocks) if n), key=lambda i: (blocks[i] / exact[i], Fraction(blocks[i], exact[i])))
    ends = [blocks[i] / exact[i] for i in order]
    gone = [0, *accumulate(blocks[i] for i in order)]
    total = sum(exact[i] for i in order)
    live = [total, *(total - w for w in accumulate(exact[i] for i in order))]

    def passed(i: int, k: int) -> int:
        """Slots until k blocks of the task have flowed, times its weight."""
        m = bisect_left(ends, k / exact[i])
        while m < len(order) and blocks[order[m]] * exact[i] < k * exact[order[m]]:
            m += 1
        return gone[m] * exact[i] + live[m] * k

    ready = [(-(-passed(i, 1) // exact[i]), i, 0, 0) for i in order]
    heapq.heapify(ready)
    waiting: list[tuple[int, int, int]] = []
    for slot in range(gone[-1]):
        while waiting and waiting[0][0] <= slot:
            release, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-passed(i, k + 1) // exact[i]), i, k, release))
        deadline, i, k, release = heapq.heappop(ready)
        yield i, k, slot, release, deadline
        if k + 1 < blocks[i]:
            heapq.heappush(waiting, (passed(i, k + 1) // exact[i], i, k + 1))


def targets(totals: Mapping[str | None, int], weights: Mapping[str | None, float] | None, temperature: float, rest: float | None = None) -> dict[str | None, float]:
    """The weight of each source; those that ``weights`` leaves out share ``rest``, or as much as the given have."""
    own = {s: n**temperature for s, n in totals.items()}
    if not weights:
        return own
    given = math.fsum(w for s, w in weights.items() if s in totals) or 1.0
    others = math.fsum(v for s, v in own.items() if s not in weights) or 1.0
    return {s: weights[s] if s in weights else own[s] * (rest or given) / others for s in totals}


def mix(df: DataFrame, weights: Mapping[str | None, float] | None = None, source_col: str = "source", keep: Sequence[str] = ("doc_id",), block_rows: int = 32, temperature: float = 0.5, rest: float | None = None) -> DataFrame:
    """Every input row once: the ``keep`` columns, ``source``, ``block``, ``release``, ``deadline``, ``slot``, ``position``.

    ``position`` orders the mixture, gapless from 0. ``weights`` gives each source its target; sources that it leaves out (all, by default)
    get their row count to the power ``temperature``, scaled to ``rest`` (the same total, by default). The budget is one epoch: every row is placed once, so the targets hold among the sources that
    have rows left, and towards the end fewer and fewer have. A null source is a source of its own. Null ids and repeated
    rows are placed like any other; an empty table gives an empty result; other columns are ignored; a ``keep`` column named as one of the results stays, and the result
    gets a longer name (``slot_``). The
    order within a source follows a hash of the ``keep`` columns. Rows of a hot source are numbered by many tasks. One
    task walks through the slots, of ``block_rows`` rows each; it holds a few numbers for each source and gives its blocks out as it goes.
    """
    spark = df.sparkSession
    ship(spark)
    rows = save(df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(source_col).cast("string").alias("source"), F.monotonically_increasing_id().alias("tie")), "mixed")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    sources = save(rows.groupBy("source").count(), "sources")
    total, longest = sources.agg(F.sum("count"), F.max(F.octet_length("source"))).first()
    bad = [s for s, w in (weights or {}).items() if not 0 < w < math.inf]
    if bad and sources.where(key.isin(["-" if s is None else "s" + s for s in bad])).head(1):
        raise ValueError("weights must be positive")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((r["source"], r["count"]) for b in batches for r in b.to_pylist()), key=lambda r: (r[0] is not None, r[0] or ""))
        totals, names = dict(found), ["-" if s is None else "s" + s for s, _ in found]
        chosen = targets(totals, weights, temperature, rest)
        sizes, begin = [n for _, n in found], 0
        slots = schedule([-(-n // block_rows) for n in sizes], [chosen[s] for s, _ in found])
        while part := list(islice(slots, 10_000)):
            lengths = [min(block_rows, sizes[i] - k * block_rows) for i, k, *_ in part]
            begins = list(accumulate(lengths, initial=begin))
            begin = begins.pop()
            columns = {"who": pa.array([names[p[0]] for p in part], pa.string())} | {n: pa.array([p[j] for p in part], pa.int64()) for j, n in enumerate(("block", "slot", "release", "deadline"), 1)} | {"begin": pa.array(begins, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    blocks = save(sources.repartition(1).mapInArrow(place, "who string, block long, slot long, release long, deadline long, begin long"), "blocks")
    placed = numbered(rows, ["source"], [F.xxhash64(*[f"k{i}" for i in range(len(keep))]), F.col("tie")], "rank", total or 0)
    placed = placed.withColumns({"who": key, "block": F.expr(f"rank div {block_rows}"), "inner": F.expr(f"rank % {block_rows}")})
    joined = placed.join(small(blocks, 64 + (longest or 0)), ["who", "block"])
    results = ("block", "release", "deadline", "slot", "position")
    named = [F.col(c).alias(o) for c, o in zip(results, fresh(df.select(*keep), *results), strict=True)]
    return joined.withColumn("position", F.col("begin") + F.col("inner")).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *([] if "source" in keep else ["source"]), *named)
