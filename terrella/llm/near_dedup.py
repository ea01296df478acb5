"""SimHash near-duplicates by bit-sliced comparison.

Distinct fingerprints are dealt to buckets that fix one of ``radius + 1`` parts of the bits, so two
fingerprints within the radius meet in a bucket. A bucket is stored as vertical bit planes, 64
fingerprints to a word; one fingerprint is compared with 64 at a time by carry-save counters, and a
block is abandoned once all its lanes are beyond the radius. A bucket over ``bucket_size`` is dealt
again by the bits that it has not fixed. Buckets give spanning edges only; alternating star
contraction, a written table each round, turns the edges into components, until those left are
few enough for one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.llm.store import save, ship, small

#: Edges that one task turns into components, at most.
FEW_EDGES = 1 << 18

_LOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def simhash(text: str | bytes | None, size: int = 3, seed: int = 42) -> int:
    """Fingerprint of the word shingles of one text: a bit is set where over half the hashes have it; 0 without words."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()  # of bytes: A-Z and ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]
    array = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(array), 1 << 16):
        counts += np.unpackbits(array[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > len(array)).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), size: int = 3, seed: int = 42) -> DataFrame:
    """``id``, ``c0..`` (carried columns) and ``fp`` of every row."""
    ship(df.sparkSession)
    chosen = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).cast("binary").alias("fp"))
    out = chosen.withColumn("fp", F.lit(0).cast("long")).schema
    for field in out.fields:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([simhash(x.as_py(), size, seed) for x in batch.column(batch.num_columns - 1)], np.uint64).view(np.int64)
            fields = [f.with_nullable(True) for f in batch.schema][:-1] + [pa.field("fp", pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], schema=pa.schema(fields))

    return chosen.mapInArrow(run, out)


def parts(mask: int, radius: int) -> list[int]:
    """``mask`` with one of ``radius + 1`` nearly equal runs of its free bits added, each in turn."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(free) * i / (radius + 1)) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Blocks of 64 values stored vertically: row i holds 64 words, word b the b-th bits of block i."""
    blocks = -(-len(values) // 64)
    padded = np.zeros(blocks * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little").view(np.uint64).reshape(blocks, 64)


def within(values: np.ndarray, ends: np.ndarray, bits: Sequence[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < ends[i], of values that differ in at most ``radius`` of the given bits, found by carry-save counters over bit planes."""
    planes, me = bit_planes(values), np.arange(len(values))
    first, last = me // 64, (ends - 1) // 64
    target = radius + 1
    query, step = me[ends - me > 1], 0
    while len(query):
        at, block = query, first[query] + step
        alive = _LOW[np.clip(ends[at] - block * 64, 0, 64)] & ~_LOW[np.clip(at + 1 - block * 64, 0, 64)]
        count = [np.zeros(len(at), np.uint64) for _ in range(target.bit_length())]
        for n, b in enumerate(bits):
            carry = planes[block, b] ^ (np.uint64(0) - ((values[at] >> np.uint64(b)) & np.uint64(1)))
            over = alive.copy()
            for k in range(len(count)):
                count[k], carry = count[k] ^ carry, count[k] & carry
                over &= count[k] if target >> k & 1 else ~count[k]
            alive &= ~over
            if n % 6 == 5 and 2 * np.count_nonzero(alive) < len(alive):  # abandon the blocks whose lanes are all beyond
                keep = alive != 0
                at, block, alive, count = at[keep], block[keep], alive[keep], [c[keep] for c in count]
                if not len(at):
                    break
        if len(at):
            row, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield at[row], block[row] * 64 + lane
        step += 1
        query = query[first[query] + step <= last[query]]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        a, b = parent[a], parent[b]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != parent[parent]).any():
            parent[:] = parent[parent]


def _edges(batches: Iterator[pa.RecordBatch], masks: dict[int, int], radius: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    path, fp = table.column("path").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
    for p in np.unique(path):
        mine, mask = fp[path == p], masks[int(p)]
        key = mine & np.uint64(mask)
        order = np.lexsort((mine, key))
        mine, key = mine[order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(mine)))
        many = np.repeat(size > 1, size)
        mine, size = mine[many], size[size > 1]
        stop = np.cumsum(size)
        bits = [b for b in range(64) if not mask >> b & 1]
        at = 0
        while at < len(stop):
            to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + (1 << 17))))
            low = int(stop[at - 1]) if at else 0
            values = mine[low : stop[to - 1]]
            ends = np.repeat(stop[at:to] - low, size[at:to])
            parent = np.arange(len(values))
            for a, b in within(values, ends, bits, radius):
                _union(parent, a, b)
            child = np.flatnonzero(parent != np.arange(len(values)))
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(values[child].view(np.int64)), pa.array(values[parent[child]].view(np.int64))], names=["a", "b"])
            at = to


def links(distinct: DataFrame, radius: int = 2, bucket_size: int = 16_384, task_rows: int = 2_000_000) -> DataFrame:
    """Edges ``a``, ``b`` that connect every two of the distinct ``fp`` within the radius. No pair is left out: large buckets are dealt again."""
    spark = distinct.sparkSession
    ship(spark)
    if radius >= 8:
        raise ValueError("radius must be below 8")
    masks = dict(enumerate(parts(0, radius)))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    fork = lambda own: F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(signed(m)).cast("long").alias("mask")) for p, m in own.items()])).alias("way")
    level = distinct.select("fp", fork(masks)).select(F.col("way.path").alias("path"), F.expr("fp & way.mask").alias("key"), "fp")
    known, light = dict(masks), None
    while True:
        heavy = save(level.groupBy("path", "key").count().where(F.col("count") > bucket_size).select("path", "key"), "heavy")
        if not (found := heavy.count()):
            light = level if light is None else light.unionByName(level)
            break
        heavy = F.broadcast(heavy) if found * 16 <= 8 << 20 else heavy
        calm = level.join(heavy, ["path", "key"], "left_anti")
        light = calm if light is None else light.unionByName(calm)
        again = level.join(heavy, ["path", "key"], "left_semi")
        forks, deeper = [], {}
        for p, m in masks.items():
            new = {len(known) + i: x for i, x in enumerate(parts(m, radius))}
            known |= new
            deeper |= new
            forks.append((p, new))
        split = F.explode(F.flatten(F.array(*[F.when(F.col("path") == p, F.array(*[F.struct(F.lit(q).alias("path"), F.lit(signed(m)).cast("long").alias("mask")) for q, m in new.items()])).otherwise(F.array()) for p, new in forks])))
        level = save(again.select("fp", split.alias("way")).select(F.col("way.path").alias("path"), F.expr("fp & way.mask").alias("key"), "fp"), "buckets")
        masks = deeper
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() * (radius + 1) // task_rows))
    return light.repartition(n, "path", "key").select("path", "fp").mapInArrow(lambda it: _edges(it, known, radius), "a long, b long").distinct()


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node``, ``root`` of all edges ``u``, ``v`` in one task."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    names, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    parent = np.arange(len(names))
    _union(parent, *np.split(at, 2))
    child = np.flatnonzero(parent != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[child]), pa.array(names[parent[child]])], names=["node", "root"])


def stars(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """``node``, ``root`` of every node of the edges but the roots, which are the smallest of their components: alternating large and small stars, until one task takes the ``few`` edges left.

    A round writes two tables, and each of their files costs an executor processes of its own, which weigh as much as its JVM while they start.
    """
    ship(edges.sparkSession)
    now = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v"), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if state[0] <= few:
            return now.coalesce(1).mapInArrow(_components, "node long, root long")
        mark = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        large = save(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        now = save(large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "small")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), size: int = 3, seed: int = 42, radius: int = 2, bucket_size: int = 16_384) -> DataFrame:
    """One row per input row: id, ``carry`` columns, ``fingerprint`` (hex), ``component_id`` (the smallest id that links reach), ``component_fp``.

    Null and wordless texts have fingerprint zero and link like any other. Texts with fewer than ``size`` words are one
    shingle. A null id is never the smallest; a component of null ids has a null ``component_id``. Repeated rows
    share a fingerprint and so a component. An empty table gives an empty result; other columns are ignored.
    """
    rows = save(fingerprints(df, id_col, text_col, carry, size, seed), "simhash")
    distinct = save(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    tree = save(stars(links(distinct.select("fp"), radius, bucket_size)), "stars")
    linked = distinct.join(small(tree, 16), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = linked.select("fp", "root").join(component, "root")
    shown = rows.join(known, "fp")
    return shown.select(F.col("id").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("root").alias("component_fp"))


def dropped(found: DataFrame, id_col: str, rows: Sequence[str]) -> DataFrame:
    """``rows`` of all but one row of each component: the smallest id stays, of equal ids the first row."""
    head = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *rows)).alias("head")
    groups = found.groupBy("component_fp").agg(F.count("*").alias("n"), head).where("n > 1").select("component_fp", "head")
    joined = found.join(groups, "component_fp")
    return joined.where(~(F.struct(*rows) == F.struct(*[F.col(f"head.{c}").alias(c) for c in rows]))).select(*rows)


def shingles(text: str | bytes | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct word shingles of one text; fewer words are one shingle."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64))


def confirmed(rows: DataFrame, keys: Sequence[str], group_col: str, text_col: str = "text", size: int = 5, least: float = 0.5) -> DataFrame:
    """``keys`` of the rows that have at least the share ``least`` of their distinct shingles in another row of their group.

    Fingerprints of unlike texts come near each other by chance, the more so the more texts there are: these rows share no shingles with their group. Shingles are counted by group
    and hash, in each task first, so no group meets in one task and no pairs are formed. Null and empty texts are one shingle; a table without rows gives none.
    """
    ship(rows.sparkSession)
    names = [f"c{i}" for i in range(len(keys))]
    chosen = rows.select(*[F.col(c).alias(n) for n, c in zip(names, keys, strict=True)], F.col(group_col).alias("own"), F.col(text_col).cast("binary").alias("marks"))
    schema = chosen.withColumn("marks", F.array().cast("array<bigint>")).schema
    for field in schema.fields:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                got = pa.array([shingles(x.as_py(), size).view(np.int64) for x in batch.column(batch.num_columns - 1)], pa.list_(pa.int64()))
                fields = [f.with_nullable(True) for f in batch.schema][:-1] + [pa.field("marks", got.type)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], schema=pa.schema(fields))

    marks = save(chosen.mapInArrow(run, schema), "marks")
    single = marks.select(*names, "own", F.size("marks").alias("n"), F.explode("marks").alias("mark"))
    common = single.groupBy("own", "mark").agg(F.count("*").alias("rows")).where("rows > 1").select("own", "mark")
    shared = single.join(common, ["own", "mark"], "left_semi").groupBy(*names, "n").agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") >= F.lit(least) * F.col("n")).select(*[F.col(n).alias(c) for n, c in zip(names, keys, strict=True)])
