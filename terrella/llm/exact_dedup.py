"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Every input partition sends each owner of a hash range one Golomb-Rice coded list of its sorted
distinct fingerprints. The owners answer with bitmaps of those that other partitions hold too. Only
rows whose bit is set (or whose fingerprint repeats inside their partition) are suspects; their texts
are shuffled, one copy per task and distinct text, and compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrella.llm.store import save, ship, small

#: White space that counts as one space.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def golomb_encode(values: np.ndarray, bits: int) -> tuple[int, bytes]:
    """Golomb-Rice code of sorted distinct unsigned values below ``2**bits``: the remainder width and the packed streams of unary quotients and remainders."""
    n = len(values)
    if not n:
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(0, min(bits, 63) - int(n).bit_length())
    quotient = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    rest = (gaps[:, None] >> np.arange(width, dtype=np.uint64)[None, :]) & np.uint64(1)
    head = np.packbits(unary).tobytes()
    return width, len(unary).to_bytes(8, "little") + head + np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def golomb_decode(n: int, width: int, blob: bytes) -> np.ndarray:
    """The values of ``golomb_encode``."""
    if not n:
        return np.empty(0, np.uint64)
    size = int.from_bytes(blob[:8], "little")
    head = (size + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, head, 8), count=size)
    quotient = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    gaps = quotient.astype(np.uint64) << np.uint64(width)
    if width:
        rest = np.unpackbits(np.frombuffer(blob, np.uint8, offset=8 + head), count=n * width).reshape(n, width)
        for b in range(width):
            gaps |= rest[:, b].astype(np.uint64) << np.uint64(b)
    return np.cumsum(gaps, dtype=np.uint64)


def _ranges(values: np.ndarray, owner_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners that hold some of the sorted values, and where their runs start and end."""
    owner = (values >> np.uint64(64 - owner_bits)).astype(np.int64)
    own, first = np.unique(owner, return_index=True)
    return own, np.append(first, len(values))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), hashes_per_owner: int = 4_000_000) -> DataFrame:
    """One row per input row: id, ``carry`` columns, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after ``normalised``; null counts as the empty text. The row with the
    smallest id of a group stays; of rows that share that id, one. A null id loses to any other; a group of
    null ids keeps one row and has a null ``keep_id``. An empty table gives an empty result. Other columns
    of the table are ignored, whatever their names.

    Bounds: a task holds the fingerprints of its own input partition or, as an owner, about
    ``hashes_per_owner`` (each partition sends a hot fingerprint once). The fingerprints of suspects are broadcast
    only if they are counted and small, else joined by shuffle.
    """
    ship(df.sparkSession)
    rows = df.count()
    owner_bits = max(6, int(-(-rows // hashes_per_owner)).bit_length())
    pick = [F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]]
    texts = df.select(*pick, normalised(F.col(text_col)).alias("norm"))
    hashed = texts.select("*", F.xxhash64("norm").alias("fp")).select("id", *[f"c{i}" for i in range(len(carry))], "fp", F.unhex(F.sha2("norm", 256)).alias("sha")).withColumns({"pid": F.lit(0), "row": F.lit(0).cast("long"), "owner": F.lit(0).cast("long"), "n": F.lit(0), "width": F.lit(0), "blob": F.lit(None).cast("binary")})
    schema, names = hashed.schema, hashed.columns

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, row, seen = TaskContext.get().partitionId(), 0, []
        shape = None
        for batch in batches:
            shape, n = pa.schema([f.with_nullable(True) for f in batch.schema]), batch.num_rows
            seen.append(batch.column(names.index("fp")).to_numpy(zero_copy_only=False).view(np.uint64))
            columns = {c: batch.column(i) for i, c in enumerate(names)} | {"pid": pa.array(np.full(n, pid, np.int32)), "row": pa.array(np.arange(row, row + n))}
            row += n
            yield pa.RecordBatch.from_arrays([columns[c].cast(shape.field(c).type) for c in names], schema=shape)
        if row:
            values = np.unique(np.concatenate(seen))
            own, cut = _ranges(values, owner_bits)
            for o, a, b in zip(own, cut[:-1], cut[1:], strict=True):
                base = np.uint64(int(o) << (64 - owner_bits))
                width, blob = golomb_encode(values[a:b] - base, 64 - owner_bits)
                one = {"pid": pid, "owner": int(o), "n": int(b - a), "width": width, "blob": blob}
                yield pa.RecordBatch.from_arrays([pa.array([one.get(c)], f.type) if c in one else pa.nulls(1, f.type) for c, f in zip(names, shape, strict=True)], schema=shape)

    for f in schema.fields:
        f.nullable = True
    sent = save(hashed.mapInArrow(send, schema), "fingerprints")
    keys = sent.where("blob is null").select("pid", "row", "id", *[f"c{i}" for i in range(len(carry))], "fp", "sha")

    def answer(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb_decode(n, w, b) for n, w, b in zip(blobs.n, blobs.width, blobs.blob, strict=True)]
        values = np.sort(np.concatenate(lists))
        twice = np.unique(values[1:][values[1:] == values[:-1]])
        bits = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
        return pd.DataFrame({"pid": blobs.pid, "owner": key[0], "n": blobs.n, "bitmap": bits})

    bitmaps = sent.where("blob is not null").select("pid", "owner", "n", "width", "blob").groupBy("owner").applyInPandas(answer, "pid int, owner long, n int, bitmap binary")

    def flag(mine: pa.Table, maps: pa.Table) -> pa.Table:
        fp = mine.column("fp").to_numpy().view(np.uint64)
        values, inverse, count = np.unique(fp, return_inverse=True, return_counts=True)
        hit = count > 1
        own, cut = _ranges(values, owner_bits)
        got = {m["owner"]: np.unpackbits(np.frombuffer(m["bitmap"], np.uint8), count=m["n"]).astype(bool) for m in maps.to_pylist()}
        for o, a, b in zip(own, cut[:-1], cut[1:], strict=True):
            hit[a:b] |= got[int(o)]
        return mine.append_column("suspect", pa.array(hit[inverse]))

    flagged_schema = keys.withColumn("suspect", F.lit(True)).schema
    flagged = save(keys.groupBy("pid").cogroup(bitmaps.groupBy("pid")).applyInArrow(flag, flagged_schema), "suspects")
    suspects = flagged.where("suspect")
    probe = texts.select("id", "norm", F.xxhash64("norm").alias("fp"))
    doubtful = probe.join(small(suspects.select("fp").distinct(), 16), "fp", "left_semi")
    equal = doubtful.groupBy("fp", "norm").agg(F.min("id").alias("keep"), F.count("*").alias("size")).where("size > 1")
    equal = save(equal.select(F.unhex(F.sha2("norm", 256)).alias("gsha"), "keep", "size"), "equal")
    heads = suspects.groupBy("sha", "id").agg(F.min(F.struct("pid", "row")).alias("head"))
    groups = equal.join(heads, F.col("gsha").eqNullSafe(F.col("sha")) & F.col("keep").eqNullSafe(F.col("id"))).select("gsha", "keep", "size", "head")
    joined = suspects.join(groups, F.col("sha") == F.col("gsha"), "left")
    alone = flagged.where("not suspect").withColumns({"keep": F.col("id"), "size": F.lit(1).cast("long"), "kept": F.lit(True)})
    doubled = joined.withColumns({"kept": F.col("gsha").isNull() | (F.struct("pid", "row") == F.col("head")), "keep": F.when(F.col("gsha").isNull(), F.col("id")).otherwise(F.col("keep")), "size": F.coalesce("size", F.lit(1).cast("long"))})
    shown = [F.col("id").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256")]
    return alone.select(*shown).unionByName(doubled.select(*shown))
