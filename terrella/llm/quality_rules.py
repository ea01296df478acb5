"""Quality rules with host-level verdicts.

Each text gets counts and penalty points for the rules that it fails. Failures are summed by host, the
rates shrink towards a beta prior that is fitted to all hosts, and the host's rate decides how many
points a document may have.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrella.llm.store import save, ship, small

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_lines")
_WHITE = b" \t\n\v\f\r"


def repeated_words(words: Sequence[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more, the first one included."""
    if len(words) <= size:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    code = ids[: len(ids) - size + 1]
    for k in range(1, size):
        if int(code.max()) * len(seen) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(seen) + ids[k : len(ids) - size + 1 + k]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(size):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def text_counts(data: bytes) -> tuple[int, ...]:
    """``COUNTS`` of one text in UTF-8. Words are runs without ASCII white space; lines count if they hold a word."""
    words = data.split()
    chars = len(data) - len(data.translate(None, bytes(range(0x80, 0xC0)))) if not data.isascii() else 0
    solid = len(data.translate(None, _WHITE)) - chars
    lines, seen, dups = [x for x in data.split(b"\n") if x.strip(_WHITE)], set(), 0
    for line in lines:
        dups += line in seen
        seen.add(line)
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    return len(words), solid, symbols, dups, repeated_words(words), data.count(b"!"), len(lines)


def counted(df: DataFrame, keep: Sequence[Column], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with ``COUNTS`` of the whole texts."""
    ship(df.sparkSession)
    chosen = df.select(*keep, F.col(text_col).cast("binary").alias("text__"))
    schema = T.StructType([*chosen.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [text_counts(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema=pa.schema([*list(batch.schema)[:-1], *[pa.field(c, pa.int64()) for c in COUNTS]]))

    return chosen.mapInArrow(run, schema)


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def points() -> Column:
    """One point for each rule that a text fails, two where it fails it by far: symbols, exclamation marks, repeated lines, repeated words, word length."""
    return F.expr(
        "int(10 * n_symbols > word_chars) + int(4 * n_symbols > word_chars)"
        " + int(4 * n_bangs > n_words) + int(2 * n_bangs > n_words)"
        " + int(4 * n_dup_lines > n_lines) + int(2 * n_dup_lines > n_lines)"
        " + int(100 * n_repeat_words > 30 * n_words)"
        " + int(n_words > 0 and (word_chars > 20 * n_words or word_chars < 2 * n_words))"
    )


def host_rates(judged: DataFrame, host: str = "host") -> DataFrame:
    """``host``, ``host_docs``, ``host_failed`` and ``host_rate``: the posterior mean under a beta prior fitted by moments to all hosts.

    Hosts that agree beyond chance share the pooled rate. One row of moments goes to the driver.
    """
    hosts = save(judged.groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed")), "hosts")
    total = hosts.agg(F.count("*").alias("k"), F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.sum(F.col("host_docs").cast("double") ** 2).alias("nn")).first()
    if not total["n"]:
        return hosts.withColumn("host_rate", F.lit(0.0))
    mean = total["f"] / total["n"]
    spread = hosts.agg(F.sum(F.col("host_docs") * (F.col("host_failed") / F.col("host_docs") - F.lit(mean)) ** 2)).first()[0]
    room = total["n"] - total["nn"] / total["n"]
    between = (spread - (total["k"] - 1) * mean * (1 - mean)) / room if room > 0 else 0.0
    weight = min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6
    return hosts.withColumn("host_rate", (F.col("host_failed") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight)))


def allowed(rate: Column) -> Column:
    """Points that a document may have: none on a host where half fail, one on a usual host, two on a clean one."""
    return F.when(rate >= 0.5, 0).when(rate >= 0.02, 1).otherwise(2)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: id, ``carry`` columns, ``COUNTS``, ``base_failed``, ``points``, ``host_docs``, ``host_failed``, ``host_rate``, ``kept``.

    Null texts count as empty and fail for want of words. Rows without a host form one host. Repeated rows are judged
    alike; an empty table gives an empty result; other columns are ignored. A text without points is
    never rejected for its host. Failures are pre-summed in each task; a hot host's rows stay where they are or are split by adaptive joins.
    """
    keep = [F.col(id_col).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(carry)], F.col(host_col).cast("string").alias("host")]
    judged = save(counted(df, keep, text_col).withColumns({"base_failed": base_failed(), "points": points()}).withColumn("failed", F.expr("base_failed or points > 0")), "rules")
    rates = host_rates(judged).withColumnRenamed("host", "host__")
    joined = judged.join(small(rates, 64), F.col("host").eqNullSafe(F.col("host__")))
    kept = ~F.col("base_failed") & (F.col("points") <= allowed(F.col("host_rate")))
    return joined.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(carry)], *COUNTS, "base_failed", "points", "host_docs", "host_failed", F.round("host_rate", 6).alias("host_rate"), kept.alias("kept"))
