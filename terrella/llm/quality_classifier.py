"""Quality classifier with hierarchical empirical Bayes.

A logistic model on the shape of a text and on its hashed character trigrams gives each document its own evidence. Hosts and their paths get posteriors from the
evidence of their documents: a path's mean shrinks towards its host's, a host's towards the global one, the more so the fewer
documents there are; both strengths are fitted to the data by moments. A document's score joins its
evidence with its path's posterior, its own part taken out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrella.llm.store import save, ship, small

#: Probabilities are summed as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
#: Buckets that character trigrams are hashed to, and features in all.
GRAMS = 256
FEATURES = 12 + GRAMS


def gram_shares(data: bytes) -> np.ndarray:
    """Square roots of the shares that each bucket has of the text's byte trigrams; zeros for texts under three bytes."""
    if len(data) < 3:
        return np.zeros(GRAMS)
    total = np.zeros(GRAMS, np.int64)
    for at in range(0, len(data) - 2, 1 << 20):
        a = np.frombuffer(data, np.uint8, min(len(data) - at, (1 << 20) + 2), at).astype(np.uint32)
        total += np.bincount(((a[:-2] * np.uint32(65_537) + a[1:-1] * np.uint32(257) + a[2:]) * np.uint32(2_654_435_761)) >> np.uint32(24), minlength=GRAMS)
    return np.sqrt(total / (len(data) - 2))


def text_shape(data: bytes) -> list[float]:
    """Shape of one text: length, word length, symbols, exclamation marks, capitals, digits, bars, full stops, repeated neighbours, distinct words, repeated lines, words in a line."""
    words, n, size = data.split(), max(1, len(data.split())), max(1, len(data))
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    rows = max(1, len(lines))
    return [
        float(np.log1p(len(words))), min(30.0, size / n), share(b"#*$%&<>"), min(2.0, data.count(b"!") / n), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"),
        share(b"|"), min(1.0, data.count(b".") / n), sum(map(eq, words, words[1:])) / n, len(set(words)) / n, 1 - len(set(lines)) / rows if lines else 0.0, float(np.log1p(len(words) / rows)),
    ]


def text_features(data: bytes) -> np.ndarray:
    return np.concatenate([text_shape(data), gram_shares(data)])


def evidence(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of rows of features, between -12 and 12."""
    w = np.array(model["weights"])
    return np.clip(((x - np.array(model["mean"])) / np.array(model["scale"])) @ w[:-1] + w[-1], -12.0, 12.0)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> dict:
    """Ridge logistic regression on standardised features by Newton steps; with one class or no rows it gives no evidence."""
    if not len(y) or y.min() == y.max():
        return {"mean": [0.0] * FEATURES, "scale": [1.0] * FEATURES, "weights": [0.0] * (FEATURES + 1), "prior": float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))}
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, keep = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weights": w.tolist(), "prior": float(y.mean())}


def per_text(df: DataFrame, keep: Sequence[Column], text_col: str, name: str, kind: T.DataType, arrow: pa.DataType, value: Callable[[list[bytes]], list]) -> DataFrame:
    """The ``keep`` columns and a column that ``value`` makes of the texts, a few hundred at a time."""
    ship(df.sparkSession)
    chosen = df.select(*keep, F.col(text_col).cast("binary").alias("text__"))
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                got = pa.array(value([x.as_py() or b"" for x in batch.column(batch.num_columns - 1)]), arrow)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], schema=pa.schema([*list(batch.schema)[:-1], pa.field(name, arrow)]))

    return chosen.mapInArrow(run, schema)


def trained(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labels: int) -> dict:
    """The model fitted on at most ``max_labels`` labelled rows, those with the least hashes of their ids: the driver holds their features, about a kilobyte each."""
    marks = labels.select(F.col(id_col).alias("id__"), F.col(label_col).cast("int").alias("y__")).where("id__ is not null and y__ is not null").distinct().orderBy(F.xxhash64("id__"), "id__", "y__").limit(max_labels)
    marked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(save(marks, "marks"), 32), F.col("id") == F.col("id__")).select("id", "y__", "text")
    rows = per_text(marked, [F.col("id"), F.col("y__").alias("y")], "text", "features", T.BinaryType(), pa.binary(), lambda texts: [text_features(t).astype(np.float32).tobytes() for t in texts])
    sample = save(rows, "sample").orderBy("id", "y", "features").limit(max_labels).toArrow()
    x = np.frombuffer(b"".join(sample.column("features").to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)
    return fit(x, (sample.column("y").to_numpy() > 0).astype(float))


def _strength(groups: DataFrame, mean: Column, within: float) -> float:
    """Pseudo-documents of a prior: variance within groups over variance between them. ``groups`` holds ``n`` and ``p`` (sum of millionths)."""
    own = F.col("p") / F.col("n") / UNIT
    r = groups.agg(F.sum(F.round(F.col("n") * (own - mean) ** 2 * UNIT).cast("long")).alias("s"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    if not r["n"]:
        return 1.0
    room = r["n"] - r["nn"] / r["n"]
    between = (r["s"] / UNIT - (r["k"] - 1) * within) / room if room > 0 else 0.0
    return min(1e6, max(1.0, within / between)) if between > 0 else 1e6


def posteriors(scored: DataFrame) -> DataFrame:
    """``scored`` (``host``, ``path``, ``p``: a written table of whole millionths) with ``mean`` (of all rows), ``host_rate`` and ``path_rate``; a row's own part is taken out of its path's rate.

    A host's rate is ``(sum + m * mean) / (n + m)``, a path's ``(sum + k * host_rate) / (n + k)``: m and k are the pseudo-documents that the spread between hosts and between
    the paths of a host calls for. Sums are taken in each task first; host and path tables are broadcast only if counted and small.
    """
    paths = save(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum(F.expr("p div 1000 * (p div 1000)")).alias("pp")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    all_ = paths.agg(F.sum("n"), F.sum("p"), F.sum("pp")).first()
    n, mean = all_[0] or 0, min(0.99, max(0.01, (all_[1] or 0) / UNIT / max(1, all_[0] or 0)))
    within = max(1e-4, (all_[2] or 0) / 1e6 / max(1, n) - mean * mean)
    m = _strength(hosts, F.lit(mean), within)
    hosts = hosts.withColumn("host_rate", (F.col("p") / UNIT + F.lit(m * mean)) / (F.col("n") + F.lit(m)))
    both = save(paths.join(hosts.select("host", "host_rate"), "host"), "posteriors")
    k = _strength(both, F.col("host_rate"), within)
    joined = scored.join(small(both.select("host", "path", "n", F.col("p").alias("sum"), "host_rate"), 96), ["host", "path"])
    rate = F.greatest(F.lit(0.001), F.least(F.lit(0.999), ((F.col("sum") - F.col("p")) / UNIT + F.lit(k) * F.col("host_rate")) / (F.col("n") - 1 + F.lit(k))))
    return joined.withColumns({"mean": F.lit(mean), "path_rate": rate}).drop("n", "sum")


def quality_classifier(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", max_labels: int = 20_000, least: float = 0.5) -> DataFrame:
    """One row per input row: id, ``evidence`` (log odds), ``host_rate``, ``path_rate``, ``score`` and ``kept`` (score of ``least`` or more).

    ``path_col`` names the part of a host that a document lies in; ``documents`` have no address, and ``pages`` put languages in directories of their own, so theirs is the language.
    The model is fitted on at most ``max_labels`` labelled rows; rows without a label or id are not used. Null hosts
    and paths are groups of their own; null and empty texts have features of an empty text; repeated rows score alike; an empty table
    gives an empty result; other columns are ignored. Texts are read once for the labelled rows and once for all.
    """
    model = trained(df, labels, id_col, text_col, label_col, max_labels)
    keep = [F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("-")).alias("host"), F.coalesce(F.concat(F.lit("p"), F.col(path_col).cast("string")), F.lit("-")).alias("path")]
    weighed = per_text(df, keep, text_col, "evidence", T.DoubleType(), pa.float64(), lambda texts: evidence(model, np.array([text_features(t) for t in texts]).reshape(-1, FEATURES)))
    scored = posteriors(save(weighed.withColumn("p", F.round(UNIT / (1 + F.exp(-F.col("evidence")))).cast("long")), "evidence"))
    odds = F.col("evidence") - F.log(F.col("mean") / (1 - F.col("mean"))) + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    score = 1 / (1 + F.exp(-odds))
    return scored.select(F.col("id").alias(id_col), F.round("evidence", 6).alias("evidence"), F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"), F.round(score, 6).alias("score"), (score >= least).alias("kept"))
