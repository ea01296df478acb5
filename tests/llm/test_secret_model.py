"""The Markov model of secret_scan: precision and recall on samples that it has not seen, and spans of known names."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from terrella.llm import secret_scan as S
from terrella.llm.queries import queries

SF = "/root/testdata/sf0.001"
NAMES = [
    "AbstractSingletonProxyFactoryBean", "XMLHttpRequestEventTargetPrototype", "InternalFrameInternalFrameTitlePaneInternalFrameTitlePaneMaximizeButton", "max_connections_per_route_total", "DEFAULT_SOCKET_TIMEOUT_MILLISECONDS", "/usr/local/share/applications/org",
    "com-example-service-account-manager", "123e4567-e89b-12d3-a456-426614174000", "getElementsByClassNameAndAttribute", "--------------------------------", "test_returns_error_when_input_is_empty", "handleUserAuthenticationRequest",
]


def test_held_out_precision_and_recall(spark):
    samples = S.labelled_samples(spark.read.parquet(f"{SF}/documents.parquet"), strings=1000).cache()
    most, others = S.held_out(samples)
    ratios, threshold = S.fitted(samples)
    table = S.confusion(others, ratios)
    found, wrong = sum(s for t, s, _ in table if t >= threshold), sum(o for t, _, o in table if t >= threshold)
    assert found + wrong and found / (found + wrong) >= 0.998 and found / sum(s for _, s, _ in table) >= 0.95
    assert not most.select("text").distinct().intersect(others.select("text").distinct()).count()
    random = [hashlib.sha256(str(i).encode()).hexdigest()[:32] for i in range(50)] + ["wJalrXUtnFEMIK7MDENGbPxRfiCYzq0123KEY", "ghp9Xk2LmQ7vRt4YbNc8ZdWs1PfHj6Gu3Ea5"]
    scored = spark.createDataFrame([(t,) for t in NAMES + random], "text string").select("text", (S.score(F.col("text"), ratios) >= threshold).alias("secret")).collect()
    assert [r.text for r in scored if r.text in NAMES and r.secret] == []
    assert sum(r.secret for r in scored if r.text in random) >= 0.95 * len(random)
    samples.unpersist()


def test_score_against_plain_python(spark):
    rows = [("abcab", True), ("zz9", True), ("hello", False), ("help_me", False), ("é!", False)]
    ratios = S.train(spark.createDataFrame(rows, "text string, secret boolean"))
    n = len(S.ALPHABET) + 1
    code = lambda c: S.ALPHABET.find(c) + 1
    counts = {k: Counter((code(a), code(b)) for t, s in rows if s == k for a, b in zip(t, t[1:], strict=False)) for k in (True, False)}
    chance = lambda k, a, b: (counts[k][a, b] + 1) / (sum(v for (x, _), v in counts[k].items() if x == a) + n)
    want = lambda t: sum(round(1000 * (math.log(chance(True, code(a), code(b))) - math.log(chance(False, code(a), code(b))))) for a, b in zip(t, t[1:], strict=False))
    texts = ["hello", "zz", "x", "", "help-9!"]
    got = {r.text: r.score for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", S.score(F.col("text"), ratios).alias("score")).collect()}
    assert got == {t: want(t) for t in texts}


def test_calibration_without_samples(spark):
    assert S.fitted(spark.createDataFrame([], "text string, secret boolean"))[1] == 10_000


def test_query_gives_base_and_model_spans(spark):
    rows = queries()["op6_secret_scan"](spark, SF).collect()
    assert all(set(filter(None, s.split(","))) >= set() for s in (r.spans for r in rows)) and all(r.n_hex <= r.spans.count("hex:") and r.n_access <= r.spans.count("access:") and r.n_assign <= r.spans.count("assign:") for r in rows)
