"""Empirical Bayes of the quality classifier: posteriors against NumPy, and documents that only their site decides."""

import random

import numpy as np
from pyspark.sql import functions as F

from terrella.llm import quality_classifier as Q
from terrella.llm.store import save

SCHEMA = "doc_id long, text string, lang string, source string"


def strength(n, p, mean, within):
    own = p / n
    s, room = (n * (own - mean) ** 2).sum(), n.sum() - (n.astype(float) ** 2).sum() / n.sum()
    between = (s - (len(n) - 1) * within) / room if room > 0 else 0.0
    return min(1e6, max(1.0, within / between)) if between > 0 else 1e6


def brute(rows):
    """host_rate and path_rate of (host, path, p) rows."""
    host, path, p = (np.array(c) for c in zip(*rows, strict=True))
    p = p / Q.UNIT
    mean = min(0.99, max(0.01, p.mean()))
    within = max(1e-4, (np.floor(p * 1000) ** 2).sum() / 1e6 / len(p) - mean * mean)
    names = sorted(set(host))
    n, s = (np.array([f(host == h) for h in names]) for f in (np.sum, lambda x: p[x].sum()))
    m = strength(n, s, mean, within)
    of_host = dict(zip(names, (s + m * mean) / (n + m), strict=True))
    pairs = sorted(set(zip(host, path, strict=True)))
    mine = [(host == h) & (path == q) for h, q in pairs]
    n, s = np.array([x.sum() for x in mine]), np.array([p[x].sum() for x in mine])
    prior = np.array([of_host[h] for h, _ in pairs])
    k = strength(n, s, prior, within)
    at = {x: i for i, x in enumerate(pairs)}
    out = []
    for h, q, v in zip(host, path, p, strict=True):
        i = at[h, q]
        out.append((of_host[h], min(0.999, max(0.001, (s[i] - v + k * prior[i]) / (n[i] - 1 + k)))))
    return mean, out


def test_posteriors_against_numpy(spark):
    rng = random.Random(3)
    rows = []
    for h in range(12):
        good = rng.random()
        for path in "abc"[: rng.randint(1, 3)]:
            rate = min(0.99, max(0.01, good + rng.uniform(-0.3, 0.3)))
            rows += [(f"h{h}", path, round(Q.UNIT * min(1, max(0, rng.gauss(rate, 0.2))))) for _ in range(rng.choice([1, 3, 40]))]
    df = save(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, host string, path string, p long"), "scored")
    mean, want = brute(rows)
    for r in Q.posteriors(df).collect():
        assert np.allclose((r["mean"], r.host_rate, r.path_rate), (mean, *want[r.id]), atol=1e-5)


def words(rng, good):
    return " ".join(rng.choice(["alpha", "river", "garden", "letter", "summer"] if good else ["zzqx", "xxkj", "qqvw", "wwzx", "jjkq"]) for _ in range(60))


def half(rng):
    return " ".join(rng.choice(["alpha", "river", "garden", "zzqx", "xxkj", "qqvw"]) for _ in range(60))


def test_the_site_decides_ambiguous_documents(spark):
    """Of documents whose own evidence says little, those on a good site are kept and those on a bad one go; a site with one document stays near the mean of all."""
    rng = random.Random(1)
    rows = [(i, words(rng, i % 2 == 0), "en", "train") for i in range(200)]
    rows += [(1000 + i, words(rng, True), "en", "good") for i in range(150)] + [(2000 + i, words(rng, False), "en", "bad") for i in range(150)]
    rows += [(3000 + i, half(rng), "en", "good") for i in range(40)] + [(4000 + i, half(rng), "en", "bad") for i in range(40)] + [(5000, words(rng, False), "en", "sparse")]
    rows += [(6000 + i, words(rng, i % 2 == 0), "de" if i % 2 == 0 else "fr", "mixed") for i in range(160)] + [(7000 + i, half(rng), "de" if i % 2 == 0 else "fr", "mixed") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.quality_classifier(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    unsure = lambda a, z: [got[i] for i in range(a, z) if abs(got[i].evidence) < 1.5]
    good, bad = unsure(3000, 3040), unsure(4000, 4040)
    assert len(good) > 5 and len(bad) > 5
    assert all(r.kept for r in good) and not any(r.kept for r in bad)
    assert any(r.evidence < 0 for r in good) or any(r.evidence > 0 for r in bad)
    assert got[1000].host_rate > 0.7 and got[2000].host_rate < 0.3
    assert abs(got[5000].host_rate - 0.5) < abs(got[2000].host_rate - 0.5)
    de, fr = [got[i] for i in range(7000, 7040, 2)], [got[i] for i in range(7001, 7040, 2)]
    assert min(r.path_rate for r in de) > max(r.path_rate for r in fr)  # two paths of one host part
    assert all(r.kept for r in de if abs(r.evidence) < 1.5) and not any(r.kept for r in fr if abs(r.evidence) < 1.5)


def test_grams_of_long_texts_are_summed_whole():
    data = random.Random(2).randbytes(3 << 20)
    whole = np.zeros(Q.GRAMS)
    for at in range(0, len(data) - 2, 700_001):
        part = data[at : at + 700_003]
        whole += Q.gram_shares(part) ** 2 * (len(part) - 2)
    assert np.allclose(np.sqrt(whole / (len(data) - 2)), Q.gram_shares(data)) and not Q.gram_shares(b"ab").any()


def test_hard_rows(spark):
    rows = [(1, None, None, None), (None, "", "en", "a"), (1, "x", "en", "a"), (1, "x", "en", "a")]
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = Q.quality_classifier(spark.createDataFrame(rows, SCHEMA), labels).orderBy("doc_id", F.col("host_rate")).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and len({(r.evidence, r.score) for r in got if r.doc_id == 1}) <= 2
