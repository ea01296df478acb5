"""The set-similarity join of license_scan against brute force over all sentences and windows."""

import json
import math
import random
import re

from pyspark.sql import functions as F

from terrella.llm import license_scan as L

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def brute(text, templates, threshold=0.8):
    words = lambda t: re.findall(L.WORD, t)
    found = {}
    for label, t in templates:
        own = words(t)
        width, tokens = math.ceil(len(own) / threshold - 1e-9), set(own)
        blocks = [set(words(s)) for s in re.split(r"\n+|[.!?;][ \t]+", text)]
        for p in re.split(r"\n[ \t\r]*\n\s*", text):
            w = words(p)
            blocks += [set(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
        best = max((len(tokens & b) / len(tokens) for b in blocks), default=0.0)
        if best >= threshold - 1e-9:
            found[label] = max(best, found.get(label, 0.0))
    return sorted((label, round(part, 9)) for label, part in found.items())


def test_against_all_windows(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(14)]
    templates = [(f"t{n}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9)))) for n in range(8)]
    texts = []
    for _ in range(150):
        words = [rng.choice(vocabulary + ["other"] * 20) for _ in range(rng.randint(0, 60))]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", ". ", "\n\n", "; "]) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(m.label, round(m.part, 9)) for m in r.matches] for r in L.license_scan(df, spark.createDataFrame(templates, "label string, text string")).collect()}
    assert got == {i: brute(t, templates) for i, t in enumerate(texts)}


def test_filters_drop_pairs_and_keep_matches(spark):
    """Each filter leaves pairs out; none of those matches."""
    long, short = [f"a{i}" for i in range(40)], ["a3", "a37", "b"]
    order = [f"a{i}" for i in range(40)] + ["b"]
    table = L.prefixes([("long", long), ("short", short)], order, 0.8)
    schema = "array<struct<template:int,label:string,width:int,need:int,tokens:array<string>,place:int,token:string>>"
    held = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), schema)))
    texts = {0: long, 1: long[:3], 2: [*long[1:8:2], *long[20:]], 3: long[2:36], 4: long[5:]}
    sets = spark.createDataFrame([(0, n, own) for n, own in texts.items()], "file__ long, row__ long, own array<string>")
    pairs = L.prefix_pairs(sets, held, min(r["need"] for r in table))
    short_texts = pairs.where("n < need")
    late = pairs.where("n >= need").where(~L.fitting())
    assert short_texts.count() > 0 and late.count() > 0
    kept = {(r.row__, r.template) for r in pairs.where(L.fitting()).collect()}
    assert {(n, t) for n, own in texts.items() for t, full in enumerate((long, short)) if len(set(own) & set(full)) >= math.ceil(0.8 * len(full))} <= kept


def test_whole_notice_in_a_source_file(spark):
    templates = spark.createDataFrame(list(L.TEMPLATES), "label string, text string")
    commented = "".join(f" * {line}\n" for line in MIT.splitlines())
    texts = [MIT, "int main() {}\n\n/*\n" + commented + " */", MIT.upper(), "prose " * 40_000 + "\n" + MIT]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.labels, r.score) for r in L.digest(L.license_scan(df, templates)).collect()} == dict.fromkeys(range(4), ("mit", 1.0))


def test_no_templates(spark):
    df = spark.createDataFrame([(1, "under the MIT license"), (2, None)], "doc_id long, text string")
    got = L.digest(L.license_scan(df, spark.createDataFrame([("none", "")], "label string, text string"))).collect()
    assert {r.doc_id: (r.n_words, r.labels) for r in got} == {1: (4, "mit"), 2: (0, "")}
