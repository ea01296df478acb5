"""Jobs that were once cut short: wrapped notices, exact targets, many sources, long source names."""

import random
from collections import Counter
from fractions import Fraction

import public_tokenizers

from terrella.llm import bpe
from terrella.llm import license_scan as L
from terrella.llm import mixing as M
from terrella.llm.queries import RANKS, SHARES, queries

BSD = """/*
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 */"""
GPL = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""


def test_wrapped_notices(spark):
    far = MIT.replace(" any person ", " any\n" + "filler words in between " * 20 + "\nperson ")
    texts = [BSD, GPL, MIT, "code\n\n" + MIT.replace("\n", "\r\n") + "\n\n" + BSD, far, MIT.replace("\n", "\n\n")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates = spark.createDataFrame(list(L.TEMPLATES), "label string, text string")
    got = {r.doc_id: (r.labels, r.score) for r in L.digest(L.license_scan(df, templates)).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("gpl", 1.0), 2: ("mit", 1.0), 3: ("bsd,mit", 1.0), 4: ("", 0.0), 5: ("", 0.0)}


def lag_below_one(placed, weights, until):
    """Whether no source is ever a whole block away from its share of the slots so far."""
    shares = [Fraction(w) for w in weights]
    scale = max(f.denominator for f in shares)
    own, done = [int(f * scale) for f in shares], [0] * len(weights)
    for slot, i in enumerate(placed[:until], 1):
        done[i] += 1
        if any(abs(n * sum(own) - slot * w) >= sum(own) for n, w in zip(done, own, strict=True)):
            return False
    return True


def test_lag_against_unrounded_targets():
    hot = [1 / 3, *[2 / 3 / 23] * 23]
    for weights, blocks in (([0.9999, 0.0001], [120_000, 30]), ([0.9, 0.0505, 0.0495], [110_000, 7_000, 7_000]), (hot, [60_000, *[5_000] * 23])):
        placed = list(M.schedule(blocks, weights))
        assert [p[2] for p in placed] == list(range(sum(blocks))) and all(r <= s < d for *_, s, r, d in placed)
        assert lag_below_one([p[0] for p in placed], weights, 110_000)
        assert Counter(p[0] for p in placed) == dict(enumerate(blocks))


def test_schedule_where_sources_run_out():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randint(1, 30)
        blocks, weights = [rng.randint(0, 40) for _ in range(n)], [rng.choice((rng.random() + 1e-9, 1.0, 1e-9, 3)) for _ in range(n)]
        placed = list(M.schedule(blocks, weights))
        assert [p[2] for p in placed] == list(range(sum(blocks))) and all(r <= s < d for *_, s, r, d in placed)
        assert sorted((i, k) for i, k, *_ in placed) == [(i, k) for i, b in enumerate(blocks) for k in range(b)]


def test_mix_follows_unrounded_targets(spark):
    rows = spark.range(120_000).selectExpr("id as doc_id", "if(id < 119970, 'a', 'b') as source")
    got = M.mix(rows, {"a": 0.9999, "b": 0.0001}, block_rows=1).select("position", "source").orderBy("position").collect()
    assert [r.position for r in got] == list(range(120_000))
    assert lag_below_one(["ab".index(r.source) for r in got], [0.9999, 0.0001], 110_000)


def test_mix_of_many_sources(spark):
    rows = spark.range(6_000).selectExpr("id as doc_id", "if(id < 2000, 'hot', concat('host', id % 1500)) as source")
    got = M.mix(rows, block_rows=2).collect()
    assert sorted(r.doc_id for r in got) == list(range(6_000)) and sorted(r.position for r in got) == list(range(6_000))
    assert all(r.release <= r.slot < r.deadline for r in got)


def fluid_lag(placed, blocks, weights):
    """The largest distance, in blocks, between what each source has had and its part of the ideal mixture, slot by slot to the end."""
    exact = [Fraction(w) for w in weights]
    had, flowed, worst = [0] * len(blocks), [Fraction(0)] * len(blocks), Fraction(0)
    for i in placed:
        had[i] += 1
        left = Fraction(1)
        while left:  # one slot of flow, cut where a source runs out
            live = [j for j, b in enumerate(blocks) if flowed[j] < b]
            total = sum(exact[j] for j in live)
            step = min([left, *((blocks[j] - flowed[j]) * total / exact[j] for j in live)])
            for j in live:
                flowed[j] += step * exact[j] / total
            left -= step
        worst = max(worst, *(abs(h - f) for h, f in zip(had, flowed, strict=True)))
    return worst


def test_lag_stays_below_one_block_to_the_end():
    rng = random.Random(5)
    for _ in range(25):
        n = rng.randint(2, 8)
        blocks, weights = [rng.randint(1, 25) for _ in range(n)], [rng.randint(1, 40) / 8 for _ in range(n)]
        assert fluid_lag([p[0] for p in M.schedule(blocks, weights)], blocks, weights) < 1


def test_registered_mixture_keeps_its_targets(spark):
    """The query over its whole table: each row once, blocks of a source in order, and no source a block away from its part of the ideal mixture in any slot."""
    rows = queries()["op2_pfair_mix"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.position for r in rows) == list(range(len(rows))) and len({r.doc_id for r in rows}) == len(rows)
    totals = Counter(r.source for r in rows)
    chosen = M.targets(totals, SHARES, 0.5, 0.70)
    assert abs(sum(chosen.values()) - 1) < 1e-9 and all(chosen[s] == w for s, w in SHARES.items())
    names = sorted(totals)
    slots = sorted({(r.slot, r.source, r.block) for r in rows})
    assert [s for s, *_ in slots] == list(range(len(slots)))
    assert fluid_lag([names.index(s) for _, s, _ in slots], [-(-totals[s] // 32) for s in names], [chosen[s] for s in names]) < 1
    for name in names:
        assert [b for _, s, b in slots if s == name] == list(range(-(-totals[name] // 32)))


def test_kept_columns_with_the_names_of_results(spark):
    rows = spark.createDataFrame([(1, "s", 5, "a b")], "doc_id long, source string, slot int, ids string")
    assert M.mix(rows, keep=("doc_id", "slot")).columns == ["doc_id", "slot", "source", "block", "release", "deadline", "slot_", "position"]
    got = bpe.bpe(rows, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, text_col="ids", keep=("ids",), outputs=("ids", "n_tokens"))
    assert got.columns == ["ids", "ids_", "n_tokens"] and got.first()["n_tokens"] == 2


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 50_000)
    own, rng = bpe.ByteBPE(public_tokenizers.path(RANKS), public_tokenizers.PATTERN), random.Random(3)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 200))) for _ in range(30))
        assert own.decode(own.encode(text)) == text.encode() and own.held <= 50_000 + own.cost([text])
        assert own.held >= own.cost(list(own.known))
