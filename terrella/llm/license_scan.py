"""License scans: fixed phrases and an exact set-similarity join of text blocks with license templates.

A block matches a template if it holds at least ``threshold`` of the template's distinct words. Blocks are
the sentences of each line, and, so that notices wrapped over lines are found, all windows of consecutive words
of a paragraph; a window is as long as the template's words divided by ``threshold``.

Texts are cut into words once. What is kept of them are the words that some template has, with their places; the join
reads only these. They are ordered by their frequency in the whole corpus, rarest first, on both sides. A match needs
``need`` common words, so a text with n template words and a template with m share one of the first ``m - need + 1`` of
the template and one of the first ``n - least need + 1`` of the text: an equi-join on these prefixes. The length filter
leaves out texts with n < ``need``; the positional filter those where at the common word fewer than ``need`` words are left on either
side. Every block lies in a text, so a pair that these filters reject has no matching block; for the others the words common to
the template and each block are counted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrella.llm.store import BROADCAST_BYTES, let, save, small, with_rows

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Sentences of public license notices, then the paragraphs of whole notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_PARAGRAPH, _SENTENCE = r"\n[\x20\t\r]*\n\s*", r"\n+|[.!?;][\x20\t]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of all templates together: they are a literal of the plan.
MAX_VOCABULARY = 100_000


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts without capitals are left alone."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, _UPPER, _LOWER)).otherwise(text)


def words_of(text: Column) -> Column:
    """Words of a text whose capitals are lowered."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _any_phrase(phrases: Sequence[str]) -> str:
    """A pattern that finds one of the phrases as whole words in a text of any case."""
    return "(?i)(?:^|" + _GAP + ")(?:" + "|".join(f"{_GAP}+".join(p.split()) for p in phrases) + ")(?:$|" + _GAP + ")"


def _places(words: Column, phrases: Mapping[str, str]) -> Column:
    """(start, label) of every place where a phrase's words stand consecutively."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words)))

    def starts(phrase: str, label: str) -> Column:
        hit = lambda i: _all([F.try_element_at(words, i + k).eqNullSafe(F.lit(w)) for k, w in enumerate(phrase.split())])
        return F.transform(F.filter(at, hit), lambda i: F.struct((i - 1).cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*[starts(p, label) for p, label in phrases.items()])


def _all(conditions: Sequence[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found &= c
    return found


def words_at(text: Column) -> Column:
    """Words of a text with the numbers of their paragraph and of their sentence in it."""
    sentence = lambda s, p, i: F.transform(words_of(s), lambda w: F.struct(p.alias("para"), i.alias("line"), w.alias("word")))
    paragraph = lambda t, p: F.flatten(F.transform(F.split(t, _SENTENCE), lambda s, i: sentence(s, p, i)))
    return F.flatten(F.transform(F.split(text, _PARAGRAPH), paragraph))


def marked(rows: DataFrame, vocabulary: Sequence[str], phrases: Mapping[str, str]) -> DataFrame:
    """The one pass over the texts: ``n_words``, ``places`` of the phrases and ``hits``, the words of the vocabulary with their places."""
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    phrase = F.col("text").rlike(_any_phrase(list(phrases)))
    hit = lambda x, i: F.struct(x["para"].alias("para"), x["line"].alias("line"), i.alias("at"), x["word"].alias("word"))
    hits = lambda a: F.filter(F.transform(a, hit), lambda h: h["word"].isin(list(vocabulary)))
    places = lambda a: F.when(phrase, let(F.transform(a, lambda x: x["word"]), lambda words: _places(words, phrases))).otherwise(none)
    seen = let(words_at(lowered(F.col("text"))), lambda a: F.struct(F.size(a).cast("long").alias("n_words"), places(a).alias("places"), hits(a).alias("hits")))
    return rows.select("id", "file__", "row__", seen.alias("seen")).select("id", "file__", "row__", "seen.*")


def prefixes(templates: Sequence[tuple[str, list[str]]], order: Sequence[str], threshold: float) -> list[dict]:
    """For each word of each template's prefix: ``template``, ``label``, ``width`` (words of a window), ``need``, ``tokens`` (rarest first), ``place`` and ``token``."""
    rank, out = {w: i for i, w in enumerate(order)}, []
    for n, (label, words) in enumerate(templates):
        tokens = sorted(set(words), key=rank.__getitem__)
        need = math.ceil(len(tokens) * threshold - 1e-9)
        out += [{"template": n, "label": label, "width": math.ceil(len(words) / threshold - 1e-9), "need": need, "tokens": tokens, "place": i, "token": tokens[i]} for i in range(len(tokens) - need + 1)]
    return out


def prefix_pairs(sets: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """Pairs of a text (``own``: its template words, rarest first) and a template that share a word of both prefixes, one row for each such word, with ``spot`` and ``place`` of it."""
    first = F.posexplode(F.slice("own", F.lit(1), F.size("own") - (least - 1))).alias("spot", "token")
    return sets.where(F.size("own") >= least).select("file__", "row__", F.size("own").alias("n"), first).join(held, "token")


def fitting() -> Column:
    """Length filter and positional filter of a pair of ``prefix_pairs``."""
    return (F.col("n") >= F.col("need")) & (F.least(F.size("tokens") - F.col("place"), F.col("n") - F.col("spot")) >= F.col("need"))


def _most_in_line() -> Column:
    """Most distinct template words in one sentence, from ``mine``."""
    ordered = F.array_sort(F.array_distinct(F.transform("mine", lambda h: F.struct(h["para"].alias("para"), h["line"].alias("line"), h["word"].alias("word")))))
    start = F.struct(F.lit(-1).alias("para"), F.lit(-1).alias("line"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, h: Column) -> Column:
        run = F.when((s["para"] == h["para"]) & (s["line"] == h["line"]), s["run"] + 1).otherwise(1)
        return F.struct(h["para"].alias("para"), h["line"].alias("line"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(ordered, start, step, lambda s: s["best"])


def _most_in_window() -> Column:
    """Most distinct template words in any ``width`` consecutive words of a paragraph, from ``mine``.

    An occurrence is the last of its word in the windows that end after it and not after the next one: an
    interval of window starts. The most intervals that overlap, from one sorted sweep, are the most distinct words.
    """
    width = F.col("width")
    ordered = F.array_sort(F.transform("mine", lambda h: F.struct(h["para"].alias("para"), h["word"].alias("word"), h["at"].alias("at"))))

    def ends(sorted_hits: Column) -> Column:
        after = F.slice(sorted_hits, F.lit(2), F.greatest(F.lit(0), F.size(sorted_hits) - 1))
        last = lambda h, n: F.when((n["para"] == h["para"]) & (n["word"] == h["word"]), F.least(h["at"], n["at"] - width)).otherwise(h["at"])
        event = lambda h, at, by: F.struct(h["para"].alias("para"), at.alias("at"), F.lit(by).alias("by"))
        return F.flatten(F.zip_with(sorted_hits, after, lambda h, n: F.array(event(h, h["at"] - width + 1, 1), event(h, last(h, n) + 1, -1))))

    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    step = lambda s, e: F.struct((s["run"] + e["by"]).alias("run"), F.greatest(s["best"], s["run"] + e["by"]).alias("best"))
    return F.aggregate(F.array_sort(let(ordered, ends)), start, step, lambda s: s["best"])


def license_scan(df: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """One row per input row: id, ``n_words``, ``places`` (start and label of each phrase), ``matches`` (label and containment of each template found), ``score``.

    ``templates`` holds ``label`` and ``text``, reference data of at most ``MAX_VOCABULARY`` distinct words; more are scanned for in groups, by a call each. ``score`` is 1 where a phrase stands, else the best containment, else 0.
    Null and empty texts have no words; repeated rows are scanned alike; an empty table gives an empty result; templates without words match nothing; other
    columns are ignored, whatever their names. Tables are broadcast only behind a check of their size.
    """
    spark = df.sparkSession
    own = templates.select("label", words_of(lowered(F.col("text"))).alias("words")).where("size(words) > 0")
    size = own.agg(F.sum(F.size("words"))).first()[0] or 0
    if size > 50 * MAX_VOCABULARY:
        raise ValueError("too many templates for one scan")
    known = [(r["label"], r["words"]) for r in own.distinct().collect()]
    vocabulary = sorted({w for _, words in known for w in words})
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError("too many templates for one scan")
    rows = with_rows(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "file__", "row__")
    marks = save(marked(rows, vocabulary or [""], phrases), "marks")
    counts = {r["word"]: r["count"] for r in marks.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").count().collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    table = prefixes(known, order, threshold)
    least = min((r["need"] for r in table), default=1)
    schema = "array<struct<template:int,label:string,width:int,need:int,tokens:array<string>,place:int,token:string>>"
    held = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), schema)))
    held = F.broadcast(held) if sum(64 + sum(map(len, r["tokens"])) for r in table) <= BROADCAST_BYTES else held
    literal = F.from_json(F.lit(json.dumps(order)), "array<string>")
    sets = marks.where(F.size("hits") >= least).select("file__", "row__", F.array_intersect(literal, F.transform("hits", lambda h: h["word"])).alias("own"))
    pairs = save(prefix_pairs(sets, held, least).where(fitting()).select("file__", "row__", "template").distinct(), "pairs")
    whole = held.where("place = 0").select("template", "label", "width", "need", "tokens")
    close = marks.select("file__", "row__", "hits").join(small(pairs, 24), ["file__", "row__"]).join(whole, "template")
    close = close.withColumn("mine", F.filter("hits", lambda h: F.array_contains("tokens", h["word"]))).where(F.size("mine") >= F.col("need"))
    part = F.greatest(_most_in_line(), _most_in_window()) / F.size("tokens")
    near = close.select("file__", "row__", "label", "need", F.size("tokens").alias("size"), part.alias("part")).where(F.round(F.col("part") * F.col("size")) >= F.col("need"))
    found = save(near.groupBy("file__", "row__", "label").agg(F.max("part").alias("part")), "matches")
    matched = found.groupBy("file__", "row__").agg(F.array_sort(F.collect_list(F.struct("label", "part"))).alias("matches"))
    matched = F.broadcast(matched) if found.count() * 128 <= BROADCAST_BYTES else matched
    best = F.array_max(F.transform("matches", lambda m: m["part"]))
    return marks.drop("hits").join(matched, ["file__", "row__"], "left").select(F.col("id").alias(id_col), "n_words", "places", F.coalesce("matches", F.array().cast("array<struct<label:string,part:double>>")).alias("matches"), F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))


def digest(scanned: DataFrame) -> DataFrame:
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    both = F.concat(base, F.transform("matches", lambda m: m["label"]))
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), named(base).alias("base_labels"), named(both).alias("labels"), F.round("score", 6).alias("score"))
