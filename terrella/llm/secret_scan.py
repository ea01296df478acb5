"""Secret scans: fixed patterns and character Markov models.

Two first-order models, of random strings and of ordinary identifiers, are trained from labelled
samples. A run of token characters is a secret if its log-likelihood ratio passes a threshold, which is
calibrated on samples held out from the training. Spans
come from the lengths of matches and of the gaps between them, all in SQL expressions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrella.llm.store import let

#: Characters of a candidate token; 0 stands for any other.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{%s})"
#: Kinds in order: pattern, pattern that a text must hold to be looked at, least length of a match.
KINDS = {"assign": (ASSIGN % "1,", ASSIGN % "6,", 0), "access": ("AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16}", 20), "hex": ("[0-9a-f]+", "[0-9a-f]{24}", 24)}
_SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


def running(values: Column, chunk: int = 256) -> Column:
    """Running sums of an array of longs, by chunks so that long arrays are not copied for each element."""
    zero = F.lit(0).cast("long")
    grow = lambda a: F.aggregate(a, F.array().cast("array<bigint>"), lambda s, v: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), zero) + v)))
    whole = lambda a: F.aggregate(a, zero, lambda s, v: s + v)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int"))), lambda c: F.slice(v, c * chunk + 1, F.lit(chunk)))
    joint = lambda parts: F.flatten(F.zip_with(parts, F.slice(F.concat(F.array(zero), grow(F.transform(parts, whole))), F.lit(1), F.size(parts)), lambda p, s: F.transform(grow(p), lambda v: v + s)))
    return let(values, lambda v: let(cut(v), joint))


def spans(text: Column, pattern: str, guard: str, kind: str, rank: int, keep: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches as spans of code points; ``keep`` takes a match's text. Only texts that hold ``guard`` are cut up."""
    lengths = lambda a: F.transform(a, lambda m: F.length(m).cast("long"))

    def placed(found: Column) -> Column:
        gaps = F.slice(lengths(F.split(text, pattern, -1)), F.lit(1), F.size(found))
        steps = F.zip_with(gaps, F.concat(F.array(F.lit(0).cast("long")), F.slice(lengths(found), F.lit(1), F.greatest(F.lit(0), F.size(found) - 1))), lambda g, m: g + m)
        return F.zip_with(found, running(steps), lambda m, s: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(m)).alias("stop"), m.alias("text")))

    all_spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    kept = F.transform(F.filter(all_spans, lambda p: keep(p["text"])), lambda p: F.struct(p["start"], p["rank"], p["stop"], F.lit(kind).alias("kind")))
    return F.when(text.rlike(guard), kept.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def _pairs(token: Column) -> Column:
    """Codes of neighbouring characters, first times the alphabet's size plus second."""
    codes, n = _codes(token), F.greatest(F.lit(0), F.length(token) - 1)
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * (len(ALPHABET) + 1) + b)


def train(samples: DataFrame, smoothing: float = 1.0) -> list[int]:
    """Log-likelihood ratios of character pairs, in thousandths, from ``text`` and boolean ``secret``; the table has a fixed size whatever the samples."""
    n = len(ALPHABET) + 1
    counts = samples.where("text is not null and secret is not null").select("secret", F.explode(_pairs(F.col("text"))).alias("pair")).groupBy("secret", "pair").count()
    table = {True: [smoothing] * (n * n), False: [smoothing] * (n * n)}
    for r in counts.collect():
        table[r["secret"]][r["pair"]] += r["count"]
    sums = {k: [sum(v[a * n : a * n + n]) for a in range(n)] for k, v in table.items()}
    return [round(1000 * (math.log(table[True][i] / sums[True][i // n]) - math.log(table[False][i] / sums[False][i // n]))) for i in range(n * n)]


#: Parts that made identifiers are put together from, besides the words of the documents.
PARTS = (
    "abstract access account action adapter address admin array async attribute base bean binary block buffer build byte cache call cancel channel char check child class client clock code collection color column command "
    "config connection constant container content context control count create cursor data database date debug default delete device dialog directory display document domain driver element email encoder engine entity "
    "error event example exception export factory field file filter folder format frame function gateway generator graph group handler hash header height helper host http image import index info input instance integer "
    "interface internal item iterator job json key label language layout length level library link list listener load local lock logger loop manager map memory menu message method model module monitor name network node "
    "number object observer option order output package page panel parameter parent parser path pattern player plugin point policy pool position prefix process profile project property protocol provider proxy query queue"
).split()


def labelled_samples(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = 1_000, strings: int = 3_000) -> DataFrame:
    """``text`` and boolean ``secret``: random strings against ordinary identifiers.

    Random strings are made by a rule: hexadecimal, base 64, capitals with digits. Ordinary are the words of at most ``docs``
    documents, those with the least hashes of their ids, and identifiers made by a rule from ``PARTS``: camel and Pascal case,
    snake and kebab case, constants, paths, names with numbers, rules of one character, and UUIDs.
    """
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    plain = F.regexp_replace(F.base64(digest), "[+/=]", "")
    numbers = df.sparkSession.range(strings)
    made = numbers.select(F.explode(F.array(F.substring(F.lower(F.hex(digest)), 1, 40), F.base64(digest), F.upper(plain))).alias("text"), F.lit(True).alias("secret"))
    pick = lambda salt: F.element_at(F.array(*map(F.lit, PARTS)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(PARTS))) + 1).cast("int"))
    parts = F.slice(F.array(*[pick(i) for i in range(5)]), F.lit(1), (F.col("id") % 3 + 3).cast("int"))
    pascal, code = F.array_join(F.transform("parts", F.initcap), ""), F.lower(F.hex(digest))
    cut = lambda at, n: F.substring(code, at, n)
    styles = [
        F.concat(F.element_at("parts", 1), F.regexp_replace(pascal, "^[A-Z][a-z]*", "")), pascal, F.array_join("parts", "_"), F.array_join("parts", "-"), F.upper(F.array_join("parts", "_")), F.concat(F.lit("/"), F.array_join("parts", "/")),
        F.concat(F.array_join("parts", "_"), F.lit("_"), F.col("id").cast("string")), F.repeat(F.substring(F.lit("-=_+/x0"), (F.col("id") % 7 + 1).cast("int"), F.lit(1)), (F.col("id") % 40 + 20).cast("int")), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)),
    ]
    names = numbers.withColumn("parts", parts).select(F.explode(F.array(*styles)).alias("text"))
    some = F.broadcast(df.select(F.col(id_col).alias("some__")).distinct().orderBy(F.xxhash64("some__"), "some__").limit(docs))
    words = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(some, F.col("id") == F.col("some__"), "left_semi").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_-]{3,}"), F.lit(0))).alias("text"))
    return made.unionByName(names.unionByName(words.where("length(text) < 20")).withColumn("secret", F.lit(False)))


def held_out(samples: DataFrame, of: int = 5) -> tuple[DataFrame, DataFrame]:
    """The samples without and with those whose hash falls in one of ``of`` parts: for training and for calibration."""
    mine = F.pmod(F.xxhash64("text"), F.lit(of)) == 0
    return samples.where(~mine), samples.where(mine)


def confusion(samples: DataFrame, ratios: list[int], least: int = 20, step: int = 500, bins: int = 400) -> list[tuple[int, int, int]]:
    """(threshold, secrets, ordinary) that score in each step of ``step`` from the threshold on, of the samples that are long enough to be candidates; at most ``2 * bins`` rows."""
    at = F.greatest(F.lit(-bins), F.least(F.lit(bins - 1), F.floor(score(F.col("text"), ratios) / step)))
    rows = samples.where((F.length("text") >= least) & F.col("secret").isNotNull()).groupBy(at.alias("at")).agg(F.count_if("secret").alias("secrets"), F.count_if(~F.col("secret")).alias("ordinary")).collect()
    return sorted((r["at"] * step, r["secrets"], r["ordinary"]) for r in rows)


def calibrate(samples: DataFrame, ratios: list[int], least: int = 20, precision: float = 0.999, default: int = 10_000) -> int:
    """The least threshold from which on at least ``precision`` of the samples found are secrets; ``default`` without samples of both kinds."""
    table = confusion(samples, ratios, least)
    if not sum(s for _, s, _ in table) or not sum(o for *_, o in table):
        return default
    found = [(t, sum(s for u, s, _ in table if u >= t), sum(o for u, _, o in table if u >= t)) for t, *_ in table]
    good = [t for t, s, o in found if s and s >= precision * (s + o)]
    return max(0, min(good)) if good else default


def fitted(samples: DataFrame, least: int = 20) -> tuple[list[int], int]:
    """Ratios and threshold: trained on most of the samples, calibrated on the others."""
    most, others = held_out(samples)
    ratios = train(most)
    return ratios, calibrate(others, ratios, least)


def score(token: Column, ratios: list[int]) -> Column:
    """Log-likelihood ratio of a token, random over ordinary, in thousandths."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<int>")
    return F.aggregate(_pairs(token), F.lit(0).cast("long"), lambda s, p: s + table[p])


def secret_scan(df: DataFrame, ratios: list[int], id_col: str = "doc_id", text_col: str = "text", threshold: int = 10_000, least: int = 20) -> DataFrame:
    """One row per input row: id, ``base`` and ``found``, arrays of spans (start, rank, stop, kind) by start and kind.

    Kinds are those of ``KINDS`` and ``markov``: runs of ``least`` or more token characters whose score passes ``threshold``. Null and empty texts have no
    spans; repeated rows are scanned alike; an empty table gives an empty result; other columns are ignored. No shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN % "1,", 2)) >= 6
    base = [spans(text, p, g, k, i, value if k == "assign" else (lambda m, n=n: F.length(m) >= n)) for i, (k, (p, g, n)) in enumerate(KINDS.items())]
    model = spans(text, f"{TOKEN}{{{least},}}", f"{TOKEN}{{{least}}}", "markov", len(KINDS), lambda m: score(m, ratios) >= threshold)
    out = df.select(F.col(id_col), F.array_sort(F.concat(*base)).alias("base"), model.alias("model"))
    return out.select(F.col(id_col), "base", F.array_sort(F.concat("base", "model")).alias("found"))


def joined(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
