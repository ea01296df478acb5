"""A corpus pipeline: quality rules, exact and near deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder and reads it
back as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.llm.bpe import bpe
from terrella.llm.exact_dedup import exact_dedup
from terrella.llm.mixing import mix
from terrella.llm.near_dedup import confirmed, dropped, near_dedup
from terrella.llm.quality_rules import quality_rules
from terrella.llm.queries import RANKS
from terrella.llm.store import fresh, save, small, with_rows
from terrella.plans.written import remove, scratch


#: Bits by which the fingerprints of near copies may differ: the widest that ``near_dedup`` takes. Over the 9,296 distinct documents of sf0.1, 181 pairs are
#: within 7 bits, 176 of which share half or more of their word 5-grams; 4 pairs are within 2 bits, the radius of op10's contract. Chance pairs grow with the square of the
#: documents; ``confirmed`` tells them.
NEAR_RADIUS = 7


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with two columns that name a row, and the names of these columns, which no column of the table has."""
    key = fresh(docs, "_file", "_row")
    return with_rows(docs, *key), key


def _without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is not in ``gone``, which is broadcast only if counted and small."""
    return rows.join(small(save(gone, "gone"), 32), key, "left_anti").drop(*key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts go, for want of words. Rows without a source form one host. Repeated rows share a fate; rows are told apart by file and
    place, so null and equal ids do not matter. An empty table stays empty; other columns stay as they are, whatever their names.
    """
    rows, key = _keyed(docs)
    return _without(rows, quality_rules(rows, carry=key).where("not kept").select(*key), key)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays: the one with the least id, of equal ids the first row; a null id loses to any other.

    Texts are equal up to runs of white space; null counts as empty, so of null and empty texts one row stays. An empty table stays
    empty; other columns stay as they are, whatever their names.
    """
    rows, key = _keyed(docs)
    return _without(rows, exact_dedup(rows, carry=key).where("not kept").select(*key), key)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints one document stays: the one with the least id, of equal ids the first row; a null id loses to any other.

    Fingerprints link at ``NEAR_RADIUS`` bits; a document that shares under half of its word 5-grams with the rest of its component has come there by chance and stays. Null and
    wordless texts have fingerprint zero and one shingle, so one of them stays; repeated rows are one component. An empty
    table stays empty; other columns stay as they are, whatever their names.
    """
    rows, key = _keyed(docs)
    found = save(near_dedup(rows, carry=key, radius=NEAR_RADIUS), "near")
    several = found.groupBy("component_fp").agg(F.count("*").alias("n")).where("n > 1").select("component_fp")
    members = save(found.join(small(save(several, "several"), 16), "component_fp", "left_semi"), "members")
    (group,) = fresh(rows, "_group")
    texts = rows.select(*key, "text").join(small(members.select(*key, F.col("component_fp").alias(group)), 32), key)
    alike = save(confirmed(texts, key, group), "alike")
    return _without(rows, dropped(members.join(alike, key, "left_semi"), "doc_id", key), key)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: sorted ranges of positions become the files that a loader reads in turn.

    The join with the positions shuffles at every size; its hash tables hold positions, not texts. Every row stays, null and empty texts, null ids and repeated rows too; a null source is a source of its own. An empty table stays empty; other
    columns stay as they are, whatever their names.
    """
    rows, key = _keyed(docs)
    (at,) = fresh(rows, "_position")
    placed = save(mix(rows, keep=key).select(*key, F.col("position").alias(at)), "placed")
    return rows.join(placed.hint("shuffle_hash"), key).repartitionByRange(at).sortWithinPartitions(at).drop(*key, at)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and digests of ids and decoded bytes, in the order of the files.

    Null and empty texts have no ids; null ids and sources are passed on; repeated rows are encoded alike. An empty table gives an empty
    result; other columns are left out.
    """
    return bpe(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=("doc_id", "source"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("simhash_near_dedup", near_stage), ("pfair_mix", mixing_stage), ("byte_bpe", encoding_stage)]

#: The stages cannot be put in SQL: fingerprints, earliest-deadline scheduling and merges. The tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes once the next stage's documents are written; only the last documents stay while they are read."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch() as tables:
            docs = save(stage(spark, docs, sf_dir), name)
        remove(spark, [*last, *tables[:-1]])
        last = tables[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
