"""The corpus pipeline: five stages over `documents`, each applying one operator of `spendlens.llm`.

1. language_id labels every text; texts without a language (`und`) go, and the
   label becomes the row's `lang`.
2. near_dedup keeps one row of each group of near duplicates: of the least
   doc_id (null if there is no other), the text of the least hash, once. Texts
   without words are in no group and stay.
3. substring_dedup removes every string of PASSAGE bytes that starts earlier in
   what is left, in a text of less doc_id or in the text itself; its first copy
   stays. 50 words take more bytes than that. Texts may become empty, no row goes.
4. mixing draws documents to the target weights of domains, languages and
   sources; a document drawn in several epochs is as many rows, and the last
   of a leaf may be cut after a word. Texts without words are never drawn.
5. packing gives the place of each piece in sequences of 2048 tokens.

Each stage but the last returns the columns of its input, extra ones of any
name included. Rows of null or empty text have no language and go in the first
stage; repeated rows, and rows of null id with one text, become one in the
second; very long texts are treated whole throughout.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spendlens.llm import langid, mixing, neardup, packing, queries, suffix
from spendlens.llm.common import table, written

#: The bytes of a repeated passage.
PASSAGE = 256
OWN = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def any_columns(stage: Stage) -> Stage:
    """The stage for tables whose further columns may have any names: they pass through it under plain ones."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        return stage(spark, docs.toDF(*(c if c in OWN else f"c{i}" for i, c in enumerate(names))), sf_dir).toDF(*names)

    return run_stage


@any_columns
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    labelled = langid.label(docs, langid.fit(docs), *names).toDF(*names, "__pred", "__score", "__spans").where(F.col("__pred") != langid.UNKNOWN)
    return labelled.select(*(F.col("__pred").alias("lang") if c == "lang" else F.col(c) for c in names))


@any_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = neardup.near_components(docs).where("component is not null")
    texts = written(rows.groupBy("component", "kept", F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash")).agg(F.count("*").alias("n")), "pipeline-near")
    # What is kept has its component's id; of several such texts the least hash stays, and one copy of it.
    several = texts.where("kept").groupBy("component").agg(F.min("__hash").alias("least"), F.count("*").alias("of")).where("of > 1")
    kept = texts.where("kept").join(several, "component", "left").withColumn("stays", F.coalesce(F.col("__hash") == F.col("least"), F.lit(True)))
    gone = texts.where("not kept").select("__id", "__hash").unionByName(kept.where("not stays or n > 1").select("__id", "__hash"))
    repeated = kept.where("stays and n > 1").select("__id", "__hash")
    same = lambda some: docs["doc_id"].cast("long").eqNullSafe(some["__id"]) & (F.xxhash64(docs["text"]) == some["__hash"])
    copies = docs.join(repeated, same(repeated)).dropDuplicates(["__id", "__hash"]).select(*docs.columns)
    return docs.join(gone, same(gone), "left_anti").unionByName(copies)


@any_columns
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs, PASSAGE, PASSAGE // 4, first=True)


@any_columns
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, queries.domain_of_source(), queries.MIX_WEIGHTS, 1.0, 4, queries.MIX_SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix),
    ("packing", pack),
]
#: Models, shingle sets, substrings and bins are beyond SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
