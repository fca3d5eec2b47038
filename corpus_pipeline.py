"""A corpus pipeline: five stages, each written and read again before the next.

Stages keep all columns of ``documents`` under any names.  Null ids are ids like
any other; an empty table gives an empty result in every stage; very long texts
are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, near_dedup, packing, secrets
from tessera.llm.common import Scratch, documents

#: A document needs this confidence in its language; und has none.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised.

    Null and empty texts, texts without letters and doubtful ones go; ties in
    the score are decided by the model's order of languages; repeated rows are
    judged alike and each stays; a null ``lang`` teaches nothing.
    """
    names = docs.columns
    model = language.learn(docs.where(~language.held_out()))
    judged = language.predict(docs, model, [F.col(c) for c in names]).toDF(*(f"c{i}" for i in range(len(names))), "_lang", "_score")
    return judged.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE)).drop("_lang", "_score").toDF(*names)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, with the least id, of each group of near copies.

    Five words a shingle, similarity 0.8 or more.  Of repeated rows one stays;
    rows without words are no copies of each other and all stay.
    """
    return near_dedup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents in which a window of the benchmark occurs.

    Rows without words stay; repeated rows are judged alike.
    """
    return decontaminate.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every row stays, a null text as null and repeated rows alike."""
    return secrets.redact(docs, secrets.train(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens.

    A null or empty text is its end token alone; repeated rows are packed each;
    of pieces of one length any may come first.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn models and solve a program: SQL does not express them; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again, and the one before is deleted."""
    scratch, last = Scratch(spark), None
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
