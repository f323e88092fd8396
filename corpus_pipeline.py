"""The corpus pipeline: five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; what
it returns is written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.llm import exact_dedup, language, near_dedup, packing, toxicity
from emberlens.llm.common import staged, unused

#: A document goes if its toxicity score is this or more.
TOXIC = 0.5
#: A document goes if the log-likelihood of its mixture over the background's is this or less.
NO_LANGUAGE = -20.0


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Score every document with the field trained on the labelled ones; toxic documents go."""
    model = toxicity.train(docs, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    name = unused(docs, "verdict")
    return toxicity.scored(docs, model, name=name).where(F.col(f"{name}.score") < TOXIC).drop(name)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no language: no text, none with a letter, or a text whose mixture of
    the learned languages is beyond doubt worse than letters in random order (``NO_LANGUAGE``).

    Where nothing can be learned (no training row with a language), no document goes.
    """
    model = language.train(language.training_rows(docs))
    if not model[0]:
        return docs
    name = unused(docs, "answer")
    spoken = (F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.evidence") > NO_LANGUAGE)
    return language.answered(docs, model, name=name).where(spoken).drop(name)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of largest id stays."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the one of least id stays."""
    return near_dedup.drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences, with the ids of each piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: Trained scores and tokenizers have no SQL; tests hold its stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
