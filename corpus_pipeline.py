"""A corpus through five stages, each written as Parquet before the next reads it.

``STAGES`` lists them; ``run`` applies them to ``documents``. All but the last keep the columns of
``documents``; the last returns packed pieces. SQL cannot express a trained network, so there is none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almucantar.llm import decontaminate, minhash, packing, secrets, shared, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not call toxic. Null texts stay; repeated rows are judged alike; no labels: all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, five-word shingles at a similarity of 0.8; texts without words stay.

    Ties, repeated rows and rows without an id go as ``minhash.keep_one`` says.
    """
    return minhash.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item. Null and empty texts stay; repeated rows are judged alike."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets masked, and n_chars to fit. Null texts stay null and have a null n_chars."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens. Null and empty texts are their end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontaminate),
    ("secrets", _secrets),
    ("packing", _packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``.

    With a shared ``folder``, a run that broke off goes on after the last stage that it completed there. A
    stage's table is deleted once the next one is complete; the last one stays.
    """
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), folder or shared.new_dir(spark, "pipeline")
    schemas = {name: docs.schema for name, _ in STAGES[:-1]}
    done = max((k for k, (name, _) in enumerate(STAGES) if shared.complete(spark, f"{at}/{name}")), default=-1)
    if done >= 0:
        name = STAGES[done][0]
        docs = shared.table(spark, f"{at}/{name}", schemas.get(name))
    for k, (name, stage) in list(enumerate(STAGES))[done + 1 :]:
        docs = shared.written(stage(spark, docs, sf_dir), name, f"{at}/{name}")
        if k:
            shared.drop(f"{at}/{STAGES[k - 1][0]}")
    return docs
