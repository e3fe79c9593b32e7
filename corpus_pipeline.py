"""From raw documents to packed sequences, in five stages; each works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, nbsvm, packing, secrets
from tidemark.llm.common import delete, exists, shared_folder, table
from tidemark.llm.queries import GOOD, word_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from the labels of rows that are not held out."""
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"))
    return nbsvm.with_score(docs, model, out="__score").where(F.col("__score") >= GOOD).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id."""
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials replaced by a mark."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks; the one at a source's cut is shortened."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a row repeated by the mix is packed each time."""
    return packing.pack(docs, word_tokenizer(), 2048, 1)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix", mix), ("pack", pack)]

#: The first stage fits a model, which SQL can't express; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows. What a stage returns is written and read again, in the shared folder unless one is named.

    With a folder of its own, a run that was broken off goes on after the last stage that is whole there, and
    everything stays; else the rows of a stage are deleted once the next one is written.
    """
    named, docs, before = folder is not None, table(spark, sf_dir, "documents"), None
    folder = folder or f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        if not exists(spark, f"{out}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
        if before and not named:
            delete(spark, before)
        before = out
    return docs
