"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from symgraph.llm import bpe, linededup, mixing, simhash, toxicity
from symgraph.llm.common import shared_dir
from symgraph.llm.queries import BPE_FILE


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score as toxic; the model is fitted on the
    labelled rows of the corpus outside the held-out third."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes passages that an earlier document holds; a document of which
    nothing is left goes."""
    return linededup.dedup(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, trims and drops documents as the mix takes their words."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of a round trip."""
    return bpe.round_trip(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Learnt scores, patience alignment and hash draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes to Parquet in the shared
    folder and is read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
