"""The driver's queries over the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from symgraph.llm import bpe, chat, imatch, linededup, mixing, simhash, topk, toxicity, urls, warc

BPE_FILE, CHAT_FILE = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op1_simhash(_t(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op2_bpe(_t(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op3_toxicity(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.op4_urls(_t(spark, sf_dir, "pages"))


def op4_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.op4_aliases(_t(spark, sf_dir, "pages"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op5_topk(_t(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6_mixing(_t(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op7_line_dedup(_t(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op8_warc(_t(spark, sf_dir, "pages"))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.op9_imatch(_t(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op10_chat(_t(spark, sf_dir, "conversations"), public_tokenizers.path(CHAT_FILE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_bpe, op3_toxicity, op4_urls, op4_aliases, op5_topk, op6_mixing, op7_line_dedup, op8_warc, op9_imatch, op10_chat)
}

#: Learnt scores, XXH64, patience, permutations and the tokenizer have no SQL form.
ORACLES: dict[str, str] = {"op4_urls": urls.ORACLE, "op4_aliases": urls.ALIASES, "op5_topk": topk.ORACLE, "op8_warc": warc.ORACLE, "op10_chat": chat.ORACLE}
