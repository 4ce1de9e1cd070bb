"""The thin queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, imatch, language, ngram_join, repeats, resampling, secrets, sharding, token_files
from tidemark.llm.common import documents, materialized, removed, shared_dir


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaks(documents(spark, sf_dir), benchmark).drop("text_md5")


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_report(documents(spark, sf_dir))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir)).drop("live")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs, ~language.held_out())
    judged = language.identify(docs, model, carry=["doc_id"])
    return judged.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "margin")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), out, end_id=1)
    digests = materialized(token_files.read_digests(spark, out), "digests")
    removed(spark, out)
    return digests


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.grouped(documents(spark, sf_dir), size=3, per_cent=90)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), n_shards=24)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(documents(spark, sf_dir))


def op10_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_imatch": op2_imatch,
        "op3_bpe": op3_bpe,
        "op4_secrets": op4_secrets,
        "op5_language": op5_language,
        "op6_token_files": op6_token_files,
        "op7_ngram_join": op7_ngram_join,
        "op8_sharding": op8_sharding,
        "op9_repeats": op9_repeats,
        "op10_resampling": op10_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {}
