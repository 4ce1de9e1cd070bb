"""A corpus pipeline of five stages, from documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

1. language: documents whose language compression can't tell go.
2. near_duplicates: of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles, the one with the
   least doc_id stays; of repeated rows, or copies that all lack an id, one stays.
3. decontaminate: documents in which a benchmark item is found go.
4. secrets: live-looking values, which few owners have, are replaced by a mark; widely copied examples stay.
5. bpe: the ids of each text, with their number; decoding them gives the text back.

Null texts have no language, so the first stage drops them. Null and repeated doc_ids are allowed: no stage joins rows
by doc_id alone. Extra columns are carried through all stages but the last, whatever their names. Empty tables go through
as empty tables. Each stage begins with the executors giving back the memory of the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, language, ngram_join, secrets
from tidemark.llm.common import discard, documents, materialized, released
from tidemark.llm.queries import vocabulary


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    released(spark)
    model = language.fit(docs, F.lit(True))
    return language.kept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    released(spark)
    kept = ngram_join.first_of_each(docs, size=5, per_cent=80)
    released(spark)  # the groups are found; what is left is joins, and the next stage has no Python either
    return kept


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    released(spark, workers=False)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    released(spark)
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    released(spark)
    return bpe.encode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("bpe", encoded),
]

#: no stage but the last could be expressed in SQL; tests/llm/test_pipeline.py has brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)  # what the stage has read
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
