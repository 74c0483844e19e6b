"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, encoding.

Each stage works on all that the one before kept, and its decisions take effect: rejected documents go, one document of
each group of near-duplicates stays, secrets are replaced in the texts, documents are repeated or left out by the mix,
and the last stage encodes what is left and decodes it again.

Defined cases: a document with a null or empty text has too few words for the quality rules and goes; a null id is kept by
near-dedup, as it can't be linked; a null source is mixed as a source of its own; of repeated rows all stay that near-dedup
keeps; texts of any length are worked on whole; an empty table gives an empty result; further columns are carried along
up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factlake.llm.bpe import round_trip
from factlake.llm.common import checkpoint_path, remove
from factlake.llm.mixing import mix
from factlake.llm.neardup import keep_first
from factlake.llm.quality import keep_good
from factlake.llm.queries import bpe_digests
from factlake.llm.secrets import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(round_trip(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("bpe", bpe),
]

#: Sketches, a trained network and the vocabulary can't be written in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet to the shared folder and read again.

    A stage's table goes when the next one's is written; the last of them stays, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{checkpoint_path(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{k}-{name}")
            docs = spark.read.parquet(f"{top}/{k}-{name}")
            if k:
                remove(spark, f"{top}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
