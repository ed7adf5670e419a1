"""The corpus pipeline: five stages over ``documents``, each one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage reads
it back from Parquet.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentmark.llm import bm25_pack, cdc_dedup, golay_simhash, mixing, pu_quality
from contentmark.llm.queries import (KEEP_SCORE, MIX_CYCLE, MIX_EPOCHS, MIX_SHARE, WORD_VOCABULARY,
                                     quality_model, vocabulary)
from contentmark.session import ensure_checkpoint_dir, table_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier accepts."""
    model = quality_model(docs, spark.read.parquet(table_path(sf_dir, "labels")))
    return docs.where(pu_quality.score(model, F.col("text")) >= KEEP_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return golay_simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that occur elsewhere."""
    out = cdc_dedup.dedup(docs)
    return (out.withColumn("n_chars", F.when(F.col("_x_spans").isNull(), F.col("n_chars"))
                           .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
            .select(*docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents to the target weights of their sources."""
    return mixing.mix(docs, mixing.cyclic_weights(MIX_CYCLE), budget_ratio=MIX_SHARE,
                      max_epochs=MIX_EPOCHS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mixture into sequences; the last stage."""
    return bm25_pack.pack(docs, vocabulary(WORD_VOCABULARY))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates),
          ("substring dedup", substrings), ("source mixing", mixture), ("packing", packing)]

#: A learned classifier, bit fingerprints and a tokenizer are not SQL; the
#: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
