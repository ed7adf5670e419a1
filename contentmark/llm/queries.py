"""Registered queries of this subpackage: the whole intended table each, with
production parameters."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentmark.llm import (bm25_pack, cdc_dedup, chat, chat_repair, crossparse, feast_whiten, golay_simhash, minhash_tensor,
                             mixing, multi_index, pu_quality, wavelet, weak_rules)
from contentmark.session import materialize, table_path

BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"
MIX_CYCLE, MIX_SHARE, MIX_EPOCHS = (3, 1, 2), 1.5, 2.0
KEEP_SCORE = 0.3
QUALITY_FOLD, LANGUAGE_FOLD = (5, 0), (4, 2)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; LLM_VOCABULARIES names another folder."""
    import public_tokenizers
    folder = os.environ.get("LLM_VOCABULARIES")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def in_fold(fold: tuple[int, int]) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold[0] == fold[1], F.lit(False))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(_t(spark, sf_dir, "documents"), mixing.cyclic_weights(MIX_CYCLE),
                    budget_ratio=MIX_SHARE, max_epochs=MIX_EPOCHS)
    return p.select("doc_id", F.col("_x_size").alias("size"), F.col("_x_source_size").alias("source_size"),
                    F.col("_x_target").alias("target"), mixing.taken().cast("bigint").alias("taken"))


def quality_model(docs: DataFrame, labels: DataFrame) -> dict:
    held = in_fold(QUALITY_FOLD)
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where((F.col("q") == 1) & ~held)
    return pu_quality.fit(docs, trusted.select(F.col("doc_id").alias("id")),
                          docs.where(~held).select(F.col("doc_id").alias("id")))


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    model = quality_model(docs, _t(spark, sf_dir, "labels"))
    return (docs.select("doc_id", in_fold(QUALITY_FOLD).alias("held_out"),
                        pu_quality.score(model, F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= KEEP_SCORE).cast("int")))


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(_t(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))
    return wavelet.read_shards(shards)


def op4_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = weak_rules.judge(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return j.select("doc_id", *[F.col(f"_x_{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")])


def op5_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)],
                                  "conv_id bigint, turn bigint, role string, text string")
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    conv = materialize(chat.conversations(turns), "chat-text")
    examples = materialize(chat.expand(conv), "chat-examples")
    parts = ["example", "context_end", "target_start", "target_end", "example_end"]
    own = (examples.groupBy(F.col("conv_id").alias("c"))
           .agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("examples")))
    got = conv.select("conv_id", "formatted").join(own, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    # the conversation again, from its last example: the context, and the target up to the end
    last = F.element_at("examples", -1)
    read = F.concat(F.substring("formatted", F.lit(1), last["context_end"]), F.coalesce(F.substring(
        F.col("formatted"), last["target_start"] + 1, last["example_end"] - last["target_start"]), F.lit("")))
    got = got.withColumn("read", read)
    loss = F.array_join(F.transform(F.filter("examples", lambda s: s["target_start"].isNotNull()),
                                    lambda s: chat.unescape(F.substring(
        F.col("formatted"), s["target_start"] + 1, s["target_end"] - s["target_start"]))), "")
    got = got.withColumn("turns", chat.read_turns(F.col("read"))).withColumn("loss", loss)
    holds = chat.examples_hold(F.col("examples"), chat.turn_bounds(F.col("read")))
    n_turns = F.when(holds, F.size("turns").cast("bigint")).otherwise(
        F.raise_error(F.lit("an example does not hold the turns before its reply")).cast("bigint"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id", n_turns.alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("read").cast("bigint").alias("formatted_chars"))


def op6_crossparse_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    held = in_fold(LANGUAGE_FOLD)
    model = crossparse.fit(docs, ~held)
    out = crossparse.predict(docs.select("doc_id", "text"), model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    out = cdc_dedup.dedup(docs)
    spans = F.coalesce("_x_spans", F.array().cast("array<struct<a:int,b:int>>"))
    cut = F.aggregate(spans, F.lit(0), lambda n, s: n + s["b"] - s["a"])
    return out.select("doc_id", "text", F.length("text").cast("bigint").alias("n_chars"),
                      F.size(spans).cast("bigint").alias("n_spans"), cut.cast("bigint").alias("removed_chars"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(_t(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_pack.pack(_t(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = golay_simhash.near_duplicates(_t(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"),
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(chat_repair.damage(_t(spark, sf_dir, "conversations")))


def op12_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = minhash_tensor.near_duplicates(_t(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return d.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feast_whiten.whiten(_t(spark, sf_dir, "embeddings"))


def registry() -> dict:
    import corpus_pipeline
    own = (op1_mixing, op2_pu_quality, op3_wavelet_tokens, op4_weak_rules, op5_chat_prefix,
           op6_crossparse_language, op7_cdc_dedup, op8_multi_index, op9_bm25_packing, op10_golay_simhash,
           op11_chat_repair, op12_minhash_tensor, op13_feast_whitening)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}
