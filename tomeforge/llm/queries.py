"""The corpus operators as named queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tomeforge.llm import context_mixing, decontaminate, ngram_join, packing, passage_dedup, pii, repetition, sharding, token_store, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.offending_sentences(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repetition.keep_unrepetitive(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "covered_fraction", "longest_repeat")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_store.store(docs, token_store.train_dictionary(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(_table(spark, sf_dir, "documents"))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.cut_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return context_mixing.score(docs, context_mixing.gather(docs))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_repetition, op3_packing, op4_sharding, op5_token_store, op6_decontamination, op7_ngram_join, op8_pii, op9_passage_dedup, op10_context_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.sql(), "op7_ngram_join": ngram_join.SQL, "op9_passage_dedup": passage_dedup.SQL}
