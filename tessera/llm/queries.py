"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate as windows
from tessera.llm import clusters, licences, middle, near_dedup, passages
from tessera.llm.chat import format_chats
from tessera.llm.decontaminate import decontaminate
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.perplexity import quality_rules
from tessera.llm.quality import quality
from tessera.llm.substring_dedup import dedup_substrings
from tessera.llm.token_files import token_files
from tessera.llm.toxicity import toxicity
from tessera.plans import Registry, table

registry = Registry()


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@registry.add("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=1024)


@registry.add("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).drop("ids")


@registry.add("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), length=200)


@registry.add("op5_minhash_near_dedup", near_dedup.oracle_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


@registry.add("op4_benchmark_decontamination", windows.oracle_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


@registry.add("op7_quality_trees")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=0, modulus=5, threshold=0.3)


@registry.add("op10_toxicity_cnn")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=2, modulus=4, threshold=0.3)


@registry.add("op8_perplexity_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@registry.add("op9_licence_scan", licences.oracle_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


@registry.add("op6_chat_transcripts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


@registry.add("op11_centroid_clustering", clusters.oracle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.kmeans(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


@registry.add("op12_substring_dedup", passages.oracle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup_passages(table(spark, sf_dir, "documents"), window=13)


@registry.add("op13_fill_in_middle", middle.oracle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=42, plain=50, spm=80)
    digest = F.sha2("output", 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest.alias("output_sha256"), F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
