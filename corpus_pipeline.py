"""From raw documents to packed sequences, one written table after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cut import settled
from tessera.llm.decontaminate import without_benchmark
from tessera.llm.near_dedup import without_near_copies
from tessera.llm.packing import pack
from tessera.llm.substring_dedup import without_repeats
from tessera.llm.toxicity import accepted, fit

#: No SQL expresses the trained classifier or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose score reaches their language's threshold; the classifier learns from ``labels``.

    A null or empty text scores as an empty document; rows without a doc_id or a
    language are judged like others, and an empty table stays one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return accepted(docs, fit(docs, labels, F.lit(True)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the smallest doc_id, null after all others; of equal rows any one.

    Rows without a doc_id and rows that share one are members like others, told
    apart by their texts. A text without words is in no group and stays.
    """
    return without_near_copies(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that 200-byte repeats cover; n_chars follows the text.

    All rows stay, those without a doc_id or a text included; a null text stays null.
    """
    out = without_repeats(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; a text without words holds none."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 1024 tokens; a null or empty text is its end id."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("minhash near-dedup", near), ("suffix-array dedup", substrings), ("benchmark decontamination", benchmark), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; each stage reads what the one before has written.

    Extra columns pass through all stages but the last, whatever their names;
    an empty table gives no pieces.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage{k}")
