"""Running k-mer counts of reads that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import seq


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n) over a stream or table of reads (seq): counts of canonical k-mers, for complete or update output."""
    rows = reads.where(F.length("seq") >= k).select(F.explode(seq.kmers(F.col("seq"), k)).alias("kmer"))
    return rows.groupBy(seq.canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(start, key, n): counts in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), key, "n")
