"""Lineage cuts that survive a lost executor.

An iterative plan doubles in size every round, so each round is written as
Parquet in the folder that the cluster shares and read back.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Paths of the tables cut so far that are not deleted.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a folder of its own that goes at
    exit; a cluster session is refused, since its executors share no disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more, in whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written once and read back, so that later plans start from a scan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    # sorted texts and numbers are stored by their differences
    df.write.option("compression", "zstd").option("parquet.writer.version", "v2").parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts and merges, never broadcasts it.

    Spark takes rows that are exploded, or made by Python, for no larger than the
    table they come from, and would send millions of them to the driver.
    """
    return df.hint("merge")


#: Rows up to which a written table may be sent whole to every task.
SMALL = 100_000


def sized(df: DataFrame) -> DataFrame:
    """A written table for joins by a shuffle, unless it has few rows.

    Files of sorted names and numbers are so small that Spark would send millions
    of their rows through the driver.
    """
    return df if df.count() <= SMALL else shuffled(df)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to as many tasks as run at once, where its files give fewer."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def settled(make: Callable[[], DataFrame], name: str = "settled") -> DataFrame:
    """``make()`` written and read back, after which the tables that were cut on its way are deleted."""
    before = len(_MADE)
    out = cut(make(), name)
    for path in _MADE[before:-1]:
        remove(out.sparkSession, path)
    del _MADE[before:-1]
    return out


def cut_round(df: DataFrame, name: str = "round") -> DataFrame:
    """:func:`cut` for a round that keeps part of the table before it: no more files than shuffle partitions.

    Without the bound every round would add its files to those it copies.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.coalesce(n), name)
