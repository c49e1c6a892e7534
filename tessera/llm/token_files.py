"""Token ids in files of byte-aligned, variable-length codes.

Ids are replaced by their rank in falling frequency, so that the commonest 256
take one byte. A block codes the ids of consecutive documents: a control stream
holds two bits for each id (its length in bytes less one, four ids to a byte)
and a data stream the little-endian bytes without the leading zeros. Both are
written and read by numpy table lookup, without a loop over ids.

A file is a Parquet file of such blocks, written by Spark's committer into a
folder: ``shard`` (its number in doc_id order), ``block`` (its number in the
shard), the blocks' doc_ids and token counts, and the two streams. Shards hold
ascending, disjoint doc_id ranges, and blocks ascend inside a shard. The rank
table lies beside them (``ranks``), with at most one row for each id of the
vocabulary.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.cut import remove, shared_dir
from tessera.llm.scan import record, small_batches, text_blocks
from tessera.llm.tokens import END, encoder

#: Ids of a block, beyond which it takes no further document.
BLOCK_IDS = 1 << 18

_BYTE = np.arange(256)
#: Lengths of the four ids of a control byte, and the bytes they take together.
LENGTHS = ((_BYTE[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def code(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data streams of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | (four[:, 1] << 2) | (four[:, 2] << 4) | (four[:, 3] << 6)
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values behind the streams: lengths by table, places by running sum, bytes by mask."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    wide = np.frombuffer(data + b"\0\0\0", np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(wide, 4)[at].copy() if n else np.zeros((0, 4), np.uint8)
    return words.view("<u4").reshape(-1) & MASKS[size]


TOKENS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def tokens(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """(doc_id, n, ids): ids of each text and the end id, in two bytes each where the text's ids allow it, else in four."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, close = encoder(tokenizer), int(end).to_bytes(4, "little")
        for batch, texts in text_blocks(batches):
            ids = [np.frombuffer(x + close, "<u4") for x in tool.encode(texts)]
            yield record(TOKENS, doc_id=batch.column(0), n=[len(x) for x in ids], ids=[(x.astype("<u2") if x.max() < 1 << 16 else x).tobytes() for x in ids])

    return docs.mapInArrow(run, "doc_id long, n long, ids binary")


def _wide(n: int, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def frequencies(coded: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs; a task sends one row per id that it saw."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                seen = np.bincount(np.concatenate([_wide(n, x) for n, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]))
                if len(seen) > len(total):
                    total = np.pad(total, (0, len(seen) - len(total)))
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield record(schema, id=used, n=total[used])

    return coded.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCK = "shard int, block int, doc_ids array<long>, counts array<long>, control binary, data binary"
BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END, shards: int | None = None) -> None:
    """Codes every row of ``docs`` (doc_id, text) into block files under ``path``, ascending by doc_id.

    A null text is the empty one and leaves the end id alone. Rows that repeat a
    doc_id stay side by side, ordered by their lengths; null doc_ids
    come first. Other columns are ignored. An empty table writes no block.
    """
    spark = small_batches(docs).sparkSession
    # tokenized once; the copy is compressed, since ids are wider than their entropy
    raw = f"{path}/tokens"
    tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer, end).write.option("compression", "zstd").parquet(raw)
    once = spark.read.schema("doc_id long, n long, ids binary").parquet(raw)
    frequencies(once).write.parquet(f"{path}/ranks")
    rank = spark.sparkContext.broadcast(_ranks(spark, path)[0])

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        total = 0

        def close() -> pa.RecordBatch:
            control, data = code(np.concatenate([rank.value[_wide(n, ids)] for _, n, ids in held]))
            return record(BLOCK_ARROW, shard=[shard], block=[block], doc_ids=[[h[0] for h in held]], counts=[[h[1] for h in held]], control=[control], data=[data])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                total += row[1]
                if total >= BLOCK_IDS:
                    yield close()
                    held, total, block = [], 0, block + 1
        if held:
            yield close()

    # dealt as it was read, so that the sampling of doc_ids runs no Python; a doc_id that many rows share is dealt by its rows' numbers
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("row")]
    dealt = once.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("row")
    dealt.mapInArrow(to_blocks, BLOCK).write.parquet(f"{path}/blocks")
    remove(spark, raw)


def _ranks(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """rank of id, and id of rank: one entry for each id of the vocabulary that occurs."""
    rows = spark.read.parquet(f"{path}/ranks").toPandas().sort_values(["n", "id"], ascending=[False, True])
    ids = rows["id"].to_numpy(np.int64)
    rank = np.zeros(int(ids.max(initial=-1)) + 1, np.uint32)
    rank[ids] = np.arange(len(ids))
    return rank, ids.astype(np.uint32)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, decoded from the files.

    ``start`` is the number of ids of all documents before it: shards are summed
    first, one row each, and blocks and documents only inside their shard.
    """
    ids = spark.sparkContext.broadcast(_ranks(spark, path)[1])
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("inner", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, docs, counts, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = np.cumsum(counts)
                values = ids.value[decode(control, data, int(ends[-1]))].astype("<u4")
                each = [values[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
                k = len(docs)
                yield record(schema, shard=[shard] * k, block=[block] * k, doc_id=docs, inner=ends - counts, n_tokens=counts, ids_crc32=[zlib.crc32(x) for x in each], ids=each)

    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    sizes = blocks.selectExpr("shard", "block", "aggregate(counts, 0L, (a, b) -> a + b) as n")
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = sizes.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("within"))
    place = inside.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("within")).alias("base"))
    out = blocks.select("shard", "block", "doc_ids", "counts", "control", "data").mapInArrow(run, "shard int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long, ids binary")
    return out.join(place, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_files(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Writes ``docs`` to files in the session's shared folder and reads them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end)
    return read_token_files(spark, path)
