import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm.token_files import code, decode, read_token_files, token_files, write_token_files  # noqa: E402

from .test_packing import WORDS, whole  # noqa: E402


def test_streams_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = code(v)
        assert len(control) == -(-n // 4)
        assert (decode(control, data, n) == v).all()


def expected(docs):
    rows = docs.collect()
    ids = [x + (2).to_bytes(4, "little") for x in whole(WORDS, [r["text"] or "" for r in rows])]
    return [(r["doc_id"], x) for r, x in zip(rows, ids, strict=True)]


def test_documents_come_back_in_order(docs):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in token_files(docs, WORDS).collect()}
    at, want = 0, {}
    for doc, ids in sorted(expected(docs)):
        want[doc] = (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    assert got == want


def test_files_ascend_and_use_short_codes(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    write_token_files(docs, path, WORDS, shards=3)
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("shard", "block").collect()
    order = [d for b in blocks for d in b["doc_ids"]]
    assert order == sorted(order)
    n = sum(sum(b["counts"]) for b in blocks)
    assert sum(len(b["control"]) + len(b["data"]) for b in blocks) < 2.25 * n
    assert read_token_files(spark, path).count() == len(order)


def test_odd_rows(odd, empty):
    rows = token_files(odd, WORDS).collect()
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in rows) == sorted((str(d), x) for d, x in expected(odd))
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
    assert token_files(empty, WORDS).count() == 0


def test_literal_special_strings_are_their_ids(spark):
    """As the library has it by default: one id for the string, in its own case only."""
    texts = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "<|startoftext|>", "x<|endoftext|>y", "plain words here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["ids"]) for r in token_files(df, WORDS).collect()}
    assert got == dict(expected(df))
    assert 49407 in np.frombuffer(got[0], "<u4") and 49406 in np.frombuffer(got[2], "<u4") and 49407 not in np.frombuffer(got[1], "<u4")


def test_a_doc_id_that_all_rows_share_is_dealt_to_all_shards(spark, tmp_path):
    df = spark.range(400).selectExpr("5L as doc_id", "concat('word ', id % 3) as text")
    path = str(tmp_path / "t")
    write_token_files(df, path, WORDS, shards=4)
    sizes = [r["n"] for r in spark.read.parquet(f"{path}/blocks").selectExpr("shard", "size(doc_ids) as k").groupBy("shard").agg({"k": "sum"}).withColumnRenamed("sum(k)", "n").collect()]
    assert sum(sizes) == 400 and max(sizes) < 250
