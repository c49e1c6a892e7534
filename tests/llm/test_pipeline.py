import re

import corpus_pipeline
from tessera.cut import cut

from .test_near import brute as near_brute
from .test_packing import check
from .test_substrings import brute as sub_brute


def test_stages_hold_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
    before = docs
    tables = []
    for _, stage in corpus_pipeline.STAGES:
        before = cut(stage(spark, before, sf), "test")
        tables.append(before)
    toxic, near, sub, clean, packed = tables
    assert all(t.columns == columns for t in tables[:-1])
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in tables[:-1]]
    assert ids[0] >= ids[1] >= ids[3] and ids[1] == ids[2]

    kept = {d for d, (_, _, k) in near_brute([(r["doc_id"], r["text"]) for r in toxic.collect()], 5, 80).items() if k}
    assert ids[1] == kept

    want = {d: (n, gone) for d, n, gone, _, _ in sub_brute([(r["doc_id"], (r["text"] or "").encode()) for r in near.collect()], 200)}
    for r in sub.collect():
        n, gone = want[r["doc_id"]]
        assert n - gone - 6 <= len(r["text"].encode()) <= n - gone
        assert r["n_chars"] == len(r["text"])

    assert check(packed.collect(), clean.collect(), 1024) > 0


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.toxic(spark, docs, sf).select("doc_id").collect()}
    insults = re.compile(r"\b(idiot|moron|scum|worthless|pathetic)\b")
    bad = [r["doc_id"] for r in docs.collect() if len(insults.findall((r["text"] or "").lower())) >= 3]
    assert bad and sum(d in left for d in bad) <= 0.1 * len(bad)
    assert len(left) > 0.85 * docs.count()


def test_run_gives_packed_pieces(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_repeated_rows_and_null_ids_survive_once(spark, sf):
    text = {k: " ".join(f"{k}{i}" for i in range(90)) for k in "abcdefg"}
    shared = " ".join(f"shared{i}" for i in range(40))
    rows = [(1, text["a"]), (1, text["a"]), (None, text["b"]), (2, text["b"]), (None, text["c"]), (None, text["c"]), (3, text["d"]), (3, text["e"]), (4, ""), (4, ""), (None, None)]
    rows += [(5, text["f"] + " " + shared), (None, shared + " " + text["g"])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = cut(corpus_pipeline.near(spark, docs, sf), "test")
    once = [(1, text["a"]), (2, text["b"]), (None, text["c"]), (3, text["d"]), (3, text["e"]), (4, ""), (4, ""), (None, None)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=order)
    assert got == sorted([*once, *rows[-2:]], key=order)
    out = {(r["doc_id"], r["text"]) for r in corpus_pipeline.substrings(spark, near, sf).collect()}
    assert out >= set(once) and len(out) == len(set(once)) + 2
    assert {t.strip() for d, t in out - set(once)} == {text["f"], text["g"]}


def test_odd_and_empty_tables_pass_all_stages(spark, sf, odd, empty, tmp_path):
    """Null ids and texts, long texts, repeats and columns with clashing or dotted names; every stage but the last returns all columns."""
    for docs, most in ((odd.selectExpr("*", "7 as row", "8 as mark", "9 as spans"), 10), (empty, 0)):
        at = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = cut(stage(spark, at, sf), "test")
            assert at.columns == docs.columns and at.count() <= most
        folder = tmp_path / str(most)
        docs.write.parquet(f"{folder}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
        packed = corpus_pipeline.run(spark, str(folder)).collect()
        assert len({r["doc_id"] for r in packed}) == len({r["doc_id"] for r in at.collect()}) and bool(packed) == bool(most)
