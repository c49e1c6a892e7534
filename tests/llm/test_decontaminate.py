import hashlib

import pytest

import tessera.llm.decontaminate as dc

from .conftest import ALNUM, words


def brute(docs, items, n):
    windows = {}
    for i, t in items:
        w = words(t, ALNUM)
        for k in range(max(len(w) - n, 0) + 1) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, found = words(t, ALNUM), set()
        hit = [0] * len(w)
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if (x := windows.get(tuple(w[k : k + m]))) is not None:
                    found |= x
                    hit[k : k + m] = [1] * m
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0))
    return sorted(out, key=str)


def run(docs, items):
    got = sorted((tuple(r) for r in dc.decontaminate(docs, items).collect()), key=str)
    return got, brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 10)


def test_documents_against_brute_force(spark, docs, sf):
    got, want = run(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert got == want
    assert any(r[5] for r in got)


@pytest.mark.parametrize("block", [200_000, 2])
def test_short_and_repeated_items(spark, odd, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WINDOWS", block)
    items = spark.createDataFrame([(1, "w1 w2 w3"), (2, "one"), (3, None), (4, "..."), (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (9, "W1 w2 W3"), (None, "null id"), (5, "a b")], "item_id long, text string")
    got, want = run(odd, items)
    assert got == want


@pytest.mark.parametrize("block", [200_000, 2])
def test_rows_that_share_ids_or_lack_them(spark, monkeypatch, block):
    """Texts of equal length under one doc_id, or without one, keep their own hits, in however many blocks the windows go out."""
    monkeypatch.setattr(dc, "BLOCK_WINDOWS", block)
    items = spark.createDataFrame([(k, f"{a} {b} {c}") for k, (a, b, c) in enumerate(["abc", "def", "ghi", "jkl"])], "item_id long, text string")
    texts = ["a b c", "x y z", "d e f", "a b c", "g h i", None, "j k l"]
    rows = [(5, t) for t in texts] + [(None, t) for t in texts] + [(0, "a b c"), (0, "q q q")]
    got, want = run(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert got == want
    left = dc.without_benchmark(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted((tuple(r) for r in left.collect()), key=str) == sorted([(5, "x y z"), (None, "x y z"), (5, None), (None, None), (0, "q q q")], key=str)


def test_no_items(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in dc.decontaminate(odd, none).collect())
    assert dc.decontaminate(empty, none).count() == 0


@pytest.mark.parametrize("block", [200_000, 2])
def test_filter_agrees_with_the_verdicts(spark, odd, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WINDOWS", block)
    items = spark.createDataFrame([(1, "w1 w2 w3"), (2, "one"), (3, "nothing like it")], "item_id long, text string")
    bad = {r["doc_id"] for r in dc.decontaminate(odd, items).where("contaminated").collect()}
    left = dc.without_benchmark(odd, items)
    assert left.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r["doc_id"]) for r in odd.collect() if r["doc_id"] not in bad)
