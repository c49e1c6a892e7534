import collections
import hashlib
import random

import pytest

import tessera.llm.substring_dedup as sd
from tessera.llm.suffix_groups import suffix_array


def test_suffix_array_against_sorting():
    rng = random.Random(3)
    for _ in range(2000):
        t = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    assert suffix_array([]) == []


def brute(rows, n):
    seen = collections.Counter()
    for _, t in rows:
        seen.update(hash(t[i : i + n]) for i in range(len(t) - n + 1))
    out = []
    for d, t in rows:
        hit = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[hash(t[i : i + n])] > 1:
                hit[i : i + n] = b"\1" * n
        kept = bytes(b for b, x in zip(t, hit, strict=True) if not x)
        out.append((d, len(t), sum(hit), sum(1 for i in range(len(hit)) if hit[i] and (not i or not hit[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, n):
    return sorted((tuple(r) for r in sd.dedup_substrings(df, n).collect()), key=str), [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]


@pytest.mark.parametrize("n", [200, 40])
def test_documents_against_brute_force(docs, n):
    got, rows = run(docs, n)
    assert got == brute(rows, n)


@pytest.mark.parametrize("members", [256, 15])
def test_many_variants_of_one_passage(spark, monkeypatch, members):
    """With few members allowed, groups are cut into shorter runs, with the same result."""
    monkeypatch.setattr(sd, "MEMBERS", members)
    rng = random.Random(1)
    base = "".join(rng.choice("ab c") for _ in range(1500))
    rows = []
    for i in range(220):
        s = list(base[rng.randint(0, 50) : rng.randint(400, 700)])
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = rng.choice("abc")
        rows.append((i, "".join(s)))
    rows += [(900, None), (901, ""), (902, "x" * 900), (903, "é" * 300), (904, "q" * 200), (905, "q" * 199)]
    got, plain = run(spark.createDataFrame(rows, "doc_id long, text string"), 200)
    assert got == brute(plain, 200)


def test_odd_rows(odd, empty):
    got, rows = run(odd, 200)
    assert got == brute(rows, 200)
    assert sd.dedup_substrings(empty).count() == 0


def test_kept_text_drops_torn_code_points(spark):
    shared = "z" * 199
    rows = [(1, shared + "é", "a"), (2, shared + "è", "b")]
    got = {tuple(r) for r in sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, row string"), 200).collect()}
    assert got == {(1, "", "a"), (2, "", "b")}


def test_rows_that_share_ids_or_lack_them(spark):
    """A null id beside a null text is no other document's row, and one id may name several texts."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdef gh") for _ in range(n))
    a, b, c = word(400), word(300), word(260)
    rows = [(None, None), (None, None), (42, a + b), (42, None), (43, b + c), (7, a), (7, c + "tail"), (7, "other"), (None, c), (None, a[:250]), (0, "zero"), (None, "zero"), (8, a + b), (8, a + b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, plain = run(df, 200)
    assert got == brute(plain, 200)
    left = sorted(((r["doc_id"], r["text"]) for r in sd.without_repeats(df, 200).collect()), key=str)
    assert len(left) == len(rows) and [r for r in left if r[1] is None] == [(42, None), (None, None), (None, None)]
    assert sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in left) == sorted(r[4] for r in got)


def test_other_columns_pass_through(odd):
    out = sd.without_repeats(odd, 200)
    assert out.columns == odd.columns and out.count() == odd.count()
