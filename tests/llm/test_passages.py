import collections
import hashlib
import random

import numpy as np
import pytest

from tessera.llm import passages as ps

COLUMNS = "doc_id long, text string"


def brute(rows, n=13):
    least = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    rank = lambda d: ps.LAST if d is None else d
    for d, w in split:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            least[k] = min(least.get(k, ps.LAST), rank(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < rank(d):
                gone.update(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def run(df, n=13):
    return sorted((tuple(r) for r in ps.dedup_passages(df, n).collect()), key=str), [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("n", [13, 3])
def test_documents_against_brute_force(docs, n):
    got, rows = run(docs, n)
    assert got == brute(rows, n)


@pytest.mark.parametrize(("members", "leaves", "runs"), [(1 << 14, 1 << 15, 1 << 18), (20, 64, 50)])
def test_many_variants_of_one_passage(spark, monkeypatch, members, leaves, runs):
    """Frequent prefixes go by all words, slices are small, and the rows are the same."""
    for name, value in (("MEMBERS", members), ("LEAVES", leaves), ("SLICE", runs), ("CONTENTS", runs)):
        monkeypatch.setattr(ps, name, value)
    rng = random.Random(2)
    base = [rng.choice("ab cd e fgh ij".split()) + str(rng.randint(0, 30)) for _ in range(300)]
    rows = []
    for i in range(240):
        w = list(base[rng.randint(0, 40) : rng.randint(60, 200)])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 5)}"
        rows.append((rng.randint(0, 200), rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(500 + i, f"u{i} " + "the common line here " + f"v{i} " * 12) for i in range(60)] + [(600, "same " * 60), (601, "same " * 40), (None, "same " * 30)]
    got, plain = run(spark.createDataFrame(rows, COLUMNS).repartition(3))
    assert got == brute(plain)


def test_odd_rows(odd, empty):
    got, rows = run(odd)
    assert got == brute(rows)
    assert ps.dedup_passages(empty).count() == 0
    out = ps.without_passages(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("text is null").count() == 1 and out.where("doc_id = 5").first()["text"] == ""


def test_rows_that_share_ids_or_lack_them(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(None, a), (None, a), (4, a), (4, a + " " + b), (3, b), (3, b), (9, c + " " + a), (None, c), (None, None), (None, b + " é漢  " + b)]
    got, plain = run(spark.createDataFrame(rows, COLUMNS))
    assert got == brute(plain)


def test_long_texts_and_words_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ps, "BLOCK_BYTES", 700)
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 400)}" for _ in range(3000)]
    huge = "z" * 9000
    rows = [(1, " ".join(words)), (2, "  ".join(words[500:2500])), (3, " ".join([*words[:30], huge, *words[30:60]])), (4, " ".join([*words[20:30], huge, *words[30:40]])), (5, huge + " " + huge + "y")]
    got, plain = run(spark.createDataFrame(rows, COLUMNS))
    assert got == brute(plain)
    text = " ".join(words).encode()
    whole = [tuple(words[i : i + 13]) for i in range(len(words) - 12)]
    cut_up = [tuple(w.decode() for w in p.split()[i : i + 13]) for p in ps.pieces(text, 13, 700) for i in range(len(p.split()) - 12)]
    assert cut_up == whole


def test_suffix_tree_nodes():
    """Internal nodes are exactly the strings that are followed in two ways (or end twice), with all their suffixes below."""
    rng = random.Random(5)
    for _ in range(200):
        suffixes = [[rng.randint(0, 2) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 25))]
        rows = np.full((len(suffixes), 7), -1, np.int64)
        for r, s in zip(rows, suffixes, strict=True):
            r[: len(s)] = s
        tree = ps.SuffixTree(rows)
        below = collections.defaultdict(set)
        after = collections.defaultdict(set)
        for i, s in enumerate(suffixes):
            for k in range(len(s) + 1):
                below[tuple(s[:k])].add(i)
                after[tuple(s[:k])].add(s[k] if k < len(s) else ("end", i))
        want = {(len(p), frozenset(below[p])) for p in below if len(after[p]) > 1 or not p}
        nodes = [(int(d), frozenset(tree.order[a:b].tolist())) for d, a, b in zip(tree.depth, tree.first, tree.last, strict=True)]
        assert set(nodes) == want and len(nodes) == len(want)
        for at in range(1, len(nodes)):
            up = int(tree.parent[at])
            assert tree.depth[up] < tree.depth[at] and nodes[up][1] > nodes[at][1] or (nodes[up][1] == nodes[at][1] and up == 0)
