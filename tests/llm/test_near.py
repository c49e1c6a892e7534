import random

import numpy as np
import pytest

import tessera.llm.near_dedup as nd

from .conftest import SPACED, words


def sets(text, n):
    w = words(text, SPACED)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    parent, of, inverted = {d: d for d, _ in rows}, {}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, t in sorted(rows):
        of[d] = sets(t, n)
        shared = {}
        for g in of[d]:
            for o in inverted.get(g, ()):
                shared[o] = shared.get(o, 0) + 1
            inverted.setdefault(g, []).append(d)
        for o, k in shared.items():
            if 100 * k >= percent * (len(of[d]) + len(of[o]) - k):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
    return {d: (len(of[d]), root(d), root(d) == d) for d, _ in rows}


def run(df, n):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df, n).collect()}
    return got, brute([(r["doc_id"], r["text"]) for r in df.collect()], n, 80)


@pytest.mark.parametrize("n", [4])
def test_documents_against_brute_force(docs, n):
    got, want = run(docs, n)
    assert got == want


@pytest.mark.parametrize(("tile", "large"), [(8, 16_384), (8, 3)])
def test_groups_of_variants(spark, monkeypatch, tile, large):
    """Chains of variants that their group's smallest member does not reach; large groups are split by further bands."""
    monkeypatch.setattr(nd, "TILE", tile)
    monkeypatch.setattr(nd, "LARGE", large)
    rng = random.Random(6)
    rows, i = [], 0
    for _ in range(4):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(5000)}"
            rows.append((i, " ".join(w)))
            i += 1
            if rng.random() < 0.3:
                base = w
    got, want = run(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert got == want


def variants(spark, n):
    rng, rows = random.Random(8), []
    for _ in range(2):
        base = [f"v{rng.randrange(5000)}" for _ in range(60)]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_large_groups_are_compared_whole(spark, monkeypatch):
    """Links do not hang on a further band: the parts of a large group may hold none of them."""
    monkeypatch.setattr(nd, "LARGE", 0)
    monkeypatch.setattr(nd, "_finer", lambda large, reps: large.select("band", "used", "rep").limit(0))
    got, want = run(variants(spark, 40), 4)
    assert got == want


def test_tiles_leave_out_links_that_join_nothing(spark, monkeypatch):
    """Without stars all links come out of tiles, in parts of few members: fewer of them than pairs that are linked."""
    counts, crossing = [], nd._crossing

    def counted(*a):
        found = nd.cut(crossing(*a))
        counts.append(found.count())
        return found

    monkeypatch.setattr(nd, "HELD", 2000, raising=False)
    monkeypatch.setattr(nd, "_crossing", counted)
    monkeypatch.setattr(nd, "_stars", lambda members: members.where("rep < hub").selectExpr("hub as a", "rep as b"))
    df = variants(spark, 60)
    got, want = run(df, 4)
    assert got == want
    of = [sets(r["text"], 4) for r in df.collect()]
    assert 0 < counts[0] < sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(of) for b in of[:i])


def test_odd_rows(odd, empty):
    got = nd.near_duplicates(odd, 4).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (1, 3, True)
    assert by[4][1:] == (4, True) and by[5][1:] == (4, False)
    assert by[None] == (2, None, True)
    assert nd.near_duplicates(empty).count() == 0
    out = nd.without_near_copies(odd, 4)
    assert out.columns == odd.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 2, 3, 4, 6, 7, 8, None]
    assert nd.without_near_copies(empty).count() == 0


def test_rows_that_share_ids_or_lack_them(spark):
    """Rows with one doc_id and other texts keep their own sets; rows without a doc_id take part."""
    t = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    near_a = t["a"].replace("a59", "x")
    rows = [(5, t["a"]), (5, t["b"]), (9, near_a), (7, t["b"]), (None, t["c"]), (None, t["c"]), (None, t["d"]), (8, t["d"]), (8, t["d"]), (6, None), (None, "")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()), key=str)
    want = [(5, 57, 5, True), (5, 57, 5, True), (9, 57, 5, False), (7, 57, 5, False), (None, 57, None, True), (None, 57, None, True), (None, 57, 8, False), (8, 57, 8, True), (8, 57, 8, True), (6, 0, 6, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    left = sorted(((r["doc_id"], r["text"], r["row"]) for r in nd.without_near_copies(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")).collect()), key=str)
    assert left == sorted([(5, t["a"], "x"), (5, t["b"], "x"), (None, t["c"], "x"), (8, t["d"], "x"), (6, None, "x"), (None, "", "x")], key=str)


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(20):
            pool = rng.integers(0, 2**63, 1400, dtype=np.uint64)
            common = pool[: int(700 * share)]
            a, b = (np.unique(np.concatenate([common, pool[700 * k : 700 * k + 700 - len(common)]])) for k in (0, 1))
            b = np.unique(np.concatenate([common, pool[700 : 1400 - len(common)]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            r = nd.registers([a, b])
            est, _ = nd.jaccard(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))
            errors.append(est[0] - true)
        assert abs(np.mean(errors)) < 0.03


def test_tiles_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    """Members of one group in as many components: every pair stands in a tile, and a member is sent to few tiles."""
    monkeypatch.setattr(nd, "TILE", 4)
    regs = np.random.default_rng(3).integers(1, 2000, nd.BUCKETS).astype(np.uint16)
    band = int(nd.band_keys(regs[None])[0][0, 0].astype(np.int64))
    n = 144
    reps = spark.createDataFrame([(i, bytearray(regs.tobytes()), 50) for i in range(n)], "rep long, regs binary, n_shingles long")
    members = spark.createDataFrame([(band, i, i, n) for i in range(n)], "band long, rep long, comp long, size long")
    rows = nd._tiles(members, reps, 0.8).collect()
    pairs = [(r["rep"], x) for r in rows for x in r["others"]]
    assert len(pairs) == len(set(pairs)) == n * (n - 1) // 2
    assert len({(r["i"], r["j"]) for r in rows}) <= n
