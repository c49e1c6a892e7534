import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm.packing import Plan, best_fit, dominating_sets, pack  # noqa: E402
from tessera.llm.tokens import Encoder  # noqa: E402

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def whole(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_and_whole_texts_give_the_same_ids(path):
    rng = random.Random(4)
    bits = ["a", "The", "x'", "'s", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "É", "́", "12", "!", "...", ",", ".", "_", "\x01", " ", "　", "ς", "漢字", "😀", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(500)]
    assert Encoder(path).encode([t.encode() for t in texts]) == whole(path, texts)


def least_bins(sizes, capacity):
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                rooms[k] -= sizes[i]
                go(i + 1, rooms)
                rooms[k] += sizes[i]
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_fixed_sets_keep_an_optimum():
    rng = random.Random(9)
    for _ in range(150):
        capacity = rng.choice([10, 12, 20])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(sizes, minlength=capacity + 1)
        left = counts.copy()
        fixed = dominating_sets(left, capacity)
        rest = [w for w in range(capacity, 0, -1) for _ in range(left[w])]
        assert sum(t for _, t in fixed) + (least_bins(rest, capacity) if rest else 0) == least_bins(sizes, capacity)


def test_plan_places_every_piece_once_without_gaps():
    rng = np.random.default_rng(1)
    for capacity, n in ((8, 0), (10, 50), (64, 300), (1024, 500)):
        sizes = rng.integers(1, capacity + 1, n)
        plan = Plan(np.bincount(sizes, minlength=capacity + 1), capacity)
        rank = np.array([(sizes[:i] == w).sum() for i, w in enumerate(sizes)], np.int64)
        where, offset = plan.place(sizes.astype(np.int64), rank) if n else (rank, rank)
        for s in set(where.tolist()):
            at = 0
            for o, w in sorted(zip(offset[where == s], sizes[where == s], strict=True)):
                assert o == at
                at += w
            assert at <= capacity
        assert len(set(where.tolist())) == plan.sequences
        alone = np.bincount(sizes, minlength=capacity + 1)
        assert plan.sequences <= sum(t for _, t in best_fit(alone, capacity)) + 1


def check(rows, docs, capacity):
    texts = [r["text"] or "" for r in docs]
    ids = [x + (2).to_bytes(4, "little") for x in whole(BYTES, texts)]
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, zlib.crc32(x), len(x) // 4) for r, x in zip(docs, ids, strict=True))
    bins, size = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] == capacity or r["piece"] == 0
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["length"]
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    for known in {w[1] for w in want if not w[0]}:
        assert size[known] == sum(w[3] for w in want if not w[0] and w[1] == known)
    crc = {}
    for r, x in zip(docs, ids, strict=True):
        n = len(x) // 4
        first = n if n <= capacity else n % capacity or capacity
        cuts = [0, *range(first, n, capacity), n]
        for s, e in zip(cuts, cuts[1:], strict=False):
            crc[r["doc_id"], s] = zlib.crc32(x[4 * s : 4 * e])
    assert all(crc[r["doc_id"], r["start"]] == r["ids_crc32"] for r in rows)
    return len(bins)


def test_pack_documents(docs):
    total = check(pack(docs, BYTES).collect(), docs.collect(), 1024)
    tokens = sum(len(x) // 4 + 1 for x in whole(BYTES, [r["text"] or "" for r in docs.collect()]))
    assert total <= -(-tokens // 1024) * 1.02 + 2


def test_pack_odd_rows(odd, empty):
    check(pack(odd, BYTES).collect(), odd.collect(), 1024)
    assert pack(empty, BYTES).count() == 0
