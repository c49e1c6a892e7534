import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.llm import chat, licences, perplexity, quality, toxicity
from tessera.llm.labelled import remainder, training_labels
from tessera.llm.stats import Stats

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def larger(spark):
    """The next larger tables: the smallest hold too few labels to learn from."""
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_remainder_is_of_the_id_as_text(spark):
    import zlib

    ids = [0, 7, 123456]
    got = {r["i"]: r["m"] for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", remainder(F.col("i"), 5).alias("m")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in ids}


def test_quality_on_held_out_rows(larger):
    docs, labels = larger
    rows = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97


def test_toxicity_on_held_out_rows(larger):
    docs, labels = larger
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y = np.array([r["toxic"] for r in rows])
    p = np.array([r["predicted"] for r in rows])
    assert (p[y == 1] == 1).mean() > 0.6
    assert (p[y == 0] == 0).mean() > 0.97


def test_trees_walk_as_they_grew():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = (x[:, 1] + x[:, 3] > 0).astype(int)
    trees = quality.grow(x, y, np.ones(600))
    one = np.full(len(x), trees.base)
    for f, t, leaf in zip(trees.feature, trees.limit, trees.leaf, strict=True):
        for i, row in enumerate(x):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            one[i] += leaf[node - len(f)]
    assert np.allclose(trees.score(x), 1 / (1 + np.exp(-one)))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


def test_pooling_against_loops():
    rng = np.random.default_rng(1)
    net = toxicity.Net.new(50, 3)
    net.bias = [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    sizes = [0, 1, 2, 7]
    slots = rng.integers(0, 50, (sum(sizes), 2)).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(sizes)])
    got, _ = net.pooled(slots, first, net.responses())
    for d, n in enumerate(sizes):
        words = net.table[slots[first[d] : first[d + 1]]].sum(1) if n else np.zeros((0, toxicity.DIM))
        want = []
        for f, b in zip(net.filters, net.bias, strict=True):
            act = [sum((words[i + j] @ f[j] for j in range(len(f)) if i + j < n), b) for i in range(n)]
            want.append(np.maximum(np.max(act, 0), 0) if n else np.zeros(toxicity.FILTERS))
        assert np.allclose(got[d], np.concatenate(want), atol=1e-4)


@pytest.mark.parametrize("fit", ["none", "one kind"])
def test_classifiers_take_odd_rows(spark, odd, empty, fit):
    labels = spark.createDataFrame([] if fit == "none" else [(4, 1, 0), (8, 1, 0), (None, 0, 1), (3, None, None), (3, 1, 0), (3, 1, 0)], LABELS)
    for f in (quality.quality, toxicity.toxicity):
        rows = f(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert f(empty, labels).count() == 0


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_rules_and_bands(docs, odd, empty):
    for df in (docs, odd):
        rows = perplexity.quality_rules(df).collect()
        text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        assert len(rows) == df.count()
        for r in rows:
            want = counts(text[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["kept"] and r["base_failed"])
    assert perplexity.quality_rules(empty).count() == 0


def test_language_model_is_a_distribution(spark, docs):
    model = perplexity.kneser_ney(perplexity.counts(docs))
    for context in (b" ", b" th", b" xq", b"zzzz", b"ions"):
        last = np.arange(256, dtype=np.uint64)
        key = np.zeros(256, np.uint64)
        for b in context:
            key = (key << np.uint64(8)) | np.uint64(b)
        key = (key << np.uint64(8)) | last
        order = np.full(256, min(len(context) + 1, perplexity.ORDER))
        assert abs(np.exp(model.score(key, order)).sum() - 1) < 2e-2


def test_ngram_counts_against_loops(spark):
    rows = ["the thé", None, "", "The  the"]
    got = {(r["order"], r["key"]): r["c"] for r in perplexity.counts(spark.createDataFrame([(t,) for t in rows], "text string")).collect()}
    want = {}
    for t in rows:
        for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()):
            p = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in w) + b" "
            for i in range(1, len(p)):
                g = p[max(0, i - 4) : i + 1]
                k = (len(g), int.from_bytes(g, "big"))
                want[k] = want.get(k, 0) + 1
    assert got == want


def test_licences(spark, odd, empty):
    rows = [(1, licences.MIT), (2, "Copyright (c) 2020 Foo\n" + licences.MIT.replace("sublicense", "Sublicence").replace(",", ";")), (3, None), (4, "hi\nReleased under the MIT licence.\n"), (5, licences.MIT + " more")]
    got = {r["doc_id"]: (r["licence_id"], r["notice_ids"], r["n_notices"]) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "", 0), 2: ("MIT", "", 0), 3: (None, "", 0), 4: (None, "MIT", 1), 5: (None, "", 0)}
    assert licences.scan_licences(odd).count() == odd.count()
    assert licences.scan_licences(empty).count() == 0


def test_licences_match_their_sql(spark, docs, sf):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, licences.scan_licences(docs).collect())) == sorted(duck.execute(licences.oracle_sql()).fetchall())


def viterbi(model, scores):
    best, back = model.start + scores[0], []
    for s in scores[1:]:
        step = best[:, None] + model.step
        back.append(step.argmax(0))
        best = step.max(0) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return [chat.STATES[k] for k in path[::-1]]


@pytest.mark.parametrize("block", [64, 1])
def test_roles_against_viterbi(spark, sf, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    rows = chat.lines(spark.read.parquet(f"{sf}/conversations.parquet"))
    model = chat.fit(rows)
    got, lines = {}, {}
    for r in sorted(chat.recover(rows, model).collect(), key=lambda r: (r["conv_id"], r["turn"], r["n"])):
        got.setdefault(r["conv_id"], []).append((r["role"], r["opens"]))
    for r in sorted(rows.collect(), key=lambda r: (r["conv_id"], r["turn"], r["n"])):
        lines.setdefault(r["conv_id"], []).append(r)
    for conv, v in lines.items():
        assert got[conv] == viterbi(model, model.scores([[r[f] for r in v] for f in chat.FEATURES]))


def test_chat_rendering(spark):
    c = "conv_id long, turn long, role string, text string"
    rows = [(k, t, ("user", "assistant")[t % 2], ("User: why?" if t % 2 == 0 else "Assistant: because\nof that")) for k in range(30) for t in range(4)]
    got = chat.format_chats(spark.createDataFrame(rows, c)).where("conv_id = 3").orderBy("turn").collect()
    assert [(r["turn"], r["role"], r["n_lines"]) for r in got] == [(0, "user", 1), (1, "assistant", 2), (2, "user", 1), (3, "assistant", 2)]
    assert got[0]["rendered"] == "<|user|>\nwhy?\n<|end|>" and got[1]["rendered"] == "<|assistant|>\nbecause\nof that\n<|end|>"
    odd = chat.format_chats(spark.createDataFrame([(None, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 5, "narrator", "A: y")], c)).collect()
    assert sum(r["n_lines"] for r in odd) == 4
    assert chat.format_chats(spark.createDataFrame([], c)).count() == 0


def test_stats_of_no_words():
    s = Stats([b"", b"\n \t"])
    assert s.n_words.tolist() == [0, 0] and np.isfinite(s.features()).all()


def test_every_ngram_counts_in_shards(spark, docs, monkeypatch):
    """Rare n-grams keep their probability, and the discounts follow all counts, however small a broadcast table is."""
    text = docs.select("doc_id", "lang", "text").limit(40)
    raw = cut(perplexity.counts(text), "raw")
    model = perplexity.kneser_ney(raw)
    monkeypatch.setattr(perplexity, "MAX_GRAMS", 300, raising=False)
    monkeypatch.setattr(perplexity, "SHARD_GRAMS", max(300, raw.count() // 3), raising=False)
    got = {r["doc_id"]: r["log_perplexity"] for r in perplexity.quality_rules(text).collect()}
    for r in text.collect():
        s = Stats([(r["text"] or "").encode()])
        if not len(s.word_hash):
            assert got[r["doc_id"]] is None
            continue
        key, order = perplexity.grams(*perplexity.padded_words(s, np.arange(len(s.word_hash))))
        assert abs(got[r["doc_id"]] + model.score(key[order > 1], order[order > 1]).mean()) < 1e-5


def test_thresholds_come_from_all_labelled_rows(larger):
    """A small training sample leaves the thresholds to every other labelled row, in their true shares."""
    docs, labels = larger
    model = toxicity.fit(docs, labels, F.lit(True), rows=150)
    sample = sorted(r["doc_id"] for r in training_labels(labels, "toxic", F.lit(True), 150).join(docs.select("doc_id"), "doc_id").collect())
    trained = {d for i, d in enumerate(sample) if i % toxicity.HELD_BACK}
    by_lang = {}
    for r in toxicity.classify(docs, model).join(labels, "doc_id").collect():
        if r["doc_id"] not in trained and r["toxic"] is not None:
            by_lang.setdefault(r["lang"], []).append((r["score"], r["toxic"]))
    want = {}
    for lang, rows in by_lang.items():
        s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        if min((y == 1).sum(), (y == 0).sum()) >= toxicity.LEAST_ROWS:
            f1 = {g: 2 * ((s >= g) & (y == 1)).sum() / max(1, (s >= g).sum() + y.sum()) for g in [*np.linspace(0.05, 0.95, 91), 0.3]}
            want[lang] = min((g for g, f in f1.items() if f >= max(f1.values()) - 1e-12), key=lambda g: abs(g - 0.3))
    assert want and model.by_language == pytest.approx(want)


def test_the_first_split_is_the_best_of_all():
    """The root of the first tree against a search over every feature and cut, by sums over rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    x[:, 3] = rng.integers(0, 4, 300)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 2)).astype(int)
    weight = rng.uniform(0.5, 2, 300)
    trees = quality.grow(x, y, weight)
    p = 1 / (1 + np.exp(-trees.base))
    g, h = weight * (p - y), weight * p * (1 - p)
    best = {}
    for f in range(5):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])).astype(np.float32):
            left = x[:, f] <= c
            if min(h[left].sum(), h[~left].sum()) >= quality.LEAST_WEIGHT:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality.L2) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + quality.L2)
                best[f, float(c)] = gain
    chosen = best[int(trees.feature[0, 0]), float(trees.limit[0, 0])]
    assert chosen >= max(best.values()) - 1e-9
    # a leaf moves the score by the rate times the Newton step of its rows
    node = np.zeros(300, int)
    for _ in range(quality.DEPTH):
        node = 2 * node + 1 + (x[np.arange(300), trees.feature[0, node]] > trees.limit[0, node])
    for k in set(node.tolist()):
        rows = node == k
        assert np.isclose(trees.leaf[0, k - (2**quality.DEPTH - 1)], -quality.RATE * g[rows].sum() / (h[rows].sum() + quality.L2))


def test_thresholds_against_every_choice():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = 200
        y = (rng.random(n) < 0.3).astype(int)
        score = np.clip(0.25 * y + rng.random(n) * 0.7, 0, 1)
        grid = toxicity.threshold_grid(0.3)
        count = np.zeros((len(grid) + 1, 2), int)
        np.add.at(count, (np.searchsorted(grid, score, "right"), y), 1)

        def f1(t, y=y, score=score):
            hit = ((score >= t) & (y == 1)).sum()
            return 2 * hit / max(1, (score >= t).sum() + y.sum())

        got = toxicity.best_threshold(count, 0.3)
        assert f1(got) >= max(f1(t) for t in grid) - 1e-9
        assert all(abs(got - 0.3) <= abs(t - 0.3) + 1e-12 for t in grid if f1(t) >= f1(got) - 1e-12)
    assert toxicity.best_threshold(np.array([[30, 5], [0, 0]]), 0.3) is None


def kneser_ney_by_loops(texts, order=5):
    """Interpolated modified Kneser-Ney over the padded bytes of words, from dictionaries."""
    padded = [b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in w) + b" " for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]
    c = {n: {} for n in range(1, order + 1)}
    for p in padded:
        for i in range(1, len(p)):
            g = p[max(0, i - order + 1) : i + 1]
            c[len(g)][g] = c[len(g)].get(g, 0) + 1
    for n in range(order - 1, 0, -1):  # how many different bytes stand before; beginnings of words keep their counts
        for g in c[n + 1]:
            c[n][g[1:]] = c[n].get(g[1:], 0) + 1
    prob = {0: {}}
    for n in range(1, order + 1):
        of = [sum(v == k for v in c[n].values()) for k in (1, 2, 3, 4)]
        if of[0] and of[1] and of[2]:
            y = of[0] / (of[0] + 2 * of[1])
            d = [min(max(v, 0.05), top) for v, top in zip((1 - 2 * y * of[1] / of[0], 2 - 3 * y * of[2] / of[1], 3 - 4 * y * of[3] / of[2]), (0.95, 1.9, 2.9), strict=True)]
        else:
            d = [0.5, 0.75, 0.9]
        total, left = {}, {}
        for g, v in c[n].items():
            total[g[:-1]] = total.get(g[:-1], 0) + v
            left[g[:-1]] = left.get(g[:-1], 0.0) + max(v - d[min(v, 3) - 1], 0.0)
        prob[n] = {}
        for g, v in c[n].items():
            gamma = max(1 - left[g[:-1]] / total[g[:-1]], 1e-9)
            lower = 1 / 256 if n == 1 else prob[n - 1][g[1:]]
            prob[n][g] = max(v - d[min(v, 3) - 1], 0.0) / total[g[:-1]] + gamma * lower
    return prob


def test_language_model_and_verdict_against_loops(spark):
    rng = np.random.default_rng(8)
    stems = ["lamo", "riva", "tesk", "undo", "the", "Par", "él", "onto"]
    texts = [" ".join(stems[i] + ("" if j else "s") for i, j in zip(rng.integers(0, 8, 70), rng.integers(0, 3, 70), strict=True)) for _ in range(24)]
    texts += [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 9)) for _ in range(70)), "too short"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in perplexity.quality_rules(df).collect()}
    prob = kneser_ney_by_loops(texts)
    logs = []
    for t in texts:
        total = n = 0
        for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode()):
            p = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in w) + b" "
            for i in range(1, len(p)):
                g = p[max(0, i - 4) : i + 1]
                total -= np.log(prob[len(g)][g])
                n += 1
        logs.append(total / n)
    assert all(abs(rows[i]["log_perplexity"] - x) < 1e-5 for i, x in enumerate(logs))
    passed = sorted(x for i, x in enumerate(logs) if not rows[i]["base_failed"])
    quarter = lambda q: passed[int(np.ceil(q * len(passed))) - 1]
    low, high = quarter(0.25), quarter(0.75)
    reach = perplexity.SPREAD * max(high - low, 0.01)
    want = [not rows[i]["base_failed"] and low - reach <= x <= high + reach for i, x in enumerate(logs)]
    assert [rows[i]["kept"] for i in range(len(texts))] == want and want.count(False) == 2
