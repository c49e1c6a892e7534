import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string"


def brute(doc, text, seed=42):
    text = text or ""
    t = TOKEN.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, len(t), "plain", None, None, text
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc, len(t), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def strange(rng, n):
    return "".join(rng.choice(["a", "é", "漢", "😀", " ", "\n", "\t", "<", "<P", "<S", ">", "P", "M>", "\x00", " ", "\x85"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [(rng.randint(0, 10**6), strange(rng, rng.choice([0, 1, 3, 63, 64, 65, 200, 900]))) for _ in range(400)] + [(None, "a b c"), (None, None), (1, None), (2, "   "), (3, "<P>"), (5, "a<M> b"), (6, "x" * 500)]


@pytest.mark.parametrize("piece", [fim.PIECE, 100])
def test_every_form_against_brute_force(spark, texts, piece):
    """The same rows come from whole texts and from texts dealt out in pieces."""
    df = spark.createDataFrame([*texts, *texts[:20]], COLUMNS)
    got = sorted((tuple(r) for r in fim.fill_in_middle(df, piece=piece).collect()), key=str)
    assert got == sorted((brute(*r) for r in [*texts, *texts[:20]]), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_text_is_restored(spark, docs):
    made = fim.fill_in_middle(docs, plain=100)
    back = made.select("doc_id", fim.restored(made["output"], made["form"]).alias("text"))
    want = docs.selectExpr("doc_id", "coalesce(text, '') as text")
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0


def test_odd_rows(odd, empty):
    got = sorted((tuple(r) for r in fim.fill_in_middle(odd.selectExpr("*", "1 as n", "2 as form", "3 as `a.b`")).collect()), key=str)
    assert got == sorted((brute(r["doc_id"], r["text"]) for r in odd.collect()), key=str)
    assert fim.fill_in_middle(empty).count() == 0


def test_functions_compose():
    """Cutting a text anywhere and composing the parts' functions gives the function of the whole, from every state."""
    rng = random.Random(7)
    for _ in range(60):
        text = strange(rng, rng.randint(1, 300)).encode()
        at = rng.randint(0, len(text))
        whole, parts = fim.Scan([text]), fim.Scan([text[:at], text[at:]])
        for s in range(fim.STATES):
            between = int(parts.function[0, s])
            assert whole.function[0, s] == parts.function[1, between]
            assert whole.closed[0, s] == parts.closed[0, s] + parts.closed[1, between]
            assert whole.marks[0, s] == parts.marks[0, s] + parts.marks[1, between]
        n = int(whole.closed[0, 0])
        ends = [m.end() for m in TOKEN.finditer(text.decode("latin-1").replace("\x85", "x").replace("\xa0", "x"))][:n]
        assert fim.Scan([b"lead ", text]).ends(np.full(n, 1), np.arange(1, n + 1)).tolist() == ends
