"""Fill-in-the-middle by a parallel automaton.

The automaton reads bytes. It is outside a word, inside one, or inside one whose
last bytes are ``<`` or ``<P``, ``<S``, ``<M``; leaving a word closes a token, and
a marker's ``>`` counts a marker. Texts are cut into lanes of ``LANE`` bytes, and
all lanes run side by side from every state at once: a lane gives the function
from its entry state to its last state, and for each entry state the tokens that
it closes and the markers. Functions are composed by a scan over the lanes of a
text, which settles every entry state, and running totals then say in which lane
a token ends.

Texts of at most ``PIECE`` bytes are whole in a task. Longer ones are dealt out
as pieces: a piece becomes one function with its counts, functions of one text
are composed in a group of a few numbers a piece, and only the pieces in which a
cut lies are looked at again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.llm.rows import named
from tessera.llm.scan import record, small_batches, text_blocks

LANE = 64
#: Bytes of text beyond which a text is dealt out in pieces, and of one piece.
PIECE = 4 << 20

#: States: outside a word, in a word, after ``<``, after ``<`` and a marker's letter.
STATES = 4
OTHER, SPACE, OPEN, LETTER, CLOSE, PAD = range(6)
KIND = np.zeros(256, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
KIND[ord("<")], KIND[ord(">")], KIND[0xFF] = OPEN, CLOSE, PAD  # no UTF-8 text has the byte 0xFF
KIND[[ord(c) for c in "PSM"]] = LETTER
NEXT = np.array([[1, 1, 1, 1], [0, 0, 0, 0], [2, 2, 2, 2], [1, 1, 3, 1], [1, 1, 1, 1], [0, 1, 2, 3]], np.uint8)
#: Closed tokens, and markers in the high byte.
COUNT = np.zeros((6, STATES), np.uint16)
COUNT[SPACE, 1:] = 1
COUNT[CLOSE, 3] = 1 << 8


def lanes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes' kinds by lane, and the first lane of each text (and the end)."""
    buf = b"".join(t + b"\xff" * (-len(t) % LANE) for t in texts)
    first = np.cumsum([0, *(-(-len(t) // LANE) for t in texts)])
    return KIND[np.frombuffer(buf, np.uint8)].reshape(-1, LANE), first


def run_lanes(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each lane and entry state the last state, the closed tokens and the markers."""
    step, count = NEXT.ravel(), COUNT.ravel()
    state = np.tile(np.arange(STATES, dtype=np.uint8), (len(kinds), 1))
    seen = np.zeros(state.shape, np.uint16)
    offset = np.ascontiguousarray((kinds * STATES).T)
    for column in offset:
        at = column[:, None] + state
        seen += count[at]
        state = step[at]
    return state, (seen & 0xFF).astype(np.int64), (seen >> 8).astype(np.int64)


def composed(state: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Functions of all bytes of a text up to and with each lane, by doubling the stretch that a function spans."""
    out = state.copy()
    place = np.arange(len(state)) - np.repeat(first[:-1], np.diff(first))
    span = 1
    while span <= place.max(initial=0):
        at = np.flatnonzero(place >= span)
        out[at] = np.take_along_axis(out[at], out[at - span], 1)
        span *= 2
    return out


class Scan:
    """Tokens and markers of a block of texts that begin in the given states."""

    def __init__(self, texts: list[bytes], entry: np.ndarray | None = None) -> None:
        self.size = np.array([len(t) for t in texts], np.int64)
        self.kinds, self.first = lanes(texts)
        state, closed, marks = run_lanes(self.kinds)
        whole = composed(state, self.first)
        self.filled = np.flatnonzero(np.diff(self.first))
        last = self.first[1:][self.filled] - 1
        #: for each text and entry state: last state, closed tokens, markers
        self.function = np.tile(np.arange(STATES, dtype=np.uint8), (len(texts), 1))
        self.function[self.filled] = whole[last]
        before = np.empty_like(whole)
        before[1:] = whole[:-1]
        before[self.first[:-1][self.filled]] = np.arange(STATES)
        closed, marks = (np.take_along_axis(x, before.astype(np.int64), 1) for x in (closed, marks))
        self.closed, self.marks = (np.zeros((len(texts), STATES), np.int64) for _ in range(2))
        if len(self.filled):
            self.closed[self.filled] = np.add.reduceat(closed, self.first[:-1][self.filled])
            self.marks[self.filled] = np.add.reduceat(marks, self.first[:-1][self.filled])
        entry = np.zeros(len(texts), np.int64) if entry is None else entry
        of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.entry = before[np.arange(len(before)), entry[of]]
        self.total = np.cumsum(closed[np.arange(len(closed)), entry[of]])

    def ends(self, text: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Byte offset in ``text`` at which its ``nth`` token (from 1) is closed; the token must be closed in it."""
        begin = self.first[text]
        done = np.where(begin > 0, self.total[begin - 1], 0)
        lane = np.searchsorted(self.total, done + nth)
        left = done + nth - np.where(lane > 0, self.total[lane - 1], 0)
        state, out = self.entry[lane], np.full(len(lane), -1, np.int64)
        for j in range(LANE):
            kind = self.kinds[lane, j]
            left = left - (COUNT[kind, state] & 0xFF)
            out[(left == 0) & (out < 0)] = j
            state = NEXT[kind, state]
        return (lane - begin) * LANE + out


def choices(doc_id: int | None, seed: int) -> list[int]:
    """The four numbers that decide a document's cuts and form."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def form_of(h: list[int], n: int, marked: bool, plain: int, spm: int) -> tuple[str, int, int]:
    """Form, and the tokens before the first and the second cut."""
    form = "plain" if not n or marked or h[2] % 100 >= plain else "spm" if h[3] % 100 < spm else "psm"
    return form, *sorted((h[0] % (n + 1), h[1] % (n + 1)))


def arranged(text: bytes, form: str, a: int, b: int) -> bytes:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle
    return b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle


RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _rows(docs: list, texts: list[bytes], n: list[int], forms: list[str], cuts: list[tuple[int, int]]) -> pa.RecordBatch:
    plain = [f == "plain" for f in forms]
    return record(
        RESULT_ARROW, doc_id=docs, n=n, form=forms,
        prefix_chars=[None if p else len(t[:a].decode()) for t, p, (a, _) in zip(texts, plain, cuts, strict=True)],
        middle_chars=[None if p else len(t[a:b].decode()) for t, p, (a, b) in zip(texts, plain, cuts, strict=True)],
        output=[arranged(t, f, a, b).decode() for t, f, (a, b) in zip(texts, forms, cuts, strict=True)],
    )


def _short(rows: DataFrame, seed: int, plain: int, spm: int) -> DataFrame:
    """Texts that one task reads whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            scan = Scan(texts)
            docs = batch.column(0).to_pylist()
            n = scan.closed[:, 0] + (scan.size > 0)
            chosen = [form_of(choices(d, seed), int(k), bool(m), plain, spm) for d, k, m in zip(docs, n, scan.marks[:, 0], strict=True)]
            cuts = np.zeros((len(texts), 2), np.int64)
            for j in (0, 1):
                nth = np.array([c[1 + j] for c in chosen], np.int64)
                cuts[:, j] = np.where(nth == n, scan.size, 0)
                inner = np.flatnonzero((nth > 0) & (nth < n))
                if len(inner):
                    cuts[inner, j] = scan.ends(inner, nth[inner])
            yield _rows(docs, texts, n.tolist(), [c[0] for c in chosen], cuts.tolist())

    return rows.select("doc_id", "text").mapInArrow(run, RESULT)


PART = [("doc", pa.int64()), ("mark", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32())]
PART_SQL = "doc long, mark long, doc_id long, piece int"


def _long(rows: DataFrame, seed: int, plain: int, spm: int, piece: int) -> DataFrame:
    """Texts dealt out in pieces: functions of pieces, their composition, and the cuts in the pieces that hold them."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*PART, ("data", pa.binary())])
        for batch in batches:
            for doc, mark, doc_id, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                data = text.as_py().encode()
                for at in range(0, len(data), piece):
                    yield record(schema, doc=[doc.as_py()], mark=[mark.as_py()], doc_id=[doc_id.as_py()], piece=[at // piece], data=[data[at : at + piece]])

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*PART, ("size", pa.int64()), *[(k, pa.list_(pa.int64())) for k in ("state", "closed", "marks")]])
        for batch, data in text_blocks(batches, "data"):
            scan = Scan(data)
            own = dict(zip(("doc", "mark", "doc_id", "piece"), batch.columns, strict=False))
            yield record(schema, **own, size=scan.size, state=scan.function.astype(np.int64).tolist(), closed=scan.closed.tolist(), marks=scan.marks.tolist())

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece")
        state, closed, marks, size, enter, before, offset = 0, 0, 0, 0, [], [], []
        for f, c, m, s in zip(group["state"], group["closed"], group["marks"], group["size"], strict=True):
            enter.append(state)
            before.append(closed)
            offset.append(size)
            closed, marks, size, state = closed + int(c[state]), marks + int(m[state]), size + int(s), int(f[state])
        n = closed + 1
        doc_id = None if pd.isna(group["doc_id"].iloc[0]) else int(group["doc_id"].iloc[0])
        form, *nth = form_of(choices(doc_id, seed), n, bool(marks), plain, spm)
        out = []
        for k in nth:
            at = len(before) - 1 if k >= n else max(0, int(np.searchsorted(before, k)) - 1)
            known = size if k == n else 0 if k == 0 else -1
            out.append((n, form, int(group["piece"].iloc[at]), enter[at], k - before[at], offset[at], known))
        frame = pd.DataFrame(out, columns=["n", "form", "piece", "entry", "nth", "offset", "known"])
        frame.insert(0, "mark", group["mark"].iloc[0])
        frame.insert(0, "doc", group["doc"].iloc[0])
        frame["which"] = [0, 1]
        return frame

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("which", pa.int32()), ("at", pa.int64())])
        for batch, data in text_blocks(batches, "data"):
            col = {f: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema.names) if f != "data"}
            scan = Scan(data, col["entry"].astype(np.int64))
            at = scan.ends(np.arange(len(data)), col["nth"].astype(np.int64)) + col["offset"]
            yield record(schema, doc=col["doc"], mark=col["mark"], which=col["which"], at=at)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc, text, n, form, cuts = (batch.column(k)[r].as_py() for k in range(5))
                yield _rows([doc], [text.encode()], [n], [form], [tuple(cuts)])

    once = rows.select("doc", "mark", "doc_id", "text").dropDuplicates(["doc", "mark"])
    pieces = cut(once.mapInArrow(split, PART_SQL + ", data binary").repartition("doc", "mark", "piece"), "pieces")
    summary = pieces.mapInArrow(functions, PART_SQL + ", size long, state array<long>, closed array<long>, marks array<long>")
    wanted = cut(summary.groupBy("doc", "mark").applyInPandas(compose, "doc long, mark long, n long, form string, piece int, entry long, nth long, offset long, known long, which int"), "cuts")
    inner = pieces.select("doc", "mark", "piece", "data").join(wanted.where("known < 0 and form <> 'plain'"), ["doc", "mark", "piece"])
    found = inner.select("doc", "mark", "which", "entry", "nth", "offset", "data").mapInArrow(locate, "doc long, mark long, which int, at long")
    at = wanted.join(found, ["doc", "mark", "which"], "left").select("doc", "mark", "n", "form", "which", F.coalesce("at", F.greatest("known", F.lit(0))).alias("at"))
    both = at.groupBy("doc", "mark").agg(F.first("n").alias("n"), F.first("form").alias("form"), F.array_sort(F.collect_list("at")).alias("cuts"))
    return rows.join(both, ["doc", "mark"]).select("doc_id", "text", "n", "form", "cuts").mapInArrow(write, RESULT)


def fill_in_middle(docs: DataFrame, seed: int = 42, plain: int = 50, spm: int = 80, piece: int = PIECE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    A text of ``n`` tokens (a run of non-space characters with the space before
    it, or space at the end) is cut after two numbers of tokens that the doc_id's
    digest gives. ``plain`` in a hundred documents are rearranged, and of these
    ``spm`` in a hundred with the suffix first; a text that is empty or holds a
    marker stays as it is, and then prefix_chars and middle_chars are null.

    A null text is the empty one, and a null doc_id is digested as no digits.
    Rows of one doc_id are cut each by its own number of tokens, repeated rows
    alike. Other columns are ignored; an empty table gives no rows.
    """
    rows = small_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    length = F.octet_length("text")
    short = _short(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(length <= piece), seed, plain, spm)
    long = rows.where(length > piece)
    if long.isEmpty():
        return short
    return short.unionByName(_long(named(long), seed, plain, spm, piece))


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged, from ``output`` and ``form``."""
    def after(text: Column, first: Column, marker: str) -> Column:
        return F.substring(text, F.length(first) + F.length(F.lit(marker)) + 1, F.length(text))

    body = F.substring(output, F.lit(4), F.length(output))
    second, third = ("<S>", "<M>"), ("<P>", "<M>")
    parts = {}
    for name, (x, y) in {"psm": second, "spm": third}.items():
        one = F.substring_index(body, x, 1)
        rest = after(body, one, x)
        two = F.substring_index(rest, y, 1)
        parts[name] = (one, two, after(rest, two, y))
    prefix, suffix, middle = parts["psm"]
    suffix2, prefix2, middle2 = parts["spm"]
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix2, middle2, suffix2))


def oracle_sql() -> str:
    """The rows of op13 over ``documents``, in DuckDB SQL."""
    return r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT *, len(w) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(w) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(w) + 1) AS y,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(list_slice(w, 1, least(x, y)), '') AS pre, array_to_string(list_slice(w, least(x, y) + 1, greatest(x, y)), '') AS mid, array_to_string(list_slice(w, greatest(x, y) + 1, n), '') AS suf FROM u)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
