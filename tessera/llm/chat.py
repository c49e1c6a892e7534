"""Chat transcripts: roles by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines. A hidden state is a role together with
whether the line begins a turn. A line shows a speaker marker ("User:", "A:"),
whether its source row begins with it, how long it is, and how it starts and
ends; given the state these are independent. Start, step and emission chances
are counted by Spark on labelled transcripts and smoothed.

Decoding takes each line's state from the best path through it. Lines of a
conversation are cut into blocks; a block is reduced to the best score between
each of its entry and exit states, blocks are chained by those small tables, and
each block is then decoded by itself, given the best way to reach and to leave
it. So a conversation that holds a third of all rows is decoded by many tasks,
and the result does not hang on where the blocks are cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.llm.scan import record

ROLES = ("system", "user", "assistant")
STATES = tuple((role, opens) for role in ROLES for opens in (True, False))
#: Words before a colon at a line's start that name a speaker, by role. Fixed values.
MARKERS = (("system", "system|instructions?"), ("user", "user|human|question|q|prompter"), ("assistant", "assistant|ai|bot|answer|a|model"))
FEATURES = ("marker", "row", "size", "start", "end")
#: Turns of one block; a block's lines are ordered by (turn, line).
BLOCK_TURNS = 64
SMOOTH = 0.5


def lines(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, n, line, role, observed features): every line of every row, numbered within its row."""
    role = F.lower(F.trim("role")) if "role" in conversations.columns else F.lit(None).cast("string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    marker = F.lit("none")
    for name, words in MARKERS:
        marker = F.when(F.col("line").rlike(rf"(?i)^\s*[\[<*#]*\s*({words})\s*[\]>*]*\s*:"), name).otherwise(marker)
    size = F.least(F.floor(F.log2(F.length("line") + 1)), F.lit(10)).cast("int")
    start = F.when(F.col("line").rlike(r"^\s*$"), "blank").when(F.col("line").rlike(r"^\s*([-*+]|\d+[.)])\s"), "list").when(F.col("line").rlike(r"^(```|    |\t)"), "code").otherwise("text")
    end = F.when(F.col("line").rlike(r"[?？]\s*$"), "ask").when(F.col("line").rlike(r"[:]\s*$"), "colon").otherwise("other")
    return rows.select("conv_id", "turn", "n", "line", "role", marker.alias("marker"), F.when(F.col("n") == 0, "first").otherwise("later").alias("row"), size.cast("string").alias("size"), start.alias("start"), end.alias("end"))


@dataclass
class Model:
    """Log chances: start (states), step (states, states), and of each feature's values (states)."""

    start: np.ndarray
    step: np.ndarray
    emit: dict[str, dict[str, np.ndarray]]
    unseen: dict[str, np.ndarray]

    def scores(self, observed: Sequence[Sequence[str]]) -> np.ndarray:
        """(lines, states) emission scores."""
        out = np.zeros((len(observed[0]), len(STATES)))
        for f, values in zip(FEATURES, observed, strict=True):
            out += np.array([self.emit[f].get(v, self.unseen[f]) for v in values])
        return out


def fit(rows: DataFrame) -> Model:
    """Counts of labelled lines (rows of :func:`lines` with a known role); conversations are read in order."""
    known = rows.where(F.col("role").isin(*ROLES))
    state = F.concat_ws("/", "role", F.col("n") == 0)
    known = known.withColumn("state", state)
    number = {f"{role}/{str(opens).lower()}": k for k, (role, opens) in enumerate(STATES)}
    size = len(STATES)
    start, step = np.full(size, SMOOTH), np.full((size, size), SMOOTH)
    # steps inside a row are counted from its number of lines, those between rows from successive rows
    inside = known.groupBy("conv_id", "turn", "role").agg(F.max("n").alias("last"))
    order = "partition by conv_id order by turn, role"
    between = inside.selectExpr("role", "last", f"lead(role) over ({order}) as next", f"lag(role) over ({order}) as before")
    for r in between.groupBy("role", "next", (F.col("last") == 0).alias("single"), F.col("before").isNull().alias("first")).agg(F.count("*").alias("rows"), F.sum("last").alias("later")).collect():
        opens, later = number[f"{r['role']}/true"], number[f"{r['role']}/false"]
        if r["first"]:
            start[opens] += r["rows"]
        if not r["single"]:
            step[opens, later] += r["rows"]
            step[later, later] += r["later"] - r["rows"]
        if r["next"] is not None:
            step[opens if r["single"] else later, number[f"{r['next']}/true"]] += r["rows"]
    emit: dict[str, dict[str, np.ndarray]] = {}
    unseen = {}
    for f in FEATURES:  # a handful of values each
        n: dict[str, np.ndarray] = {}
        for r in known.groupBy("state", f).agg(F.count("*").alias("c")).collect():
            n.setdefault(r[f], np.zeros(size))[number[r["state"]]] += r["c"]
        total = sum(n.values(), np.zeros(size)) + SMOOTH * (len(n) + 1)
        emit[f] = {v: np.log((c + SMOOTH) / total) for v, c in n.items()}
        unseen[f] = np.log(SMOOTH / total)
    return Model(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), emit, unseen)


def through(model: Model, scores: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """(lines, states): best score of a path up to each line and state; ``entry`` holds the first line's, its own emission excluded."""
    out = np.empty_like(scores)
    best = entry
    for i in range(len(scores)):
        out[i] = best + scores[i]
        best = (out[i][:, None] + model.step).max(0)
    return out


def onward(model: Model, scores: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """(lines, states): best score of what follows each line and state; ``leave`` holds that of the last line."""
    out = np.empty_like(scores)
    best = leave
    for i in range(len(scores) - 1, -1, -1):
        out[i] = best
        best = (model.step + (scores[i] + out[i])[None, :]).max(1)
    return out


def decode(model: Model, scores: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """State of each line on the best path through it (the smallest of equals, within rounding)."""
    total = through(model, scores, entry) + onward(model, scores, leave)
    return (total >= total.max(1, keepdims=True) - 1e-7).argmax(1)


LINE = ("conv_id", "block", "turn", "n", *FEATURES, "line")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one (conv_id, block) at a time, from rows in that order."""
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and r[:2] != held[0][:2]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def recover(rows: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn, n, line, role, opens): the role of every line, and whether it begins a turn."""
    size = len(STATES)
    held = rows.sparkSession.sparkContext.broadcast(model)
    ordered = rows.withColumn("block", F.expr(f"floor(turn / {BLOCK_TURNS})")).select(*LINE)
    ordered = ordered.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "n", "line")
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("best", pa.list_(pa.float64()))])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for run in _runs(batches):
            scores = m.scores([[r[4 + k] for r in run] for k in range(len(FEATURES))])
            best = np.full((size, size), -np.inf)
            for s in range(size):
                entry = np.full(size, -np.inf)
                entry[s] = 0
                best[s] = through(m, scores, entry)[-1]
            yield record(schema, conv_id=[run[0][0]], block=[run[0][1]], best=[best.ravel().tolist()])

    tables = ordered.mapInArrow(reduce, "conv_id long, block long, best array<double>")

    def chain(table: pa.Table) -> pa.Table:
        m = held.value
        order = np.argsort(table.column("block").to_numpy())
        best = [np.array(table.column("best")[int(k)].as_py()).reshape(size, size) for k in order]
        entry, leave = [m.start], [np.zeros(size)]
        for b in best[:-1]:
            at_end = (entry[-1][:, None] + b).max(0)
            entry.append((at_end[:, None] + m.step).max(0))
        for b in best[:0:-1]:
            leave.append((m.step + (b + leave[-1][None, :]).max(1)[None, :]).max(1))
        return pa.table({"conv_id": table.column("conv_id").take(pa.array(order)), "block": table.column("block").take(pa.array(order)), "entry": pa.array([x.tolist() for x in entry]), "leave": pa.array([x.tolist() for x in reversed(leave)])})

    ends = cut(tables.groupBy("conv_id").applyInArrow(chain, "conv_id long, block long, entry array<double>, leave array<double>"), "ends")
    out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("n", pa.int32()), ("line", pa.string()), ("role", pa.string()), ("opens", pa.bool_())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for run in _runs(batches):
            scores = m.scores([[r[4 + k] for r in run] for k in range(len(FEATURES))])
            state = [STATES[s] for s in decode(m, scores, np.array(run[0][-2]), np.array(run[0][-1]))]
            yield record(out, conv_id=[r[0] for r in run], turn=[r[2] for r in run], n=[r[3] for r in run], line=[r[4 + len(FEATURES)] for r in run], role=[s[0] for s in state], opens=[s[1] for s in state])

    joined = ordered.join(ends.withColumnsRenamed({"conv_id": "_c", "block": "_b"}), F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b")))
    joined = joined.select(*LINE, "entry", "leave").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "n", "line")
    return joined.mapInArrow(settle, "conv_id long, turn long, n int, line string, role string, opens boolean")


def format_chats(conversations: DataFrame, learn: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, n_lines, rendered): recovered turns in canonical form.

    A turn begins at a line that opens one or changes the role, and is named by
    the row (``turn``) of its first line; lines that follow in later rows join
    it. Its speaker marker is dropped, and it is rendered as
    ``<|role|>\\n<text>\\n<|end|>``. The model learns from rows with a known
    role for which ``learn`` (a condition on conv_id) holds.

    Null text is one empty line. Null conv_ids make one conversation and null
    turns come first in theirs; rows with equal conv_id and turn are read
    one after the other by line number. Roles other than system, user and
    assistant teach nothing. Without labels all roles are equally likely. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = lines(conversations)
    rows = rows.withColumn("turn", F.coalesce("turn", F.lit(-1).cast("long")))
    model = fit(rows.where(learn) if learn is not None else rows)
    found = recover(rows, model)
    by = "partition by conv_id order by turn, n, line"
    found = found.selectExpr("*", f"lag(role) over ({by}) as before")
    found = found.selectExpr("*", f"sum(cast(opens or before is null or before <> role as int)) over ({by} rows unbounded preceding) as k")
    words = "|".join(w for _, w in MARKERS)
    bare = F.when(F.col("first"), F.regexp_replace("line", rf"(?i)^\s*[\[<*#]*\s*({words})\s*[\]>*]*\s*:\s*", "")).otherwise(F.col("line"))
    found = found.selectExpr("*", "row_number() over (partition by conv_id, k order by turn, n, line) = 1 as first").withColumn("bare", bare)
    said = F.array_sort(F.collect_list(F.struct("turn", "n", "bare")))
    turns = found.groupBy("conv_id", "k").agg(F.min("turn").alias("turn"), F.first("role").alias("role"), F.count("*").alias("n_lines"), said.alias("said"))
    body = F.array_join(F.col("said.bare"), "\n")
    return turns.select("conv_id", "turn", "role", "n_lines", F.concat(F.lit("<|"), "role", F.lit("|>\n"), body, F.lit("\n<|end|>")).alias("rendered"))
