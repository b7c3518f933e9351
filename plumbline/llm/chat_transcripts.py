"""Chat formatting: transcripts become turns with roles, by a hidden Markov model and Viterbi.

A transcript is a sequence of lines. The model's states are a role and whether the line begins a turn or goes on with
it; a line's observations are its marker (a speaker name before a colon, a markdown heading or a tag, looked up in
MARKERS; or none), its length class, and its closing sign. Start, transition and emission probabilities are smoothed
counts over labelled conversations (all rows, summed by Spark); nothing is sampled.

Viterbi runs over conversations of any length without gathering one in a task: rows are dealt into blocks of SPAN turns.
The many conversations of one block are decoded as they are. For the others each block gives its best score from every
state before it to every state at its end (a matrix under (max, +)), the matrices of a conversation are folded, in two
levels, into the scores before and after every block, and each block then traces its own part of the best path.

Turns are rendered canonically: ``<|im_start|>role\\n``, the lines of the turn without its marker, ``<|im_end|>``. A turn
that runs over several blocks is one turn: the pieces that go on with it are added to the block where it begins. Inside a
turn ``<|im_`` is written ``<\\|im_``, so no text forges a turn. When rows are written as transcripts, a line of a text that
begins like a marker, or with a backslash, gets a backslash, which rendering takes off: such lines stay in their turn.

Defined cases: a null text is an empty line; roles are lower-cased, trimmed and mapped by ROLES, unknown or null roles
are not learnt from, and their turns carry no marker; rows that repeat in every column count
once, others of one turn are ordered by text; a null conv_id is a conversation and a null turn comes first; with no labelled rows the model is uniform, so markers alone decide; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import clashing, cut, longs

#: Turns of a block, rows of a crowded one, blocks folded at once.
SPAN, CROWD, GROUP = 1024, 4096, 1024
STATES = [(r, b) for r in ("system", "user", "assistant") for b in (True, False)]
ROLES = {"system": "system", "developer": "system", "user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "gpt": "assistant"}
#: Speaker names as transcripts write them.
MARKERS = {"system": "system", "instructions": "system", "user": "user", "human": "user", "question": "user", "q": "user", "prompter": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "chatbot": "assistant", "answer": "assistant", "a": "assistant", "response": "assistant", "model": "assistant"}
#: How transcripts mark the speaker of a turn's first line.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "Instructions: ", "user": "Human: ", "assistant": "AI: "},
    {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "},
    {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "},
)
_MARK = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?\s*([A-Za-z]{1,12})\s*(?:\*\*)?\s*(?::(?:\*\*)?|\|?>|\])(?:\s+|$)")
_KINDS = ("none", "system", "user", "assistant")
SYMBOLS = len(_KINDS) * 4 * 3


def marker(line: str) -> tuple[str, str]:
    """Role that a line's marker names ("none" without one) and the line without it."""
    found = _MARK.match(line)
    role = MARKERS.get(found[1].lower()) if found else None
    return (role, line[found.end() :]) if role else ("none", line)


def symbol(line: str) -> int:
    """A line's observation as one number."""
    role, body = marker(line)
    body = body.strip()
    size = 0 if not body else 1 if len(body) < 80 else 2 if len(body) < 240 else 3
    close = 1 if body.endswith("?") else 2 if body.endswith((".", "!", ":")) else 0
    return (_KINDS.index(role) * 4 + size) * 3 + close


class Model:
    """Log probabilities: start (S), move (S x S), emit (S x SYMBOLS)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        allowed = np.array([[(r == q and not b) or b for q, b in STATES] for r, _ in STATES])
        begins = np.array([b for _, b in STATES])
        with np.errstate(divide="ignore"):
            self.start = np.log((start + 0.5) * begins / ((start + 0.5) * begins).sum())
            move = (move + 0.5) * allowed
            self.move = np.log(move / move.sum(1, keepdims=True))
            # a marker on a line that goes on, or of another role, is rare whatever the counts
            kind = np.arange(SYMBOLS) // 12
            own = np.array([[1e-3 if k and (not b or _KINDS[k] != r) else 0.5 for k in kind] for r, b in STATES])
            emit = emit * np.array([[1e-3 if k and (not b or _KINDS[k] != r) else 1.0 for k in kind] for r, b in STATES]) + own
            self.emit = np.log(emit / emit.sum(1, keepdims=True))

    def block(self, seen: np.ndarray, first: bool) -> np.ndarray:
        """Best score from each state before a block to each state at its end; nothing is before the first block."""
        best = _UNIT
        for i, s in enumerate(seen):
            best = (np.broadcast_to(self.start, best.shape) if first and i == 0 else times(best, self.move)) + self.emit[:, s]
        return best

    def path(self, before: np.ndarray, seen: np.ndarray, after: np.ndarray, first: bool) -> list[int]:
        """States of a block, given the scores of the states before it and those of what follows."""
        score, back = before, []
        for i, s in enumerate(seen):
            if first and i == 0:
                back.append(np.zeros(len(STATES), int))
                score = self.start + self.emit[:, s]
                continue
            ways = score[:, None] + self.move
            back.append(ways.argmax(0))
            score = ways.max(0) + self.emit[:, s]
        at, out = int(np.argmax(score + after)), []
        for b in reversed(back):
            out.append(at)
            at = int(b[at])
        return out[::-1]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None]).max(1)


_UNIT = np.where(np.eye(len(STATES)) > 0, 0.0, -np.inf)


def viterbi(model: Model, seen: list[int]) -> list[int]:
    """The whole path in one piece."""
    return model.path(np.zeros(len(STATES)), np.asarray(seen), np.zeros(len(STATES)), True)


def role_of(column: str):
    """The canonical role of a role column, null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    name = F.lower(F.trim(column))
    return F.when(name.isin(list(ROLES)), F.element_at(known, name))


def written(conversations: DataFrame, unmarked: int = 0) -> DataFrame:
    """Rows of conversations as transcript lines: conv_id, turn, role, lines.

    The first line of a row whose role is known carries a speaker marker, in one of four styles by conversation; nothing
    else in the lines tells speakers apart. unmarked: percentage of turns (by hash) that go without. Rows that repeat in
    every column count once.
    """
    c = clashing(conversations, ["conv_id", "turn", "role", "text"])
    c = c.select("conv_id", F.col("turn").cast("long").alias("turn"), role_of("role").alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    pick = F.pmod(F.xxhash64(F.col("conv_id").cast("string")), F.lit(len(STYLES)))
    marks = F.array(*[F.create_map(*[F.lit(x) for r, name in style.items() for x in (r, name)]) for style in STYLES])
    mark = F.when(F.col("role").isNotNull() & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(100)) >= unmarked), F.element_at(F.get(marks, pick), F.coalesce("role", F.lit("user"))))
    alike = rf"(?i)^(?:\\|\W*(?:{'|'.join(MARKERS)})(?:\W|$))"
    kept = F.transform(F.split("text", "\n"), lambda x, i: F.when((i == 0) & F.col("mark").isNotNull(), F.concat("mark", x)).otherwise(F.when(x.rlike(alike), F.concat(F.lit("\\"), x)).otherwise(x)))
    return c.withColumn("mark", mark).select("conv_id", "turn", "role", kept.alias("lines"))


def lines_of(texts: DataFrame) -> DataFrame:
    """texts(conv_id, text), raw transcripts, as lines: a row for each line, turn its number."""
    t = clashing(texts, ["conv_id", "text"])
    at = t.select("conv_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("turn", "line"))
    line = F.when(F.startswith("line", F.lit("\\")), F.concat(F.lit("\\"), "line")).otherwise(F.col("line"))
    return at.select("conv_id", F.col("turn").cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.array(line).alias("lines"))


def blocks(rows: DataFrame) -> DataFrame:
    """conv_id, chunk, sub, rows: the rows of a conversation by ranges of SPAN turns; a range with more than CROWD rows
    is split further by ranges of (turn, lines, role), so no block grows with the data and (chunk, sub) keeps the order."""
    chunk = F.floor(F.coalesce("turn", F.lit(-1)) / SPAN)
    rows = rows.withColumn("chunk", chunk)
    full = cut(rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select(F.col("conv_id").alias("cc"), F.col("chunk").alias("ck"), "c"), "chat-crowded")
    crowd = full.agg(F.sum("c")).first()[0]
    placed = rows.withColumn("sub", F.lit(0).cast("long"))
    if crowd:
        key = F.col("conv_id").eqNullSafe(F.col("cc")) & (F.col("chunk") == F.col("ck"))
        dense = rows.join(full, key, "left_semi").repartitionByRange(-(-crowd // CROWD), "conv_id", "chunk", "turn", "lines", "role")
        placed = placed.join(full, key, "left_anti").unionByName(dense.withColumn("sub", F.spark_partition_id().cast("long")))
    return placed.groupBy("conv_id", "chunk", "sub").agg(F.sort_array(F.collect_list(F.struct("turn", "lines", "role"))).alias("rows"))


def train(blocked: DataFrame) -> Model:
    """Counts over the lines of rows whose role is known; every block counts its rows, and Spark sums the counts. Where a
    conversation goes on in another block, the step between the two is a move, not a start."""
    s = len(STATES)
    index = {x: i for i, x in enumerate(STATES)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(s + s * s + s * SYMBOLS)
        start, move, emit = total[:s], total[s : s + s * s].reshape(s, s), total[s + s * s :].reshape(s, SYMBOLS)
        for b in batches:
            for rows in b["rows"]:
                was = None
                for r in rows:
                    if r["role"] is None:
                        was = None
                        continue
                    for i, line in enumerate(r["lines"]):
                        now = index[r["role"], i == 0]
                        emit[now, symbol(line)] += 1
                        if was is not None:
                            move[was, now] += 1
                        elif i == 0:
                            start[now] += 1
                        was = now
        yield pd.DataFrame({"at": np.arange(len(total)), "n": total})

    summed = blocked.select("rows").mapInPandas(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(s + s * s + s * SYMBOLS)
    for r in summed:
        total[r["at"]] = r["n"]
    start, move, emit = total[:s], total[s : s + s * s].reshape(s, s), total[s + s * s :].reshape(s, SYMBOLS)
    ends = blocked.select("conv_id", "chunk", "sub", F.col("rows")[0]["role"].alias("head"), F.element_at("rows", -1).alias("last"))
    ends = ends.select("conv_id", "chunk", "sub", "head", F.struct(F.col("last.role").alias("role"), (F.size("last.lines") == 1).alias("begins")).alias("tail"))
    steps = ends.withColumn("tail", F.lag("tail").over(Window.partitionBy("conv_id").orderBy("chunk", "sub")))
    for r in steps.where("head IS NOT NULL AND tail.role IS NOT NULL").groupBy("head", "tail").count().collect():
        head = index[r["head"], True]
        start[head] -= r["count"]
        move[index[r["tail"]["role"], r["tail"]["begins"]], head] += r["count"]
    return Model(start, move, emit)


def _render(rows, states: list[int]) -> list[tuple]:
    """(place in the block, turn, role, opens, text) of each turn, or part of one that began in an earlier block."""
    out, at = [], 0
    for r in rows:
        for line in r["lines"]:
            role, begins = STATES[states[at]]
            at += 1
            line = line or ""
            mark, body = marker(line)
            if not begins or mark == "none":
                body = line.removeprefix("\\")
            if begins or not out:
                out.append((r["turn"], role, begins, [body]))
            else:
                out[-1][3].append(body)
    return [(i, turn, role, opens, "\n".join(body).replace("<|im_", "<\\|im_")) for i, (turn, role, opens, body) in enumerate(out)]


def _rendered(turns: DataFrame) -> DataFrame:
    text = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>"))
    return turns.select("conv_id", "turn", "role", F.lit(True).alias("opens"), text.alias("rendered"))


def _whole(pieces: DataFrame) -> DataFrame:
    """Turns of pieces(conv_id, chunk, sub, at, turn, role, opens, text), those that run over several blocks put together.
    Which turn a piece goes on with is found in a light row for each block."""
    order = Window.partitionBy("conv_id").orderBy("chunk", "sub").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("chunk", "sub", "at")
    last = pieces.groupBy("conv_id", "chunk", "sub").agg(F.max(F.when(F.col("opens"), place)).alias("last"), F.max(~F.col("opens")).alias("goes_on"))
    to = last.withColumn("to", F.last("last", ignorenulls=True).over(order)).where("goes_on").select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.col("sub").alias("s"), "to")
    more = pieces.where(~F.col("opens")).join(to, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")) & (F.col("sub") == F.col("s")))
    more = more.groupBy("c", "to").agg(F.sort_array(F.collect_list(F.struct("chunk", "sub", "text"))).alias("rest"))
    more = more.select("c", "to", F.array_join(F.transform("rest", lambda x: x["text"]), "\n").alias("rest"))
    turns = pieces.where("opens").withColumn("place", place).join(more, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("to")), "left")
    return turns.withColumn("text", F.concat_ws("\n", "text", "rest"))


def parse(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """conv_id, turn, role, opens, rendered of each recovered turn of rows(conv_id, turn, role, lines).

    turn is that of the row in which the recovered turn begins; opens is true. role of rows is only learnt from, and only
    where no model is given.
    """
    # turns as strings, as large ones beside nulls lose bits on the way to pandas, inside a list too
    told = F.transform("rows", lambda r: F.struct(r["turn"].cast("string").alias("turn"), r["lines"].alias("lines"), r["role"].alias("role")))
    blocked = cut(blocks(rows).withColumn("rows", told), "chat-blocks")
    model = model or train(blocked)
    piece = "conv_id long, at int, turn long, role string, opens boolean, text string"
    some = blocked.groupBy("conv_id").agg(F.count("*").alias("of"), F.min(F.struct("chunk", "sub")).alias("first"))
    long = cut(some.where("of > 1").select(F.col("conv_id").alias("lc"), "first"), "chat-long")
    key = F.col("conv_id").eqNullSafe(F.col("lc"))
    neutral = np.zeros(len(STATES))

    def seen(rows) -> np.ndarray:
        return np.array([symbol(line or "") for r in rows for line in r["lines"]], int)

    def frame(conv, rows, states) -> pd.DataFrame:
        out = _render(rows, states)
        columns = {c: [x[i] for x in out] for i, c in ((0, "at"), (2, "role"), (3, "opens"), (4, "text"))}
        return pd.DataFrame({"conv_id": longs([conv] * len(out)), "turn": longs(x[1] for x in out)} | columns)

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [frame(None if conv is None else int(conv), rows, model.path(neutral, seen(rows), neutral, True)) for conv, rows in zip(b["conv_id"], b["rows"], strict=True)]
            if parts:
                yield pd.concat(parts)

    text_key = F.col("conv_id").cast("string").alias("conv_id")
    done = _rendered(blocked.join(long, key, "left_anti").select(text_key, "rows").mapInPandas(short, piece))
    if not long.limit(1).count():
        return done

    # long conversations: a matrix for each block, folded in two levels into the scores before and after every block
    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"conv_id": b["conv_id"], "chunk": b["chunk"], "sub": b["sub"], "m": [model.block(seen(rows), first).tobytes() for rows, first in zip(b["rows"], b["first"], strict=True)]})

    place = ["chunk", "sub"]
    parts = blocked.join(long, key).select(text_key, *place, "rows", (F.struct(*place) == F.col("first")).alias("first"))
    made = cut(parts.mapInPandas(matrices, "conv_id string, chunk long, sub long, m binary"), "chat-matrices")
    made = made.withColumn("top", F.floor(F.col("chunk") / GROUP))
    s = len(STATES)

    def product(b: pd.DataFrame) -> pd.DataFrame:
        b, best = b.sort_values(place), _UNIT
        for m in b["m"]:
            best = times(best, np.frombuffer(m).reshape(s, s))
        return pd.DataFrame({"conv_id": [b["conv_id"].iloc[0]], "top": [b["top"].iloc[0]], "m": [best.tobytes()]})

    def around(by: list[str]):
        """Scores before and after each matrix of a sequence, given those before and after the sequence."""

        def run(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values(by)
            ms = [np.frombuffer(m).reshape(s, s) for m in b["m"]]
            before, after = [np.frombuffer(b["before"].iloc[0])], [np.frombuffer(b["after"].iloc[0])]
            for m in ms[:-1]:
                before.append((before[-1][:, None] + m).max(0))
            for m in reversed(ms[1:]):
                after.append((m + after[-1][None]).max(1))
            return pd.DataFrame({c: b[c] for c in ("conv_id", *by)} | {"before": [x.tobytes() for x in before], "after": [x.tobytes() for x in reversed(after)]})

        return run

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for conv, chunk, sub, rows, first, before, after in zip(*[b[c] for c in ("conv_id", "chunk", "sub", "rows", "first", "before", "after")], strict=True):
                out = frame(None if conv is None else int(conv), rows, model.path(np.frombuffer(before), seen(rows), np.frombuffer(after), first))
                yield out.assign(chunk=chunk, sub=sub)

    tops = made.groupBy("conv_id", "top").applyInPandas(product, "conv_id string, top long, m binary")
    edge = {"before": F.lit(neutral.tobytes()), "after": F.lit(neutral.tobytes())}
    outer = tops.withColumns(edge).groupBy("conv_id").applyInPandas(around(["top"]), "conv_id string, top long, before binary, after binary")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    within = made.join(outer, same(made, outer) & (made["top"] == outer["top"])).select(made["conv_id"], made["top"], "chunk", "sub", "m", "before", "after")
    scores = within.groupBy("conv_id", "top").applyInPandas(around(place), "conv_id string, chunk long, sub long, before binary, after binary")
    both = parts.join(scores, same(parts, scores) & (parts["chunk"] == scores["chunk"]) & (parts["sub"] == scores["sub"]))
    decoded = both.select(parts["conv_id"], parts["chunk"], parts["sub"], "rows", "first", "before", "after").mapInPandas(decode, piece + ", chunk long, sub long")
    return done.unionByName(_rendered(_whole(cut(decoded, "chat-pieces"))))


def format_turns(conversations: DataFrame) -> DataFrame:
    """The table written as transcripts and parsed again: conv_id, turn, role, opens, rendered."""
    return parse(written(conversations))


#: What a perfect recovery renders: every row, by its own role.
SQL = """
SELECT DISTINCT conv_id, turn, role, true AS opens, '<|im_start|>' || role || chr(10) || replace(coalesce(text, ''), '<|im_', '<\\|im_') || '<|im_end|>' AS rendered
FROM conversations
"""
