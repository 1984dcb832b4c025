"""Transcript parsing: a hidden Markov model over line features recovers who speaks, then turns are rendered in one canonical form."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ROLES = ("system", "user", "assistant")
# How transcripts name their speakers.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "you", "me", "prompt"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model", "response", "chatbot"),
}
_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in MARKERS[role]}
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?(" + "|".join(sorted(_ROLE_OF, key=lambda x: (-len(x), x))) + r")(?:\*\*|\|?>|\])?\s*(?::|：|>|-\s)(?:\*\*)?\s*", re.IGNORECASE)
#: Turns of a conversation in a block: a block is decoded by one task, a conversation by as many as it has blocks.
BLOCK = 256
#: The tables of so many blocks in a row are joined by a task, level by level, until no conversation has more than `TOP` of them.
FAN = 256
TOP = 4096

#: States: role r begins a turn (2 r) or goes on with it (2 r + 1).
STATES = 2 * len(ROLES)


@dataclass(frozen=True)
class LineModel:
    """Probabilities of the hidden Markov model. Tables are by role, in the order of ``ROLES``."""

    start: tuple[float, float, float] = (0.2, 0.7, 0.1)
    next_role: tuple[tuple[float, float, float], ...] = ((0.02, 0.9, 0.08), (0.02, 0.08, 0.9), (0.02, 0.9, 0.08))
    go_on: float = 0.6
    marked: float = 0.8
    wrong_mark: float = 0.004
    stray_mark: float = 0.01
    gap_at_turn: float = 0.97
    gap_inside: float = 0.05
    asks: tuple[float, float, float] = (0.02, 0.3, 0.08)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms: of the first state, and of state to state."""
        first, step = np.full(STATES, -np.inf), np.full((STATES, STATES), -np.inf)
        for r in range(len(ROLES)):
            first[2 * r] = np.log(self.start[r])
            for s in (2 * r, 2 * r + 1):
                step[s, 2 * r + 1] = np.log(self.go_on)
                for q in range(len(ROLES)):
                    step[s, 2 * q] = np.log((1 - self.go_on) * self.next_role[r][q])
        return first, step

    def emissions(self, mark: np.ndarray, gap: np.ndarray, asks: np.ndarray) -> np.ndarray:
        """Log-probability of each line's features in each state. ``mark``: the role that the line's marker names, or -1; ``gap``: a blank line or a new piece comes before."""
        out = np.zeros((len(mark), STATES))
        for r in range(len(ROLES)):
            begins = np.where(mark < 0, 1 - self.marked - self.wrong_mark, np.where(mark == r, self.marked, self.wrong_mark / 2))
            inside = np.where(mark < 0, 1 - self.stray_mark, self.stray_mark / 3)
            question = np.log(np.where(asks, self.asks[r], 1 - self.asks[r]))
            out[:, 2 * r] = np.log(begins) + np.log(np.where(gap, self.gap_at_turn, 1 - self.gap_at_turn)) + question
            out[:, 2 * r + 1] = np.log(inside) + np.log(np.where(gap, self.gap_inside, 1 - self.gap_inside)) + question
        return out


def line_features(pieces: list[str]) -> tuple[list[tuple[int, str]], np.ndarray, np.ndarray, np.ndarray]:
    """The lines of consecutive pieces with words in them (piece, text without the marker) and their features. Blank lines count as gaps and are left out."""
    lines, mark, gap, asks = [], [], [], []
    for i, piece in enumerate(pieces):
        before = True
        for line in piece.split("\n"):
            if not line.strip():
                before = True
                continue
            found = _MARKER.match(line)
            lines.append((i, line[found.end() :] if found else line))
            mark.append(_ROLE_OF[found[1].lower()] if found else -1)
            gap.append(before)
            asks.append(line.rstrip()[-1] in "?？")
            before = False
    return lines, np.array(mark, int), np.array(gap, bool), np.array(asks, bool)


def transfer(emission: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best log-probability of a run of lines for each state before it and each state at its end."""
    best = step + emission[0]
    for e in emission[1:]:
        best = (best[:, :, None] + step[None]).max(axis=1) + e
    return best


def viterbi(emission: np.ndarray, entry: np.ndarray, step: np.ndarray, last: int | None = None) -> np.ndarray:
    """The best states of the lines. ``entry``: log-probabilities of the first line's state; ``last``: the state at the end, if it is known. The lower state wins a tie."""
    score, back = entry + emission[0], np.zeros(emission.shape, int)
    for t in range(1, len(emission)):
        ways = score[:, None] + step
        back[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + emission[t]
    state = int(score.argmax()) if last is None else last
    out = np.zeros(len(emission), int)
    for t in range(len(emission) - 1, -1, -1):
        out[t], state = state, int(back[t, state])
    return out


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks of batches that are sorted by conversation and block."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = list(zip(batch.column("conv").to_pylist(), batch.column("block").to_pylist(), strict=True))
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if rest and (rest[-1].column("conv")[-1].as_py(), rest[-1].column("block")[-1].as_py()) != key[a]:
                yield pa.concat_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.concat_batches(rest)


def _joined(tables: list[np.ndarray]) -> np.ndarray:
    """The table of a run of blocks: best scores from any state to any other, and of the last state if the run comes first."""
    size = STATES * STATES
    best, first = tables[0][:size].reshape(STATES, STATES), tables[0][size:]
    for own in tables[1:]:
        step = own[:size].reshape(STATES, STATES)
        best, first = (best[:, :, None] + step[None]).max(axis=1), (first[:, None] + step).max(axis=0)
    return np.concatenate([best.ravel(), first])


def _ends(tables: list[np.ndarray], entry: int | None, last: int | None) -> list[int]:
    """The state at the end of each block of a run that is entered from state ``entry`` (null: it comes first) and ends in ``last`` (null: the best)."""
    size = STATES * STATES
    score = tables[0][size:] if entry is None else tables[0][:size].reshape(STATES, STATES)[entry]
    back = []
    for own in tables[1:]:
        ways = score[:, None] + own[:size].reshape(STATES, STATES)
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    states = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of batches sorted by ``conv`` and ``up``, those that agree in both together."""
    mine: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if mine and (row["conv"], row["up"]) != (mine[0]["conv"], mine[0]["up"]):
                yield mine
                mine = []
            mine.append(row)
    if mine:
        yield mine


def _states(scores: DataFrame, partitions: int) -> DataFrame:
    """``conv, block, entry, last``: the states before and at the end of each block on the conversation's best way, from the blocks' tables (``conv, block, scores``).

    The tables of `FAN` blocks are joined to one, those of as many runs again, until a conversation has few; there the best way is found, and then downwards level by
    level within each run. So no task holds the tables of a long conversation.
    """
    kind = scores.schema["conv"].dataType.simpleString()

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type = None

        def peeked() -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field("conv").type
                yield b

        for rows in _runs(peeked()):
            table = _joined([np.array(r["scores"]) for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[0]["conv"]], conv_type), pa.array([rows[0]["up"]], pa.int64()), pa.array([table.tolist()], pa.list_(pa.float64()))], names=["conv", "block", "scores"]
            )

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type = None

        def peeked() -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field("conv").type
                yield b

        for rows in _runs(peeked()):
            states = _ends([np.array(r["scores"]) for r in rows], rows[0]["entry"], rows[0]["last"])
            columns = [pa.array([r["conv"] for r in rows], conv_type), pa.array([r["block"] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([rows[0]["entry"], *states[:-1]], pa.int32()), pa.array(states, pa.int32())], names=["conv", "block", "entry", "last"]
            )

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions, "conv", "up").sortWithinPartitions("conv", "up", "block")

    levels = [scores]
    while (levels[-1].groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > TOP:
        runs = levels[-1].withColumn("up", F.floor(F.col("block") / FAN).cast("long"))
        levels.append(stored(dealt(runs).mapInArrow(up, f"conv {kind}, block long, scores array<double>"), "blocks"))
    known = None
    for level in reversed(levels):
        if known is None:
            rows = level.select("conv", F.lit(0).cast("long").alias("up"), "block", "scores", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("int").alias("last"))
        else:
            mine = level.withColumn("up", F.floor(F.col("block") / FAN).cast("long")).alias("l")
            same = F.col("l.conv").eqNullSafe(F.col("k.conv")) & (F.col("l.up") == F.col("k.block"))
            rows = mine.join(known.alias("k"), same).select("l.conv", "l.up", "l.block", "l.scores", "k.entry", "k.last")
        known = dealt(rows).mapInArrow(down, f"conv {kind}, block long, entry int, last int")
    return known


def parse_transcripts(df: DataFrame, conv_col: str, order_col: str, text_col: str, model: LineModel = LineModel()) -> DataFrame:
    """``conv_col, order_col, role, begins, n_lines, rendered`` of each piece of transcript: who speaks in its first line, whether a turn begins there, its lines with words, and
    the piece in canonical form: a header before each line where a turn begins, markers removed.

    The pieces of a conversation are put in the order of ``order_col`` (a number or a time; equal ones by text; nulls last, in the order of a hash of the text), their lines are
    decoded together. Blocks of `BLOCK` places are decoded apart: first each gives its best score from any state to any other, these small tables are joined along the
    conversation (`_states`), and then each block is decoded between the states found at its ends. So a conversation that holds a large share of all rows is spread over tasks;
    pieces with a null place, or one that is no number, are spread over blocks by the hash. A task holds the pieces of one block.

    Null, empty and blank pieces have no lines: they take the role that speaks before them (none: null), and render as the empty string. A null conversation is one of its own.
    Repeated rows are pieces of their own. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    number = F.col("__order").cast("double")
    block = F.when(number.isNull(), F.lit(1 << 40) + F.pmod(F.xxhash64("__text"), F.lit(1024))).otherwise(F.floor(number / BLOCK)).cast("long")
    rows = df.select(df[conv_col].alias("conv"), df[order_col].alias("__order"), df[text_col].cast("string").alias("__text")).select(
        "conv", block.alias("block"), F.col("__order").alias("place"), F.col("__text").alias("text")
    )
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "place")}
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, step = model.tables()

    def pieces(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
        lines, mark, gap, asks = line_features([t or "" for t in batch.column("text").to_pylist()])
        return lines, model.emissions(mark, gap, asks)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            lines, emission = pieces(batch)
            if lines:
                table = [transfer(emission, step).ravel(), first + emission[0] if len(emission) == 1 else (first + emission[0] + transfer(emission[1:], step).T).max(axis=1)]
                numbers = pa.array([np.concatenate(table).tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("conv").slice(0, 1), batch.column("block").slice(0, 1), numbers], names=["conv", "block", "scores"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            lines, emission = pieces(batch)
            entry, last = batch.column("entry")[0].as_py(), batch.column("last")[0].as_py()
            states = viterbi(emission, first if entry is None else step[entry], step, last) if lines else []
            own: list[list[tuple[int, str]]] = [[] for _ in range(batch.num_rows)]
            for (i, text), s in zip(lines, states, strict=True):
                own[i].append((int(s), text))
            speaking = None if entry is None else entry // 2
            role, begins, count, text = [], [], [], []
            for mine in own:
                speaking = mine[0][0] // 2 if mine else speaking
                role.append(None if speaking is None else ROLES[speaking])
                begins.append(bool(mine) and mine[0][0] % 2 == 0)
                count.append(len(mine))
                parts: list[str] = []
                for s, line in mine:
                    parts.append(render(ROLES[s // 2], line) if s % 2 == 0 else f"{line}\n")
                text.append("".join(parts))
                speaking = mine[-1][0] // 2 if mine else speaking
            out = [pa.array(role, pa.string()), pa.array(begins), pa.array(count, pa.int64()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("place"), *out], names=["conv", "place", "role", "begins", "n_lines", "rendered"])

    order = ["conv", "block", F.col("place").asc_nulls_last(), "text"]
    dealt = rows.repartition(partitions, "conv", "block").sortWithinPartitions(*order)
    scores = stored(dealt.mapInArrow(measure, f"conv {kind['conv']}, block long, scores array<double>"), "blocks")
    ends = _states(scores, partitions)
    same = F.col("r.conv").eqNullSafe(F.col("e.conv")) & (F.col("r.block") == F.col("e.block"))
    joined = rows.alias("r").join(ends.alias("e"), same, "left").select("r.conv", "r.block", "r.place", "r.text", "e.entry", "e.last")
    out = joined.repartition(partitions, "conv", "block").sortWithinPartitions(*order).mapInArrow(decode, f"conv {kind['conv']}, place {kind['place']}, role string, begins boolean, n_lines long, rendered string")
    return out.withColumnsRenamed({"conv": conv_col, "place": order_col})


def with_markers(text: Column, role: Column, turn: Column, keep_of: int = 8) -> Column:
    """A transcript piece as chat logs write it: the speaker's marker, in one of several styles by turn, and the text; every ``keep_of``-th turn lacks its marker."""
    name = F.when(role == "user", F.when(turn % 3 == 0, F.lit("Human: ")).otherwise("User: ")).when(role == "assistant", F.when(turn % 3 == 0, F.lit("AI: ")).otherwise("Assistant: ")).when(role == "system", F.lit("System: ")).otherwise("")
    return F.concat(F.when(turn % keep_of == keep_of - 1, F.lit("")).otherwise(F.coalesce(name, F.lit(""))), F.coalesce(text, F.lit("")))
