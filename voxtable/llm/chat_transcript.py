"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines, then the turns are rendered in one canonical form."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import checkpoint, fold
from voxtable.operators.ordered import numbered

ROLES = ["system", "user", "assistant"]
#: Words that mark a speaker at the start of a line.
MARKERS = {
    "system": ["system", "instruction", "instructions", "context"],
    "user": ["user", "human", "question", "prompt", "q", "me"],
    "assistant": ["assistant", "ai", "bot", "answer", "model", "a"],
}
CLASS = {w: k for k, role in enumerate(ROLES) for w in MARKERS[role]}
MARKER = re.compile(r"^[\s>*#\[]{0,4}(" + "|".join(sorted(CLASS, key=len, reverse=True)) + r")[\]*]{0,2}\s?:\s?", re.IGNORECASE)
BINS = (20, 60, 120, 240, 480)
#: A state is the first line of a turn of a role, or one that goes on.
STATES = [(role, first) for role in ROLES for first in (True, False)]
N_SYMBOLS = 4 * (len(BINS) + 1) * 2


def cut_line(line: str) -> tuple[int, str]:
    """The symbol of a line (speaker marker, length, question), and the line without its marker."""
    found = MARKER.match(line)
    rest = line[found.end() :] if found else line
    marker = CLASS[found[1].lower()] if found else 3
    return (marker * (len(BINS) + 1) + int(np.searchsorted(BINS, len(rest)))) * 2 + rest.rstrip().endswith("?"), rest


@dataclass
class Model:
    """Logarithms of the probabilities of first states, changes and symbols."""

    first: np.ndarray
    change: np.ndarray
    emit: np.ndarray

    def viterbi(self, symbols: list[int], entry: int | None = None, last: int | None = None) -> list[int]:
        """The likeliest states after the state ``entry`` (or at the start), up to the state ``last`` (or any); of equally likely ones the first in order."""
        best, back = (self.first if entry is None else self.change[entry]) + self.emit[:, symbols[0]], []
        for s in symbols[1:]:
            ways = best[:, None] + self.change
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + self.emit[:, s]
        path = [int(best.argmax()) if last is None else last]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    def across(self, symbols: list[int]) -> np.ndarray:
        """The best weight from each state before the symbols (the last row: from the start) to each state at the last of them."""
        best = np.vstack([self.change, self.first]) + self.emit[:, symbols[0]]
        for s in symbols[1:]:
            best = (best[:, :, None] + self.change).max(axis=1) + self.emit[:, s]
        return best


def borders(across: list[np.ndarray]) -> list[int]:
    """The states at the ends of consecutive stretches of symbols on the likeliest path over all of them."""
    ahead = [across[0][-1]]
    for m in across[1:]:
        ahead.append((ahead[-1][:, None] + m[:-1]).max(axis=0))
        ahead[-1] -= ahead[-1].max()
    out = [int(ahead[-1].argmax())]
    for before, m in zip(ahead[-2::-1], across[:0:-1]):
        out.append(int((before + m[:-1, out[-1]]).argmax()))
    return out[::-1]


def turns_of(model: Model, text: str, entry: int | None = None, last: int | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn. A first line of a turn, or a line of another role than the one before, opens a turn."""
    return parts_of(model, text, entry, last)[0]


def parts_of(model: Model, text: str, entry: int | None, last: int | None) -> tuple[list[tuple[str, str]], bool]:
    """The turns of a text that comes after the state ``entry`` and ends in ``last``, and whether the first of them goes on from before."""
    lines = [cut_line(x) for x in text.split("\n")]
    states = model.viterbi([s for s, _ in lines], entry, last)
    turns: list[tuple[str, list[str]]] = []
    for state, (_, rest) in zip(states, lines):
        role, first = STATES[state]
        if first or not turns or turns[-1][0] != role:
            turns.append((role, []))
        turns[-1][1].append(rest)
    goes_on = entry is not None and not STATES[states[0]][1] and STATES[states[0]][0] == STATES[entry][0]
    return [(role, "\n".join(x)) for role, x in turns], goes_on


def rendered(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text.strip()}\n<|end|>\n" for role, text in turns)


def fit(marked: DataFrame, text: str, states: str, smooth: float = 0.5, before: str | None = None) -> Model:
    """From transcripts whose lines' states are known (an array of numbers, or null): counts over all rows, added up before they leave the tasks.

    ``before``: the state before a transcript that goes on from another, -1 where a conversation starts (as all do by default), null where unknown.
    """
    n = len(STATES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, change, emit = np.zeros(n), np.zeros((n, n)), np.zeros((n, N_SYMBOLS))
        for batch in batches:
            for raw, path, ahead in zip(*(c.to_pylist() for c in batch.columns)):
                symbols = [cut_line(x)[0] for x in raw.split("\n")]
                if ahead == -1:
                    first[path[0]] += 1
                elif ahead is not None:
                    change[ahead, path[0]] += 1
                np.add.at(change, (path[:-1], path[1:]), 1)
                np.add.at(emit, (path, symbols), 1)
        all_counts = np.concatenate([first, change.ravel(), emit.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(all_counts), dtype=np.int32)), pa.array(all_counts.astype(np.int64))], ["at", "n"])

    total = np.zeros(n + n * n + n * N_SYMBOLS)
    known = marked.where(F.col(text).isNotNull() & F.col(states).isNotNull()).select(text, states, (F.col(before) if before else F.lit(-1)).cast("int").alias("ahead_"))
    for r in known.mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    share = lambda x: np.log((x + smooth) / (x + smooth).sum(axis=-1, keepdims=True))
    return Model(share(total[:n]), share(total[n : n + n * n].reshape(n, n)), share(total[n + n * n :].reshape(n, N_SYMBOLS)))


PARSED = "key string, n_turns int, roles string, rendered string, line_roles array<int>, goes_on boolean"


def parse(transcripts: DataFrame, model: Model, key: str, text: str, entry: str | None = None, last: str | None = None) -> DataFrame:
    """key (as text), n_turns, roles (comma-joined), rendered, line_roles (the number of each line's role) and goes_on of every row.

    ``entry`` and ``last`` name columns of the states before a transcript and at its end, null where none is given; goes_on tells that the first turn
    goes on from before. A null transcript is empty; an empty one has one turn, of the likeliest role. Null keys, repeated rows and other columns
    don't matter; an empty table gives no rows.
    """
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [parts_of(shared.value, x or "", a, b) for x, a, b in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            found = [t for t, _ in parts]
            roles = [[r for r, _ in t] for t in found]
            lines = [[ROLES.index(r) for r, x in t for _ in x.split("\n")] for t in found]
            columns = [pa.array([len(t) for t in found], pa.int32()), pa.array([",".join(r) for r in roles], pa.string()), pa.array([rendered(t) for t in found], pa.string()), pa.array(lines, pa.list_(pa.int32())), pa.array([x for _, x in parts], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_turns", "roles", "rendered", "line_roles", "goes_on"])

    states = [(F.col(c) if c else F.lit(None)).cast("int").alias(name) for c, name in ((entry, "entry"), (last, "last"))]
    return transcripts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), *states).mapInArrow(run, PARSED)


def border_states(transcripts: DataFrame, model: Model) -> DataFrame:
    """key, entry and last of transcripts (key, conv_id, lone, segment, part, transcript) that follow each other in a conversation: the states before
    each (null for the first) and at its end, on the likeliest path over the conversation as a whole. A task has 42 numbers of each transcript of a conversation."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.across([cut_line(x)[0] for x in text.split("\n")]).tobytes() for text in batch.column("transcript").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], [*batch.schema.names[:-1], "across"])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by([("segment", "ascending"), ("part", "ascending")])
        states = borders([np.frombuffer(x).reshape(len(STATES) + 1, len(STATES)) for x in table.column("across").to_pylist()])
        return pa.table([table.column("key"), pa.array([None, *states[:-1]], pa.int32()), pa.array(states, pa.int32())], ["key", "entry", "last"])

    rows = transcripts.select("key", F.to_json(F.struct("conv_id", "lone")).alias("conv"), F.col("segment").cast("bigint"), F.col("part").cast("bigint"), "transcript")
    weighed = rows.mapInArrow(weigh, "key string, conv string, segment bigint, part bigint, across binary")
    return weighed.groupBy("conv").applyInArrow(chain, "key string, entry int, last int")


def as_transcripts(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = 64) -> DataFrame:
    """Transcripts written down from turns of known roles: key, conv_id, transcript, and the states of its lines (null if some role is unknown).

    Speakers are marked in one of four ways by the hash of the conversation, and about a fifth of the turns not at all. A conversation comes
    in segments of ``segment`` turn numbers, and a segment in parts of as many turns, so that none is gathered without a bound; ``before`` is the last
    state of the part before, -1 in the first and null if unknown, and ``n_parts`` counts those of the conversation. Null turns come first, in the segment of turn 0. A null text
    is an empty turn. Equal turn numbers are in the order of role and text. A turn of no conversation (a null id) is a transcript by itself.
    """
    known, h = F.nullif(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")), F.lit(0)) - 1, F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int")
    ways = [[MARKERS[r][k] for r in ROLES] for k in range(4)]
    name: Column = F.get(F.get(F.array(*(F.array(*(F.lit(w) for w in way)) for way in ways)), h), F.coalesce(known, F.lit(-1)).cast("int"))
    bare = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(5)) == 0
    marker = F.when(name.isNull() | bare, F.lit("")).otherwise(F.concat(F.initcap(name), F.lit(": ")))
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    start = (known * 2).cast("int")
    states = F.concat(F.array(start), F.array_repeat(start + 1, F.size(F.split("text", "\n")) - 1))
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).alias("lone")
    rows = rows.select("conv_id", lone, F.floor(F.coalesce(F.col("turn"), F.lit(0)) / segment).alias("segment"), "turn", "role", "text", F.concat(marker, "text").alias("line"), states.alias("states"))
    ranked = numbered(rows, ["conv_id", "lone", "segment"], ["turn", "role", "text"], "rank")
    ranked = ranked.select("conv_id", "lone", "segment", F.floor((F.col("rank") - 1) / segment).alias("part"), F.struct("rank", "line", "states").alias("t"))
    joined = ranked.groupBy("conv_id", "lone", "segment", "part").agg(F.sort_array(F.collect_list("t")).alias("t"))
    all_states = F.flatten(F.col("t.states"))
    written = checkpoint(joined.select(
        F.to_json(F.struct("conv_id", "segment", "lone", "part")).alias("key"), "conv_id", "lone", "segment", "part", F.size("t").alias("true_turns"),
        F.array_join(F.col("t.line"), "\n").alias("transcript"), F.when(~F.exists(all_states, lambda s: s.isNull()), all_states).alias("states"),
    ))
    whole = Window.partitionBy("conv_id", "lone")
    order = whole.orderBy("segment", "part")
    before = F.when(F.row_number().over(order) == 1, F.lit(-1)).otherwise(F.lag(F.element_at("states", -1)).over(order))
    return written.join(written.select("key", before.alias("before"), F.count("*").over(whole).alias("n_parts")), "key")


def chat_formatting(conversations: DataFrame, conv_id: str = "conv_id", folds: int = 5, test: int = 0, **columns: str) -> DataFrame:
    """conv_id, segment, part, held_out, true_turns, n_turns, roles, rendered, goes_on, n_lines and n_right (lines given their true role) of every transcript.

    The model learns from the transcripts of conversations outside the test fold. The roles are those of the likeliest path over all transcripts of a
    conversation, in the order of segment and part; where goes_on, the first turn is the rest of the last one of the transcript before. Very long
    turns are read whole.
    """
    written = checkpoint(as_transcripts(conversations, conv_id, **columns).withColumn("held_out", fold("conv_id", folds) == test))
    model = fit(written.where(~F.col("held_out")), "transcript", "states", before="before")
    states = border_states(written.where("n_parts > 1"), model)
    found = parse(written.join(states, "key", "left"), model, "key", "transcript", "entry", "last")
    right = F.size(F.filter(F.zip_with("line_roles", "states", lambda a, s: a == F.floor(s / 2)), lambda x: x))
    return written.join(found, "key").select("conv_id", "segment", "part", "held_out", "true_turns", "n_turns", "roles", "rendered", "goes_on", F.size("line_roles").alias("n_lines"), F.when(F.col("states").isNotNull(), right).alias("n_right"))
