"""Chat formatting with minimum-cost role repair.

Legal chats: an optional ``system`` turn, then ``user`` and ``assistant`` in turn, ``user``
first. A raw turn may be kept (0), relabelled to another role (2), or merged into the turn before
it if that has the role it takes (1 for its own role, 3 after relabelling); before any raw turn an
empty turn may be inserted (3). A turn whose role is unknown or null takes any role for 2. The
cheapest repair is found by dynamic programming over the automaton's states (the last role so
far); among equals the one whose sequence of states is first, compared from the first turn on.
The repaired turns are rendered in order as the chat's training text.

A conversation may hold any share of the rows: turns are cut to segments of ``segment`` turn
numbers. A segment is a min-plus matrix from the state before it to the state behind it, with the
order of its cheapest ways and how many turns they give; the matrices of a conversation are
combined, which gives each segment its two states and the number of its first turn, and segments
are then repaired on their own. What a segment's last turn and the next one's first share is put
together last. So the result doesn't depend on ``segment``. Only a conversation's matrices, one for
each segment, meet in one task; a repaired turn is one row, as long as the turns merged into it.

Defined cases: turns sort by (turn, role, text) with nulls last, repeated rows are turns of their
own; turns without a number come last, by the hash of role and text, in segments by that hash;
null text is empty; an empty table gives no rows; rows of null conv_id are one conversation; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.scratch import materialize

SEGMENT = 256
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
KEEP, RELABEL, MERGE, INSERT = 0, 2, 1, 3
FAR = 1 << 40
PIECES = "conv_id long, segment long, place long, role string, text string, source_turns int, cost int, open boolean"
#: Turns without a number stand in segments from here on, by so many bits of their hash.
UNNUMBERED, BITS = 1 << 61, 12


def _moves() -> list[tuple[int, int, int, tuple[int, ...], int]]:
    """For a raw turn that takes a role: (state before, state behind, cost without relabelling,
    roles of empty turns before it, 1 if it merges). In order of preference."""
    out = []
    for before in range(STATES):
        for behind in (SYSTEM, USER, ASSISTANT):
            if before == behind:
                out.append((before, behind, MERGE, (), 1))
            if behind in LEGAL[before]:
                out.append((before, behind, KEEP, (), 0))
            for empty in LEGAL[before]:
                if behind in LEGAL[empty]:
                    out.append((before, behind, INSERT, (empty,), 0))
    return out


def _steps(role: str | None) -> list[tuple[int, int, int, tuple[int, ...], int]]:
    own = ROLES.index(role) + 1 if role in ROLES else 0
    return [(a, b, c + (0 if b == own else RELABEL), d, e) for a, b, c, d, e in _moves()]


STEPS = {role: _steps(role) for role in (*ROLES, None)}


def _tables():
    """Per role a matrix of the cheapest step between states, that step's number, and the turns it begins."""
    cost, pick, begun = {}, {}, {}
    for role, steps in STEPS.items():
        c, p, n = np.full((STATES, STATES), FAR, np.int64), np.full((STATES, STATES), -1), np.zeros((STATES, STATES), np.int64)
        for k, (a, b, x, empty, merged) in enumerate(steps):
            if x < c[a, b]:
                c[a, b], p[a, b], n[a, b] = x, k, len(empty) + 1 - merged
        cost[role], pick[role], begun[role] = c, p, n
    return cost, pick, begun


COST, PICK, BEGUN = _tables()
#: From a state to itself without a turn: costs, order of the ways, turns begun.
NOTHING = np.stack([np.where(np.eye(STATES, dtype=bool), 0, FAR), np.zeros((STATES, STATES), np.int64), np.zeros((STATES, STATES), np.int64)])


def _step(held: np.ndarray, role: str | None) -> tuple[np.ndarray, np.ndarray]:
    """``held`` (costs, order, turns; by state before and state now) with one turn more, and through
    which state the best way comes. Ways of equal cost compare by their states from the first on."""
    name = role if role in ROLES else None
    cost, order, turns = held
    costs = np.minimum(cost[:, :, None] + COST[name][None], FAR)
    best = costs.min(1)
    by = np.where(costs == best[:, None, :], order[:, :, None], STATES).argmin(1)  # the state before
    rows = np.arange(len(cost))[:, None]
    key = order[rows, by] * STATES + np.arange(STATES) + (best >= FAR) * STATES * STATES
    return np.stack([best, key.argsort(1, kind="stable").argsort(1, kind="stable"), turns[rows, by] + BEGUN[name][by, np.arange(STATES)]]), by


def transfer(roles: list[str | None]) -> np.ndarray:
    """Costs, order and turns begun of the best ways from every state to every state over the turns."""
    held = NOTHING
    for role in roles:
        held = _step(held, role)[0]
    return held


def through(segments: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(state before, state behind, turns begun before) of each segment on the best way from START."""
    left = [np.zeros(STATES, np.int64)]  # the least cost from each state to the end
    for cost, _, _ in segments[::-1]:
        left.append(np.minimum((cost + left[-1][None, :]).min(1), FAR))
    out, state, begun = [], START, 0
    for (cost, order, turns), rest in zip(segments, left[-2::-1], strict=True):
        whole = cost[state] + rest
        behind = int(np.where(whole == whole.min(), order[state], STATES).argmin())
        out.append((state, behind, begun))
        state, begun = behind, begun + int(turns[state, behind])
    return out


def repair(turns: list[tuple[str | None, str]], entry: int, leave: int) -> list[tuple[str, list[str], int, bool]]:
    """(role, texts, cost, continues the turn before) of a segment's repaired turns."""
    held, ways = NOTHING[:, entry : entry + 1], []
    for role, _ in turns:
        held, by = _step(held, role)
        ways.append(by[0])
    state, path = leave, []
    for (role, text), by in zip(turns[::-1], ways[::-1], strict=True):
        name = role if role in ROLES else None
        before = int(by[state])
        path.append((STEPS[name][PICK[name][before, state]], text))
        state = before
    out: list[tuple[str, list[str], int, bool]] = []
    for (_, behind, cost, empty, merged), text in path[::-1]:
        out += [(ROLES[e - 1], [], INSERT, False) for e in empty]
        cost -= INSERT * len(empty)
        if merged and out:
            role, texts, spent, joined = out.pop()
            out.append((role, [*texts, text], spent + cost, joined))
        else:
            out.append((ROLES[behind - 1], [text], cost, bool(merged)))
    return out


def render(role, text):
    """A turn as it stands in the training text."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def _runs(batches, width: int):
    """Runs of rows with equal (conv_id, segment), which come together, as lists of rows."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True):
            if rows and row[:2] != key:
                yield rows
                rows = []
            key = row[:2]
            rows.append(row)
    if rows:
        yield rows


def _matrices(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("matrix", pa.list_(pa.int64()))])
    for some in _chunked(_runs(batches, 3)):
        yield pa.RecordBatch.from_pylist([{"conv_id": r[0][0], "segment": r[0][1], "matrix": transfer([x[2] for x in r]).ravel().tolist()} for r in some], schema)


def _chunked(runs, size: int = 1000):
    some = []
    for run in runs:
        some.append(run)
        if len(some) == size:
            yield some
            some = []
    if some:
        yield some


def _repaired(batches):
    names = [c.split() for c in PIECES.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in names])
    for some in _chunked(_runs(batches, 7)):
        rows = []
        for run in some:
            turns = repair([(r[2], r[3] or "") for r in run], run[0][4], run[0][5])
            place = run[0][6] - turns[0][3]
            for k, (role, texts, cost, joined) in enumerate(turns):
                rows.append(dict(zip(schema.names, (run[0][0], run[0][1], place + k, role, "\n".join(texts), len(texts), cost, joined or k == len(turns) - 1), strict=True)))
        yield pa.RecordBatch.from_pylist(rows, schema)


def format_chats(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Repaired turns of ``turns`` (conv_id, turn, role, text): conv_id, place (from 0), role, text
    (merged turns joined by a newline), rendered (joined in order they are the chat's training text),
    source_turns (0: an inserted empty turn) and the turn's share of the repair cost."""
    turn = F.col("turn").cast("long")
    hashed = F.when(turn.isNull(), F.xxhash64(F.col("role").cast("string"), F.col("text").cast("string")))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.floor(turn / segment), F.shiftrightunsigned(hashed, 64 - BITS) + UNNUMBERED).alias("segment"),
        turn.alias("turn"), hashed.alias("hashed"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    # Hashes compare as unsigned numbers, as their first bits do.
    order = [F.col("conv_id"), F.col("segment"), F.col("turn").asc_nulls_last(), F.shiftrightunsigned("hashed", 1), F.col("hashed"), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]
    dealt = rows.repartition("conv_id", "segment").sortWithinPartitions(*order).select("conv_id", "segment", "role")
    parts = materialize(dealt.mapInArrow(_matrices, "conv_id long, segment long, matrix array<long>"))

    @F.pandas_udf("array<struct<entry:int,leave:int,begun:long>>")
    def ways(column: pd.Series) -> pd.Series:
        named = ("entry", "leave", "begun")
        return pd.Series([[dict(zip(named, w, strict=True)) for w in through([m.reshape(3, STATES, STATES) for m in ms])] for ms in column])

    by_chat = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "matrix"))).alias("all"))
    states = by_chat.select("conv_id", F.col("all.segment").alias("segments"), ways(F.col("all.matrix")).alias("way"))
    around = F.explode(F.transform("segments", lambda s, k: F.struct(s.alias("of_segment"), F.col("way")[k].alias("w"))))
    states = states.select(F.col("conv_id").alias("of"), around.alias("a")).select("of", "a.of_segment", "a.w.*")
    met = rows.join(states, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("of_segment")))
    met = met.repartition("conv_id", "segment").sortWithinPartitions(*order).select("conv_id", "segment", "role", "text", "entry", "leave", "begun")
    pieces = materialize(met.mapInArrow(_repaired, PIECES))
    columns = ("conv_id", "place", "role", "text", "source_turns", "cost")
    split = pieces.where("open").groupBy("conv_id", "place").agg(
        F.min_by("role", "segment").alias("role"), F.array_sort(F.collect_list(F.struct("segment", "source_turns", "text"))).alias("all"),
        F.sum("source_turns").cast("int").alias("source_turns"), F.sum("cost").cast("int").alias("cost"),
    )
    split = split.withColumn("text", F.array_join(F.transform(F.filter("all", lambda x: x["source_turns"] > 0), lambda x: x["text"]), "\n"))
    whole = pieces.where("not open").select(*columns).unionByName(split.select(*columns))
    return whole.select("conv_id", "place", "role", "text", render(F.col("role"), F.col("text")).alias("rendered"), "source_turns", "cost")
