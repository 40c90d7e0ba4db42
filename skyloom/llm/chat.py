"""Repair of role sequences in conversations at minimum cost, and their rendering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import written

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the turn before. A conversation ends after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1, 2, 3
FAR = 1 << 40


def _moves() -> list[list[list[tuple[int, int, int, tuple[int, ...]]]]]:
    """For each observed role and state before: (cost, next state, merged, inserted states), best first.

    A turn keeps its role or is relabelled; it then joins a turn of the same role before it, or follows it
    legally, if need be after empty turns.
    """
    out = []
    for seen in range(4):  # 3: no known role
        by_state = []
        for before in range(4):
            found = []
            for role in (SYSTEM, USER, ASSISTANT):
                cost = 0 if role == seen + 1 else RELABEL
                if role == before:
                    found.append((cost + MERGE, role, 1, ()))
                if role in LEGAL[before]:
                    found.append((cost, role, 0, ()))
                else:
                    for middle in LEGAL[before]:
                        if role in LEGAL[middle]:
                            found.append((cost + INSERT, role, 0, (middle,)))
            by_state.append(sorted(found, key=lambda m: (m[0], m[1] != seen + 1, len(m[3]), m[1], m[3])))
        out.append(by_state)
    return out


MOVES = _moves()
#: Empty turns that end a conversation in each state.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


@lru_cache(maxsize=50_000)
def run_costs(roles: bytes) -> tuple[list[int], list[int]]:
    """Least cost from each state to each through the turns, and the turns it leaves (as few as can be)."""
    cost = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    turns = np.zeros((4, 4), dtype=np.int64)
    steps = []
    for seen in range(4):
        steps.append([(b, c, to, 1 - merged + len(ins)) for b in range(4) for c, to, merged, ins in MOVES[seen][b]])
    for seen in roles:
        key = np.full((4, 4), FAR * 4, dtype=np.int64)
        new_turns = np.zeros((4, 4), dtype=np.int64)
        for b, c, to, more in steps[seen]:
            total = cost[:, b] + c
            less = (total < key[:, to]) | ((total == key[:, to]) & (turns[:, b] + more < new_turns[:, to]))
            key[less, to] = total[less]
            new_turns[less, to] = turns[less, b] + more
        cost, turns = np.minimum(key, FAR), new_turns
    return cost.ravel().tolist(), turns.ravel().tolist()


#: Runs up to this length are remembered: at most some 40 MB.
MOST_CACHED, CACHED_RUNS = 64, 8192


def repair_run(roles: bytes, begin: int, end: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """cheapest_run, remembered for short runs."""
    return _cached_run(roles, begin, end) if len(roles) <= MOST_CACHED else cheapest_run(roles, begin, end)


def cheapest_run(roles: bytes, begin: int, end: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """The cheapest path through the turns from one state to another: (role, merged, inserted) per turn.

    Of paths of equal cost, one with the fewest turns.
    """
    best = [[(FAR, 0)] * 4 for _ in range(len(roles) + 1)]
    best[0][begin] = (0, 0)
    back: list[list] = []
    for i, seen in enumerate(roles):
        links: list = [None] * 4
        row = best[i + 1]
        for b in range(4):
            if best[i][b][0] >= FAR:
                continue
            cost, turns = best[i][b]
            for move in MOVES[seen][b]:
                total = (cost + move[0], turns + 1 - move[2] + len(move[3]))
                if total < row[move[1]]:
                    row[move[1]], links[move[1]] = total, (b, move)
        back.append(links)
    path, state = [], end
    for links in reversed(back):
        state, move = links[state]
        path.append((move[1], move[2], move[3]))
    return path[::-1]


# A function of its own name: tasks' functions refer to it by that name.
@lru_cache(maxsize=CACHED_RUNS)
def _cached_run(roles: bytes, begin: int, end: int) -> list[tuple[int, int, tuple[int, ...]]]:
    return cheapest_run(roles, begin, end)


def render(role: str, text: str, first: bool) -> str:
    """A turn's head and text, or what a merged turn adds to the turn before."""
    return f"<|{role}|>\n{text}" if first else f"\n\n{text}"


def _block_costs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per block, with costs and turns of all pairs of states as lists."""
    names = ["conv", "block", "size", "cost", "turns"]
    rows, key, roles = [], None, bytearray()
    for part in parts:
        for conv, block, seen in zip(part["conv"], part["block"], part["seen"], strict=True):
            if (conv, block) != key:
                if roles:
                    rows.append((*key, len(roles), *run_costs(bytes(roles))))
                key, roles = (conv, block), bytearray()
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            roles.append(seen)
    if roles:
        rows.append((*key, len(roles), *run_costs(bytes(roles))))
    if rows:
        yield pd.DataFrame(rows, columns=names)


def _chained(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block of a conversation the states it begins and ends in, and the turns and rows before it."""
    def chain(conv, blocks):
        best = [(0, 0) if s == START else (FAR, 0) for s in range(4)]
        back = []
        for _, _, cost, turns in blocks:
            row, links = [(FAR, 0)] * 4, [0] * 4
            for b in range(4):
                if best[b][0] >= FAR:
                    continue
                for e in range(4):
                    if cost[b * 4 + e] < FAR:
                        total = (best[b][0] + cost[b * 4 + e], best[b][1] + turns[b * 4 + e])
                        if total < row[e]:
                            row[e], links[e] = total, b
            best = row
            back.append(links)
        state = min(
            (s for s in range(4) if best[s][0] < FAR),
            key=lambda s: (best[s][0] + INSERT * len(CLOSING[s]), best[s][1] + len(CLOSING[s]), s),
        )
        total = best[state][0] + INSERT * len(CLOSING[state])
        ends = []
        for links in reversed(back):
            ends.append((links[state], state))
            state = links[state]
        out, before, position = [], 0, 0
        for (block, size, _, turns), (b, e) in zip(blocks, reversed(ends), strict=True):
            out.append((conv, block, b, e, before, position, total, block == blocks[-1][0]))
            before += turns[b * 4 + e]
            position += size
        return out

    names = ["conv", "block", "begin", "end", "before", "position", "total_cost", "last"]
    rows, conv, blocks = [], None, []
    for part in parts:
        for c, block, size, cost, turns in zip(*[part[k] for k in ("conv", "block", "size", "cost", "turns")], strict=True):
            if c != conv:
                if blocks:
                    rows += chain(conv, blocks)
                conv, blocks = c, []
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            blocks.append((block, size, cost, turns))
    if blocks:
        rows += chain(conv, blocks)
    if rows:
        yield pd.DataFrame(rows, columns=names)


ROW = ["conv", "block", "begin", "end", "before", "position", "total_cost", "last", "seen", "turn", "text"]
OUT = ["conv", "turn", "position", "turn_index", "role", "action", "rendered", "total_cost"]


def _repaired(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The turns of each block between its two states; the last block closes the conversation."""
    action = {(True, 0): "keep", (False, 0): "relabel", (True, 1): "merge", (False, 1): "relabel and merge"}

    def repair(rows):
        conv, _, begin, end, before, position, cost, last = rows[0][:8]
        index, path = before - 1, repair_run(bytes(r[8] for r in rows), begin, end)
        for at, (row, (role, merged, inserted)) in enumerate(zip(rows, path, strict=True)):
            for empty in inserted:
                index += 1
                yield conv, None, None, index, ROLES[empty - 1], "insert", render(ROLES[empty - 1], "", True), cost
            index += 1 - merged
            name = ROLES[role - 1]
            what = action[role == row[8] + 1, merged]
            yield conv, row[9], str(position + at), index, name, what, render(name, row[10] or "", not merged), cost
        for empty in CLOSING[end] if last else ():
            index += 1
            yield conv, None, None, index, ROLES[empty - 1], "insert", render(ROLES[empty - 1], "", True), cost

    out, key, rows = [], None, []
    for part in parts:
        for row in part[ROW].itertuples(index=False, name=None):
            if row[:2] != key:
                if rows:
                    out += repair(rows)
                key, rows = row[:2], []
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=OUT)
                    out = []
            rows.append(row)
    if rows:
        out += repair(rows)
    if out:
        yield pd.DataFrame(out, columns=OUT)


def repair_roles(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block: int = 512,
) -> DataFrame:
    """One row per turn of the repaired conversations, merged and inserted ones too, each with its rendered text.

    Legal conversations are an optional system turn, then user and assistant in turns, ending with the assistant.
    Per conversation the cheapest repair is chosen: merging a turn into the one before of its role (1), giving a
    turn another role (2), inserting an empty turn (3); of equal ones that with the fewest turns. Rendered texts in the
    order of (turn_index, position) make the conversation. position counts the source turns of the conversation from 0,
    action says what became of one; inserted turns have neither number nor position.

    Turns are dealt out by ranges of (conversation, turn), so a conversation of any length spreads over tasks, and
    numbered; blocks of at most block turns yield a table of costs between automaton states, a conversation's
    tables are chained, and every block is repaired between the states found for it.

    Roles are compared without case and outer spaces; a null or unknown role may become any, as a relabelling. A null
    text is empty. A null conversation id is one conversation. Turns of equal or null number (first) are ordered by
    role and text hash, so ties and repeated rows have one result. An empty table gives no rows. Other columns are not read.
    """
    spark = turns.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {c: turns.schema[c].dataType for c in (conv_col, turn_col)}
    name = F.lower(F.trim(F.col(role_col)))
    known = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), name).cast("int"), F.lit(0))
    rows = turns.select(
        F.col(conv_col).cast("string").alias("conv"),  # pandas would turn integers beside nulls into floats
        F.col(turn_col).alias("turn"),
        F.when(known == 0, 3).otherwise(known - 1).alias("seen"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("tie"),
    )
    order = ["conv", "turn", "seen", "tie"]
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "text")
    # Places grow along the ranges, and no block of places reaches over two ranges.
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "turns").select(
        "conv", F.col("turn").cast("string").alias("turn"), "seen", "text", "place", F.floor(F.col("place") / block).alias("block")
    )

    def gathered(df: DataFrame, by: list[str], *sort: str) -> DataFrame:
        return df.repartition(tasks, *by).sortWithinPartitions(*by, *sort)

    costs = gathered(rows.select("conv", "block", "place", "seen"), ["conv", "block"], "place").mapInPandas(
        _block_costs, "conv string, block bigint, size bigint, cost array<bigint>, turns array<bigint>"
    )
    chained = gathered(costs, ["conv"], "block").mapInPandas(
        _chained,
        "conv string, block bigint, begin int, end int, before bigint, position bigint, total_cost bigint, last boolean",
    )
    chained = written(chained, "chained").withColumnsRenamed({"conv": "c", "block": "b"})
    both = rows.join(chained, F.col("c").eqNullSafe(F.col("conv")) & (F.col("b") == F.col("block")))
    done = gathered(both.select(*ROW, "place"), ["conv", "block"], "place").mapInPandas(
        _repaired,
        "conv string, turn string, position string, turn_index bigint, role string, action string, rendered string,"
        " total_cost bigint",
    )
    return done.select(
        F.col("conv").cast(kinds[conv_col]).alias("conv_id"),
        F.col("turn").cast(kinds[turn_col]).alias("turn"),
        F.col("position").cast("bigint").alias("position"),
        "turn_index",
        "role",
        "action",
        "rendered",
        "total_cost",
    )
