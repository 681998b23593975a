"""Chat formatting with minimum-cost role repair.

A conversation is legal when an optional system turn is followed by user and assistant turns in alternation
and the last turn is the assistant's. Dynamic programming over that automaton chooses for every given turn
whether to keep its role, to relabel it, to merge it into the turn before, and how many empty turns to insert
in front, at the least total cost; the repaired sequence is then rendered turn by turn.

The step from state to state over one turn is a small matrix, and steps compose in the (min, +) algebra, so a
conversation of any length is repaired in blocks of consecutive rows: each block's border conversations are
summarised by one matrix, the matrices of a conversation are chained to fix the states at block borders, and
the blocks are then solved apart from each other. Roles alone go through the programming; the decisions are joined
to the texts by row number and rendered there. The output has one row a given turn.

Markers in a text are made harmless: between ``<`` and ``|`` one more backslash is put (``escaped``, ``unescaped``), so
that no text can open or close a turn and every text can be read back.

Defined cases: turns follow the order of turn, role and a checksum of the text, nulls first; rows with null conv_id are
one conversation; a null or unknown role is relabelled; a null text is empty; repeated rows are turns of their own; among
equal costs the first in the order keep, merge, relabel, then fewer and earlier-listed insertions wins; an empty table gives
an empty one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import table

ROLES = ("system", "user", "assistant")
#: Which turn may follow which; the key None is the beginning.
NEXT: dict[str | None, tuple[str, ...]] = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
LAST = ("assistant",)
STATES: tuple[str | None, ...] = (None, *ROLES)
#: Costs of a merge of a turn with the same role, of a change of role and of an empty turn.
MERGE, RELABEL, INSERT = 1.0, 5.0, 3.0
ROWS_LEAST, ROWS_MOST, BLOCKS = 1024, 65_536, 1 << 15


@lru_cache
def _inserted(state: str | None) -> dict[str | None, tuple[str, ...]]:
    """The shortest insertions that lead from a state to every other one."""
    paths: dict[str | None, tuple[str, ...]] = {state: ()}
    queue = [state]
    for at in queue:
        for role in NEXT[at]:
            if role not in paths:
                paths[role] = (*paths[at], role)
                queue.append(role)
    return paths


@lru_cache
def step(role: str | None) -> list[list[tuple[float, str, tuple[str, ...]] | None]]:
    """step[s][t]: (cost, action, inserted roles) of the best way over one turn of this role from state s to t."""
    out: list[list[tuple[float, str, tuple[str, ...]] | None]] = [[None] * len(STATES) for _ in STATES]
    for s, state in enumerate(STATES):
        for t, target in enumerate(STATES):
            if target is None:
                continue
            ways = []
            change = 0.0 if role == target else RELABEL
            if state == target:
                ways.append((MERGE + change, 1, "merge", ()))
            for before, path in _inserted(state).items():
                if target in NEXT[before]:
                    ways.append((change + INSERT * len(path), 2 if change else 0, "relabel" if change else "keep", path))
            if ways:
                cost, _, action, path = min(ways, key=lambda w: (w[0], len(w[3]), w[1], w[3]))
                out[s][t] = (cost, action, path)
    return out


@lru_cache
def matrix(role: str | None) -> np.ndarray:
    return np.array([[np.inf if c is None else c[0] for c in row] for row in step(role)])


def _end_costs() -> np.ndarray:
    """Cost of the empty turns that are needed after the last one; none after an empty conversation."""
    return np.array([0.0 if s is None or s in LAST else INSERT * len(_inserted(s)[LAST[0]]) for s in STATES])


def _over(entry: np.ndarray, roles: list[str | None]) -> list[np.ndarray]:
    """Least costs of every state after each turn."""
    out = [entry]
    for role in roles:
        out.append((out[-1][:, None] + matrix(role)).min(0))
    return out


def summary(roles: list[str | None]) -> np.ndarray:
    """Least costs from every state before the turns to every state after them."""
    total = np.where(np.eye(len(STATES)) > 0, 0.0, np.inf)
    for role in roles:
        total = (total[:, :, None] + matrix(role)[None]).min(1)
    return total


def path(roles: list[str | None], entry: int, leave: int) -> list[int]:
    """The states after each turn on a cheapest way between two states."""
    start = np.full(len(STATES), np.inf)
    start[entry] = 0
    costs, states = _over(start, roles), [leave]
    for i in range(len(roles) - 1, 0, -1):
        states.append(int(np.argmin(costs[i] + matrix(roles[i])[:, states[-1]])))
    return states[::-1]


def _segments(keys: list[str]) -> list[tuple[int, int]]:
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _roles(frame: pd.DataFrame) -> list[str | None]:
    return [r if r in ROLES else None for r in frame["role"].tolist()]


def _borders(frame: pd.DataFrame) -> pd.DataFrame:
    """The matrices of a block's first and last conversation."""
    frame = frame.sort_values("row")
    roles, cuts = _roles(frame), _segments(frame["ck"].tolist())
    rows = [(frame["ck"].iloc[a], frame["block"].iloc[0], summary(roles[a:b]).ravel().tolist()) for a, b in {cuts[0], cuts[-1]}]
    return pd.DataFrame(rows, columns=["ck", "block", "costs"])


def _chained(frame: pd.DataFrame) -> pd.DataFrame:
    """The states before and after each of a conversation's parts, and which part is the last."""
    frame = frame.sort_values("block")
    parts = [np.array(c).reshape(len(STATES), -1) for c in frame["costs"]]
    costs = [np.array([0.0] + [np.inf] * len(ROLES))]
    for p in parts:
        costs.append((costs[-1][:, None] + p).min(0))
    states = [int(np.argmin(costs[-1] + _end_costs()))]
    for i in range(len(parts) - 1, -1, -1):
        states.append(int(np.argmin(costs[i] + parts[i][:, states[-1]])))
    states.reverse()
    last = [False] * (len(parts) - 1) + [True]
    return pd.DataFrame({"block": frame["block"], "ck": frame["ck"], "enter": states[:-1], "leave": states[1:], "last": last})


def _opened(role: Column | str) -> Column:
    return F.concat(F.lit("<|"), F.lit(role) if isinstance(role, str) else role, F.lit("|>\n"))


CLOSED = "<|end|>\n"


def escaped(text: Column) -> Column:
    """The text without markers: a backslash more between < and |."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def rendered() -> Column:
    """What a turn adds to the rendering, from the columns before (the state in front of it), action, inserted, new_role, text,
    last (whether it ends its conversation) and appended (the empty turns behind it)."""
    empty = lambda roles: F.array_join(F.transform(F.filter(F.split(roles, ","), lambda r: r != ""), lambda r: F.concat(_opened(r), F.lit(CLOSED))), "")
    front = F.concat(F.when(F.col("before").isNotNull(), CLOSED).otherwise(""), empty(F.col("inserted")), _opened(F.col("new_role")))
    begin = F.when(F.col("action") == "merge", "\n").otherwise(front)
    end = F.when(F.col("last"), F.concat(F.lit(CLOSED), empty(F.col("appended")))).otherwise("")
    return F.concat(begin, escaped(F.coalesce("text", F.lit(""))), end)


DECIDED = "row long, before string, new_role string, action string, inserted string, appended string, last boolean, cost double"


def _decided(_key, frame: pd.DataFrame, borders: pd.DataFrame) -> pd.DataFrame:
    """The decisions of a block's turns; borders: the states around its first and last conversation."""
    frame = frame.sort_values("row")
    fixed = {b.ck: (b.enter, b.leave, b.last) for b in borders.itertuples()}
    roles, keys, rows = _roles(frame), frame["ck"].tolist(), frame["row"].tolist()
    made: list[tuple] = []
    for a, b in _segments(keys):
        own = roles[a:b]
        if keys[a] in fixed:
            enter, leave, last = fixed[keys[a]]
        else:
            start = np.array([0.0] + [np.inf] * len(ROLES))
            enter, leave, last = 0, int(np.argmin(_over(start, own)[-1] + _end_costs())), True
        before = enter
        for i, state in enumerate(path(own, enter, leave)):
            cost, action, inserted = step(own[i])[before][state]
            ends = bool(last and a + i == b - 1)
            after = _inserted(STATES[state])[LAST[0]] if ends and STATES[state] not in LAST else ()
            made.append((rows[a + i], STATES[before], STATES[state], action, ",".join(inserted), ",".join(after), ends, cost + INSERT * len(after)))
            before = state
    return pd.DataFrame(made, columns=[c.split()[0] for c in DECIDED.split(", ")])


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, new_role, action, inserted, appended, cost, rendered), one row a given turn: inserted and
    appended name empty turns. The renderings of a conversation in the order of its turns are the formatted conversation."""
    given = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    rows, n = numbered(given.withColumn("sum", F.xxhash64("text")), "conv_id", "turn", "role", "sum")
    size = max(ROWS_LEAST, min(ROWS_MOST, n // BLOCKS))
    roles = rows.select("row", F.expr(f"row div {size}").alias("block"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("ck"), "role")
    borders = roles.groupBy("block").applyInPandas(_borders, "ck string, block long, costs array<double>")
    chained = borders.groupBy("ck").applyInPandas(_chained, "block long, ck string, enter long, leave long, last boolean")
    decided = roles.groupBy("block").cogroup(chained.groupBy("block")).applyInPandas(_decided, DECIDED)
    both = rows.join(decided.hint("merge"), "row")
    return both.select("conv_id", "turn", "role", "new_role", "action", "inserted", "appended", "cost", rendered().alias("rendered"))


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
