"""Operator 3: minimum-cost repair of the roles of conversations, and their rendering.

Legal is an optional system turn, then user and assistant in turns, the user first. Each turn of the input is kept,
merged into the turn before, relabelled, or preceded by an empty turn of the other role; the least total cost is found
over the automaton of the last role. A stretch of turns is a min-plus matrix between automaton states, and matrices
chain: a long conversation is cut into stretches, whose matrices are chained before each stretch is solved between its
own two states. So no conversation has to fit into one task; a stretch has at most ``2**SHIFT`` turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowline.llm.common import pick
from stowline.session import cut_lineage

ROLES = ("system", "user", "assistant")
START = 3
MERGE, INSERT, RELABEL, NAME = 1.0, 2.0, 3.0, 0.5
NONE = float("inf")
END = "<|end|>\n"
SHIFT = 16


@lru_cache(maxsize=None)
def steps(role: str | None) -> tuple[tuple[tuple[float, str, int | None], ...], ...]:
    """For each state and each role of the output: (cost, action, inserted role) of taking one turn of ``role``.

    Costs: 1 to merge into a turn of the same role, 2 for an empty turn before it, 3 to relabel, 0.5 to name a turn
    whose role is unknown or null.
    """
    table = []
    for state in range(4):
        row = []
        for out in range(3):
            known = role in ROLES
            base, name = (0.0, "keep") if role == ROLES[out] else (RELABEL, "relabel") if known else (NAME, "name")
            legal = state == START and out in (0, 1) or state == 0 and out == 1 or state in (1, 2) and out == 3 - state
            if legal:
                row.append((base, name, None))
            elif state == out:
                row.append((base + MERGE, "merge" if name == "keep" else f"{name}, merge", None))
            elif out == 2 and state in (START, 0):
                row.append((base + INSERT, "insert" if name == "keep" else f"{name}, insert", 1))
            else:
                row.append((NONE, "", None))
            if state == out and out in (1, 2) and base + INSERT < row[-1][0]:
                row[-1] = (base + INSERT, "insert" if name == "keep" else f"{name}, insert", 3 - out)
        table.append(tuple(row))
    return tuple(table)


def matrix(roles: list[str | None]) -> list[float]:
    """Least cost from each of the four states to each output role, row by row."""
    out: list[float] = []
    for begin in range(4):
        cost = [NONE] * 4
        cost[begin] = 0.0
        for role in roles:
            table = steps(role)
            cost = [min(cost[s] + table[s][r][0] for s in range(4)) for r in range(3)] + [NONE]
        out += cost[:3]
    return out


def solve(roles: list[str | None], begin: int, end: int | None) -> tuple[float, list[tuple[str, int, int | None]]]:
    """Least cost and the (action, role, inserted) of each turn between two states; any end if ``end`` is None."""
    cost = [NONE] * 4
    cost[begin] = 0.0
    back: list[list[int]] = []
    for role in roles:
        table = steps(role)
        best = [min(range(4), key=lambda s, r=r: (cost[s] + table[s][r][0], s)) for r in range(3)]
        cost = [cost[best[r]] + table[best[r]][r][0] for r in range(3)] + [NONE]
        back.append(best)
    at = end if end is not None else min(range(3), key=lambda r: (cost[r], r))
    total, out = cost[at], []
    for role, best in zip(reversed(roles), reversed(back)):
        _, action, inserted = steps(role)[best[at]][at]
        out.append((action, at, inserted))
        at = best[at]
    return total, out[::-1]


def piece(action: str, role: int, inserted: int | None, text: str | None, first: bool, last: bool) -> str:
    """What a turn adds to the rendered conversation."""
    body = text or ""
    if action.endswith("merge"):
        head = "\n"
    else:
        empty = "" if inserted is None else f"<|{ROLES[inserted]}|>\n{END}"
        head = ("" if first else END) + empty + f"<|{ROLES[role]}|>\n"
    return head + body + (END if last else "")


def _chain(rows: list[tuple[int, list[float]]]) -> list[tuple[int, int, int]]:
    """(part, begin, end): the states between stretches on the cheapest way through a conversation."""
    cost, back = [NONE, NONE, NONE, 0.0], []
    for _, m in rows:
        best = [min(range(4), key=lambda s, r=r: (cost[s] + m[3 * s + r], s)) for r in range(3)]
        cost = [cost[best[r]] + m[3 * best[r] + r] for r in range(3)] + [NONE]
        back.append(best)
    at, out = min(range(3), key=lambda r: (cost[r], r)), []
    for (part, _), best in zip(reversed(rows), reversed(back)):
        out.append((part, best[at], at))
        at = best[at]
    return out[::-1]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, roles = None, []
    for batch in batches:
        out = []
        for conv, part, role in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "role"))):
            if (conv, part) != now:
                if roles:
                    out.append((*now, matrix(roles)))
                now, roles = (conv, part), []
            roles.append(role)
        yield _rows(out)
    yield _rows([(*now, matrix(roles))] if roles else [])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                                       pa.array([r[2] for r in out], pa.list_(pa.float64()))], ["conv", "part", "m"])


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, found in zip(batch.column("conv").to_pylist(), batch.column("found").to_pylist()):
            path = _chain([(x["part"], x["m"]) for x in found])
            out += [(conv, part, begin, end, i == len(path) - 1) for i, (part, begin, end) in enumerate(path)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["conv", "part", "begin", "end", "closing"])


OUT = ("conv", "turn", "place", "action", "role", "inserted", "piece")


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv", "part", "seq", "turn", "role", "text", "begin", "end", "closing")
    held: list[tuple] = []

    def close() -> list[tuple]:
        if not held:
            return []
        begin, end, closing = held[0][6:9]
        _, path = solve([r[4] for r in held], begin, end)
        out = []
        for i, (r, (action, role, inserted)) in enumerate(zip(held, path)):
            text = piece(action, role, inserted, r[5], begin == START and i == 0, closing and i == len(held) - 1)
            out.append((r[0], r[3], r[2], action, ROLES[role], None if inserted is None else ROLES[inserted], text))
        held.clear()
        return out

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], list(OUT))

    for batch in batches:
        done: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if held and held[0][:2] != row[:2]:
                done += close()
            held.append(row)
        yield batch_of(done)
    yield batch_of(close())


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, place, action, role, inserted, piece), one row per row.

    ``place`` orders the rows of a conversation (1 first), by turn, then role and text, null turns last; ``action`` is keep,
    merge, relabel, name or insert, or a pair of them; ``inserted`` is the role of an empty turn put before; the pieces of a
    conversation, joined by place, are its rendered text. Roles are compared in lower case without outer blanks; null
    and unknown ones are named. Of repairs of equal cost the one counts whose last role comes first among system, user and
    assistant, and so for each role before it. Null texts are empty; rows without conversation take no part; repeated rows are turns of
    their own; an empty table gives an empty one; other columns are ignored.
    """
    rows = pick(turns, conv=conv_id, turn=turn, role=role, text=text).where("conv IS NOT NULL").select(
        F.col("conv").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.lower(F.trim("role")).alias("role"), "text")
    keys = ["conv", F.col("turn").isNull().alias("late"), "turn", "role", F.xxhash64("text").alias("h")]
    spread = rows.select("*", *keys[1:2], keys[4]).withColumn("same", F.monotonically_increasing_id())
    order = ["conv", "late", "turn", "role", "h", "same"]
    # After the range sort, the id of a row grows with the order over all partitions: the partition's number in the upper
    # bits, the row's in the lower. What is above SHIFT bits numbers the stretch.
    table = cut_lineage(
        spread.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
        .select("conv", F.shiftright("seq", SHIFT).alias("part"), "seq", "turn", "role", "text")
    )
    parts = table.select("conv", "part", "seq", "role").repartition("conv", "part").sortWithinPartitions("conv", "part", "seq").mapInArrow(
        _matrices, "conv bigint, part bigint, m array<double>")
    bounds = cut_lineage(
        parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "m"))).alias("found"))
        .mapInArrow(_bounds, "conv bigint, part bigint, begin int, end int, closing boolean")
    )
    # A stretch must sit in one task when it is solved; the reader may have dealt its rows to several.
    whole = table.join(bounds, ["conv", "part"]).repartition("conv", "part").sortWithinPartitions("conv", "part", "seq")
    solved = whole.mapInArrow(
        _solved, "conv bigint, turn bigint, place bigint, action string, role string, inserted string, piece string")
    # Places: the number within the stretch, which is dense, after the rows of the conversation's earlier stretches.
    sizes = table.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("conv", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return solved.withColumn("part", F.shiftright("place", SHIFT)).join(shifts, ["conv", "part"]).select(
        F.col("conv").alias(conv_id), F.col("turn").alias(turn), (F.col("place") - F.col("first") + F.col("shift") + 1).alias("place"),
        "action", "role", "inserted", "piece")
