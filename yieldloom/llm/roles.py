"""Minimum-cost repair of chat roles, and rendering of the repaired turns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import pin

#: States of the automaton: what the last message was. A legal conversation is system? (user assistant)+.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs of repairs. A role that is missing or unknown must be relabelled anyway, which then costs less.
MERGE, INSERT, RELABEL, NAME = 2, 3, 4, 1
FAR = 1 << 40
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
SCHEMA = "conv_id long, turn long, role string, new_role string, action string, rendered string"


def bridges() -> dict[tuple[int, int], tuple[int, ...]]:
    """Roles of the fewest empty messages that make a step from one state to a message of another legal."""
    out = {}
    for start in LEGAL:
        reached = {start: ()}
        ways = [start]
        while ways:
            at = ways.pop(0)
            for to in LEGAL[at]:
                if (start, to) not in out:
                    out[start, to] = reached[at]
                if to not in reached:
                    reached[to] = (*reached[at], to)
                    ways.append(to)
    return out


BRIDGES = bridges()


def steps(role: str | None) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, action) for a turn: it becomes a message or joins the last one, perhaps under another role."""
    own = NAMES.index(role) if role in NAMES[1:] else None
    out = []
    for to in (SYSTEM, USER, ASSISTANT):
        base, label = (0, "") if to == own else (NAME if own is None else RELABEL, "relabel")
        for at in range(4):
            if (at, to) in BRIDGES:
                gap = len(BRIDGES[at, to])
                out.append((at, to, base + INSERT * gap, "+".join(filter(None, (label, "insert" if gap else ""))) or "keep"))
            if at == to:
                out.append((at, to, base + MERGE, "+".join(filter(None, (label, "merge")))))
    return sorted(out, key=lambda s: (s[1], s[2], s[0], s[3]))


#: After the last turn: what must be inserted so that the conversation ends with the assistant.
CLOSING = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}


def forward(costs: list[int], role: str | None, table: dict) -> list[int]:
    new = [FAR] * 4
    for at, to, cost, _ in table[role if role in NAMES[1:] else None]:
        new[to] = min(new[to], costs[at] + cost)
    return new


def tables() -> dict:
    return {role: steps(role) for role in (*NAMES[1:], None)}


def path(entry: list[int], roles: list, end: int | None, table: dict) -> tuple[list[tuple[int, int, str]], int]:
    """Steps (from, to, action) of the cheapest way through the turns, and the state it entered in.

    ``end`` is the state after the last turn, None at a conversation's end. Going back from there, the smallest state
    and then the cheapest step is taken among equals, so ties have one answer however the turns are cut into slices.
    """
    costs = [entry]
    for role in roles:
        costs.append(forward(costs[-1], role, table))
    if end is None:
        end = min(range(4), key=lambda s: (costs[-1][s] + CLOSING[s], s))
    out, at = [], end
    for k in range(len(roles), 0, -1):
        moves = table[roles[k - 1] if roles[k - 1] in NAMES[1:] else None]
        came, _, _, action = min((s for s in moves if s[1] == at and costs[k - 1][s[0]] + s[2] == costs[k][at]), key=lambda s: (s[0], s[2], s[3]))
        out.append((came, at, action))
        at = came
    return out[::-1], at


def render(steps_taken: list[tuple[int, int, str]], texts: list, last: bool) -> Iterator[str]:
    """A fragment for each turn; a conversation's fragments in order are the whole chat."""
    for k, ((came, to, action), text) in enumerate(zip(steps_taken, texts)):
        if "merge" in action:
            piece = "\n" + (text or "")
        else:
            empty = "".join(OPEN.format(NAMES[r]) + "\n" + CLOSE for r in BRIDGES[came, to])
            piece = ("\n" + CLOSE if came != START else "") + empty + OPEN.format(NAMES[to]) + (text or "")
        if last and k == len(texts) - 1:
            piece += "\n" + CLOSE + {SYSTEM: OPEN.format("user") + "\n" + CLOSE, USER: ""}.get(to, "")
            piece += OPEN.format("assistant") + "\n" + CLOSE if to != ASSISTANT else ""
        yield piece


def slices(batches) -> Iterator[tuple[object, list]]:
    """(conv_id, rows) of a sorted partition."""
    key, rows, begun = None, [], False
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if begun and row[1] != key:
                yield key, rows
                rows = []
            key, begun = row[1], True
            rows.append(row)
    if begun:
        yield key, rows


def repair_roles(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, action, rendered (this turn's fragment of the chat).

    Dynamic programming over the automaton system? (user assistant)+ chooses, at least cost, between keeping a turn,
    relabelling it, merging it into the message before and inserting empty messages; an open end gets an empty answer.
    Turns are ordered by turn (null last), role and text; repeated rows are turns like others and ties have one answer.
    A null or unknown role is always relabelled, a null text counts as empty, null conv_ids form one conversation.

    Rows are range-partitioned by conversation and order, so a conversation of any length is spread over many tasks.
    What crosses a cut is a vector of four costs and a state per partition: the slices at the edges of partitions are
    summed up as min-plus matrices, joined on the driver (one row per partition, whatever the data), and each slice is
    then traced back on its own. Memory is bounded by one slice.
    """
    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim("role")).alias("clean"), "role", "text")
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("clean"), F.col("text"), F.col("role"), F.col("tie")]
    sorted_rows = ordered.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    cut = pin(sorted_rows.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "clean", "role", "text"))

    def edges(batches):
        """First and last conversation of a partition with the costs between all states."""
        table, first, last = tables(), None, None
        for conv, rows in slices(batches):
            last = (rows[0][0], conv, rows)
            first = first or last
        if first:
            whole = first is last
            for place, (part, conv, rows) in (("first", first), ("last", last)):
                matrix = []
                for s in range(4):
                    costs = [0 if t == s else FAR for t in range(4)]
                    for row in rows:
                        costs = forward(costs, row[3], table)
                    matrix += [min(c, FAR) for c in costs]
                yield pa.RecordBatch.from_pylist([{"part": part, "place": place, "conv_id": conv, "whole": whole, "matrix": matrix}], schema=EDGE)

    found: dict[int, dict] = {}
    for row in cut.mapInArrow(edges, "part int, place string, conv_id long, whole boolean, matrix array<long>").collect():
        found.setdefault(row["part"], {})[row["place"]] = row
    entry, open_end = entries(found)

    def maps(batches):
        """Of a slice that began in an earlier partition: the state it came in with, by final state, and for a conversation's end."""
        table = tables()
        for conv, rows in slices(batches):
            if (part := rows[0][0]) in entry:
                roles, start = [r[3] for r in rows], entry[part]
                reach = start
                for role in roles:
                    reach = forward(reach, role, table)
                came = [path(start, roles, s, table)[1] if reach[s] < FAR else -1 for s in range(4)]
                yield pa.RecordBatch.from_pylist([{"part": part, "came": [*came, path(start, roles, None, table)[1]]}], schema=MAP)
            break  # only the first conversation can have begun before

    back = {r["part"]: r["came"] for r in cut.mapInArrow(maps, "part int, came array<long>").collect()} if entry else {}
    final = endings(found, open_end, back)

    def trace(batches):
        table, seen = tables(), False
        held = None

        def repaired(conv, rows, is_last):
            part = rows[0][0]
            start = entry.get(part, FRESH) if not seen else FRESH
            end = final.get(part) if is_last and part in open_end else None
            steps_taken, _ = path(start, [r[3] for r in rows], end, table)
            pieces = render(steps_taken, [r[5] for r in rows], end is None)
            columns = zip(*[(conv, r[2], r[4], NAMES[to], action, piece) for r, (_, to, action), piece in zip(rows, steps_taken, pieces)])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, OUT.types)], schema=OUT)

        for conv, rows in slices(batches):
            if held:
                yield repaired(*held, False)
                seen = True
            held = conv, rows
        if held:
            yield repaired(*held, True)

    return cut.mapInArrow(trace, SCHEMA)


FRESH = [0, FAR, FAR, FAR]
EDGE = pa.schema([("part", pa.int32()), ("place", pa.string()), ("conv_id", pa.int64()), ("whole", pa.bool_()), ("matrix", pa.list_(pa.int64()))])
MAP = pa.schema([("part", pa.int32()), ("came", pa.list_(pa.int64()))])
OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("rendered", pa.string())])


def times(costs: list[int], matrix: list[int]) -> list[int]:
    return [min(FAR, *(costs[s] + matrix[4 * s + t] for s in range(4))) for t in range(4)]


def entries(found: dict[int, dict]) -> tuple[dict[int, list[int]], dict[int, bool]]:
    """Costs with which a partition's first conversation comes in, where it began before; and the partitions whose

    last conversation goes on in the next one (True: it is their only one, so it may have begun before, too).
    """
    parts = sorted(found)
    entry, open_end = {}, {}
    for before, part in zip(parts, parts[1:]):
        last = found[before]["last"]
        if last["conv_id"] == found[part]["first"]["conv_id"]:
            start = entry.get(before, FRESH) if last["whole"] else FRESH
            entry[part], open_end[before] = times(start, last["matrix"]), last["whole"]
    return entry, open_end


def endings(found: dict[int, dict], open_end: dict[int, bool], back: dict[int, list[int]]) -> dict[int, int]:
    """The state in which each slice that goes on must end, traced back from the conversations' ends."""
    final: dict[int, int] = {}
    parts = sorted(found)
    for before, part in reversed([*zip(parts, parts[1:])]):
        if before in open_end:
            goes_on = found[part]["first"]["whole"] and part in open_end
            final[before] = back[part][final[part] if goes_on else 4]
    return final
