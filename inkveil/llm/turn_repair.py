"""Repair of conversation structure: the cheapest edits that make a conversation an optional system turn and pairs of user and assistant.

Edits. Keep 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty turn) 5. Blank turns and those whose role and text stood earlier
must go; a truncated turn that stays costs 5 more. Of the cheapest edits the least string of initials (D, I, K, R) counts.

Method. A conversation's edit lattice has a node for each place between its turns and each state of the roles so far (nothing, system,
user, assistant). A* goes over it with a queue keyed (cost plus heuristic, audit): the heuristic is the suffix sum of what is
unavoidable, 2 for each turn that must go and 2 for each truncated one, as deleting is the cheaper way out. That never
exceeds the true rest and falls by at most an edit's cost, so a node is settled when it is first taken from the queue, with its cheapest and least audit.

Long conversations. Turns are sorted over ranges by one exchange and numbered there; `block` turns of one conversation and range
are one block. A* runs in each block from every state it may be entered in to every state it may be left in. The blocks' results are then
put together in order, four paths at a time, of which the common beginning is final. So no task holds a conversation's turns; a task that
puts together holds a block and the audit. Repeated turns are found by an aggregate over (conversation, digest), which gives first places only.
The digest of the repaired turns is sequential by nature: turns come to one task in order, one at a time.

Order of turns: turn (nulls first), then role, then the text's first 256 code points, then the digest. Initials are first
code points of roles.

Defined results. Null role or text: one space. Null turns count in no gap. A null conv_id is a conversation. An empty role has no
initial: keeping it changes no state, and its neighbours are illegal pairs. Repeated rows are turns each, so all but the first are duplicates.
Conversations without turns, if named by `all_ids`: zeros, an empty audit, the empty string's digest. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, release
from ._shared import stash

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn of each initial, by the state before; what is missing is not allowed.
AFTER = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the only role of the two that may follow
NAME = {USER: "user", ASSISTANT: "assistant"}
BLOCK = 256


def damaged(turns: DataFrame) -> DataFrame:
    """Known faults, by crc32 of `conv_id:turn` modulo 20: dropped, emptied, without sentence ends, repeated, said by the user. Nulls: one space."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(name) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def ordered(turns: DataFrame) -> DataFrame:
    """Turns with `at`, their place (rising within a conversation, block after block), `said` (digest of role and text), blank and truncated; as a table."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("said"))
    order = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 256), "said", "tie"]  # ascending puts nulls first
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)  # equal rows may lie in several ranges
    core = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    cut = (core != "") & ~F.substring(core, -1, 1).isin(".", "!", "?")
    return stash(placed.select("conv_id", "turn", "role", "text", "said", (core == "").alias("blank"), cut.alias("truncated"), F.monotonically_increasing_id().alias("at")), "turns")


def _moves(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits of one turn. Codes: x must go; else the role's initial (s, u, a, o other, e none), upper case if truncated."""
    yield "D", DELETE, state
    if code == "x":
        return
    more, kind = (TRUNCATED if code.isupper() else 0), code.lower()
    if kind == "e":
        yield "K", KEEP + more, state
    elif kind in AFTER and state in AFTER[kind]:
        yield "K", KEEP + more, AFTER[kind][state]
    yield "R", REROLE + more, NEXT[state]


def search(codes: str, entry: int) -> dict[int, tuple[int, str]]:
    """A* over a block's lattice: cheapest cost and least audit for each state in which it may be left, entered in `entry`."""
    rest = [0] * (len(codes) + 1)
    for i in range(len(codes) - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if codes[i] == "x" else min(DELETE, KEEP + TRUNCATED) if codes[i].isupper() else 0)
    queue, done, out = [(rest[0], "", 0, entry)], set(), {}
    while queue:
        value, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(codes):
            out[state] = (value, audit)
            continue
        cost = value - rest[i]
        for edit, price, then in _moves(codes[i], state):
            if (i + 1, then) not in done:
                heapq.heappush(queue, (cost + price + rest[i + 1], audit + edit, i + 1, then))
        if (i, NEXT[state]) not in done:
            heapq.heappush(queue, (cost + INSERT + rest[i], audit + "I", i, NEXT[state]))
    return out


@lru_cache(maxsize=1 << 14)
def block_paths(codes: str) -> tuple[tuple[int, int, int, str], ...]:
    """(entry, exit, cost, audit) of a block."""
    return tuple((entry, left, cost, audit) for entry in range(4) for left, (cost, audit) in sorted(search(codes, entry).items()))


class Joiner:
    """Puts a conversation's blocks together: the best path into each state, their common beginning apart."""

    def __init__(self) -> None:
        self.settled: list[str] = []
        self.ends: dict[int, tuple[int, str]] = {NONE: (0, "")}

    def add(self, paths) -> None:
        best: dict[int, tuple[int, str]] = {}
        for entry, left, cost, audit in paths:
            if entry in self.ends:
                before = self.ends[entry]
                found = (before[0] + cost, before[1] + audit)
                best[left] = min(best.get(left, found), found)
        shared = len(os.path.commonprefix([audit for _, audit in best.values()]))
        self.settled.append(next(iter(best.values()))[1][:shared])
        self.ends = {state: (cost, audit[shared:]) for state, (cost, audit) in best.items()}

    def result(self) -> tuple[int, str]:
        missing = {NONE: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}  # turns to insert at the end
        cost, audit = min((cost + INSERT * missing[state], audit + "I" * missing[state]) for state, (cost, audit) in self.ends.items())
        return cost, "".join(self.settled) + audit


_LONG, _TEXT = pa.int64(), pa.string()
PATHS_ARROW = pa.schema(
    [("conv_id", _LONG), ("block", _LONG), ("n", _LONG), ("low", _LONG), ("high", _LONG), ("distinct", _LONG), ("first_role", _TEXT), ("last_role", _TEXT)]
    + [(c, _LONG) for c in ("blank", "duplicate", "truncated", "illegal")]
    + [("paths", pa.list_(pa.struct([("entry", _LONG), ("left", _LONG), ("cost", _LONG), ("audit", _TEXT)])))]
)
PATHS = "conv_id long, block long, n long, low long, high long, distinct long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, paths array<struct<entry: long, left: long, cost: long, audit: string>>"
COUNTS = ("n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PLAN_ARROW = pa.schema([("conv_id", _LONG), *((c, _LONG) for c in COUNTS), ("audit", _TEXT)])
PLAN = f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string"
DIGESTS_ARROW, DIGESTS = PLAN_ARROW.append(pa.field("repaired_sha256", _TEXT)), f"{PLAN}, repaired_sha256 string"
REPAIRED_ARROW = pa.schema([("conv_id", _LONG), ("place", _LONG), ("turn", _LONG), ("edit", _TEXT), ("role", _TEXT), ("text", _TEXT)])
REPAIRED = "conv_id long, place long, turn long, edit string, role string, text string"
LEGAL = {"su", "ua", "au"}


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
    release()


def _block(row: dict) -> dict:
    """A block's counts and paths from its turns in order and the places of first sayings."""
    firsts, codes, counts = set(row["firsts"]), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for t in row["turns"]:
        fault = "blank" if t["blank"] else "duplicate" if t["at"] not in firsts else "truncated" if t["truncated"] else None
        if fault:
            counts[fault] += 1
        initial = t["initial"] if t["initial"] in AFTER else "o" if t["initial"] else "e"
        codes.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
    numbers, roles = [t["turn"] for t in row["turns"] if t["turn"] is not None], [t["initial"] for t in row["turns"]]
    return counts | {
        "conv_id": row["conv_id"], "block": row["block"], "n": len(roles), "low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None, "distinct": len(set(numbers)),
        "first_role": roles[0], "last_role": roles[-1], "illegal": sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False)),
        "paths": [{"entry": e, "left": x, "cost": cost, "audit": audit} for e, x, cost, audit in block_paths("".join(codes))],
    }


class _Whole:
    """A conversation's row, block after block."""

    def __init__(self, conv_id: int | None):
        self.row = {"conv_id": conv_id, "n_turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.joiner, self.distinct, self.low, self.high, self.last_role = Joiner(), 0, None, None, None

    def add(self, block: dict) -> None:
        self.joiner.add([(p["entry"], p["left"], p["cost"], p["audit"]) for p in block["paths"]])
        for c in ("blank", "duplicate", "truncated", "illegal"):
            self.row[c] += block[c]
        self.row["n_turns"] += block["n"]
        self.row["illegal"] += self.last_role is not None and self.last_role + block["first_role"] not in LEGAL
        self.last_role = block["last_role"]
        if block["low"] is not None:
            self.distinct += block["distinct"] - (block["low"] == self.high)
            self.low, self.high = block["low"] if self.low is None else self.low, block["high"]

    def result(self) -> dict:
        cost, audit = self.joiner.result()
        return self.row | {"gaps": self.high - self.low + 1 - self.distinct if self.low is not None else 0, "cost": cost, "audit": audit}


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """From blocks sorted by conversation and number."""
    whole = None
    for batch in batches:
        for block in batch.to_pylist():
            if whole is None or whole.row["conv_id"] != block["conv_id"]:
                if whole is not None:
                    yield whole.result()
                whole = _Whole(block["conv_id"])
            whole.add(block)
    if whole is not None:
        yield whole.result()


def planned(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conversation of an `ordered` table: conv_id, n_turns, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    of = F.expr(f"at div {block}").alias("block")
    own = turns.select("conv_id", of, F.struct("at", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "truncated").alias("t"), F.lit(None).cast("long").alias("first"))
    firsts = turns.groupBy("conv_id", "said").agg(F.min("at").alias("at")).select("conv_id", of, F.lit(None).cast(own.schema["t"].dataType).alias("t"), F.col("at").alias("first"))
    blocks = own.unionByName(firsts).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("turns"), F.collect_list("first").alias("firsts"))
    paths = blocks.mapInArrow(lambda b: _in_batches((_block(row) for batch in b for row in batch.to_pylist()), PATHS_ARROW), PATHS)
    together = paths.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return together.mapInArrow(lambda b: _in_batches(_wholes(b), PLAN_ARROW), PLAN)


class _Replay:
    """Applies a conversation's audit to its turns as they come."""

    def __init__(self, plan: dict):
        self.plan, self.at, self.place, self.state = plan, 0, 0, NONE

    def _out(self, edit: str, role: str, text: str, turn: int | None) -> dict:
        self.place += 1
        return {"conv_id": self.plan["conv_id"], "place": self.place - 1, "turn": turn, "edit": edit, "role": role, "text": text}

    def inserted(self) -> Iterator[dict]:
        while self.plan["audit"][self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield self._out("I", NAME[self.state], "", None)

    def turn(self, row: dict) -> Iterator[dict]:
        yield from self.inserted()
        edit = self.plan["audit"][self.at]
        self.at += 1
        if edit == "R":
            self.state = NEXT[self.state]
            yield self._out(edit, NAME[self.state], row["text"], row["turn"])
        elif edit == "K":
            self.state = AFTER[row["role"][0]][self.state] if row["role"] else self.state
            yield self._out(edit, row["role"], row["text"], row["turn"])


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict | None]]:
    """(plan, repaired turn) in order, and (plan, None) at a conversation's end; a plan comes before its turns."""
    now = None
    for batch in chunks(batches):
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if now is not None:
                    yield from ((now.plan, out) for out in now.inserted())
                    yield now.plan, None
                now = _Replay(row)
            else:
                yield from ((now.plan, out) for out in now.turn(row))
    if now is not None:
        yield from ((now.plan, out) for out in now.inserted())
        yield now.plan, None


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    digest, first = hashlib.sha256(), True
    for plan, turn in _replayed(batches):
        if turn is None:
            yield {c: plan[c] for c in PLAN_ARROW.names} | {"repaired_sha256": digest.hexdigest()}
            digest, first = hashlib.sha256(), True
        else:
            digest.update(f"{'' if first else chr(10)}{turn['role']}:{turn['text']}".encode())
            first = False


def _with_plans(turns: DataFrame) -> DataFrame:
    """The turns of each conversation in order, its plan before them."""
    rows = ordered(turns)
    plans = planned(rows).withColumns({"at": F.lit(-1).cast("long"), "turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    both = plans.unionByName(rows.select("conv_id", "at", F.col("turn").cast("long").alias("turn"), "role", "text"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at")


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), turn (null if inserted), edit (K, R or I), role, text."""
    return _with_plans(turns).mapInArrow(lambda b: _in_batches((turn for _, turn in _replayed(b) if turn is not None), REPAIRED_ARROW), REPAIRED)


def digests(turns: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """Per conversation: conv_id, n_turns, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of `role:text`, joined by newlines)."""
    out = _with_plans(turns).mapInArrow(lambda b: _in_batches(_hashed(b), DIGESTS_ARROW), DIGESTS)
    if all_ids is None:
        return out
    joined = all_ids.select(F.col("conv_id").alias("id")).join(out, F.expr("id <=> conv_id"), "left")
    none = {**dict.fromkeys(COUNTS, F.lit(0)), "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return joined.select(F.col("id").alias("conv_id"), *(F.coalesce(c, v).alias(c) for c, v in none.items()))
