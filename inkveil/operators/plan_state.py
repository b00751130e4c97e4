"""The state of running plans: tasks completed, put before the current one, or replaced from it on.

Operations of a session count in order of time, then number; each `start` begins a new run, which is folded apart from the others, so a long
session spreads over many tasks. A run holds its open tasks only: a task that lies before the current one never moves again and is given out at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ---
INSERTED, REPLANNED = ("adaptive_step", "Adaptive browser step"), ("step", "Step")  # type and description of a task that says neither
COMPLETED, PENDING = "completed", "pending"
# --- end of fixed values ---

#: op: start, complete, insert, replace; any other leaves the plan as it is. tasks: the plan of start and replace, the first is what insert puts in.
STATES = "session long, run long, op_id long, op string, task_type string, task_description string, total long, completed long, pending long"
STATES_ARROW = pa.schema([(n, pa.string() if n in ("op", "task_type", "task_description") else pa.int64()) for n in (f.split()[0] for f in STATES.split(", "))])
TASKS = "session long, run long, pos long, type string, description string, status string"
TASKS_ARROW = pa.schema([("session", pa.int64()), ("run", pa.int64()), ("pos", pa.int64()), ("type", pa.string()), ("description", pa.string()), ("status", pa.string())])


class Plan:
    """One run: its open tasks with the current one last, the number of tasks before them, and how far completions went past the end."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str]] = []
        self.before = self.completed = self.beyond = 0

    def _settle(self, task: tuple[str, str], status: str) -> tuple[int, str, str, str]:
        self.before += 1
        return (self.before - 1, *task, status)

    def apply(self, op: str | None, tasks: list[dict | None] | None) -> list[tuple[int, str, str, str]]:
        """Position, type, description and status of the tasks that the operation settles."""
        other = INSERTED if op == "insert" else REPLANNED
        given = [((t or {}).get("type") or other[0], (t or {}).get("description") or other[1]) for t in tasks or []]
        if op == "complete":
            if self.open:
                self.completed += 1
                return [self._settle(self.open.pop(), COMPLETED)]
            self.beyond += 1
        elif op == "insert":
            task = given[0] if given else other
            if self.beyond:  # it lands before the place that completions have reached, so nobody will take it up
                self.beyond -= 1
                return [self._settle(task, PENDING)]
            self.open.append(task)
        elif op in ("start", "replace"):
            self.open, self.beyond = given[::-1], 0
        return []

    def rest(self) -> list[tuple[int, str, str, str]]:
        return [self._settle(t, PENDING) for t in self.open[::-1]]

    def current(self) -> tuple[str | None, str | None]:
        return self.open[-1] if self.open else (None, None)

    def total(self) -> int:
        return self.before + len(self.open)


def _runs(ops: DataFrame) -> DataFrame:
    order = Window.partitionBy("session").orderBy("at", "op_id")
    rows = ops.where("session IS NOT NULL AND at IS NOT NULL").select("session", "op_id", "at", "op", "tasks")
    rows = rows.withColumn("run", F.count_if(F.coalesce(F.col("op") == "start", F.lit(False))).over(order))
    return rows.repartition("session", "run").sortWithinPartitions("session", "run", "at", "op_id").select("session", "run", "op_id", "op", "tasks")


def _folded(ops: DataFrame, step: Callable, end: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, plan = None, Plan()
        for batch in batches:
            out = []
            for op in batch.to_pylist():
                key = (op["session"], op["run"])
                if key != now:
                    out += [(*now, *r) for r in end(plan)] if now else []
                    now, plan = key, Plan()
                out += [(*key, *r) for r in step(plan, op)]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], arrow)
        left = [(*now, *r) for r in end(plan)] if now else []
        if left:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in left], arrow)

    return _runs(ops).mapInArrow(run, schema)


def states(ops: DataFrame) -> DataFrame:
    """The current task after each operation (null past the end), and how many tasks the plan has, completed and not.

    ops: session, op_id, at, op, tasks (array of struct<type, description>); further columns are left out, as are rows without session or time.
    Operations before a session's first start are run 0, whose plan starts empty. Repeated rows are operations of their own.
    """

    def step(plan: Plan, op: dict) -> list[tuple]:
        plan.apply(op["op"], op["tasks"])
        return [(op["op_id"], op["op"], *plan.current(), plan.total(), plan.completed, plan.total() - plan.completed)]

    return _folded(ops, step, lambda plan: [], STATES, STATES_ARROW)


def tasks(ops: DataFrame) -> DataFrame:
    """Each run's tasks as its last operation leaves them, by position from 0. ops as for `states`."""
    return _folded(ops, lambda plan, op: plan.apply(op["op"], op["tasks"]), Plan.rest, TASKS, TASKS_ARROW)
