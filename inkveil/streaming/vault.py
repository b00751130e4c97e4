"""The vault as a stream: operations wait in the state until the watermark has passed them, so they count in order of time across batches.

State is one row a session: its vault and what waits. A timeout in event time comes at the next waiting operation or the next
expiry, whichever is first, sweeps, and removes the session's state once nothing is left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.vault import KEEP_MS, OPS, OUT, Vault

FIELDS = [x.split()[0] for x in OPS.split(", ")]


def _plain(frames: Iterator[pd.DataFrame]) -> list[dict]:
    rows = [r for f in frames for r in f[FIELDS].astype(object).where(f[FIELDS].notna(), None).to_dict("records")]
    whole = lambda x: int(x) if x is not None else None
    return [{k: whole(v) if k in ("session", "op_id", "ms", "ttl_ms", "secret_length") else bool(v) if k == "authorized" and v is not None else v for k, v in r.items()} for r in rows]


def vault_stream(ops: DataFrame, late: str = "10 minutes", keep_ms: int = KEEP_MS) -> DataFrame:
    """Answers as of operators.vault.replay, once the watermark has passed an operation. Operations later than `late` are let go."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = state.get if state.exists else (None, "[]")
        vault, known = Vault(held, keep_ms), json.loads(waiting)
        if not state.hasTimedOut:
            known += _plain(frames)
        passed = state.getCurrentWatermarkMs()
        known.sort(key=lambda r: (r["ms"], r["op_id"]))
        now = [r for r in known if r["ms"] < passed]
        known = known[len(now) :]
        out = [vault.apply(r) for r in now]
        vault.sweep(passed)
        if vault.entries or known:
            state.update((vault.held(), json.dumps(known)))
            due = min([x for x in (vault.due(), known[0]["ms"] if known else None) if x is not None])
            state.setTimeoutTimestamp(max(due, passed) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    timed = ops.where("session IS NOT NULL AND ms IS NOT NULL").withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    return timed.groupBy("session").applyInPandasWithState(run, OUT, "vault string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
