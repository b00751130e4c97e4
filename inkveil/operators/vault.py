"""A vault for each session: secrets by purpose with expiry, tokens that stand for them, and what an access is answered.

Operations of a session count in order of time, then number. An entry expires at its time to live, within bounds, and is swept away `keep_ms`
after that; tokens go with their entry. A session holds MOST_ENTRIES entries at most, so its state is bounded, and only hashes of secrets reach
the state. `replay` folds a table in one sorted pass, one operation at a time whatever a session's length; the stream in
streaming/vault.py folds the same way as time passes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# --- fixed values ---
DEFAULT_TTL_MS, MOST_TTL_MS, LEAST_TTL_MS, MOST_ENTRIES, MOST_SECRET = 300_000, 1_800_000, 1_000, 100, 10_000
PURPOSES = ["LOGIN", "FORM_FILL", "CHECKOUT", "VERIFY_IDENTITY", "CONTACT", "SEARCH", "LOCAL_ACTION"]
LOCAL = ["LOCAL_BROWSER", "LOCAL_EXTENSION"]
# --- end of fixed values ---
KEEP_MS = 1_800_000

#: op: store, retrieve, revoke, expire, has, clear, size, register. target: a vault id or a token; token: given to what is stored or registered.
OPS = (
    "session long, op_id long, ms long, op string, target string, token string, category string, pii_id string, secret_hash string, secret_length int, purpose string, ttl_ms long, destination string, authorized boolean, policy string"
)
OUT = "session long, op_id long, op string, vault_id string, result string, size long"
OUT_ARROW = pa.schema([("session", pa.int64()), ("op_id", pa.int64()), ("op", pa.string()), ("vault_id", pa.string()), ("result", pa.string()), ("size", pa.int64())])


class Vault:
    """One session's entries, by id: [expires, state, secret hash, purpose, uses]; and tokens to ids."""

    def __init__(self, held: str | None = None, keep_ms: int = KEEP_MS):
        self.entries, self.tokens = json.loads(held) if held else ({}, {})
        self.keep_ms = keep_ms

    def held(self) -> str:
        return json.dumps([self.entries, self.tokens])

    def sweep(self, now: int) -> None:
        """Expires what is due, its secret gone at once, and drops what has been over for keep_ms."""
        for vault_id, e in list(self.entries.items()):
            if e[1] == "ACTIVE" and now >= e[0]:
                e[1], e[2] = "EXPIRED", None
            if now >= e[0] + self.keep_ms:
                del self.entries[vault_id]
        self.tokens = {t: i for t, i in self.tokens.items() if i in self.entries}

    def due(self) -> int | None:
        """When the next entry expires or goes."""
        return min((e[0] if e[1] == "ACTIVE" else e[0] + self.keep_ms for e in self.entries.values()), default=None)

    def size(self) -> int:
        return sum(e[1] == "ACTIVE" for e in self.entries.values())

    def apply(self, op: dict) -> dict:
        self.sweep(op["ms"])
        vault_id = op["target"] if op["target"] in self.entries else self.tokens.get(op["target"])
        e = self.entries.get(vault_id)
        if op["op"] == "store":
            result = self._refused(op) or "GRANTED"
            vault_id = None
            if result == "GRANTED":
                vault_id = f"vault_{op['op_id']}"
                ttl = min(MOST_TTL_MS, max(LEAST_TTL_MS, op["ttl_ms"] or DEFAULT_TTL_MS))
                self.entries[vault_id] = [op["ms"] + ttl, "ACTIVE", op["secret_hash"], op["purpose"].upper(), 0]
                if op["token"]:
                    self.tokens[op["token"]] = vault_id
        elif op["op"] == "clear":
            self.entries, self.tokens, vault_id, result = {}, {}, None, "CLEARED"
        elif op["op"] == "size":
            vault_id, result = None, "SIZE"
        elif e is None:
            vault_id, result = None, "DENIED_NOT_FOUND"
        elif op["op"] == "revoke":
            e[1], e[2], result = "REVOKED", None, "REVOKED"
        elif op["op"] == "expire":
            e[0], e[1], e[2], result = min(e[0], op["ms"]), "EXPIRED", None, "EXPIRED"
        elif op["op"] == "register":
            result = "REGISTERED" if op["token"] else "DENIED_INVALID_REQUEST"
            if op["token"]:
                self.tokens[op["token"]] = vault_id
        elif op["op"] == "has":
            result = "TRUE" if e[1] == "ACTIVE" else "FALSE"
        else:
            result = self._access(e, op)
        return {"session": op["session"], "op_id": op["op_id"], "op": op["op"], "vault_id": vault_id, "result": result, "size": self.size()}

    def _refused(self, op: dict) -> str | None:
        blank = lambda x: not (x or "").strip()
        if blank(op["category"]) or blank(op["pii_id"]) or not op["secret_hash"] or not 0 < (op["secret_length"] or 0) <= MOST_SECRET or (op["purpose"] or "").upper() not in PURPOSES:
            return "DENIED_INVALID_REQUEST"
        if op["destination"] not in LOCAL:
            return "DENIED_REMOTE_DESTINATION"
        if op["authorized"] is False:
            return "DENIED_UNAUTHORIZED"
        return "DENIED_INVALID_REQUEST" if op["policy"] == "REDACT" or len(self.entries) >= MOST_ENTRIES else None

    def _access(self, e: list, op: dict) -> str:
        if op["destination"] not in LOCAL:
            return "DENIED_REMOTE_DESTINATION"
        if e[1] != "ACTIVE":
            return f"DENIED_{e[1]}"
        if not op["authorized"]:
            return "DENIED_UNAUTHORIZED"
        if (op["purpose"] or "").upper() != e[3]:
            return "DENIED_PURPOSE_MISMATCH"
        e[4] += 1
        return "GRANTED"


def replay(ops: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """An answer to each operation, and how many entries are active after it. Rows without session or time are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vault = None, None
        for batch in batches:
            out = []
            for op in batch.to_pylist():
                if vault is None or op["session"] != now:
                    now, vault = op["session"], Vault(keep_ms=keep_ms)
                out.append(vault.apply(op))
            if out:
                yield pa.RecordBatch.from_pylist(out, OUT_ARROW)

    rows = ops.where("session IS NOT NULL AND ms IS NOT NULL").select(*[x.split()[0] for x in OPS.split(", ")])
    return rows.repartition("session").sortWithinPartitions("session", "ms", "op_id").mapInArrow(run, OUT)
