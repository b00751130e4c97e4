"""The vault: its rules, a plain replay of events, and the stream against the batch."""

from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkveil.operators import vault
from inkveil.plans import state
from inkveil.streaming import vault as streaming

SF = "/root/testdata/sf0.001"


def op(ms, kind, target=None, **more):
    base = {"session": 1, "op_id": ms, "ms": ms, "op": kind, "target": target, "token": None, "category": "email", "pii_id": "P", "secret_hash": "h", "secret_length": 5, "purpose": "login", "ttl_ms": 5000, "destination": "LOCAL_BROWSER", "authorized": True, "policy": None}
    return base | more


def results(*ops, keep_ms=10_000):
    v = vault.Vault(keep_ms=keep_ms)
    return [v.apply(o)["result"] for o in ops], v


@pytest.mark.parametrize(
    "more,want",
    [
        ({}, "GRANTED"), ({"category": " "}, "DENIED_INVALID_REQUEST"), ({"pii_id": None}, "DENIED_INVALID_REQUEST"), ({"secret_length": 0}, "DENIED_INVALID_REQUEST"), ({"secret_length": 10_001}, "DENIED_INVALID_REQUEST"), ({"purpose": "fun"}, "DENIED_INVALID_REQUEST"),
        ({"destination": "REMOTE_SERVICE"}, "DENIED_REMOTE_DESTINATION"), ({"authorized": False}, "DENIED_UNAUTHORIZED"), ({"authorized": None}, "GRANTED"), ({"policy": "REDACT"}, "DENIED_INVALID_REQUEST"),
    ],
)
def test_store(more, want):
    assert results(op(1, "store", **more))[0] == [want]


def test_access_and_life():
    got, v = results(
        op(1, "store", token="T"), op(2, "retrieve", "T"), op(3, "retrieve", "vault_1", purpose="checkout"), op(4, "retrieve", "vault_1", authorized=False), op(5, "retrieve", "T", destination="REMOTE"), op(6, "retrieve", "nope"),
        op(7, "has", "T"), op(8, "register", "vault_1", token="U"), op(9, "retrieve", "U"), op(5000, "has", "U"), op(5001, "retrieve", "U"), op(5002, "has", "T"), op(15_001, "retrieve", "T"),
    )
    assert got == ["GRANTED", "GRANTED", "DENIED_PURPOSE_MISMATCH", "DENIED_UNAUTHORIZED", "DENIED_REMOTE_DESTINATION", "DENIED_NOT_FOUND", "TRUE", "REGISTERED", "GRANTED", "TRUE", "DENIED_EXPIRED", "FALSE", "DENIED_NOT_FOUND"]
    assert v.entries == {} and v.tokens == {} and v.due() is None


def test_revoke_expire_clear_and_no_secret_left():
    got, v = results(op(1, "store"), op(2, "revoke", "vault_1"), op(3, "retrieve", "vault_1"), op(4, "store"), op(5, "expire", "vault_4"), op(6, "retrieve", "vault_4"), op(7, "revoke", "x"))
    assert got == ["GRANTED", "REVOKED", "DENIED_REVOKED", "GRANTED", "EXPIRED", "DENIED_EXPIRED", "DENIED_NOT_FOUND"] and all(e[2] is None for e in v.entries.values())
    v.apply(op(8, "clear"))
    assert v.entries == {}


def test_capacity_and_bounds_of_life():
    got, v = results(*[op(i, "store", ttl_ms=10**9) for i in range(1, 102)])
    assert got[:100] == ["GRANTED"] * 100 and got[100] == "DENIED_INVALID_REQUEST" and v.size() == 100
    assert {e[0] - i for i, e in enumerate(v.entries.values(), 1)} == {vault.MOST_TTL_MS}
    assert next(iter(results(op(1, "store", ttl_ms=1))[1].entries.values()))[0] == 1 + vault.LEAST_TTL_MS
    assert next(iter(results(op(1, "store", ttl_ms=None))[1].entries.values()))[0] == 1 + vault.DEFAULT_TTL_MS


def replayed(rows, keep_ms):
    vaults, out = defaultdict(lambda: vault.Vault(keep_ms=keep_ms)), {}
    for r in sorted(rows, key=lambda r: (r["ms"], r["op_id"])):
        out[r["op_id"]] = tuple(vaults[r["session"]].apply(r).values())
    return out


def test_replay_of_events(spark):
    ops = state.vault_ops(spark, SF)
    want = replayed([r.asDict() for r in ops.collect()], 86_400_000)
    got = {r["op_id"]: tuple(r) for r in vault.replay(ops.repartition(5), 86_400_000).collect()}
    assert got == want
    assert {"GRANTED", "DENIED_NOT_FOUND", "DENIED_EXPIRED", "DENIED_REMOTE_DESTINATION"} <= set(Counter(r[4] for r in got.values()))


def test_stream_equals_batch_and_state_shrinks(spark, tmp_path):
    ops = state.vault_ops(spark, SF).orderBy("ms").limit(300).cache()
    last = ops.agg(F.max("ms")).first()[0]
    # Four batches; operations of one time lie in several of them.
    ranked = ops.toPandas()
    ranked["batch"] = ((ranked["ms"] + ranked["op_id"] % 3 * 900_000).rank(pct=True) * 3.999).astype(int)
    end = ranked.iloc[[0]].assign(session=-1, op_id=-1, ms=last + 10**9, op="size", batch=4)
    after = end.assign(op_id=-2, ms=last + 2 * 10**9, batch=5)
    rows = pd.concat([ranked, end, after])
    for i in range(6):
        own = rows[rows["batch"] == i].drop(columns="batch")
        spark.createDataFrame([tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in own.itertuples(index=False)], vault.OPS).coalesce(1).write.parquet(str(tmp_path / f"{i}"))
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(vault.OPS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = streaming.vault_stream(stream, late="90 minutes", keep_ms=3_600_000).writeStream.format("memory").queryName("vaults").outputMode("append").start()
    sizes = []
    try:
        for i in range(6):
            for f in (tmp_path / f"{i}").glob("*.parquet"):
                f.rename(folder / f"{i}-{f.name}")
            query.processAllAvailable()
            sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        query.stop()
    got = {r["op_id"]: tuple(r) for r in spark.table("vaults").where("op_id >= 0").collect()}
    assert got == replayed([r.asDict() for r in ops.collect()], 3_600_000)
    assert max(sizes[:4]) >= 3 and sizes[-1] <= 1
