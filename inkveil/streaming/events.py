"""Structured Streaming forms of the event operators and of the expiring secret store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import level


def read_events(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") -> DataFrame:
    """A stream of Parquet files; zoneless times are read as UTC so that they can carry a watermark."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_metrics(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and mean values by window and level; events later than `late` are let go."""
    kept = events.withWatermark("ts", late).withColumn("level", level(F.col("event_type")))
    return kept.groupBy(F.window("ts", width), "level").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def first_of_each(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


STORE_OUT = "vault_id string, op string, result string, size long"
STORE_STATE = "expires_ms long, state string, secret_hash string, purpose string"


def secret_store(ops: DataFrame, least_ms: int = 1_000, most_ms: int = 1_800_000) -> DataFrame:
    """Answers of a store keyed by vault_id to rows (vault_id, op, now_ms, ttl_ms, secret_hash, purpose, authorized, destination).

    ops are store, retrieve, revoke. Only keyed hashes reach the state, never a value, as state is written to disk.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None
        for frame in frames:
            out = []
            for r in frame.sort_values("now_ms").to_dict("records"):
                expired = held is not None and r["now_ms"] >= held[0]
                if r["op"] == "store":
                    held = [r["now_ms"] + min(max(int(r["ttl_ms"]), least_ms), most_ms), "ACTIVE", r["secret_hash"], r["purpose"]]
                    result = "STORED"
                elif held is None:
                    result = "DENIED_NOT_FOUND"
                elif r["op"] == "revoke":
                    held[1], result = "REVOKED", "REVOKED"
                elif not str(r["destination"]).startswith("LOCAL"):
                    result = "DENIED_REMOTE_DESTINATION"
                elif held[1] == "REVOKED":
                    result = "DENIED_REVOKED"
                elif expired:
                    result = "DENIED_EXPIRED"
                elif not r["authorized"]:
                    result = "DENIED_UNAUTHORIZED"
                else:
                    result = "GRANTED" if held[3] == r["purpose"] else "DENIED_PURPOSE_MISMATCH"
                out.append((key[0], r["op"], result, int(held is not None)))
            yield pd.DataFrame(out, columns=["vault_id", "op", "result", "size"])
        if held is not None:
            state.update(tuple(held))

    return ops.groupBy("vault_id").applyInPandasWithState(run, STORE_OUT, STORE_STATE, "append", GroupStateTimeout.NoTimeout)
