"""Queries on state over time: operations on vaults, made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vault
from ..streaming import ingest
from .catalog import query, table
from .derived import spread


def vault_ops(spark, sf):
    """Each event as an operation of its user's vault; what is asked for is an earlier event's entry, or its token."""
    e = table(spark, sf, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    kind = F.when(F.col("event_type").isin("signup", "view"), "store").when(F.col("event_type") == "click", "retrieve").when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "revoke").when(F.col("event_id") % 3 == 1, "expire").otherwise("has"))
    kind = F.when(F.col("event_id") % 97 == 0, "clear").otherwise(F.coalesce(kind, F.when(F.col("event_id") % 2 == 0, "register").otherwise("size")))
    last = "first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"
    target = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("T"), F.expr(last.format(2)).cast("string"))).otherwise(F.concat(F.lit("vault_"), F.expr(last.format(1)).cast("string")))
    return e.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("op_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), kind.alias("op"), target.alias("target"), F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("token"),
        F.when(F.col("event_id") % 31 > 0, "email").alias("category"), F.lit("P1").alias("pii_id"), F.sha2(F.col("props"), 256).alias("secret_hash"), F.length("props").alias("secret_length"), F.when(F.col("event_id") % 5 > 0, "login").otherwise("checkout").alias("purpose"),
        F.floor(F.col("value") * 100_000).cast("long").alias("ttl_ms"), F.when(F.col("event_id") % 11 > 0, "LOCAL_BROWSER").otherwise("REMOTE_SERVICE").alias("destination"), (F.col("event_id") % 13 > 0).alias("authorized"), F.when(F.col("event_id") % 17 == 0, "REDACT").alias("policy"),
    )


@query
def vault_replay(spark, sf):
    """The answer to each operation."""
    return vault.replay(vault_ops(spark, sf), keep_ms=86_400_000)


def event_lines(spark, sf):
    """Events as the lines a logger would send, some of them broken."""
    e = spread(table(spark, sf, "events").select("event_id", "event_type").where("event_type IS NOT NULL"))
    no = F.col("event_id").cast("string")
    payload = F.struct(
        F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("stage"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Warn-"), F.col("event_type"))).alias("category"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("event"),
        F.when(F.col("event_id") % 7 == 0, "debug").alias("level"), F.when(F.col("event_id") % 5 > 0, F.struct(F.concat(F.lit("s"), no).alias("password"), F.concat(F.lit("by u"), no, F.lit("@example.com")).alias("note"))).alias("data"),
        F.struct(F.concat(F.lit("v"), no).alias("apiKey")).alias("metadata"),
    )
    line = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit('{"stage": '), no)).when(F.col("event_id") % 13 == 0, no).otherwise(F.to_json(payload))
    return e.select("event_id", line.alias("line"))


@query
def event_ingest(spark, sf):
    """What becomes of each line: kept with defaults, level and scrubbed data, or why not."""
    return ingest.ingested(event_lines(spark, sf)).drop("line")
