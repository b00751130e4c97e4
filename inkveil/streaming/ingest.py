"""Permissive ingest of telemetry lines: defaults, level and a recursive scrub; what is no JSON object goes to quarantine with its reason.

`ingested` judges a batch of lines. As a stream, each micro-batch overwrites folders of its own number, so a batch that runs
again, after a lost driver say, changes nothing; `ring` reads the last events back in order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import json_tree
from ..operators.events import level

# --- fixed values ---
MOST_EVENTS, NO_STAGE, NO_EVENT = 1000, "GENERAL", "EVENT"
# --- end of fixed values ---


def _text(v: Column, *names: str) -> Column:
    """The first of these members that is a string and not empty."""
    found = [F.try_variant_get(v, f"$.{n}", "string") for n in names]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def ingested(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with ok, reason, stage, event, level, data and metadata (scrubbed JSON); the latter five are null where ok is false."""
    others = [x for x in lines.columns if x != line]
    read = lines.select(*others, line, F.try_parse_json(line).alias("v"))
    has = F.try_variant_get("v", "$", "map<string,variant>").isNotNull()
    stage = F.upper(F.coalesce(_text(F.col("v"), "stage", "category"), F.lit(NO_STAGE)))
    member = lambda n: F.to_json(F.try_variant_get("v", f"$.{n}", "variant"))
    given = lambda x: F.when(~x.isin("null", "false", "0", '""'), x)
    data = F.coalesce(member("data"), given(member("payload")), F.lit("{}"))
    rows = read.select(
        *others, line, has.alias("ok"), F.when(F.col("v").isNull(), "NO_JSON").when(~has, "NO_OBJECT").alias("reason"), F.when(has, stage).alias("stage"),
        F.when(has, F.coalesce(_text(F.col("v"), "event", "action"), F.lit(NO_EVENT))).alias("event"), F.when(has, F.coalesce(_text(F.col("v"), "level"), level(stage))).alias("level"),
        F.when(has, data).alias("data"), F.when(has, F.coalesce(given(member("metadata")), F.lit("{}"))).alias("metadata"),
    )
    of_data, of_metadata = json_tree.depths(rows, "data", "metadata")
    return json_tree.scrubbed(json_tree.scrubbed(rows, "data", of_data), "metadata", of_metadata)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """A stream from a folder of lines to target/events and target/quarantine, a folder a batch; ends when all there is has been read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(source).withColumnRenamed("value", "line")
    return lines.writeStream.foreachBatch(lambda df, number: write(df, number, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write(lines: DataFrame, number: int, target: str) -> None:
    """One batch, whole or again."""
    rows = ingested(lines.select("line")).withColumn("at", F.monotonically_increasing_id())
    rows.where("ok").drop("line", "reason", "ok").write.mode("overwrite").parquet(f"{target}/events/batch={number}")
    rows.where("NOT ok").select("line", "reason", "at").write.mode("overwrite").parquet(f"{target}/quarantine/batch={number}")


def ring(spark: SparkSession, target: str, size: int = MOST_EVENTS) -> DataFrame:
    """The last events, by batch and place in it."""
    return spark.read.parquet(f"{target}/events").orderBy(F.desc("batch"), F.desc("at")).limit(size)
