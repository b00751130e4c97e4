"""Event telemetry: levels, filters, rings, run lengths, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level(stage: Column) -> Column:
    up = F.upper(stage)
    return F.when(up.contains("ERROR") | up.contains("FAIL"), "error").when(up.contains("WARN"), "warn").otherwise("info")


def since(events: DataFrame, event_id: int, stage: str) -> DataFrame:
    return events.where((F.col("event_id") > event_id) & (F.upper("event_type") == stage.upper()))


def ring(events: DataFrame, size: int = 1000) -> DataFrame:
    """The last `size` events: a distributed top-k, no global sort."""
    return events.orderBy(F.desc("event_id")).limit(size)


def repeats(actions: DataFrame, session: str, order: list[str], what: str, times: int = 3) -> DataFrame:
    """actions with `looping`: the same action `times` times in a row by then."""
    w = Window.partitionBy(session).orderBy(*order)
    same = F.lit(True)
    for k in range(1, times):
        same = same & F.lag(what, k).over(w).eqNullSafe(F.col(what)) & F.lag(F.lit(1), k).over(w).isNotNull()
    return actions.withColumn("looping", same)


def failure_runs(actions: DataFrame, session: str, order: list[str], failed: Column, least: int = 3) -> DataFrame:
    """(session, first, run) of the stretches of at least `least` failures in a row; first: the order key of the first."""
    w = Window.partitionBy(session).orderBy(*order)
    marked = actions.withColumn("failed", failed).withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    runs = marked.where("failed").groupBy(session, "island").agg(F.min(order[0]).alias("first"), F.count("*").alias("run"))
    return runs.where(F.col("run") >= least).select(session, "first", "run")


def budget_spent(actions: DataFrame, session: str, order: list[str], counted: Column, most: int) -> DataFrame:
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return actions.withColumn("used", F.sum(counted.cast("long")).over(w)).withColumn("exhausted", F.col("used") >= most)


def halted(actions: DataFrame, session: str, order: list[str], denied: Column) -> DataFrame:
    """actions with `executed`: false from the first denial of the session on."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return actions.withColumn("executed", ~F.bool_or(denied).over(w))


def last_n(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("back") <= n)
