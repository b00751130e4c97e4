"""How well scores tell classes apart: precision, recall and average precision by class, and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.when(whole > 0, part / whole), F.lit(0.0))


def evaluated(scores: DataFrame, buckets: int = 64) -> DataFrame:
    """(class, support, predicted, hits, precision, recall, ap); class null is the whole: sums of counts, plain means of the rest.

    scores: class, score, hit (the class is the row's true one), chosen (the class was predicted). Rows without class or with a null or NaN score
    count in support, predicted and hits but have no rank. Equal scores are one threshold. A class without positives has average precision and
    recall 0, one never predicted precision 0. No rows: only the whole, of zeros.

    Scores of a class are cut into buckets at quantiles of all scores, ranked within a bucket and shifted by what the buckets above hold, so
    that a class may hold any share of the rows; equal scores meet as one row before that.
    """
    hit, chosen = F.coalesce("hit", F.lit(False)), F.coalesce("chosen", F.lit(False))
    rows = scores.select(F.col("class"), F.col("score").cast("double").alias("score"), hit.alias("hit"), chosen.alias("chosen")).where(F.col("class").isNotNull())
    counts = rows.groupBy("class").agg(F.count_if("hit").alias("support"), F.count_if("chosen").alias("predicted"), F.count_if(F.col("hit") & F.col("chosen")).alias("hits"))

    ranked = rows.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("class", "score").agg(F.count_if("hit").alias("tp"), F.count("*").alias("n"))
    found = rows.agg(F.percentile_approx("score", [i / buckets for i in range(1, buckets)])).first()[0] or []
    bounds = F.array(*[F.lit(float(b)) for b in sorted(set(found))]).cast("array<double>")
    ranked = ranked.withColumn("bucket", F.size(F.filter(bounds, lambda b: b > F.col("score"))))
    above = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = ranked.groupBy("class", "bucket").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    held = held.select("class", "bucket", F.coalesce(F.sum("tp").over(above), F.lit(0)).alias("tp_above"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"))
    upto = Window.partitionBy("class", "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranked.select("class", "bucket", "tp", F.sum("tp").over(upto).alias("tp_upto"), F.sum("n").over(upto).alias("n_upto")).where("tp > 0").join(held, ["class", "bucket"])
    area = placed.groupBy("class").agg(F.sum(F.col("tp") * (F.col("tp_upto") + F.col("tp_above")) / (F.col("n_upto") + F.col("n_above"))).alias("area"))

    rates = counts.join(area, "class", "left").select(
        "class", "support", "predicted", "hits",
        _share(F.col("hits"), F.col("predicted")).alias("precision"), _share(F.col("hits"), F.col("support")).alias("recall"), _share(F.col("area"), F.col("support")).alias("ap"),
    )
    sums, means = ("support", "predicted", "hits"), ("precision", "recall", "ap")
    whole = rates.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sums], *[F.coalesce(F.avg(x), F.lit(0.0)).alias(x) for x in means])
    return rates.unionByName(whole, allowMissingColumns=True)
