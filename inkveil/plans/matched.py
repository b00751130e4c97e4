"""Queries that match by value: nearest brackets of prices, candidates of constraint sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from .catalog import query, table


@query
def nearest_bracket(spark, sf):
    """The bracket of each order line's unit price; brackets are limits and ranges about the prices of some parts."""
    part = table(spark, sf, "part").where("p_retailprice IS NOT NULL")
    low = F.floor("p_retailprice").cast("double")
    limits = part.where("p_partkey % 40 = 0").select(F.col("p_partkey").alias("bracket_id"), F.col("p_partkey").alias("pos"), F.lit(None).cast("double").alias("low"), low.alias("high"))
    ranges = part.where("p_partkey % 40 = 7").select(F.col("p_partkey").alias("bracket_id"), (-F.col("p_partkey")).alias("pos"), low.alias("low"), (low + F.col("p_size")).alias("high"))
    price = F.when(F.col("l_quantity") > 0, F.col("l_extendedprice") / F.col("l_quantity"))
    targets = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", price.alias("value"))
    return matching.nearest_bracket(targets, limits.unionByName(ranges))


@query
def constraint_division(spark, sf):
    """For each customer's constraints on price, size and brand: how many parts break none."""
    c = table(spark, sf, "customer")
    rows = F.array(
        F.struct(F.lit("price").alias("name"), F.lit("<=").alias("operator"), (900 + F.col("c_custkey") % 97).cast("string").alias("value")),
        F.struct(F.lit("size").alias("name"), F.lit(">=").alias("operator"), (F.col("c_custkey") % 40).cast("string").alias("value")),
        F.when(F.col("c_custkey") % 3 == 0, F.struct(F.lit("brand").alias("name"), F.lit("=").alias("operator"), F.concat(F.lit("BRAND#"), (1 + F.col("c_nationkey") % 9).cast("string")).alias("value"))),
        F.when(F.col("c_custkey") % 5 == 0, F.struct(F.lit("price").alias("name"), F.lit(">=").alias("operator"), F.lit("910").alias("value"))),
    )
    constraints = c.select(F.col("c_custkey").alias("set_id"), F.explode(F.array_compact(rows)).alias("x")).select("set_id", "x.*")
    part = table(spark, sf, "part")
    missing = lambda column, k: F.when(F.col("p_partkey") % 50 != k, F.col(column))
    candidates = part.select(F.col("p_partkey").alias("candidate_id"), missing("p_retailprice", 1).alias("price"), missing("p_size", 2).alias("size"), missing("p_brand", 3).alias("brand"))
    return matching.division(constraints, candidates, ["price", "size"], ["brand"])
