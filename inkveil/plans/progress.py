"""Queries on what has become of plans and goals, and on how well scores tell classes apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import completion, evaluation, goals, plan_state, recovery
from .catalog import query, table
from .derived import derived, fed, pick
from .spoken import GOALS

CURRENT = f"{pick('goal_id', None, 'about:blank', 'https://www.YouTube.com/watch', 'chrome://newtab', 'https://shop.example/', 'https://example.org/a')} AS current"


def plan_ops(spark, sf):
    """Each event as an operation on its user's plan."""
    ops = derived(spark, sf, "plan_ops")
    named = F.transform("types", lambda t: F.struct(t.alias("type"), F.concat(t, F.lit(" of "), F.col("op_id").cast("string")).alias("description")))
    return ops.select("session", "op_id", F.col("moment").alias("at"), "op", named.alias("tasks"))


@query
def plan_states(spark, sf):
    """The current task and the counts of the plan after each operation."""
    return plan_state.states(plan_ops(spark, sf))


@query
def plan_tasks(spark, sf):
    """The tasks of each run as its last operation leaves them."""
    return plan_state.tasks(plan_ops(spark, sf))


def goal_inputs(spark, sf):
    """Goals of orders, and of their lines actions, tasks and candidates."""
    goals, candidates = derived(spark, sf, "checked_goals"), derived(spark, sf, "goal_candidates")
    one = F.struct(F.col("c_name").alias("name"), F.col("c_operator").alias("operator"), F.col("c_value").alias("value"), F.col("c_update").alias("is_update"))
    goals = goals.withColumn("constraints", F.filter(F.array(one), lambda x: x["name"].isNotNull()))
    stated = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in ("price", "brand", "rating")]), lambda e: e["v"].isNotNull()))
    return goals, derived(spark, sf, "goal_actions"), derived(spark, sf, "goal_tasks"), candidates.select("goal_id", stated.alias("attributes"))


@query
def goal_completion(spark, sf):
    """Whether each goal has been reached, and what it lacks."""
    return completion.checked(*goal_inputs(spark, sf)).select("goal_id", "completed", "reason", F.size("missing").cast("long").alias("n_missing"))


def _centroid_scores(vectors):
    """For each vector and class, how near the vector is to the class's mean: whole numbers of ten-thousandths, so that sums are exact in any order."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10_000 + 0.5))
    rows = vectors.where("label IS NOT NULL AND embedding IS NOT NULL").select("label", whole.alias("v"))
    means = rows.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.floor(F.sum("x").cast("double") / F.count("*") + 0.5).alias("m"))
    model = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("mean"))
    # One row: as many numbers as there are classes and dimensions, whatever the number of vectors.
    model = model.agg(F.sort_array(F.collect_list(F.struct("label", "mean"))).alias("model"))

    def far(one):
        return F.struct(F.aggregate(F.zip_with("v", one["mean"], lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda t, d: t + d).alias("far"), one["label"].alias("class"))

    near = rows.select("label", "v", model.scalar().alias("model")).select("label", F.transform("model", far).alias("near"))
    each = near.select("label", F.array_min("near")["class"].alias("best"), F.explode("near").alias("one"))
    return each.select(F.col("one.class").alias("class"), (-F.col("one.far")).cast("double").alias("score"), (F.col("label") == F.col("one.class")).alias("hit"), (F.col("best") == F.col("one.class")).alias("chosen"))


@query
def centroid_evaluation(spark, sf):
    """Nearest class means as a classifier of the vectors' labels, judged by class and overall."""
    rows = evaluation.evaluated(_centroid_scores(table(spark, sf, "embeddings")))
    return rows.select("class", "support", "predicted", "hits", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "ap")])


@query
def stale_targets(spark, sf):
    """Targets of orders found again among the elements of their pages, made of lines."""
    refs, elements, nodes = (derived(spark, sf, name) for name in ("stale_refs", "live_elements", "live_nodes"))
    return recovery.recovered(refs, elements, nodes)


@query
def goal_start_url(spark, sf):
    """Where a browser should go first for each goal, from one of several pages."""
    rows = fed(spark, sf, "goals", GOALS, "goal_id long, goal string").selectExpr("goal_id", "goal", CURRENT)
    goal = F.col("goal")
    return rows.select("goal_id", "goal", "current", goals.start_url(goal, goals.navigation(goal), F.col("current")).alias("url"))
