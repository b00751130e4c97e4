"""Whether a goal has been reached: what its history, plan and candidates still lack. Conditional aggregates by goal, joined to the goals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c

# --- fixed values ---
WORDS = {
    "asks_cart": r"\b(?:add to cart|add to bag|add to basket)\b",
    "asks_buy": r"\b(?:buy now|purchase|checkout|order now)\b",
    "asks_submit": r"\b(?:submit|register|book now|complete order|confirm|confirm order|place order)\b",
    "asks_compare": r"\bcompare\b",
    "presses": r"^(?:click\s|press\s|tap\s|confirm\s|submit\s)",
    "did_cart": r"\b(?:add to cart|add to bag|add to basket|cart|bag)\b",
    "did_buy": r"\b(?:add to cart|cart|bag|bought|purchased|checkout|buy now)\b",
    "did_submit": r"\b(?:submit|submitting|registered|booked|submitted form|order placed|confirm|confirmed|clicked)\b",
    "did_search": r"\b(?:search|entered search|typed into search|searchbox|search_query|query|type)\b",
    "did_fill": r"\b(?:fill|populated|typed?|entered|form field|input|select|check)\b",
}
SUBMITS, FILLS = ["submit_form", "submit"], ["TYPE", "CHECK", "SELECT"]
REQUIRED = ["search", "filter", "select_candidate", "fill_form", "submit_form", "perform_action", "submit_action", "submit"]
OPENS = ["open", "read", "view"]
NOT_STARTED, FIRST = "Execution has not started.", "Execute initial planned tasks"
REACHED, LACKS = "User goal and all constraints have been genuinely satisfied.", "Goal not fully satisfied: "
NO_CART = "Requested item has not been added to cart yet (add to cart action missing)."
NO_PURCHASE = "Purchase or cart action has not been executed yet."
NO_SUBMIT = "Requested action or submission has not been executed yet."
NO_SEARCH = "Search query has not been executed yet."
NO_FILL = "Form fields have not been populated yet."
NO_CANDIDATE = "No candidate currently satisfies all specified constraints."
# --- end of fixed values ---
# Texts are in lower case; the words begin and end with word characters, so one side of a boundary is known.
SIGNS = {k: c.java(re.sub(r"\\b$", r"(?!\\w)", re.sub(r"^\\b", r"(?<!\\w)", p))) for k, p in WORDS.items()}


def _needed(pattern: str) -> list[str]:
    """What stands in every match of one of these alternatives of plain words, in lower case: one of them in any match."""
    words = [re.sub(r"\w\?", "", x) for x in re.sub(r"\\[bs]|\^|\(\?:|\)", "", pattern).split("|")]
    return sorted({x for x in words if not any(y != x and y in x for y in words)})


NEEDED = {k: _needed(p) for k, p in WORDS.items()}


def _is(text: Column, sign: str) -> Column:
    """Whether the sign stands in a lower-case text. Most texts hold none of its words, so the pattern is tried on the others only."""
    may = F.contains(text, F.lit(NEEDED[sign][0]))
    for word in NEEDED[sign][1:]:
        may = may | F.contains(text, F.lit(word))
    return F.coalesce(may & text.rlike(SIGNS[sign]), F.lit(False))


def _said(*names: str) -> Column:
    return F.lower(F.concat(*[x for n in names for x in (F.coalesce(n, F.lit("")), F.lit(" "))]))


def _plans(tasks: DataFrame) -> DataFrame:
    done = F.coalesce(F.lower("status") == "completed", F.lit(False))
    kind = F.col("type")
    presses = kind.isin(SUBMITS) | ((kind == "perform_action") & F.coalesce(F.col("action_kind") == "CLICK", F.lit(False)))
    shown = F.coalesce(F.nullif("description", F.lit("")), "type")
    return tasks.groupBy("goal_id").agg(
        F.lit(True).alias("planned"),
        F.bool_or(presses).alias("plans_submit"),
        F.min(F.when(kind == "perform_action", F.struct("pos", "action"))).alias("performs"),
        F.bool_or((kind == "search") & ~done).alias("search_open"),
        F.min(F.when(kind.isin(REQUIRED) & ~done, F.struct("pos", shown.alias("shown")))).alias("open_task"),
    )


def _history(actions: DataFrame, verbs: DataFrame) -> DataFrame:
    """Flags of what was done; equal actions of a goal are one row before they meet its verbs."""
    once = actions.select("goal_id", "kind", "reason", "action", "target", "target_id").distinct()
    said = {"plain": ["kind", "reason", "target"], "named": ["kind", "reason", "action", "target"], "whole": ["kind", "reason", "action", "target", "target_id"]}
    rows = once.select("goal_id", "kind", *[_said(*names).alias(k) for k, names in said.items()]).join(verbs, "goal_id")
    plain, named, whole = map(F.col, said)
    kind = F.coalesce("kind", F.lit(""))
    return rows.groupBy("goal_id").agg(
        F.lit(True).alias("started"),
        F.bool_or(_is(plain, "did_cart")).alias("carted"),
        F.bool_or(_is(plain, "did_buy")).alias("bought"),
        F.bool_or(_is(named, "did_submit") | named.contains(F.col("click_verb")) | kind.isin("SUBMIT", "CLICK")).alias("submitted"),
        F.bool_or(whole.contains(F.col("verb"))).alias("performed"),
        F.bool_or(_is(plain, "did_search")).alias("searched"),
        F.bool_or(_is(plain, "did_fill") | kind.isin(FILLS)).alias("filled"),
    )


def _suits(attributes: Column, one: Column) -> Column:
    """Whether a candidate breaks no constraint; what it doesn't state breaks none, nor do numbers that aren't any."""
    own, want = F.try_element_at(attributes, one["name"]), one["value"]
    off = F.lit(False)
    for operator, test in (("<=", lambda a, b: a > b), (">=", lambda a, b: a < b)):
        a, b = (F.when(~F.isnan(x.try_cast("double")), x.try_cast("double")) for x in (own, want))
        off = off | ((one["operator"] == operator) & F.coalesce(test(a, b), F.lit(False)))
    off = off | ((one["operator"] == "=") & F.coalesce(F.lower(own) != F.lower(want), F.lit(False)))
    return (one["name"] == "candidate_count") | ~off


def _candidates(candidates: DataFrame, goals: DataFrame) -> DataFrame:
    rows = candidates.select("goal_id", "attributes").join(goals.select("goal_id", "constraints"), "goal_id")
    return rows.groupBy("goal_id").agg(
        F.count("*").alias("inspected"),
        F.bool_or(F.forall("constraints", lambda one: _suits(F.col("attributes"), one))).alias("suited"),
        F.bool_or(F.coalesce(F.size("attributes"), F.lit(0)) > 2).alias("described"),
    )


def checked(goals: DataFrame, actions: DataFrame, tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(goal_id, completed, reason, missing): one row a goal; missing names what it lacks, in a fixed order.

    goals: goal_id, request, summary, operations, click_target, action, domain, picks (selects items or names some), constraints
    (array of struct<name, operator, value, is_update>; operators <=, >=, =). goal_id is unique and not null; null arrays count as empty.
    actions: goal_id, kind, reason, action, target, target_id. tasks: goal_id, pos, type, description, status, action_kind, action; a goal without
    any has no plan. candidates: goal_id, attributes (map<string, string>). Rows of other goals, and without one, count for nothing.
    """
    rows = goals.select(
        "goal_id", "click_target", "action", "domain", F.coalesce("picks", F.lit(False)).alias("picks"), F.coalesce("request", F.lit("")).alias("request"), _said("request", "summary").alias("text"),
        F.coalesce("operations", F.array().cast("array<string>")).alias("operations"), F.coalesce("constraints", F.array().cast(goals.schema["constraints"].dataType)).alias("constraints"),
    )
    rows = rows.withColumn("click_target", F.nullif("click_target", F.lit(""))).withColumn("action", F.nullif("action", F.lit("")))
    rows = rows.join(_plans(tasks), "goal_id", "left").withColumn("intent", F.coalesce("action", F.nullif(F.col("performs.action"), F.lit(""))))
    verb = F.lower(F.trim(F.coalesce("intent", F.lit("action"))))
    rows = rows.withColumn("verb", verb).withColumn("click_verb", F.lower(F.coalesce("click_target", "action", F.lit("submit"))))
    asks = ["asks_cart", "asks_buy", "asks_submit", "asks_compare"]
    rows = rows.withColumns({k: _is(F.col("text"), k) for k in asks} | {"presses": _is(F.lower("request"), "presses")})
    rows = rows.join(_history(actions, rows.select("goal_id", "verb", "click_verb")), "goal_id", "left").join(_candidates(candidates, rows), "goal_id", "left")

    def op(*names: str) -> Column:
        return F.arrays_overlap("operations", F.array(*map(F.lit, names)))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    constraints = F.col("constraints")
    cart_only = op("add_to_cart") | F.col("asks_cart")
    cart = cart_only | F.col("asks_buy")
    submit = ~cart & (F.col("click_target").isNotNull() | op(*SUBMITS) | F.col("asks_submit")) & (F.col("planned").isNull() | flag("plans_submit"))
    opens = F.coalesce(F.col("intent").isin(OPENS), F.lit(False)) & F.col("picks")
    perform = (F.col("intent").isNotNull() | op("perform_action")) & ~opens & ~submit
    form = (op("fill_form", "fill") | F.coalesce(F.col("domain") == "form_filling", F.lit(False))) & F.col("click_target").isNull() & ~F.col("presses")
    fill = ~cart & (F.exists(constraints, lambda x: F.coalesce(x["is_update"], F.lit(False))) | form)
    asked = F.get(F.filter(constraints, lambda x: x["name"] == "candidate_count"), F.lit(0))
    least = F.when(asked.isNotNull(), F.coalesce(asked["value"].try_cast("int"), F.lit(0))).when(op("compare") | F.col("asks_compare"), 2).otherwise(1)
    inspected = F.coalesce("inspected", F.lit(0))
    rules = [
        (cart & cart_only & ~flag("carted"), F.lit(NO_CART)),
        (cart & ~cart_only & ~flag("bought"), F.lit(NO_PURCHASE)),
        (submit & ~flag("submitted"), F.lit(NO_SUBMIT)),
        (perform & ~flag("performed"), F.format_string("Requested action '%s' has not been executed yet.", F.col("verb"))),
        (op("search") & flag("search_open") & ~flag("searched"), F.lit(NO_SEARCH)),
        (fill & ~flag("filled"), F.lit(NO_FILL)),
        ((least > 1) & (inspected < least), F.format_string("Comparison requires at least %d candidates (inspected %d).", least, inspected)),
        ((F.size(constraints) > 0) & flag("described") & ~flag("suited"), F.lit(NO_CANDIDATE)),
        (F.col("open_task").isNotNull(), F.concat(F.lit("Pending required task: "), F.col("open_task.shown"))),
    ]
    lacking = F.array_compact(F.array(*[F.when(test, what) for test, what in rules]))
    rows = rows.select("goal_id", flag("started").alias("started"), F.when(flag("started"), lacking).otherwise(F.array(F.lit(FIRST))).alias("missing"))
    reached = F.size("missing") == 0
    reason = F.when(~F.col("started"), NOT_STARTED).when(reached, REACHED).otherwise(F.concat(F.lit(LACKS), F.array_join("missing", "; ")))
    return rows.select("goal_id", reached.alias("completed"), reason.alias("reason"), "missing")
