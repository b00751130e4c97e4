"""From a goal in words to what it needs done: operations, entity, summary, a plan of tasks, and what to do when a page is in the way.

All but `obstacles` are column expressions over one row. Constraints are an array of struct<name, operator, value, is_update>
(is_update: a form field to set), named entities an array of struct<preposition, text, person>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c

SIGNS = {k: c.java(f"(?i:{p})") for k, p in c.GOAL_SIGNS.items()}


def _sign(text: Column, name: str) -> Column:
    return F.coalesce(text.rlike(SIGNS[name]), F.lit(False))


def _updates(constraints: Column) -> Column:
    return F.filter(constraints, lambda x: x["is_update"])


def operations(goal: Column, domain: Column, explicit: Column, ordinal: Column, click_target: Column, action: Column, constraints: Column) -> Column:
    """The operations a goal needs, in a fixed order, each once; a goal that names none is an inspection. ordinal: what is selected, or null."""
    has = {k: _sign(goal, k) for k in SIGNS}
    shop, learn, form = domain == "ecommerce", domain == "research", domain == "form_filling"
    chosen, updates = ordinal.isNotNull(), F.size(_updates(constraints)) > 0
    acts = click_target.isNotNull() | action.isNotNull()
    search = has["search"] | shop | (learn & ~chosen)
    pressed = acts | has["press"]
    fill, send = updates | has["fill"] | form, pressed | has["send"]
    rules = [
        ("navigate", explicit), ("search", search), ("filter", (F.size(constraints) > 0) | has["filter"]), ("inspect", chosen | search | (has["look"] & ~pressed) | shop | learn), ("compare", has["compare"]),
        ("fill", fill), ("fill_form", fill), ("click", send), ("submit", send), ("submit_form", send), ("add_to_cart", has["cart"]), ("submit", has["cart"]), ("perform_action", acts),
        ("extract", (has["extract"] | learn) & action.isNull() & ~chosen),
    ]
    named = F.array_distinct(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules])))
    return F.when(F.size(named) == 0, F.array(F.lit("inspect"))).otherwise(named)


def _without_action(text: Column, action: Column) -> Column:
    tail = F.concat(F.lit(f"(?i:{c.BEFORE_ACTION}"), action, F.lit(c.java(r"\b") + r".*\z)"))
    return F.when(action.isNull(), text).otherwise(F.trim(F.regexp_replace(text, tail, F.lit(""))))


def target_entity(goal: Column, domain: Column, click_target: Column, action: Column) -> Column:
    """What the goal is about: what is clicked, else what is searched, else the noun after the verb, else the goal less verb and limits."""
    text = F.trim(goal)
    item = F.trim(F.regexp_extract(text, c.java(c.ITEM), 1))
    rest = F.trim(F.regexp_replace(_without_action(F.regexp_replace(text, c.java(c.GOAL_PREFIX), ""), action), c.java(c.GOAL_LIMITS), ""))
    none = F.coalesce(F.create_map(*[F.lit(x) for kv in c.NO_ENTITY.items() for x in kv])[domain], F.lit(c.NO_ENTITY[""]))
    return (
        F.when(click_target.isNotNull(), click_target)
        .when(text.rlike(c.java(c.SEARCHED)), _without_action(F.trim(F.regexp_extract(text, c.java(c.SEARCHED), 1)), action))
        .when((item != "") & ~F.lower(item).isin(c.NO_ITEM), item)
        .when(rest != "", rest)
        .otherwise(none)
    )


def _pairs(constraints: Column, form: str) -> Column:
    return F.array_join(F.transform(constraints, lambda x: F.format_string(form, x["name"], x["value"])), ", ")


def summary(goal: Column, entity: Column, domain: Column, ordinal: Column, chosen: Column, click_target: Column, action: Column, constraints: Column) -> Column:
    """One sentence on the goal. chosen: whether it selects items at all, as "all" has no ordinal."""
    updates, prefix = _updates(constraints), F.when(ordinal.isNotNull(), F.concat(ordinal, F.lit(" "))).otherwise("")
    low = F.lower(goal)
    return (
        F.when((F.size(updates) > 0) & click_target.isNotNull(), F.format_string('Update form fields and click "%s"', click_target))
        .when(F.size(updates) > 0, F.concat(F.lit("Update form field: "), _pairs(updates, '%s to "%s"')))
        .when(click_target.isNotNull(), F.format_string('Click "%s"', click_target))
        .when(action.isNotNull(), F.concat(F.lit("Find "), prefix, entity, F.lit(" and "), action))
        .when(low.contains("compare"), F.format_string("Find, filter, and compare options for %s", entity))
        .when(low.rlike("add to cart|buy"), F.format_string("Find and add %s to cart", entity))
        .when(chosen, F.concat(F.lit("Locate and interact with "), prefix, entity))
        .when(domain == "form_filling", F.format_string("Complete form workflow for %s", entity))
        .when(domain == "research", F.format_string("Research and extract information regarding %s", entity))
        .otherwise(F.format_string("Accomplish user goal: %s", goal))
    )


def plan(goal: Column, url: Column, ops: Column, entity: Column, domain: Column, explicit: Column, ordinal: Column, chosen: Column, click_target: Column, action: Column, constraints: Column, entities: Column) -> Column:
    """The tasks of a goal, in order: array of struct<type, description, target>. url: the page it starts from, null or empty for none."""

    def op(*names: str) -> Column:
        return F.arrays_overlap(ops, F.array(*map(F.lit, names)))

    def task(kind: str | Column, description: str | Column, target: Column | None = None) -> Column:
        own = [x if isinstance(x, Column) else F.lit(x) for x in (kind, description)]
        return F.struct(own[0].alias("type"), own[1].alias("description"), (F.lit(None).cast("string") if target is None else target).alias("target"))

    updates = _updates(constraints)
    sets, form = F.size(updates) > 0, domain == "form_filling"
    clicks = click_target.isNotNull() | op("click", "submit", "submit_form", "add_to_cart") | _sign(goal, "press_or_send")
    direct = click_target.isNotNull() | (~op("search") & clicks & (domain != "ecommerce"))
    blank = F.coalesce(url, F.lit("")) == ""
    for start in c.BROWSER_PAGES:
        blank = blank | F.coalesce(url.startswith(start), F.lit(False))
    picks = chosen | F.exists(entities, lambda e: e["person"])
    filters = F.exists(constraints, lambda x: ~x["name"].isin(c.NO_FILTER) & ~x["is_update"])
    listed = F.array_join(F.transform(constraints, lambda x: F.concat_ws(" ", x["name"], x["operator"], x["value"])), ", ")
    around = F.array_join(F.transform(entities, lambda e: F.concat(F.coalesce(e["preposition"], F.lit("matching")), F.lit(" "), e["text"])), " ")
    fills = (op("fill", "fill_form") | form | sets) & ~(direct & ~sets & ~op("fill", "fill_form") & ~_sign(goal, "any_fill"))
    select = (picks | op("search") | domain.isin("ecommerce", "research")) & ~sets & ~direct
    what = (
        F.when(ordinal.isNotNull(), F.format_string("Locate and select %s %s matching constraints", ordinal, entity))
        .when(F.size(entities) > 0, F.concat(F.lit("Locate and select "), entity, F.lit(" "), around))
        .when((domain == "research") | op("search"), F.format_string('Inspect primary article or search result for "%s"', entity))
        .otherwise("Inspect visible candidate results and verify attributes")
    )
    cart = op("add_to_cart") | _sign(goal, "any_cart")
    submits = cart | _sign(F.coalesce(click_target, action, goal), "submit")
    pressed = F.coalesce(click_target, action, F.when(cart, "add to cart").otherwise("submit"))
    tasks = [
        (explicit | (blank & ~form & ~sets & (op("search") | ~direct)) | op("navigate"), task("navigate", F.format_string("Navigate to appropriate website for %s", entity))),
        (op("search") & (~picks | _sign(goal, "any_search")), task("search", F.format_string('Locate search bar and enter query for "%s"', entity))),
        (op("filter") & filters & ~domain.isin("form_filling", "navigation") & ~sets & ~direct, task("filter", F.format_string("Locate and apply filters matching constraints: [%s]", listed))),
        (fills | sets, task("fill_form", F.when(sets, F.concat(F.lit("Update form fields: "), _pairs(updates, '%s = "%s"'))).otherwise("Fill out required form fields with relevant context"))),
        (select, task("select_candidate", what)),
        (~select & ((domain == "navigation") | op("inspect")) & ~form & ~sets & ~direct, task("inspect", "Inspect target page elements and verify content")),
        (op("compare"), task("compare", "Compare inspected candidates against user constraints and select best matching options")),
        (clicks, task(F.when(cart, "add_to_cart").when(submits, "submit_form").otherwise("perform_action"), F.when(cart, "Add selected item to cart").otherwise(F.format_string('Click "%s"', pressed)), pressed)),
        (F.lit(True), task("verify_goal", "Verify all constraints are met and formulate final response")),
    ]
    return F.array_compact(F.array(*[F.when(test, one) for test, one in tasks]))


def obstacles(states: DataFrame, elements: DataFrame) -> DataFrame:
    """Per state: obstacle (null without one), description, target_id, replanned, reason, new_task.

    states: state_id, task_type, failures, overlay, nothing_found, replans, entity. elements: state_id, pos, element_id, tag, role, text,
    aria_label, width, height. Elements are aggregated by state before the join, so a state sends one row of flags for each of its tasks.
    """
    text, aria = F.coalesce("text", F.lit("")), F.coalesce("aria_label", F.lit(""))
    both = F.lower(F.concat(text, F.lit(" "), aria))
    closes = both.rlike(c.java(c.MODAL_CLOSE)) | F.coalesce((F.col("tag") == "button") & (text == "×"), F.lit(False)) | F.lower(aria).contains("close")
    pressable = F.coalesce(F.col("tag").isin("button", "a", ""), F.lit(True)) | F.coalesce(F.col("role") == "button", F.lit(False))
    seen = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(True))
    shown = F.coalesce(F.nullif(text, F.lit("")), F.nullif(aria, F.lit("")), F.lit("Close"))
    low = F.lower(text)
    one = F.struct("pos", F.col("element_id").alias("id"), shown.alias("shown"))
    flags = elements.groupBy("state_id").agg(
        F.bool_or(low.rlike(c.java(c.MODAL))).alias("modal"),
        F.min(F.when(seen & closes & pressable, one)).alias("closer"),
        F.bool_or(low.rlike(c.java(c.NOTHING_FOUND))).alias("nothing"),
        F.min(F.when(low.rlike(c.java(c.CHOOSE_CATEGORY)), one)).alias("selector"),
    )
    rows = states.join(flags, "state_id", "left")

    def holds(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    kind = (
        F.when((holds("overlay") | holds("modal")) & F.col("closer").isNotNull() & ~F.col("task_type").eqNullSafe("close_modal"), "modal_overlay")
        .when(holds("nothing_found") | holds("nothing"), "zero_results")
        .when(F.col("selector").isNotNull() & F.col("task_type").eqNullSafe("search"), "category_selector")
        .when(F.coalesce("failures", F.lit(0)) >= 2, "consecutive_failures")
    )
    rows = rows.withColumn("obstacle", kind)
    is_ = {k: F.col("obstacle") == k for k in c.REPLAN_TASKS}
    target = F.when(is_["modal_overlay"], F.col("closer.id")).when(is_["category_selector"], F.col("selector.id"))
    description = (
        F.when(is_["modal_overlay"], F.format_string('Dismiss modal/popup by clicking "%s"', F.col("closer.shown")))
        .when(is_["zero_results"], "Zero results found matching current query and filters. Modifying search strategy.")
        .when(is_["category_selector"], "Website requires selecting a category before displaying results.")
        .when(is_["consecutive_failures"], F.format_string("Encountered %d consecutive action failures. Adapting navigation strategy.", F.col("failures")))
    )
    spent = F.coalesce("replans", F.lit(0)) >= c.MOST_REPLANS
    reason, task = F.when(F.col("obstacle").isNull(), "Missing obstacle or planner specification."), F.lit(None)
    reason = reason.when(spent, f"Maximum replan budget ({c.MOST_REPLANS}) exceeded. Halting plan modification.")
    for name, (kind_, why) in c.REPLAN_TASKS.items():
        reason = reason.when(is_[name], F.concat(F.lit(why), target) if name == "modal_overlay" else F.lit(why))
        task = F.when(is_[name], kind_).otherwise(task)
    replanned = F.col("obstacle").isNotNull() & ~spent
    return rows.select("state_id", "obstacle", description.alias("description"), target.alias("target_id"), replanned.alias("replanned"), reason.alias("reason"), F.when(replanned, task).alias("new_task"))
