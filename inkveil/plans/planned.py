"""Queries on goals as plans of tasks, obstacles to them, and what reviewers are shown. Inputs that the tables lack are inline rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as c
from ..functions import text as t
from ..operators import goals, grammar, planning, policy
from .catalog import query, table
from .derived import fed
from .spoken import GOALS

MORE_GOALS = [
    (101, "find laptops under 50000 and compare options"), (102, "Search for noise cancelling headphones under 200 and star it"), (103, "open the latest mail from Ana"), (104, "fill out the contact form and submit"),
    (105, "change the email to x@y.z and click save"), (106, "add to cart the second pair of shoes"), (107, "look up tide tables"), (108, "summarize the article"), (109, "review the third issue, please"),
    (110, "search on example.org for maps with legends"), (111, "buy"), (112, "extract the prices"), (113, "check this"), (114, "Compare two phones"), (115, "press the big red button"), (116, "get me a coffee machine priced below 90"),
]
CONSTRAINTS = [
    (101, 1, "price", "<=", "50000", False), (102, 1, "price", "<=", "200", False), (103, 1, "sender", "=", "Ana", False), (105, 1, "email", "=", "x@y.z", True), (104, 1, "name", "=", "Ana", True), (104, 2, "phone", "=", "555", True),
    (2, 1, "url", "=", "https://example.org", False), (116, 1, "price", "<=", "90", False), (116, 2, "color", "=", "red", False), (8, 1, "email", "=", "a@b.c", True),
]
ENTITIES = [(103, 1, "from", "Ana", True), (109, 1, None, "please", False), (116, 1, "for", "home", False)]
STARTS = [(101, "https://shop.example/"), (102, "about:blank"), (103, "https://mail.example/"), (105, "chrome://newtab"), (107, ""), (112, "https://a.example/"), (115, "https://a.example/")]


def _specs(spark, sf):
    """Goals with what they were given: constraints, entities, the page they start from."""
    goals_ = fed(spark, sf, "goals", GOALS + MORE_GOALS, "goal_id long, goal string")
    given = spark.createDataFrame(CONSTRAINTS, "goal_id long, pos int, name string, operator string, value string, is_update boolean")
    named = spark.createDataFrame(ENTITIES, "goal_id long, pos int, preposition string, text string, person boolean")

    def listed(rows, fields, name):
        in_order = F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("x"))))
        return rows.groupBy("goal_id").agg(F.transform(in_order, lambda r: r["x"]).alias(name))

    rows = goals_.join(listed(given, ["name", "operator", "value", "is_update"], "constraints"), "goal_id", "left").join(listed(named, ["preposition", "text", "person"], "entities"), "goal_id", "left")
    rows = rows.withColumn("constraints", F.coalesce("constraints", F.array())).withColumn("entities", F.coalesce("entities", F.array()))
    return _worked_out(rows.join(spark.createDataFrame(STARTS, "goal_id long, url string"), "goal_id", "left"))


def _parsed(spark, sf):
    """Goals with the constraints and entities that their words have."""
    rows = fed(spark, sf, "goals", GOALS + MORE_GOALS, "goal_id long, goal string").withColumn("entities", grammar.entities(F.col("goal")))
    return rows.withColumn("constraints", grammar.constraints(F.col("goal"), F.col("entities"))).withColumn("url", F.lit(None).cast("string"))


def _worked_out(rows):
    goal = F.col("goal")
    rows = rows.select("*", goals.navigation(goal)["explicit"].alias("explicit"), goals.selection(goal).alias("s"), goals.click_target(goal).alias("click_target"), goals.action(goal).alias("action"))
    rows = rows.select("*", F.col("s.ordinal").alias("ordinal"), F.col("s").isNotNull().alias("chosen"), goals.domain(goal, F.col("explicit")).alias("domain"))
    rows = rows.withColumn("entity", planning.target_entity(goal, F.col("domain"), F.col("click_target"), F.col("action")))
    chosen = F.when(F.col("chosen"), F.lit("any"))
    return rows.withColumn("ops", planning.operations(goal, F.col("domain"), F.col("explicit"), chosen, F.col("click_target"), F.col("action"), F.col("constraints")))


@query
def goal_spec(spark, sf):
    """Operations, entity and summary of each goal."""
    names = ("goal", "entity", "domain", "ordinal", "chosen", "click_target", "action", "constraints")
    return _specs(spark, sf).select("goal_id", F.array_join("ops", ",").alias("operations"), "entity", planning.summary(*map(F.col, names)).alias("summary"))


@query
def goal_plan(spark, sf):
    """The tasks of each goal, in order."""
    names = ("goal", "url", "ops", "entity", "domain", "explicit", "ordinal", "chosen", "click_target", "action", "constraints", "entities")
    tasks = _specs(spark, sf).select("goal_id", F.posexplode(planning.plan(*map(F.col, names))).alias("pos", "t"))
    return tasks.select("goal_id", "pos", "t.type", "t.description", "t.target")


@query
def goal_constraints(spark, sf):
    """The constraints of each goal, as its words have them."""
    rows = _parsed(spark, sf).select("goal_id", F.posexplode("constraints").alias("pos", "x"))
    return rows.select("goal_id", "pos", "x.name", "x.operator", "x.value", "x.is_update")


@query
def goal_entities(spark, sf):
    """The entities of each goal, as its words have them."""
    rows = _parsed(spark, sf).select("goal_id", F.posexplode("entities").alias("pos", "e"))
    return rows.select("goal_id", "pos", "e.preposition", "e.text", F.array_join("e.roles", ",").alias("roles"))


@query
def goal_plain_constraints(spark, sf):
    """Constraints of the rules without look-ahead: prices, color, brand, rating, size, number of candidates, specification."""
    rows = fed(spark, sf, "goals", GOALS + MORE_GOALS, "goal_id long, goal string")
    found = rows.select("goal_id", F.explode(grammar.plain_constraints(F.col("goal"))).alias("x"))
    return found.where(F.col("x.name").isin("price", "color", "brand", "rating", "size", "candidate_count", "spec")).select("goal_id", "x.name", "x.operator", "x.value")


@query
def goal_plan_parsed(spark, sf):
    """The tasks of each goal, with the constraints and entities that its words have."""
    names = ("goal", "url", "ops", "entity", "domain", "explicit", "ordinal", "chosen", "click_target", "action", "constraints", "entities")
    tasks = _worked_out(_parsed(spark, sf)).select("goal_id", F.posexplode(planning.plan(*map(F.col, names))).alias("pos", "t"))
    return tasks.select("goal_id", "pos", "t.type", "t.description", "t.target")


STATES = [
    (1, "search", 0, False, False, 0), (2, "close_modal", 0, True, False, 1), (3, "search", 0, False, False, 0), (4, "filter", 3, False, False, 2), (5, "search", 1, False, True, 5), (6, None, None, None, None, None), (7, "search", 2, True, False, 0), (8, "search", 2, False, False, 4),
]
SEEN = [
    (1, 1, "e1", "div", None, "We use cookies", None, 10.0, 10.0), (1, 2, "e2", "button", None, "Accept all", None, 0.0, 10.0), (1, 3, "e3", "button", None, "Got it", None, 50.0, 10.0), (1, 4, "e4", "a", None, "Close", None, 50.0, 10.0),
    (2, 1, "e1", "button", None, "×", None, None, None), (3, 1, "e1", "span", None, "All departments", None, 9.0, 9.0), (3, 2, "e2", "span", None, "select a category", None, 9.0, 9.0), (4, 1, "e1", "p", None, "text", None, 5.0, 5.0),
    (5, 1, "e1", "p", None, None, None, 5.0, 5.0), (7, 1, "e1", "div", "button", None, "Dialog-closer", 5.0, 5.0), (8, 1, "e1", "p", None, "No results found for x", None, 5.0, 5.0), (8, 2, "e2", "p", None, "enclosed", None, 5.0, 5.0),
]


@query
def page_obstacles(spark, sf):
    """What stands in the way of each state's task, and how its plan changes."""
    states = fed(spark, sf, "states", STATES, "state_id long, task_type string, failures int, overlay boolean, nothing_found boolean, replans int")
    elements = fed(spark, sf, "seen", SEEN, "state_id long, pos int, element_id string, tag string, role string, text string, aria_label string, width double, height double")
    return planning.obstacles(states, elements)


def _mixed(spark, sf):
    rows = fed(spark, sf, "mixed", c.MIXED_CONTENT, "item_id string, category string, detection double, role string, relevance string, necessity string, destination string, value string")
    sure = F.lit(0.9)
    choice = policy.decide(*[F.col(x) for x in ("category", "role", "relevance", "necessity", "destination")], F.lit(False), F.col("detection"), sure, sure)
    # Bound once: the ladder is long, and all that follows asks for it several times.
    rows = rows.withColumn("decision", F.transform(F.array(choice), lambda x: x["decision"])[0])
    token = F.when(F.col("decision") == "TOKENIZE", F.concat(F.lit("PII_TOKEN_"), F.upper("category")))
    return rows.withColumn("token", token).withColumn("shown", policy.representations(F.col("decision"), F.col("token"), F.col("value")))


@query
def mixed_content(spark, sf):
    """Seven fixed items and those of events, their decisions and what each place shows of them."""
    return _mixed(spark, sf).select("item_id", "decision", "shown.*")


REPRESENTED = [
    (1, "ALLOW", None, True, False, "x"), (2, "ALLOW", None, False, True, "x"), (3, "TOKENIZE", "", True, True, "x"), (4, "TOKENIZE", "T1", True, True, "T2"), (5, "TOKENIZE", "T1", True, False, "T1"), (6, "REDACT", None, True, False, "[REDACTED]"),
    (7, "REDACT", None, True, True, "raw"), (8, "LOCAL_ONLY", None, True, True, "a secret"), (9, "LOCAL_ONLY", None, True, None, None), (10, "TOKENIZE", "T1", None, True, "T1"), (11, None, None, True, False, "raw"), (12, "LOCAL_ONLY", None, True, False, ""),
]


@query
def representation_violations(spark, sf):
    """Items that some place shows otherwise than decided: seeded ones and those of events; of the items that were decided here, none."""
    seeded = fed(spark, sf, "represented", REPRESENTED, "item_id long, decision string, token string, dom_masked boolean, screenshot_masked boolean, remote_payload string")
    masked = F.col("shown.screenshot").startswith("Masked")
    own = _mixed(spark, sf).select(F.lit(0).cast("long").alias("item_id"), "decision", "token", (F.col("decision") != "ALLOW").alias("dom_masked"), masked.alias("screenshot_masked"), "shown.remote_payload")
    broken = policy.violation(*[F.col(x) for x in ("decision", "token", "dom_masked", "screenshot_masked", "remote_payload")])
    return seeded.unionByName(own).select("item_id", t.given(broken).alias("violation"))


SOURCES = [
    (-1, "// eval(x)\nlet a = 1;"), (-2, "a = Eval (b)"), (-3, "/* new Function() */ f('https://example.com/x')"), (-4, "k = 'SUPER_SECRET_KEY'; new  Function('a')"), (-5, "m = /(eval(x))/i.test(s)"), (-6, "medieval(1)"), (-7, None),
]


@query
def source_audit(spark, sf):
    """Pages, and seeded sources, by the rules they break."""
    rows = table(spark, sf, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.col("html").alias("source"))
    rows = rows.unionByName(spark.createDataFrame(SOURCES, "page_id long, source string"))
    return rows.select("page_id", policy.source_audit(F.col("source")).alias("a")).select("page_id", "a.*")
