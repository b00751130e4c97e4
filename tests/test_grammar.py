"""Goals in words: entities and constraints against a plain reading of the same grammar, and the model's own examples."""

import re

import pytest
from pyspark.sql import functions as F

from inkveil import config as c
from inkveil.operators import grammar

GOALS = [
    "Find a waterproof winter jacket under $150 in black and add the best reviewed one to my cart", "Compare the top 2 laptops with 16GB RAM and select the cheapest one", "headphones under 5k by Sony, 4.5 stars", "shoes size 10 over 1,200.50 and below 2 thousand rs",
    "Change the email to abc@gmail.com and click save", "update phone number to 9876543210, set quantity to 3", "enter alice@example.com into the email field", "type 9876543210 in the phone field and confirm", "open the latest mail from Ana Lima about taxes",
    "message: 'hello there', name is Ana Lima and phone 415-555-0199", "book a ticket from Paris to Rome for two on Monday", "from here to the cart by clicking", "visit www.example.org/x,y or http://a.b/c?d now", "mail bob@site.com only", "email as x@y.zz", "Search for maps on example.org for maps",
    "fill in first name with Bob. then change name to Rob", "replace the shipping address box with 12 Oak Street", "put it in the second box", "3 options at least 2 star", "name Al", "max , of", "", "comment is great stuff. By now", "from bob, from Bob and by BOB", "by the way\n", "to Rome\n",
    "Été à Rome from Zoë", "set the the name field to 'Q'", "insert a into b into c", "best 0 items, 12 items", "price > 30 <= 90k", "1TB storage 8 gb",
]


def entities_read(text):
    out = []
    for preposition, ends, refused, roles in c.ENTITY_RULES:
        for m in re.finditer(c.entity_pattern(preposition, ends).replace("$)", r"\Z)"), text, re.ASCII):
            value = m[2].strip()
            if value and not any(value.lower() == e[1].lower() for e in out) and not re.fullmatch(refused, value, re.IGNORECASE):
                out.append((m[1].lower(), value, m[1].lower() in ("from", "by"), roles))
    return out


def number_read(x):
    return str(int(x)) if x == int(x) else str(x)


def constraints_read(text, named):
    end = lambda p: p.replace("$|", r"\Z|").replace("$)", r"\Z)")
    hit = lambda p: re.search(end(p), text, re.ASCII)
    out = []

    def add(name, operator, value, update=False, target=None):
        out.append([name, operator, value, update, target])

    for pattern, operator in ((c.MOST_PRICE, "<="), (c.LEAST_PRICE, ">=")):
        if m := hit(pattern):
            try:
                add("price", operator, number_read(float(m[1].replace(",", "")) * (1000 if m[2] else 1)))
            except ValueError:
                pass
    if m := hit(c.COLOR_WORD):
        add("color", "=", m[1].lower())
    if m := hit(c.BRAND_WORD):
        add("brand", "=", m[1].capitalize())
    if (m := hit(c.RATING_WORD)) and 1 <= float(m[1]) <= 5:
        add("rating", ">=", number_read(float(m[1])))
    if m := hit(c.SIZE_WORD):
        add("size", "=", m[1].upper())
    if (m := hit(c.COUNT_BEFORE) or hit(c.COUNT_AFTER)) and int(m[1]) > 0:
        add("candidate_count", ">=", str(int(m[1])))
    if m := hit(c.SPEC_WORD):
        add("spec", "contains", re.sub(r"\s+", "", m[1].lower()))
    if m := hit(c.URL_WORD):
        add("url", "=", m[0] if m[0].startswith("http") else "https://" + m[0])
    explicit = bool(hit(c.MODIFIES))
    unquote = lambda x: re.sub(r"""^["']|["']\Z""", "", x).strip()
    if m := hit(c.EMAIL_FIELD) or hit(c.EMAIL_ANYWHERE):
        add("email", "=", m[1].strip(), explicit, "email")
    if m := hit(c.NAME_FIELD):
        add("name", "=", m[1].strip(), explicit, "name")
    if m := hit(c.PHONE_FIELD):
        add("phone", "=", re.sub(r"[\s-]", "", m[1]), explicit, "phone")
    if m := hit(c.MESSAGE_FIELD):
        add("message", "=", unquote(m[1]), explicit, "message")
    for pattern, field, value, refused, with_name in ((c.CHANGE_FIELD, 1, 2, c.NO_FIELD_CHANGED, True), (c.ENTER_FIELD, 2, 1, c.NO_FIELD_ENTERED, False)):
        for m in re.finditer(end(pattern), text, re.ASCII):
            raw, put = m[field].strip(), unquote(m[value])
            if not raw or not put or re.search(refused, raw):
                continue
            target = re.sub(r"\s+(?:field|input|box|control|element)\Z", "", re.sub(r"^(?:the|an|a)\s+", "", raw.lower())).strip()
            name = re.sub(r"\s+", "_", target)
            means = lambda x, k: k in (x[0], x[4])
            for x in out:
                if x[0] == name or x[4] == target or (target == "email" and means(x, "email")) or ("phone" in target and means(x, "phone")) or (with_name and target == "name" and means(x, "name")):
                    x[2:] = [put, True, target]
                    break
            else:
                add(name, "=", put, True, target)
    for preposition, value, *_ in named:
        if preposition in ("from", "by"):
            add("sender" if preposition == "from" else "author", "contains", value)
    return [tuple(x) for x in out]


def parsed(spark, goals):
    rows = spark.createDataFrame(list(enumerate(goals)), "goal_id long, goal string").withColumn("entities", grammar.entities(F.col("goal")))
    return rows.withColumn("constraints", grammar.constraints(F.col("goal"), F.col("entities"))).orderBy("goal_id").collect()


def test_as_a_plain_reading(spark):
    turns = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("role = 'user'").collect()]
    goals = [*GOALS, *turns, *(f"{a}, {b}" for a, b in zip(GOALS, reversed(GOALS), strict=True))]
    for goal, r in zip(goals, parsed(spark, goals), strict=True):
        named = entities_read(goal)
        assert [tuple(e) for e in r["entities"]] == named, goal
        assert [tuple(x) for x in r["constraints"]] == constraints_read(goal, named), goal


@pytest.mark.parametrize(
    "goal,name,operator,value",
    [
        (GOALS[0], "price", "<=", "150"), (GOALS[0], "color", "=", "black"), (GOALS[1], "candidate_count", ">=", "2"), (GOALS[1], "spec", "contains", "16gbram"), (GOALS[2], "price", "<=", "5000"), (GOALS[2], "author", "contains", "Sony"),
        (GOALS[3], "price", ">=", "1200.5"), (GOALS[4], "email", "=", "abc@gmail.com"), (GOALS[5], "quantity", "=", "3"), (GOALS[8], "sender", "contains", "Ana Lima"),
    ],
)
def test_examples(spark, goal, name, operator, value):
    assert (name, operator, value) in [(x["name"], x["operator"], x["value"]) for x in parsed(spark, [goal])[0]["constraints"]]


def test_a_null_goal(spark):
    r = parsed(spark, [None])[0]
    assert (r["entities"], r["constraints"]) == ([], [])


def test_plans_of_parsed_goals(spark):
    from inkveil.plans import catalog, planned  # noqa: F401

    rows = catalog.QUERIES["goal_plan_parsed"](spark, "/root/testdata/sf0.001").where("goal_id = 101").orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows))) and any("50000" in (r["description"] or "") for r in rows)
    found = catalog.QUERIES["goal_constraints"](spark, "/root/testdata/sf0.001")
    assert found.where("goal_id = 105 AND name = 'email' AND value = 'x@y.z' AND is_update").count() == 1
    named = catalog.QUERIES["goal_entities"](spark, "/root/testdata/sf0.001")
    assert [r["text"] for r in named.where("goal_id = 103").collect()] == ["Ana"]
