"""State of plans against a plain list, completion of goals rule by rule, evaluation against plain ranks."""

import random
from collections import Counter, defaultdict

import pytest

from inkveil.operators import completion, evaluation, plan_state
from inkveil.plans import progress

SF = "/root/testdata/sf0.001"
OPS = "session long, op_id long, at long, op string, tasks array<struct<type:string,description:string>>"


def replayed(rows):
    """States and final tasks by a list that is spliced."""
    states, final, run = {}, {}, Counter()
    plans = defaultdict(lambda: [[], 0])
    for session, op_id, _, op, tasks in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
        run[session] += op == "start"
        key = (session, run[session])
        plan, at = plans[key]
        other = ("adaptive_step", "Adaptive browser step") if op == "insert" else ("step", "Step")
        given = [[(t or (None, None))[0] or other[0], (t or (None, None))[1] or other[1], "pending"] for t in tasks or []]
        if op == "start":
            plan, at = given, 0
        elif op == "complete":
            if at < len(plan):
                plan[at][2] = "completed"
            at += 1
        elif op == "insert":
            plan.insert(at, given[0] if given else [*other, "pending"])
        elif op == "replace":
            plan = plan[:at] + given
            at = len(plan) - len(given)
        plans[key] = [plan, at]
        done = sum(t[2] == "completed" for t in plan)
        now = plan[at][:2] if at < len(plan) else [None, None]
        states.setdefault(key, []).append((op_id, op, *now, len(plan), done, len(plan) - done))
        final[key] = [tuple(t) for t in plan]
    return states, final


def both(spark, df, rows):
    want_states, want_tasks = replayed(rows)
    got = defaultdict(list)
    for r in plan_state.states(df).collect():
        got[r[0], r[1]].append(tuple(r[2:]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want_states.items()}
    ends = defaultdict(dict)
    for r in plan_state.tasks(df).collect():
        assert r.pos not in ends[r.session, r.run]
        ends[r.session, r.run][r.pos] = (r.type, r.description, r.status)
    assert {k: [v[i] for i in range(len(v))] for k, v in ends.items()} == {k: v for k, v in want_tasks.items() if v}
    return want_states, want_tasks


def test_plans_of_events(spark):
    ops = progress.plan_ops(spark, SF)
    rows = [(r.session, r.op_id, r.at, r.op, [tuple(t) for t in r.tasks]) for r in ops.collect()]
    _, tasks = both(spark, ops.repartition(7), rows)
    assert {t[2] for v in tasks.values() for t in v} == {"completed", "pending"}


def test_plans_at_random(spark):
    """Completions past the end, tasks without type, null tasks, unknown operations, ties in time, rows without session or time."""
    rng, rows = random.Random(3), []
    for i in range(3000):
        op = rng.choice(["complete"] * 5 + ["insert"] * 3 + ["replace", "start", "look", None])
        tasks = rng.choice([None, [], [None], [("a", f"t{i}")], [("b", None), (None, f"u{i}"), ("", "")]])
        rows.append((rng.choice([1, 1, 1, 2, 3, 4, None]), i, rng.choice([i // 3, i // 3, None]), op, tasks))
    states, tasks = both(spark, spark.createDataFrame(rows, OPS).repartition(3), rows)
    assert any(s[2] is None and s[4] > 0 for v in states.values() for s in v)
    assert any(a[2] == "pending" and b[2] == "completed" for v in tasks.values() for a, b in zip(v, v[1:], strict=False))


def test_one_run_beyond_a_batch(spark):
    rows = [(1, 0, 0, "start", [("a", "a")] * 3)] + [(1, i, i, "insert" if i % 2 else "complete", [("x", f"x{i}")]) for i in range(1, 25_000)]
    both(spark, spark.createDataFrame(rows, OPS), rows)


def test_plans_of_no_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], OPS)
    assert plan_state.states(empty).collect() == plan_state.tasks(empty).collect() == []
    more = spark.createDataFrame([(1, 1, 1, "start", [("a", "b")], "x", 9)], OPS + ", run string, pos long")
    assert [tuple(r) for r in plan_state.tasks(more).collect()] == [(1, 1, 0, "a", "b", "pending")]


GOAL = "goal_id long, request string, summary string, operations array<string>, click_target string, action string, domain string, picks boolean, constraints array<struct<name:string,operator:string,value:string,is_update:boolean>>"
ACTION = "goal_id long, kind string, reason string, action string, target string, target_id string"
TASK = "goal_id long, pos long, type string, description string, status string, action_kind string, action string"
CANDIDATE = "goal_id long, attributes map<string,string>"


def goal(request="look", ops=(), click=None, action=None, domain="general", picks=False, constraints=()):
    return (request, None, list(ops), click, action, domain, picks, list(constraints))


def act(kind=None, reason=None, action=None, target=None, target_id=None):
    return (kind, reason, action, target, target_id)


LOOK = act("SCROLL", "look around")
LIMIT = ("price", "<=", "100", False)
CASES = [
    (goal(), [], [], [], [completion.FIRST]),
    (goal(), [LOOK], [], [], []),
    (goal(ops=["add_to_cart"]), [act("CLICK", "checkout")], [], [], [completion.NO_CART]),
    (goal(ops=["add_to_cart"]), [act("CLICK", None, None, "Shopping Bag")], [], [], []),
    (goal("please buy now"), [act("CLICK", "checkouts")], [], [], [completion.NO_PURCHASE]),
    (goal("please buy now"), [act("CLICK", "went to Checkout")], [], [], []),
    (goal(ops=["submit"]), [LOOK], [], [], [completion.NO_SUBMIT]),
    (goal(ops=["submit"]), [LOOK], [(1, "inspect", None, "completed", None, None)], [], []),
    (goal(ops=["submit"]), [LOOK], [(1, "perform_action", None, "completed", "CLICK", None)], [], [completion.NO_SUBMIT]),
    (goal(click="Save"), [act("WAIT", None, None, "save_all")], [], [], []),
    (goal(ops=["submit"]), [act("CLICK")], [], [], []),
    (goal(action="Star"), [LOOK], [], [], ["Requested action 'star' has not been executed yet."]),
    (goal(action="Star"), [act("WAIT", target_id="restart")], [], [], []),
    (goal(ops=["perform_action"]), [LOOK], [(2, "perform_action", None, "completed", None, "share"), (1, "inspect", None, "pending", None, None)], [], ["Requested action 'share' has not been executed yet."]),
    (goal(action="open"), [LOOK], [], [], ["Requested action 'open' has not been executed yet."]),
    (goal(action="open", picks=True), [LOOK], [], [], []),
    (goal(ops=["search"]), [LOOK], [(1, "search", "Find it", "pending", None, None)], [], [completion.NO_SEARCH, "Pending required task: Find it"]),
    (goal(ops=["search"]), [act("TYPE", "query")], [(1, "search", "", "in_progress", None, None)], [], ["Pending required task: search"]),
    (goal(domain="form_filling"), [LOOK], [], [], [completion.NO_FILL]),
    (goal("click  it", domain="form_filling"), [LOOK], [], [], []),
    (goal(constraints=[("email", "=", "a@b.c", True)]), [LOOK], [], [], [completion.NO_FILL]),
    (goal(constraints=[("email", "=", "a@b.c", True)]), [act("SELECT")], [], [], []),
    (goal("compare two"), [LOOK], [], [{"a": "1"}], ["Comparison requires at least 2 candidates (inspected 1)."]),
    (goal("compare two", constraints=[("candidate_count", "=", "1", False)]), [LOOK], [], [], []),
    (goal(constraints=[LIMIT]), [LOOK], [], [{"price": "200", "brand": "x", "title": "y"}], [completion.NO_CANDIDATE]),
    (goal(constraints=[LIMIT]), [LOOK], [], [{"price": "200", "brand": "x"}], []),
    (goal(constraints=[LIMIT]), [LOOK], [], [{"price": "200", "brand": "x", "title": "y"}, {"title": "z"}], []),
    (goal(constraints=[LIMIT, ("brand", "=", "ACME", False)]), [LOOK], [], [{"price": "dear", "brand": "acme", "title": "y"}], []),
    (goal(constraints=[("rating", ">=", "4", False)]), [LOOK], [], [{"rating": "3.9", "brand": "x", "title": "y"}], [completion.NO_CANDIDATE]),
    (goal(), [LOOK], [(2, "filter", "second", "pending", None, None), (1, "filter", "first", "failed", None, None), (0, "filter", "done", "COMPLETED", None, None)], [], ["Pending required task: first"]),
    (goal(), [LOOK], [(1, "verify_goal", "v", "pending", None, None)], [], []),
    ((None,) * 8, [act()], [], [], []),
]


def test_completion_rule_by_rule(spark):
    goals = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(CASES)], GOAL)
    parts = [spark.createDataFrame([(i, *r) for i, c in enumerate(CASES) for r in c[n] for _ in range(1 if n == 2 else 2)] + [(None, *c[n][0]) for c in CASES[1:2] for _ in range(n == 1)], s) for n, s in ((1, ACTION), (2, TASK))]
    candidates = spark.createDataFrame([(i, r) for i, c in enumerate(CASES) for r in c[3]] + [(10**6, {"a": "b"})], CANDIDATE)
    got = {r.goal_id: r for r in completion.checked(goals, *parts, candidates).collect()}
    assert {i: r.missing for i, r in got.items()} == {i: c[4] for i, c in enumerate(CASES)}
    assert all(r.completed == (not r.missing) for r in got.values()) and got[0].reason == completion.NOT_STARTED and got[1].reason == completion.REACHED
    assert got[16].reason == completion.LACKS + completion.NO_SEARCH + "; Pending required task: Find it"


def test_completion_of_no_goals(spark):
    assert completion.checked(*[spark.createDataFrame([], s) for s in (GOAL, ACTION, TASK, CANDIDATE)]).collect() == []


def test_completion_of_orders_meets_every_rule(spark):
    reasons = " ".join(r.reason for r in progress.goal_completion(spark, SF).collect())
    for text in (completion.NOT_STARTED, completion.REACHED, completion.NO_CART, completion.NO_PURCHASE, completion.NO_SUBMIT, completion.NO_SEARCH, completion.NO_FILL, completion.NO_CANDIDATE, "Requested action '", "Comparison requires", "Pending required task"):
        assert text in reasons, text


def average_precision(rows):
    """Thresholds one by one, equal scores together."""
    support, area = sum(h for _, h in rows), 0.0
    for s in {s for s, h in rows if s is not None and s == s}:
        above = [h for x, h in rows if x is not None and x == x and x >= s]
        area += sum(h for x, h in rows if x == s) * sum(above) / len(above)
    return area / support if support else 0.0


@pytest.mark.parametrize("buckets", [1, 2, 64])
def test_evaluation(spark, buckets):
    rng = random.Random(buckets)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, float("nan"), 0.5, 0.5] + [rng.randrange(40) / 40 for _ in range(12)]), rng.random() < 0.4, rng.choice([True, False, None])) for _ in range(600)]
    rows += [("never", 0.1, False, False), ("missed", None, True, False)]
    got = {r["class"]: r for r in evaluation.evaluated(spark.createDataFrame(rows, "class string, score double, hit boolean, chosen boolean"), buckets).collect()}
    assert set(got) == {"a", "b", "c", "never", "missed", None}
    for name in ("a", "b", "c", "never", "missed"):
        own = [r for r in rows if r[0] == name]
        support, predicted, hits = sum(r[2] for r in own), sum(bool(r[3]) for r in own), sum(bool(r[2] and r[3]) for r in own)
        r = got[name]
        assert (r.support, r.predicted, r.hits) == (support, predicted, hits)
        assert r.precision == pytest.approx(hits / predicted if predicted else 0) and r.recall == pytest.approx(hits / support if support else 0)
        assert r.ap == pytest.approx(average_precision([(x[1], x[2]) for x in own]))
    whole = got[None]
    assert whole.support == sum(got[k].support for k in got if k) and whole.ap == pytest.approx(sum(got[k].ap for k in got if k) / 5)


def test_evaluation_of_no_rows(spark):
    rows = evaluation.evaluated(spark.createDataFrame([], "class int, score double, hit boolean, chosen boolean")).collect()
    assert [tuple(r) for r in rows] == [(None, 0, 0, 0, 0.0, 0.0, 0.0)]


def test_signs_are_found_as_by_their_whole_patterns(spark):
    from pyspark.sql import functions as F

    from inkveil import config

    texts = ["add to cart", "the carts", "my cart.", "checkout", "check out", "typed", "type", "types", "submitting", "submitted form", "xsubmit", "submit_1", "entered search", "click it", " click", "tap\n", "compare", "comparé", "écart", "buy nowé", "order placed", "form field", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *[completion._is(F.col("t"), k).alias(k) for k in completion.WORDS], *[F.coalesce(F.col("t").rlike(config.java(f"(?i:{p})")), F.lit(False)).alias(f"{k}_plain") for k, p in completion.WORDS.items()])
    for r in rows.collect():
        for k in completion.WORDS:
            assert r[k] == r[f"{k}_plain"], (k, r["t"])
    assert all(completion.NEEDED.values()) and completion.NEEDED["did_cart"] == ["add to basket", "bag", "cart"]
