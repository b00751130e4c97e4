"""Nearest brackets and division against all pairs, on ties, missing values and few or many buckets."""

import random

import pytest

from inkveil.operators import matching

BRACKETS = "bracket_id long, pos long, low double, high double"


def bracket_brute(value, brackets):
    if value is None:
        return None, None
    fits = [(abs(h - value), p, i) for i, p, lo, h in brackets if h is not None and (h <= value * matching.ABOVE if lo is None else lo <= h and lo <= value <= h * matching.BEYOND)]
    return (min(fits)[2], min(fits)[0]) if fits else (None, None)


@pytest.mark.parametrize("buckets", [1, 4, 64])
@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_bracket(spark, buckets, seed):
    rng = random.Random(seed)
    brackets = [(i, rng.randrange(20), None if rng.random() < 0.5 else float(rng.randrange(100)), None if rng.random() < 0.05 else float(rng.randrange(120))) for i in range(60)]
    targets = [(i, rng.choice([None, float(rng.randrange(1, 130)), rng.random() * 130])) for i in range(300)] + [(1000 + i, 50.0) for i in range(40)]
    got = matching.nearest_bracket(spark.createDataFrame(targets, "id long, value double"), spark.createDataFrame(brackets, BRACKETS), buckets).collect()
    assert sorted((r["id"], r["bracket_id"], r["diff"]) for r in got) == sorted((i, *bracket_brute(v, brackets)) for i, v in targets)


def test_no_brackets_or_targets(spark):
    targets, brackets = spark.createDataFrame([(1, 5.0)], "id long, value double"), spark.createDataFrame([], BRACKETS)
    assert [tuple(r) for r in matching.nearest_bracket(targets, brackets).collect()] == [(1, 5.0, None, None)]
    assert matching.nearest_bracket(targets.where("id = 0"), spark.createDataFrame([(1, 1, None, 5.0)], BRACKETS)).count() == 0


def divided_brute(sets, candidates):
    def breaks(rule, values):
        name, op, value = rule
        have = values.get(name)
        if have is None:
            return False
        return have > float(value) if op == "<=" else have < float(value) if op == ">=" else str(have).lower() != value.lower()

    out = []
    for set_id, rules in sets.items():
        ok = [i for i, values in candidates if not any(breaks(r, values) for r in rules)]
        out.append((set_id, len(ok), min(ok, default=None)))
    return sorted(out)


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_division(spark, buckets):
    rng = random.Random(buckets)
    some = lambda *x: rng.choice([*x, None])
    candidates = [(i, {"price": some(*(float(rng.randrange(30)) for _ in range(4))), "size": some(1.0, 2.0, 3.0), "brand": some("A", "b", "C"), "color": some("red", "Blue")}) for i in range(250)]
    rules = lambda: [
        ("price", rng.choice(["<=", ">="]), str(rng.randrange(30))), ("price", "<=", str(rng.randrange(30))), ("size", ">=", rng.choice("123")), ("brand", "=", rng.choice("aBcz")), ("brand", "=", rng.choice("AB")), ("color", "=", "RED"),
    ]
    sets = {s: rng.sample(rules(), rng.randrange(1, 5)) for s in range(120)}
    rows = spark.createDataFrame([(s, *r) for s, own in sets.items() for r in own], "set_id long, name string, operator string, value string")
    wide = spark.createDataFrame([(i, v["price"], v["size"], v["brand"], v["color"]) for i, v in candidates], "candidate_id long, price double, size double, brand string, color string")
    got = matching.division(rows, wide, ["price", "size"], ["brand", "color"], buckets)
    assert sorted(map(tuple, got.collect())) == divided_brute(sets, candidates)


def test_plans_have_no_nested_loop(spark):
    from inkveil.plans import catalog, matched  # noqa: F401

    for name in ("nearest_bracket", "constraint_division"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranges_that_all_overlap_are_not_paired_off_with_targets(spark):
    brackets = spark.createDataFrame([(i, i % 3, float(-50 + i % 7), float(900 + i)) for i in range(200)] + [(900 + i, 1, -90.0 - i, -80.0 + i) for i in range(5)], BRACKETS)
    targets = spark.createDataFrame([(i, v) for i, v in enumerate([-95.0, -93.0, -91.5, -90.0, -80.0, -44.0, -50.0, 0.0, 900.0, 950.5, 1099.0, 1200.0, 1263.8, 1265.0])], "id long, value double")
    out = matching.nearest_bracket(targets, brackets, 4)
    rows = [tuple(r) for r in brackets.collect()]
    assert sorted((r["id"], r["bracket_id"], r["diff"]) for r in out.collect()) == sorted((r["id"], *bracket_brute(r["value"], rows)) for r in targets.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("currentrow$(), unboundedfollowing$()") == 0
