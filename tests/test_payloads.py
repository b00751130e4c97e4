"""JSON rewriting against a plain walk over random payloads, and what must never leave."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from inkveil import config as c
from inkveil.operators import json_tree

SENSITIVE = re.compile(f"^(?:{'|'.join(c.SENSITIVE_KEYS)})$", re.IGNORECASE)
KEYS = ["a", "b", "password", "Secret_Value", "token", "value", "category", "secretValue", "html", "rawScreenshot", 'é"q', "task", "isVaultInstance", "purpose", " otp "]


def given(v):
    return bool(v) or isinstance(v, list | dict)


def walked(x):
    if isinstance(x, str):
        return x.replace("a@b.io", "[EMAIL_REDACTED]")
    if isinstance(x, list):
        return [walked(v) for v in x]
    if not isinstance(x, dict):
        return x
    either = lambda k, other: x[k] if given(x.get(k)) else other
    if given(x.get("isVaultInstance")) or ("secretValue" in x and "category" in x):
        return {"isVaultProtected": True, "category": either("category", "vault_entry"), "purpose": either("purpose", "local_execution"), "status": "PROTECTED_LOCAL_ONLY"}
    if isinstance(x.get("token"), str) and x["token"].startswith("PII_TOKEN_") and given(x.get("value")):
        return {"token": x["token"], "category": either("category", "tokenized_entity"), "value": c.PROTECTED_MAPPING}
    out = {}
    for k, v in x.items():
        hidden = c.RAW_PAGE if k in c.RAW_PAGE_KEYS else c.RAW_IMAGE if k in c.RAW_IMAGE_KEYS else None
        out[k] = (None if v is None else c.PROTECTED) if SENSITIVE.match(k.strip()) else hidden or walked(v)
    return out


def some(rng, depth):
    r = rng.random()
    if depth == 0 or r < 0.35:
        return rng.choice([None, True, False, 0, 1, -7, 2.5, "", "x", "mail a@b.io", "PII_TOKEN_E1", 'línea\n"q"\\', "\x01", "[{"])
    if r < 0.55:
        return [some(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: some(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(6))}


def test_scrubbed_as_a_walk_does(spark):
    rng = random.Random(4)
    values = [some(rng, 5) for _ in range(800)]
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=rng.random() < 0.5)) for i, v in enumerate(values)], "id long, payload string").repartition(4)
    got = dict(json_tree.scrubbed(rows, "payload").collect())
    for i, v in enumerate(values):
        assert json.dumps(json.loads(got[i]), sort_keys=True) == json.dumps(walked(v), sort_keys=True)


def test_what_is_no_json_does_not_leave(spark):
    rows = spark.createDataFrame([(1, "nope"), (2, None), (3, '{"a":1,"a":2}'), (4, ""), (5, '"only a@b.io"'), (6, "{}"), (7, "[]")], "id long, payload string")
    assert dict(json_tree.scrubbed(rows, "payload").collect()) == {1: None, 2: None, 3: None, 4: None, 5: '"only [EMAIL_REDACTED]"', 6: "{}", 7: "[]"}


def test_levels_are_measured_and_what_is_deeper_is_closed(spark):
    deep = "x"
    for _ in range(12):
        deep = {"a": [deep]}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, '{"s":"[[[[{{{{"}')], "id long, payload string")
    assert json_tree.deepest(rows, "payload") == 24
    assert json.loads(dict(json_tree.scrubbed(rows, "payload").collect())[1]) == deep
    assert dict(json_tree.scrubbed(rows, "payload", levels=1).collect())[1] == '{"a":["[TOO_DEEP]"]}'


def test_remote_payload(spark):
    text = '{"b":{"Value":1,"c":"4111 1111 1111 1111"},"a":[{"note":"mail x@y.zz","OTP":"1"},3,null]}'
    rows = json_tree.remote(spark.createDataFrame([(1, text)], "id long, payload string"), "payload")
    assert rows.first()["payload"] == '{"a":[{"note":"mail [EMAIL_REDACTED]"},3,null],"b":{"c":"[CARD_REDACTED]"}}'


@pytest.mark.parametrize("most,ok", [(10_000, True), (100, False)])
def test_assembly_is_refused_beyond_its_size(spark, most, ok):
    row = ("k", "find x@y.zz " + "t" * 600, "LOGIN", [("el_1", "button")], ["a 4111111111111111"], [("EMAIL_1", "email"), ("EMAIL_1", "email")])
    rows = spark.createDataFrame([row], "id string, task string, intent string, elements array<struct<elementId:string,value:string>>, blocks array<string>, tokens array<struct<token:string,category:string>>")
    got = json_tree.assembled(rows, "id", most_bytes=most).first()
    assert (got["ok"], got["status"]) == (ok, "SANITIZED" if ok else "REJECTED")
    if not ok:
        assert got["payload"] is None
        return
    payload = json.loads(got["payload"])
    assert payload["userTask"] == "find [EMAIL_REDACTED] " + "t" * 488 and payload["interactiveElements"] == [{"elementId": "el_1"}]
    assert payload["visualBlocks"] == ["a [CARD_REDACTED]"] and payload["metadata"]["tokensCount"] == 1 and set(payload["tokenMapping"]) == {"EMAIL_1"}


def test_no_python_worker_and_no_shuffle(spark):
    rows = json_tree.scrubbed(spark.range(3).select("id", F.lit('{"a":["x"]}').alias("payload")), "payload", levels=2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name,pattern,most", [("telemetry_scrub", "regexp_replace(", 7), ("telemetry_leaks", "regexp_replace(", 7), ("remote_strings", "regexp_replace(", 2), ("token_secret_scrub", "regexp_replace(", 2), ("payload_firewall", "RLIKE(", 9), ("payload_audit", "RLIKE(", 4)])
def test_expressions_are_computed_once(spark, name, pattern, most):
    """No filter repeats what the projection computes."""
    from inkveil.plans import seeded, spoken  # noqa: F401
    from inkveil.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(pattern) <= most, plan
