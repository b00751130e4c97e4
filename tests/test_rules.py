"""Rules against results worked out by hand, apart from the SQL twins."""

import zlib

import pytest
from pyspark.sql import functions as F

from inkveil import config as c
from inkveil.functions import text as t
from inkveil.operators import context, detection, entities, goals, layout, redaction, telemetry
from inkveil.plans import catalog, seeded
from inkveil.sources import pages


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def found(spark, text):
    return [(s["kind"], s["value"], s["start"]) for s in one(spark, text, detection.labelled_found(F.col("text")))]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("full name: ana lima", [("name", "ana lima", 11)]),
        ("id: 77", [("id", "77", 4)]),
        ("id: 7", []),
        ("dear Bob", [("greeting", "Bob", 5)]),
        ("Dear Customer", []),
        ("Hello GUEST", []),
        ("otp: 4821 otp: 4821", [("otp", "4821", 5)]),
        ("4821 is your code", [("otp", "4821", 0)]),
        ("4821 is not", []),
        ("card: 1234", []),
        ("Card: 4111 1111 1111 1111", [("card", "4111 1111 1111 1111", 6)]),
        ("Card: 1234 5678 9012 3456", [("labelled_card", "1234 5678 9012 3456", 6)]),
        ("", []),
        (None, []),
    ],
)
def test_labelled(spark, text, expected):
    assert [x for x in found(spark, text) if x[0] != "phone"] == expected


def test_spans_keep_their_places_beside_marks(spark):
    text = "\x01\x01\x01mail bob.smith@example.com now"
    (s,) = one(spark, text, t.spans(F.col("text"), c.EMAIL))
    assert text[s["start"] : s["end"]] == s["value"] == "bob.smith@example.com"
    spans = F.transform(t.spans(F.col("text"), c.EMAIL), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("REDACT").alias("decision"), F.lit("").alias("token")))
    assert one(spark, text, redaction.rewritten(F.col("text"), spans)) == "\x01\x01\x01mail [REDACTED] now"
    assert one(spark, "a\x01b@c.de", t.spans(F.col("text"), r"a.b"))[0]["value"] == "a\x01b"


def test_spans_of_a_long_text(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    spans = one(spark, text, t.spans(F.col("text"), "[a-z0-9]+"))
    assert len(spans) == 3000 and all(text[s["start"] : s["end"]] == s["value"] for s in spans)


@pytest.mark.parametrize(
    ("goal", "explicit", "destination", "url"),
    [
        ("Open https://example.org/a now", True, None, "https://example.org/a"),
        ("go to example.org and read", True, "example", "https://example.org"),
        ("navigate to youtube", True, "youtube", None),
        ("open amazon and buy shoes", True, "amazon", None),
        ("open mail and reply", False, None, None),
        ("open youtube", True, "youtube", None),
        ("open cart", False, None, None),
        ("", False, None, None),
    ],
)
def test_navigation(spark, goal, explicit, destination, url):
    got = one(spark, goal, goals.navigation(F.col("text")))
    assert (got["explicit"], got["destination"], got["url"]) == (explicit, destination, url)


@pytest.mark.parametrize(
    ("goal", "target", "verb", "domain"),
    [
        ("Click on the Submit button", "submit", "submit", "general"),
        ("find the report and then press download link", "download", "download", "general"),
        ("select the first", None, None, "general"),
        ("add to cart the last laptop", None, None, "ecommerce"),
        ("book a train ticket", None, None, "booking"),
        ("change the email to a@b.c", None, None, "form_filling"),
        ("confirm order", "confirm order", "confirm", "general"),
        ("read the paper and star it", None, "star", "research"),
    ],
)
def test_goal_parts(spark, goal, target, verb, domain):
    row = spark.createDataFrame([(goal,)], "text string").select(goals.click_target(F.col("text")), goals.action(F.col("text")), goals.domain(F.col("text"), F.lit(False))).first()
    assert tuple(row) == (target, verb, domain)


def test_scrub(spark):
    text = "TEST_TELEMETRY_X1 password: hunter2 with token abc?key=1&b=2 4111 1111 1111 1111 a@b.io 12 Long Oak Street"
    assert one(spark, text, telemetry.scrub(F.col("text"))) == (
        "[PROTECTED_SENTINEL] password: [PROTECTED_SECRET] with token [PROTECTED_SECRET] [CARD_NUMBER_REDACTED] [EMAIL_REDACTED] [ADDRESS_REDACTED]"
    )
    assert one(spark, "1234 5678 9012 3456", telemetry.scrub(F.col("text"))) == "1234 5678 9012 3456"
    assert one(spark, None, telemetry.scrub(F.col("text"))) is None


def test_hidden_subtrees_stay_hidden(spark):
    html = '<body><div hidden aria-label="L1"><p>a</p>SECRET1</div><div aria-hidden="true"><b><i>x</i></b>SECRET2</div><input hidden value="v"><p aria-label="L2">seen</p></body>'
    rows = pages.text_nodes(spark.createDataFrame([(1, html), (2, None), (3, "<p>z")], "page_id long, html string")).collect()
    assert [(r["page_id"], r["text"], r["source"]) for r in rows] == [(1, "L2", "aria"), (1, "seen", "text"), (3, "z", "text")]


def test_dataset_split_by_hash(spark):
    rows = catalog.QUERIES["dataset_split"](spark, "/root/testdata/sf0.001").collect()
    names = ["train"] * 8 + ["validation", "test"]
    assert rows and all(r["part"] == names[zlib.crc32(str(r["doc_id"]).encode()) % 10] for r in rows)


def brute_merge(items):
    """Spans in order of start into the first kept one that they overlap."""
    kept = []
    for i in sorted(items, key=lambda r: (r["start"], -r["confidence"], r["end"], r["source"])):
        hit = next((k for k in kept if max(k["start"], i["start"]) < min(k["end"], i["end"])), None)
        if hit is None:
            kept.append(dict(i))
        elif (hit["start"], hit["end"]) == (i["start"], i["end"]) and hit["source"] != i["source"]:
            hit.update(confidence=max(hit["confidence"], i["confidence"]), source="hybrid")
        elif i["confidence"] > hit["confidence"]:
            hit.update(i)
    return kept


def test_merged_spans_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    both = detection.both_sources(docs, "doc_id").drop("value")
    per = {}
    for r in both.collect():
        per.setdefault(r["doc_id"], []).append(r.asDict())
    want = sorted(tuple(m[k] for k in both.columns) for items in per.values() for m in brute_merge(items))
    assert sorted(tuple(r) for r in entities.merge_sources(both, "doc_id").collect()) == want


def test_ocr_lines_join_neighbours(spark):
    rows = catalog.QUERIES["ocr_lines"](spark, "/root/testdata/sf0.001").collect()
    texts = {(r["page_id"], r["text"]) for r in rows}
    assert (1, "john@example.com") in texts or (1, "john @example.com") in texts
    assert (1, "Total") in texts and (1, "42") in texts


def test_fused_items_of_fixed_boxes(spark):
    rows = catalog.QUERIES["fused_items"](spark, "/root/testdata/sf0.001").where("page_id < 1000000").collect()  # the fixed ones
    assert len(rows) < len(seeded.ITEMS) and {r["page_id"] for r in rows} == {1, 2}
    assert layout.fuse


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (' {"a": 1} ', '{"a":1}'),
        ('Sure:\n```json\n{"a": [1, 2]}\n```', '{"a":[1,2]}'),
        ('I think {not json} but {"b": "}"} fits', '{"b":"}"}'),
        ("3", None),
        ("", None),
        (None, None),
        ("{", None),
    ],
)
def test_recovered_json(spark, text, expected):
    assert one(spark, text, context.recovered_json(F.col("text"))) == expected


def test_values_are_gone_from_prompts(spark):
    row = spark.createDataFrame([("ann anna x", ["ann", "anna", "", "ann"])], "text string, v array<string>")
    assert row.select(context.without_values(F.col("text"), F.col("v")).alias("x")).first()["x"] == "[REDACTED] [REDACTED] x"


def test_fusion_keeps_names_apart(spark):
    """Fusion folds five kinds of names only; the context's own rules fold more."""
    from inkveil.operators import context, layout

    rows = spark.createDataFrame([(x,) for x in ("first_name", "home_address", "email_field", "Card", None)], "c string")
    got = rows.select(layout.fused_category(F.col("c")), context.normal_category(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("first_name", "person_name"), ("home_address", "address"), ("email", "email"), ("payment_card", "payment_card"), ("", "")]


def test_limits_of_goals_end_before_a_last_newline_only_with_the_text(spark):
    from inkveil.operators import planning

    none = F.lit(None).cast("string")
    texts = ["compare laptops over 1k that\n", "compare laptops over 1k that"]
    rows = spark.createDataFrame([(t,) for t in texts], "goal string").select(planning.target_entity(F.col("goal"), F.lit("general"), none, none).alias("e"))
    assert [r["e"] for r in rows.collect()] == ["laptops over 1k that\n", "laptops"]


def test_lines_and_fused_items_as_one_group_at_a_time_gives_them(spark):
    """Over several partitions and batches, with missing numbers and texts; no frame for each page."""
    blocks = spark.createDataFrame(
        [(p, i, t, float(x), float(y), 30.0, 10.0, c) for p in range(300) for i, (t, x, y, c) in enumerate([("a", 0, 0, 0.9), ("@b", 35, 3, 0.5), (None, 36, 3, 0.1), ("far", 200, 0, 0.8), ("low", 0, 40, None), ("er", 32, 41, 0.7)])],
        seeded.BLOCK_SCHEMA,
    ).repartition(5)
    lines = layout.stitch(blocks, "page_id")
    assert "FlatMapGroups" not in lines._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in lines.collect():
        got.setdefault(r["page_id"], []).append((r["pos"], r["text"], r["width"]))
    assert got == {p: [(0, "a@b", 65.0), (1, "far", 30.0), (2, "low er", 62.0)] for p in range(300)}
    schema = "page_id long, pos int, category string, source string, evidence array<string>, x double, y double, width double, height double"
    items = [(p, i, k, s, ["PATTERN"], x, 0.0, 10.0, 10.0) for p in range(300) for i, (k, s, x) in enumerate([("email", "dom", 0.0), ("email_field", "ocr", 5.0), ("phone", "dom", 5.0), ("email", "dom", 300.0)])]
    rows = layout.fuse(spark.createDataFrame(items, schema).repartition(5)).collect()
    assert sorted((r["page_id"], r["category"], r["no"], r["source"], r["members"]) for r in rows) == sorted(x for p in range(300) for x in [(p, "email", 0, "fusion", 2), (p, "email", 1, "dom", 1), (p, "phone", 0, "dom", 1)])
