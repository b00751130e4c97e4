"""Further reference queries: guards, fields, boxes, spans in order. Inputs that the tables lack are inline rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as c
from ..functions import geometry as g
from ..functions import text as t
from ..operators import detection as d
from ..operators import entities as en
from ..operators import gates, layout
from ..operators import policy as p
from ..sources import pages as pg
from .catalog import query, table
from .derived import derived, fed, spread

FIELDS = [
    (1, "password", "", "pw", "", "", "", ""), (2, "text", "email", "user", "", "", "", ""), (3, "tel", "", "x", "", "", "", ""), (4, "text", "cc-number", "", "", "", "", ""), (5, "text", "one-time-code", "", "", "", "", ""),
    (6, "text", "", "full-name", "", "", "", "Full name"), (7, "text", "street-address", "", "", "", "", ""), (8, "text", "", "customer-id", "", "", "", ""), (9, "text", "", "q", "", "Search", "", ""),
    (10, "text", "given-name", "", "", "", "", ""), (11, "text", "", "iban", "", "", "", ""), (12, "text", "", "cvv", "", "", "", "Security code"), (13, "text", "nickname", "", "", "", "", "Nick"), (14, "text", "", "", "", "Zip Code", "", ""),
]
FIELD_COLUMNS = ["type", "autocomplete", "name", "id", "placeholder", "aria_label", "label_text"]


@query
def field_categories(spark, sf):
    rows = fed(spark, sf, "fields", FIELDS, "field_id long, " + ", ".join(f"{x} string" for x in FIELD_COLUMNS))
    own = [F.col(x) for x in FIELD_COLUMNS]
    return rows.select("field_id", gates.field_category(*own).alias("category"), gates.field_semantics(*own).alias("semantics"))


@query
def payload_firewall(spark, sf):
    """The first reason why a document may not be sent, counted."""
    reason = gates.payload_reason(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.given(reason).alias("reason"))


RESPONSES = [
    (1, '{"ok": true, "status": "DONE", "recommendedActions": []}'), (2, '{"status": "DONE"}'), (3, '{"ok": true, "status": "DONE", "recommendedActions": {"a": 1}}'),
    (4, '{"ok": false, "status": "X", "recommendedActions": [' + ",".join(["1"] * 11) + "]}"), (5, '{"ok": true, "status": "X", "recommendedActions": [{"t": "<script>"}]}'),
    (6, '{"ok": true, "status": "X", "recommendedActions": [{"t": "vaultSecret"}]}'), (7, '{"ok": true, "status": "X", "recommendedActions": [{"executeDirectly": true}]}'), (8, '{"ok": true, "status": "X"}'),
]


@query
def response_firewall(spark, sf):
    rows = fed(spark, sf, "responses", RESPONSES, "response_id long, json string")
    return rows.select("response_id", F.coalesce(gates.response_reason(F.col("json")), F.lit("VALID")).alias("verdict"))


STORES = [
    (1, "email", "P1", 10, True, "LOCAL_BROWSER", None, None), (2, " ", "P1", 10, True, "LOCAL_BROWSER", None, None), (3, "email", None, 10, True, "LOCAL_BROWSER", None, None), (4, "email", "P1", 0, True, "LOCAL_BROWSER", None, None),
    (5, "email", "P1", 10001, True, "LOCAL_BROWSER", None, None), (6, "email", "P1", 10, False, "LOCAL_BROWSER", None, None), (7, "email", "P1", 10, True, "REMOTE_SERVICE", None, None), (8, "email", "P1", 10, True, "LOCAL_BROWSER", False, None),
    (9, "email", "P1", 10, True, "LOCAL_EXTENSION", True, "REDACT"), (10, "email", "P1", 10, True, "LOCAL_EXTENSION", True, "ALLOW"),
]


@query
def vault_store_codes(spark, sf):
    rows = fed(spark, sf, "stores", STORES, "op_id long, category string, pii_id string, length int, purpose_ok boolean, destination string, authorized boolean, policy string")
    return rows.select("op_id", gates.store_code(*[F.col(x) for x in ("category", "pii_id", "length", "purpose_ok", "destination", "authorized", "policy")]).alias("code"))


ASKED_ACTIONS = [
    (1, "CLICK", "LOCAL_BROWSER", True, None, "{}"), (2, "HACK", "LOCAL_BROWSER", True, None, "{}"), (3, "CLICK", "REMOTE_SERVICE", True, None, "{}"), (4, "CLICK", "LOCAL_BROWSER", False, None, "{}"),
    (5, "NAVIGATE", "LOCAL_BROWSER", True, "javascript:x", "{}"), (6, "NAVIGATE", "LOCAL_BROWSER", True, "https://a.b/", "{}"), (7, "TYPE", "LOCAL_EXTENSION", True, None, '{"text": "eval(1)"}'), (8, "NAVIGATE", "LOCAL_BROWSER", True, None, "{}"),
]


@query
def action_codes(spark, sf):
    rows = fed(spark, sf, "actions", ASKED_ACTIONS, "action_id long, kind string, destination string, has_target boolean, url string, parameters string")
    return rows.select("action_id", gates.action_code(*[F.col(x) for x in ("kind", "destination", "has_target", "url", "parameters")]).alias("code"))


@query
def page_protocols(spark, sf):
    return table(spark, sf, "pages").groupBy(gates.protocol_allowed(F.col("url")).alias("allowed")).agg(F.count("*").alias("pages"))


TASKS = [
    (1, "READ_INFORMATION", [], ["email"], False, False), (2, "LOGIN", ["phone"], [], True, False), (3, "VERIFY_IDENTITY", [], [], False, False), (4, "CONTACT", [], [], False, True), (5, "SUBMIT_FORM", [], [], True, False),
    (6, "FIND_INFORMATION", [], ["email"], True, False), (7, "ENTER_INFORMATION", [], [], False, False), (8, "OTHER", [], [], False, False),
]
TASK_CATEGORIES = ["email", "phone", "otp", "price", "payment_card"]


@query
def task_relevance(spark, sf):
    rows = fed(spark, sf, "tasks", TASKS, "task_id long, intent string, negated array<string>, named array<string>, field boolean, contact boolean")
    rows = rows.select("*", F.explode(F.array(*map(F.lit, TASK_CATEGORIES))).alias("category"))
    out = gates.relevance(*[F.col(x) for x in ("category", "intent", "negated", "named", "field", "contact")])
    return rows.withColumn("r", out).select("task_id", "category", "r.relevance", "r.confidence", p.necessity(F.col("category"), F.col("r.relevance")).alias("necessity"))


ELEMENTS = [
    (1, "phone number", "tel_1", "tel"), (2, "email address", "user_email", "email"), (3, "submit order", "btn_submit", "submit"), (4, "", "confirm_order", "button"), (5, "cancel", "c", "button"), (6, "your message", "msg", "textarea"),
]
TARGETS = [(1, "phone number"), (2, "the email"), (3, "confirm order"), (4, "message"), (5, "nothing alike")]


@query
def target_resolution(spark, sf):
    """The best element of each target, more than 20 points, ties to the first; six fixed elements, so they are one broadcast array."""
    elements = F.array(*[F.struct(F.lit(i).cast("long").alias("element_id"), F.lit(s).alias("shown"), F.lit(k).alias("code"), F.lit(t).alias("kind")) for i, s, k, t in ELEMENTS])
    rows = spread(fed(spark, sf, "targets", TARGETS, "target_id long, target string")).select("*", F.explode(elements).alias("e"))
    scored = rows.select("target_id", "e.element_id", gates.target_score(F.col("target"), F.col("e.shown"), F.col("e.code"), F.col("e.kind")).cast("long").alias("score"))
    best = scored.groupBy("target_id").agg(F.max_by(F.struct("element_id", "score"), F.struct(F.col("score"), -F.col("element_id"))).alias("b"))
    return best.select("target_id", "b.element_id", "b.score").where("score > 20")


@query
def value_dedup(spark, sf):
    """One row for each category and normalised value of a document."""
    found = d.hybrid_spans(table(spark, sf, "documents"), "doc_id")
    return layout.distinct_values(found, ["doc_id"], ["start", "end", "confidence"]).select("doc_id", "category", "normal", "start")


@query
def decision_badges(spark, sf):
    """Decisions of e-mail, phone and card spans with what a reviewer is shown: a fixed dimension, broadcast."""
    badges = spark.createDataFrame(BADGES, "decision string, label string, css string")
    found = d.hybrid_spans(table(spark, sf, "documents"), "doc_id").withColumn("decision", F.when(F.col("category") == "email", "TOKENIZE").when(F.col("category") == "payment_card", "LOCAL_ONLY").otherwise("REDACT"))
    return found.join(F.broadcast(badges), "decision", "left").groupBy("label", "css").agg(F.count("*").alias("n"))


BADGES = [("ALLOW", "ALLOW", "privacy-badge-allow"), ("TOKENIZE", "TOKENIZE", "privacy-badge-tokenize"), ("LOCAL_ONLY", "LOCAL_ONLY", "privacy-badge-local"), ("REDACT", "REDACT", "privacy-badge-redact")]
BLOCKS = [
    (1, 0, "john", 10, 10, 40, 12, 91.0), (1, 1, "@example.com", 52, 12, 90, 12, 80.0), (1, 2, "Total", 10, 60, 50, 12, 55.0), (1, 3, "42", 300, 61, 20, 12, 99.0), (2, 0, "Name:", 5, 5, 40, 10, 88.0), (2, 1, "Ana", 48, 6, 30, 11, 70.0), (2, 2, None, 0, 0, 1, 1, 90.0),
]
BLOCK_SCHEMA = "page_id long, pos int, text string, x double, y double, width double, height double, confidence double"


def _blocks(spark, sf):
    return fed(spark, sf, "blocks", [(a, b, t, *map(float, r)) for a, b, t, *r in BLOCKS], BLOCK_SCHEMA)


@query
def ocr_blocks(spark, sf):
    """Blocks worth reading: text that isn't blank, confidence of 60 or more, at most 500 a page; confidence as a share."""
    from pyspark.sql import Window

    kept = _blocks(spark, sf).where("trim(text) <> '' AND confidence >= 60")
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return kept.withColumn("n", n).where("n <= 500").select("page_id", "pos", "text", F.round(F.col("confidence") / 100, 2).alias("confidence"))


@query
def ocr_lines(spark, sf):
    return layout.stitch(_blocks(spark, sf), "page_id").select("page_id", "pos", "text", "width", "confidence")


@query
def cover_boxes(spark, sf):
    rows = _blocks(spark, sf).where("width > 0 AND height > 0").select("page_id", "pos", layout.cover(g.box(F.col("x"), F.col("y"), F.col("width"), F.col("height"))).alias("c"))
    return rows.select("page_id", "pos", "c.x", "c.y", "c.width", "c.height")


ITEMS = [
    (1, 0, "email", "dom", ["DOM_SEMANTIC", "PATTERN"], 50, 50, 100, 20), (1, 1, "EMAIL_FIELD", "ocr", ["OCR_VISUAL", "PATTERN"], 52, 51, 98, 18), (1, 2, "phone", "dom", ["PATTERN"], 50, 50, 100, 20),
    (1, 3, "email", "dom", ["PATTERN"], 400, 50, 100, 20), (2, 0, "payment_card", "dom", ["CHECKSUM", "PATTERN"], 0, 0, 10, 10), (2, 1, "card", "dom", ["PATTERN"], 15, 0, 10, 10), (2, 2, "card", "ocr", ["OCR_VISUAL"], 32, 0, 10, 10),
]


@query
def fused_items(spark, sf):
    rows = [(a, b, k, s, e, *map(float, r)) for a, b, k, s, e, *r in ITEMS]
    return layout.fuse(fed(spark, sf, "fusable", rows, "page_id long, pos int, category string, source string, evidence array<string>, x double, y double, width double, height double"))


@query
def doc_entities(spark, sf):
    """Named spans of documents, the best that don't overlap, from the operator's own threshold on."""
    return en.best_disjoint(en.entity_candidates(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id"), "doc_id").drop("value")


@query
def doc_merged_spans(spark, sf):
    """Core and strict spans merged in order of start."""
    return en.merge_sources(d.both_sources(table(spark, sf, "documents"), "doc_id").drop("value"), "doc_id")


@query
def event_status(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("total"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count_distinct("user_id").alias("clients"))


@query
def event_stage_pivot(spark, sf):
    e = table(spark, sf, "events").where("event_type IN ('click', 'error', 'view')")
    return e.groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1))).na.fill(0).select("user_id", *[F.col(x).alias(f"{x}_n") for x in ("click", "error", "view")])


@query
def order_plan_summary(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count_if(F.col("o_orderstatus") != "F").alias("pending"), F.bool_and(F.col("o_totalprice") > 0).alias("all_priced"))


@query
def dataset_split(spark, sf):
    """80/10/10 by a hash of the key: the same for every run and partitioning."""
    bucket = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    part = F.when(bucket < 8, "train").when(bucket == 8, "validation").otherwise("test")
    return table(spark, sf, "documents").select("doc_id", part.alias("part"))


LABEL_LINES = [(1, "0 0.5 0.5 0.2 0.2"), (2, "16 0.5 0.5 0.2 0.2"), (3, "1 0.5 0.5"), (4, "x 0.5 0.5 0.1 0.1"), (5, "2 1.5 0.5 0.1 0.1"), (6, ""), (7, "3 0.1 0.2 0.3 0.4")]


@query
def label_line_errors(spark, sf):
    """Lines `class cx cy w h`: the first thing wrong with each."""
    f = F.split(F.trim("line"), r"\s+")
    cls, values = F.try_element_at(f, F.lit(1)).try_cast("int"), F.transform(F.slice(f, 2, 4), lambda x: x.try_cast("double"))
    reason = (
        F.when(F.trim("line") == "", "EMPTY").when(F.size(f) != 5, "FIELDS").when(cls.isNull(), "CLASS").when(~cls.between(0, 15), "CLASS_RANGE")
        .when(F.exists(values, lambda x: x.isNull()), "NUMBER").when(F.exists(values, lambda x: ~x.between(0, 1)), "RANGE").otherwise("OK")
    )
    return fed(spark, sf, "label_lines", LABEL_LINES, "line_no long, line string").select("line_no", reason.alias("reason"))


@query
def page_elements(spark, sf):
    """Numbered interactive elements: links in order of appearance, 100 a page at most."""
    return pg.links(table(spark, sf, "pages")).where(F.substring("element_id", 4, 9).cast("int") <= 100).groupBy("page_id").agg(F.count("*").alias("elements"))


@query
def legacy_policy(spark, sf):
    """The short form: classification, purpose, reference, authorization."""
    rows = spark.range(1).select()
    for name, values in (("classification", ("sensitive", "not_sensitive")), ("purpose", ("remote_reasoning", "local_action", "other")), ("reference", (True, False)), ("authorized", (True, False))):
        rows = rows.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    rows = rows.unionByName(derived(spark, sf, "short_policies"))
    local, remote = F.col("purpose") == "local_action", F.col("purpose") == "remote_reasoning"
    category = F.when(local, "password_field").otherwise("email")
    needed = (local & F.col("authorized")) | (remote & F.col("reference"))
    relevance = F.when(needed, "REQUIRED").otherwise("IRRELEVANT")
    place = F.when(remote, "REMOTE_REASONING").when(local, "LOCAL_BROWSER").otherwise("UNKNOWN_DESTINATION")
    one, confidence = F.lit(0.9), F.lit(0.95)
    full = p.decide(category, F.lit(None).cast("string"), relevance, F.lit("UNKNOWN"), place, F.col("authorized"), confidence, one, one)["decision"]
    decision = F.when(F.col("classification") == "not_sensitive", "ALLOW").otherwise(full)
    return rows.select("*", decision.alias("decision"), decision.isin("ALLOW", "TOKENIZE").alias("may_leave"))


@query
def opaque_tokens(spark, sf, key: str = "bench-key"):
    """Keyed tokens of the documents' addresses: equal values have equal tokens, and none shows its value."""
    found = d.spans_of(table(spark, sf, "documents"), "doc_id", "text", c.EMAIL)
    token = F.concat(F.lit("PII_TOKEN_EMAIL_"), F.substring(F.sha2(F.concat(F.lit(f"{key}:"), F.col("value")), 256), 1, 12))
    return found.select("doc_id", "start", token.alias("token"))
