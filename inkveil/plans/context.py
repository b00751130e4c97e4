"""Queries on items in their context: roles, OCR blocks, policies, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as c
from ..functions import geometry as g
from ..operators import context, policy
from .catalog import query, table
from .derived import fed, spread

ELEMENTS = [
    (1, 1, "e1", "n1", "email", "text", "email", "user email", ""), (1, 2, "e2", "n2", "password", "password", "", "pw", ""), (1, 3, "e3", "n3", "card_number", "text", "cc-number", "card", ""),
    (1, 4, "e4", "n4", "", "text", "", "send_to", ""), (1, 5, "e5", "n5", "misc", "search", "", "q", "searchbox"), (2, 1, "e1", "n1", "address", "text", "", "billing street", ""), (2, 2, "e2", "n9", "price", "text", "", "total", ""),
]
ELEMENT_SCHEMA = "page_id long, pos int, element_id string, node_id string, category string, type string, autocomplete string, names string, role string"
ITEMS = [
    (1, "e1", None, "email", None), (1, "x", "n2", "thing", None), (1, "y", None, "card", None), (1, "z", "n4", "thing", None), (1, "e5", None, "thing", None), (1, "w", None, "unlisted", None), (2, "a", None, "home_address", None), (2, "b", "n9", "thing", None),
    (2, "c", None, "phone", "send a message"), (3, "d", None, "address", None), (3, "f", None, "product_title", None), (3, "g", None, None, None), (3, "h", None, "login_otp", None),
]


@query
def semantic_roles(spark, sf):
    """Items with the element they belong to, and what they are there."""
    items = fed(spark, sf, "items", ITEMS, "page_id long, item_id string, node_id string, category string, request string")
    rows = context.with_element(items, fed(spark, sf, "elements", ELEMENTS, ELEMENT_SCHEMA))
    role = context.role(F.col("category"), F.col("element_type"), F.col("autocomplete"), F.col("names"), F.col("role"), F.col("request"))
    return rows.withColumn("r", role).select("page_id", "item_id", "pos", "r.role", "r.confidence")


RELEVANCE = [(1, "e1", None, "REQUIRED"), (2, None, "email", "OPTIONAL"), (3, None, "card", "IRRELEVANT"), (4, "e1", None, "OPTIONAL"), (5, None, "card", "REQUIRED")]


@query
def item_relevance(spark, sf):
    """Relevance by id, else by category; the last record counts."""
    items = fed(spark, sf, "item_names", [(i, k) for _, i, _, k, _ in ITEMS], "item_id string, category string")
    return policy.with_relevance(items, fed(spark, sf, "relevance", RELEVANCE, "pos int, item_id string, category string, relevance string"))


BLOCKS = [
    (1, 0, "Email: a@b.io", 10, 10, 100, 12, 0.9), (1, 1, "ID: 77, Name: Ana Lima", 10, 40, 100, 12, None), (1, 2, "plain", 400, 40, 50, 12, 0.5), (2, 0, "4111 1111 1111 1111", 0, 0, 50, 10, 0.99), (2, 1, "  ", 0, 0, 1, 1, 0.9), (3, 0, "otp: 4821", 5, 5, 20, 10, 0.8),
]
POLICIES = [(1, 2, "person_name", "TOKENIZE", "T1", 10, 40, 90, 12), (1, 1, "id", "LOCAL_ONLY", None, 900, 900, 5, 5), (1, 3, "", None, None, 410, 42, 30, 8), (2, 1, "phone", "REDACT", None, 700, 700, 1, 1), (3, 1, "address", "REDACT", None, 500, 500, 1, 1)]


def _boxed(spark, sf, name, rows, schema):
    own = g.box(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    return fed(spark, sf, name, rows, schema).withColumn("box", own)


@query
def ocr_pii(spark, sf):
    blocks = fed(spark, sf, "ocr_texts", [(p, n, t, s) for p, n, t, *_, s in BLOCKS], "page_id long, pos int, text string, confidence double")
    found = spread(blocks.where("trim(text) <> ''")).select("page_id", "pos", F.explode(context.ocr_found(F.col("text"), F.col("confidence"))).alias("f"))
    return found.select("page_id", "pos", "f.type", "f.value", "f.confidence")


@query
def block_policies(spark, sf):
    blocks = _boxed(spark, sf, "placed_texts", [(p, n, t, *map(float, b)) for p, n, t, *b, _ in BLOCKS], "page_id long, pos int, text string, x double, y double, width double, height double")
    rules = _boxed(spark, sf, "policies", [(*r[:5], *map(float, r[5:])) for r in POLICIES], "page_id long, rank int, category string, decision string, token string, x double, y double, width double, height double")
    return context.block_decisions(blocks.select("page_id", "pos", "text", "box"), rules)


@query
def prompt_scrub(spark, sf):
    """Texts of turns without the words that open their conversation, as if those were raw values: none remains."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    opening = turns.groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("opening"))
    values = F.slice(F.filter(F.split("opening", " "), lambda w: F.length(w) > 4), 1, 3)
    done = turns.join(opening, "conv_id").select("conv_id", "turn", F.sha2(context.without_values(F.col("text"), values), 256).alias("scrubbed_sha256"))
    return done.distinct()


@query
def screen_labels(spark, sf):
    """Turns by the kind of screen that their words ask for."""
    low, label = F.lower("text"), None
    for n, words in c.SCREEN_LABELS:
        label = F.when(low.rlike(words), n) if label is None else label.when(low.rlike(words), n)
    return table(spark, sf, "conversations").where("text IS NOT NULL").groupBy(label.otherwise(0).alias("label")).agg(F.count("*").alias("turns"))


ENTRIES = [(1, "ACTIVE", 5000), (1, "ACTIVE", 900), (1, "REVOKED", 5000), (2, "EXPIRED", 9000), (2, "ACTIVE", 1001), (3, "ACTIVE", 1000)]


@query
def vault_sizes(spark, sf):
    """Entries that still count at 1000 ms."""
    rows = fed(spark, sf, "entries", ENTRIES, "vault_id long, state string, expires_ms long")
    return rows.groupBy("vault_id").agg(F.count_if((F.col("state") == "ACTIVE") & (F.col("expires_ms") > 1000)).alias("size"))
