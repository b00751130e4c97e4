"""What an item means where it stands: its element, its role, OCR blocks under policies, and texts of models."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions import geometry as g
from . import detection


def normal_category(category: Column) -> Column:
    low, out = F.lower(F.coalesce(category, F.lit(""))), None
    for part, name in c.CATEGORY_PARTS:
        out = F.when(F.contains(low, F.lit(part)), name) if out is None else out.when(F.contains(low, F.lit(part)), name)
    return out.otherwise(low)


def with_element(items: DataFrame, elements: DataFrame) -> DataFrame:
    """Each item (item_id, node_id, category) with the first element (pos) of the page that has its id, its node or its category.

    Three equi-joins on keys instead of one on an OR condition; the first position of all three counts.
    """
    named = elements.select("page_id", "pos", "element_id", F.col("node_id").alias("element_node"), normal_category(F.col("category")).alias("kind"))
    keyed = items.select("page_id", "item_id", "node_id", normal_category(F.col("category")).alias("kind"))

    def first(left: str, right: str) -> DataFrame:
        own = named.groupBy("page_id", F.col(right).alias("key")).agg(F.min("pos").alias("pos"))
        return keyed.select("page_id", "item_id", F.col(left).alias("key")).join(own, ["page_id", "key"]).select("page_id", "item_id", "pos")

    found = first("item_id", "element_id").unionByName(first("node_id", "element_node")).unionByName(first("kind", "kind")).groupBy("page_id", "item_id").agg(F.min("pos").alias("pos"))
    shown = elements.select("page_id", "pos", F.col("type").alias("element_type"), "autocomplete", "names", "role")
    return items.join(found, ["page_id", "item_id"], "left").join(shown, ["page_id", "pos"], "left")


def role(category: Column, kind: Column, autocomplete: Column, names: Column, element_role: Column, contact_request: Column) -> Column:
    """struct<role, confidence>: the first of eight rules. contact_request: the request if its intent is to contact someone."""
    cat = normal_category(category)
    kind, auto, text = (F.lower(F.coalesce(x, F.lit(""))) for x in (kind, autocomplete, names))
    has = {k: text.rlike(c.java(p)) for k, p in c.ROLE_WORDS.items()}
    auto_has = lambda *parts: F.greatest(*[F.contains(auto, F.lit(x)) for x in parts]) if len(parts) > 1 else F.contains(auto, F.lit(parts[0]))
    asked = F.coalesce(F.lower(contact_request).rlike(c.java(c.ROLE_WORDS["sending"])), F.lit(False))
    rules = [
        ((kind == "password") | auto_has("password") | cat.isin("password_field", "otp") | has["secret"], "authentication_secret", 0.96),
        ((cat == "payment_card") | auto_has("cc-", "card", "billing") | has["billing"], "billing_information", 0.94),
        (((cat == "address") & ~F.contains(text, F.lit("billing"))) | auto_has("shipping", "street-address", "postal-code") | has["shipping"], "shipping_information", 0.90),
        (has["recipient"] | asked, "recipient", 0.88),
        (cat.isin("email", "phone", "account_identifier", "person_name") | auto_has("email", "username", "tel") | has["account"], "account_identifier", 0.90),
        (cat.isin(c.PUBLIC) | has["product"], "public_product_attribute", 0.95),
        ((kind == "search") | F.coalesce(element_role == "searchbox", F.lit(False)) | has["search"], "search_target", 0.92),
    ]
    out = None
    for test, name, confidence in rules:
        value = F.struct(F.lit(name).alias("role"), F.lit(confidence).alias("confidence"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit("general_data").alias("role"), F.lit(0.70).alias("confidence")))


def ocr_found(text: Column, confidence: Column) -> Column:
    """Spans of a block's trimmed text: array<struct<type, value, confidence>>, surer blocks surer."""
    pick = lambda table, kind: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), kind)
    base = F.coalesce(confidence, F.lit(0.95))

    def one(s: Column) -> Column:
        sure = F.round(F.least(F.lit(1.0), base * pick(c.KIND_CONFIDENCE, s["kind"])), 2)
        return F.struct(pick(c.KIND_TYPE, s["kind"]).alias("type"), s["value"].alias("value"), sure.alias("confidence"))

    return F.transform(detection.labelled_found(F.trim(text)), one)


def block_decisions(blocks: DataFrame, policies: DataFrame) -> DataFrame:
    """Each block (page_id, pos, text, box) with the first policy (rank, category, decision, token, box) of its page that it meets or that names it.

    A page's policies are few; the pairs of one page only are compared, and the first is kept by a minimum, not by a sort.
    """
    rules = policies.select("page_id", "rank", F.lower(F.coalesce("category", F.lit(""))).alias("named"), "decision", "token", F.col("box").alias("rule_box"))
    both = blocks.join(rules, "page_id")
    wide = F.greatest(*[F.contains("named", F.lit(x)) for x in ("password", "card", "email", "phone")])
    meets = F.coalesce(g.overlap(F.col("rule_box"), F.col("box")), F.lit(False)) | ((F.col("named") != "") & (F.contains(F.lower("text"), F.col("named")) | wide))
    first = both.where(meets).groupBy("page_id", "pos").agg(F.min(F.struct("rank", F.coalesce("decision", F.lit("REDACT")).alias("decision"), "token")).alias("first"))
    return blocks.join(first, ["page_id", "pos"], "left").select("page_id", "pos", F.col("first.decision").alias("decision"), F.col("first.token").alias("token"))


def without_values(text: Column, values: Column) -> Column:
    """The text with every known raw value replaced, longer ones first."""
    order = F.array_sort(F.filter(F.array_distinct(values), lambda v: F.length(v) > 0), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(F.coalesce(order, F.array().cast("array<string>")), text, lambda done, v: F.replace(done, v, F.lit("[REDACTED]")))


_FENCED = re.compile(r"```(?:json)?\s*([\s\S]*?)\s*```", re.IGNORECASE)


def _recovered(text: str | None) -> str | None:
    """The first object or array in a model's text: the whole, then fenced blocks, then whatever starts at a brace."""
    decoder = json.JSONDecoder()
    text = (text or "").strip()
    for candidate in [text, *(m[1].strip() for m in _FENCED.finditer(text))]:
        try:
            value = json.loads(candidate)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict | list):
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
    return None


def recovered_json(column: Column) -> Column:
    """JSON of a model's answer, null without any."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_recovered)

    return run(column)
