"""Queries on JSON payloads: telemetry without secrets, payloads for remote reasoning. Payloads are made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as c
from ..functions import text as t
from ..operators import detection as d
from ..operators import json_tree as jt
from .catalog import query, table


def _turn_payloads(spark, sf):
    """A nested telemetry event for each turn, with secrets in every place that the rules know."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    no = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    secret, mail = F.concat(F.lit("s3cret-"), no), F.concat(F.lit("u"), no, F.lit("@example.com"))
    said = F.concat(F.col("text"), F.lit(" password: "), secret)
    payload = F.struct(
        F.col("role").alias("event"), said.alias("task"), F.col("turn").alias("step"), F.concat(F.lit("<p>"), F.col("text")).alias("html"), F.lit("AAAA").alias("rawScreenshot"),
        F.struct(F.struct(secret.alias("Password"), mail.alias("mail"), F.array(mail, F.lit("public")).alias("list"), secret.alias("User_Input")).alias("auth"), F.lit(None).cast("string").alias("cvv")).alias("data"),
        F.struct(secret.alias("secretValue"), F.lit("password_field").alias("category"), F.lit("login").alias("purpose")).alias("entry"),
        F.struct(F.concat(F.lit("PII_TOKEN_EMAIL_"), no).alias("token"), mail.alias("value"), F.lit("email").alias("category")).alias("mapping"),
    )
    return turns.select("conv_id", "turn", F.array(secret, mail).alias("sentinels"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


@query
def telemetry_payloads(spark, sf):
    rows = jt.scrubbed(_turn_payloads(spark, sf), "payload")
    return rows.select("conv_id", "turn", F.sha2("payload", 256).alias("payload_sha256"), F.length("payload").cast("long").alias("chars"))


@query
def telemetry_payload_leaks(spark, sf):
    """Scrubbed payloads that still hold a secret: no rows."""
    rows = jt.scrubbed(_turn_payloads(spark, sf), "payload")
    return rows.where(F.exists("sentinels", lambda s: F.instr(F.col("payload"), s) > 0)).select("conv_id", "turn")


@query
def telemetry_payload_leaks_control(spark, sf):
    """The same audit of the raw payloads finds all of them."""
    return _turn_payloads(spark, sf).where(F.exists("sentinels", lambda s: F.instr(F.col("payload"), s) > 0)).select("conv_id", "turn")


@query
def event_props_scrubbed(spark, sf):
    """Free-form properties of events, scrubbed; null where they are no JSON."""
    return jt.scrubbed(table(spark, sf, "events").select("event_id", "props"), "props")


@query
def payload_assembly(spark, sf):
    """Documents as payloads for remote reasoning: lines as blocks and elements, addresses as tokens."""

    def tokens(text):
        mails = F.array_distinct(F.transform(d.checked(text, c.EMAIL), lambda s: s["value"]))
        return F.transform(mails, lambda m, i: F.struct(F.concat(F.lit("EMAIL_"), (i + 1).cast("string")).alias("token"), F.lit("email").alias("category")))

    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("task"))
    rows = docs.select("doc_id", "task", F.lit("READ_INFORMATION").alias("intent"), F.split("task", "\n", -1).alias("blocks"), t.let(F.col("task"), tokens).alias("tokens"))
    elements = F.transform("blocks", lambda b, i: F.struct(F.concat(F.lit("el_"), (i + 1).cast("string")).alias("elementId"), F.substring(b, 1, 120).alias("text"), F.length(b).alias("value")))
    built = jt.assembled(rows.withColumn("elements", elements), "doc_id")
    return built.select("doc_id", "ok", "status", "bytes", F.sha2("payload", 256).alias("payload_sha256"))
