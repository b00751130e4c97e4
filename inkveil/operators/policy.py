"""The decision ladders, as one `when` chain each: no rows move, nothing leaves code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as c


def sensitivity(category: Column) -> Column:
    low = [x for x in c.PUBLIC if x != "public_text"]
    return (
        F.when(category.isin(c.CRITICAL), "CRITICAL").when(category.isin(c.HIGH), "HIGH").when(category.isin(low), "LOW").when(category == "public_text", "PUBLIC").otherwise("MEDIUM")
    )


def decide(
    category: Column, role: Column, relevance: Column, necessity: Column, destination: Column, authorized: Column, detection: Column, relevance_confidence: Column, necessity_confidence: Column
) -> Column:
    """struct<decision, reason, confidence>: the first rung of the ladder that holds."""

    def out(decision: str | Column, reason: str | Column, confidence: float) -> Column:
        d = F.lit(decision) if isinstance(decision, str) else decision
        r = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(d.alias("decision"), r.alias("reason"), F.lit(confidence).alias("confidence"))

    role_, level = F.coalesce(role, F.lit("")), sensitivity(category)
    local, remote = destination.isin(c.LOCAL), destination.isin(c.REMOTE)
    unneeded = (relevance == "IRRELEVANT") | (necessity == "UNNECESSARY")
    secret = (role_ == "authentication_secret") | category.isin(c.SECRETS) | (local & category.isin(c.CARDS))
    public = category.isin(c.PUBLIC) | role_.isin("public_product_attribute", "contextual_reference") | level.isin("LOW", "PUBLIC")
    unknown = (relevance == "UNKNOWN") & (necessity == "UNKNOWN")
    token = F.when(category.isin(c.TOKENIZABLE), "TOKENIZE").otherwise("REDACT")
    by_level = F.when(level == "CRITICAL", "CRITICAL_SENSITIVITY").when(level == "HIGH", "HIGH_SENSITIVITY").otherwise("MEDIUM_SENSITIVITY")
    reasoning = (necessity == "REMOTE_REASONING_REQUIRED") | ((necessity == "UNKNOWN") & relevance.isin("REQUIRED", "OPTIONAL"))
    low = c.LEAST_POLICY_CONFIDENCE
    return (
        F.when(category.isNull() | (category == ""), out("REDACT", "SAFE_DEFAULT", 0.95))
        .when(secret & unneeded, out("REDACT", "TASK_IRRELEVANT", 0.98))
        .when(secret, out("LOCAL_ONLY", "CRITICAL_SENSITIVITY", 0.98))
        .when(~(local | remote) | destination.isNull(), out("REDACT", "UNKNOWN_DESTINATION", 0.95))
        .when(relevance == "IRRELEVANT", out("REDACT", "TASK_IRRELEVANT", 0.95))
        .when(necessity == "UNNECESSARY", out("REDACT", "UNNECESSARY_DATA_REDACTED", 0.95))
        .when(unknown & public, out("ALLOW", "PUBLIC_DATA_ALLOWED", 0.95))
        .when(unknown, out("REDACT", "TASK_UNKNOWN", 0.95))
        .when(detection < low, out("REDACT", "LOW_DETECTION_CONFIDENCE", 0.92))
        .when(relevance_confidence < low, out("REDACT", "LOW_RELEVANCE_CONFIDENCE", 0.90))
        .when((necessity != "UNKNOWN") & (necessity_confidence < low), out("REDACT", "LOW_POLICY_CONFIDENCE", 0.90))
        .when(public, out("ALLOW", "PUBLIC_DATA_ALLOWED", 0.95))
        .when(remote & (necessity == "LOCAL_EXECUTION_ONLY"), out("LOCAL_ONLY", by_level, 0.98))
        .when(remote & (reasoning | (necessity == "CONTEXTUAL_REFERENCE")), out(token, by_level, 0.95))
        .when(remote, out("REDACT", by_level, 0.95))
        .when(authorized, out("ALLOW", by_level, 0.92))
        .otherwise(out("LOCAL_ONLY", by_level, 0.94))
    )


def necessity(category: Column, relevance: Column) -> Column:
    """What a task needs an item for."""
    secret, public = category.isin(c.SECRETS) | category.isin(c.CRITICAL), category.isin(c.PUBLIC)
    return (
        F.when(secret, F.when(relevance == "IRRELEVANT", "UNNECESSARY").otherwise("LOCAL_EXECUTION_ONLY"))
        .when(public, F.when(relevance == "IRRELEVANT", "UNNECESSARY").otherwise("CONTEXTUAL_REFERENCE"))
        .when(relevance == "IRRELEVANT", "UNNECESSARY")
        .when(relevance.isin("REQUIRED", "OPTIONAL"), "REMOTE_REASONING_REQUIRED")
        .otherwise("UNKNOWN")
    )


def with_relevance(items: DataFrame, relevance: DataFrame) -> DataFrame:
    """Items with the relevance record of their id, else of their category; of several records the last (`pos`) counts."""

    def last(by: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("pos")))
        return relevance.where(F.col(by).isNotNull()).withColumn("n", n).where("n = 1").select(by, F.col("relevance").alias(f"by_{by}"))

    by_category = last("category").withColumnRenamed("category", "low_category")
    joined = items.withColumn("low_category", F.lower("category")).join(last("item_id"), "item_id", "left").join(by_category, "low_category", "left")
    return joined.select(*items.columns, F.coalesce("by_item_id", "by_category", F.lit("UNKNOWN")).alias("relevance"))


def vault_result(known: Column, destination: Column, state: Column, expires_ms: Column, now_ms: Column, authorized: Column, purpose: Column, wanted: Column) -> Column:
    """The code with which a vault answers a retrieval."""
    return (
        F.when(~F.coalesce(known, F.lit(False)), "DENIED_NOT_FOUND")
        .when(~F.coalesce(destination.isin(c.LOCAL), F.lit(False)), "DENIED_REMOTE_DESTINATION")
        .when(state == "REVOKED", "DENIED_REVOKED")
        .when((state == "EXPIRED") | (now_ms >= expires_ms), "DENIED_EXPIRED")
        .when(~F.coalesce(authorized, F.lit(False)), "DENIED_UNAUTHORIZED")
        .when(~purpose.eqNullSafe(wanted), "DENIED_PURPOSE_MISMATCH")
        .otherwise("GRANTED")
    )


def representations(decision: Column, token: Column, value: Column) -> Column:
    """struct<dom, screenshot, remote_payload, vault>: what each place shows of a value under its decision; an unknown decision counts as REDACT."""
    known = F.when(decision.isin(*c.SHOWN), decision).otherwise("REDACT")
    dom = F.when(known == "ALLOW", value).when(known == "TOKENIZE", token).when(known == "LOCAL_ONLY", "[LOCAL_ONLY_PROTECTED]").otherwise("[REDACTED]")
    shown = F.create_map(*[x for k, v in c.SHOWN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[known]
    remote = F.when(known == "LOCAL_ONLY", "EXCLUDED (Zero Remote Egress)").otherwise(dom)
    return F.struct(dom.alias("dom"), shown[0].alias("screenshot"), remote.alias("remote_payload"), shown[1].alias("vault"))


def violation(decision: Column, token: Column, dom_masked: Column, screenshot_masked: Column, remote_payload: Column) -> Column:
    """The first rule that an item's representations break, null if none. Nulls: not known, which breaks nothing, but a missing token does."""
    sent, say = F.coalesce(remote_payload, F.lit("")), c.VIOLATIONS
    clear = decision.isin("TOKENIZE", "REDACT", "LOCAL_ONLY") & ~screenshot_masked
    return (
        F.when((decision == "ALLOW") & dom_masked, say["allow_dom"])
        .when((decision == "ALLOW") & screenshot_masked, say["allow_screenshot"])
        .when((decision == "TOKENIZE") & (F.coalesce(token, F.lit("")) == ""), say["token"])
        .when((decision == "TOKENIZE") & (sent != "") & (sent != token), say["token_payload"])
        .when(clear, F.concat(decision, F.lit(say["screenshot"])))
        .when((decision == "REDACT") & ~sent.isin("", "[REDACTED]"), say["redact_payload"])
        .when((decision == "LOCAL_ONLY") & sent.contains("secret"), say["local_payload"])
    )


def source_audit(text: Column) -> Column:
    """struct of three flags, true where a source text breaks the rule. Comments and literals of patterns do not count as calls."""
    code = text
    for pattern in c.SOURCE_COMMENTS:
        code = F.regexp_replace(code, pattern, "")
    of = {name: code if name == "execution_primitives" else text for name in c.SOURCE_RULES}
    return F.struct(*[F.coalesce(of[name].rlike(c.java(rule)), F.lit(False)).alias(name) for name, rule in c.SOURCE_RULES.items()])
