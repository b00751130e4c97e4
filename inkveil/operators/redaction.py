"""Rewriting texts by spans and patterns, and audits of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions import text as t


def replacement(decision: Column, token: Column, value: Column) -> Column:
    return F.when(decision == "ALLOW", value).when(decision == "TOKENIZE", F.concat(F.lit("{{"), token, F.lit("}}"))).when(decision == "LOCAL_ONLY", "[LOCAL_ONLY_PROTECTED]").otherwise("[REDACTED]")


def rewritten(text: Column, spans: Column) -> Column:
    """The text with its disjoint spans (start, end, decision, token; in order) replaced."""
    body = F.coalesce(text, F.lit(""))

    def step(a: Column, s: Column) -> Column:
        before = F.substr(body, a["at"] + 1, s["start"] - a["at"])
        value = F.substr(body, s["start"] + 1, s["end"] - s["start"])
        return F.struct(F.concat(a["out"], before, replacement(s["decision"], s["token"], value)).alias("out"), s["end"].alias("at"))

    return F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda a: F.concat(a["out"], F.substr(body, a["at"] + 1)))


def counted(spans: Column) -> list[Column]:
    """How many spans were replaced, and how many left."""
    allowed = F.size(F.filter(spans, lambda s: s["decision"] == "ALLOW"))
    return [(F.size(spans) - allowed).cast("long").alias("redacted"), allowed.cast("long").alias("allowed")]


def redact(docs: DataFrame, spans: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with `sanitized` and counts, by spans of elsewhere: disjoint (key, start, end, decision, token), gathered by their document's key."""
    per = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "decision", "token"))).alias("spans"))
    own = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,decision:string,token:string>>"))
    return docs.join(per, key, "left").select(*docs.columns, rewritten(F.col(text), own).alias("sanitized"), *counted(own))


def scrub_secrets(text: Column) -> Column:
    """Inline secrets after a keyword, and secret URL parameters."""
    inline = F.regexp_replace(text, c.java(c.INLINE_SECRET), "$1[PROTECTED_SECRET]")
    return F.regexp_replace(inline, c.java(c.URL_SECRET), "$1[PROTECTED_PARAM]")


def scrub_contacts(text: Column) -> Column:
    return F.regexp_replace(text, c.java(c.EMAIL), "[EMAIL_REDACTED]")


def leaks(output: Column, sentinels: Column) -> Column:
    """The sentinel values that an output still holds."""
    return F.filter(F.array_distinct(sentinels), lambda v: F.instr(output, v) > 0)


def payload_errors(json: Column) -> Column:
    """Why a payload may not leave: array of codes."""
    has_card = F.exists(t.matches(json, c.CARD), t.luhn)
    checks = [
        (json.rlike(r"[0-9]{13,19}"), "DIGIT_RUN"),
        (json.rlike(r"<[sS][cC][rR][iI][pP][tT]|[oO][nN][a-zA-Z]+="), "SCRIPT"),
        (json.rlike(r"data:[a-z]+/"), "DATA_URL"),
        (has_card, "CARD"),
        (json.rlike(c.java(c.EMAIL)), "EMAIL"),
        (F.octet_length(json) > 250_000, "SIZE"),
    ]
    return F.array_compact(F.array(*[F.when(test, code) for test, code in checks]))
