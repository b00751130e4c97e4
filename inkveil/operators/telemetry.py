"""Scrubbing of what may leave as telemetry or as a remote payload: strings by expressions; json_tree.py does whole payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as c
from ..functions import text as t
from . import detection


def scrub(text: Column) -> Column:
    """Six replacements in order: sentinels, spoken secrets, URL parameters, cards that pass their checksum, e-mail and street addresses."""
    out = F.regexp_replace(text, c.java(c.SENTINEL), "[PROTECTED_SENTINEL]")
    out = F.regexp_replace(out, c.java(c.SPOKEN_SECRET), "$1$3$5[PROTECTED_SECRET]")
    out = F.regexp_replace(out, c.URL_PARAMETER, "$1[PROTECTED_PARAM]")
    out = t.let(out, lambda x: F.when(x.rlike(c.java(c.STRICT_CARD)), _without_cards(x)).otherwise(x))
    out = t.let(out, lambda x: F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, c.java(c.EMAIL), "[EMAIL_REDACTED]")).otherwise(x))
    return t.let(out, lambda x: F.when(x.rlike(c.java(c.STREET_WORD)), F.regexp_replace(x, c.java(c.LONG_ADDRESS), "[ADDRESS_REDACTED]")).otherwise(x))


def _without_cards(text: Column) -> Column:
    cards = F.transform(detection.checked(text, c.STRICT_CARD, t.luhn), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("[CARD_NUMBER_REDACTED]").alias("with")))

    def step(a: Column, s: Column) -> Column:
        return F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), s["with"]).alias("out"), s["end"].alias("at"))

    return F.aggregate(cards, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def task(text: Column, summary: Column) -> Column:
    """struct<task, summary, had_secrets>; a missing summary is the scrubbed task."""
    own = scrub(F.coalesce(text, F.lit("")))
    given = F.coalesce(summary, own)
    done = scrub(given)
    return F.struct(own.alias("task"), done.alias("summary"), ((~own.eqNullSafe(text)) | (done != given)).alias("had_secrets"))


def error(kind: Column, message: Column, code: Column, stack: Column) -> Column:
    """struct<kind, message, code, stack>: the first five lines of the stack, scrubbed."""
    lines = F.array_join(F.slice(F.split(stack, "\n", -1), 1, 5), "\n")
    return F.struct(F.coalesce(kind, F.lit("Error")).alias("kind"), scrub(message).alias("message"), F.coalesce(code, F.lit("ERR_RUNTIME")).alias("code"), scrub(lines).alias("stack"))


def remote_string(text: Column) -> Column:
    """E-mail addresses, then runs of 13 to 19 digits, masked."""
    return F.regexp_replace(F.regexp_replace(text, c.java(c.REMOTE_EMAIL), "[EMAIL_REDACTED]"), c.REMOTE_DIGITS, "[CARD_REDACTED]")
