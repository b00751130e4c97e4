"""Pattern detectors: text in, character spans out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions import text as t

#: category, pattern, check of the value, evidence beside the pattern
CORE = [
    ("email", c.EMAIL, None, []),
    ("phone", c.PHONE, lambda v: F.length(t.digits(v)).between(7, 15), []),
    ("payment_card", c.CARD, t.luhn, ["CHECKSUM"]),
    ("account_identifier", c.ACCOUNT_ID, None, []),
    ("person_name", c.PERSON_NAME, None, []),
    ("address", c.ADDRESS, None, []),
]
#: category, pattern, check, confidence
HYBRID = [
    ("email", c.EMAIL, None, 0.98),
    ("phone", c.STRICT_PHONE, lambda v: F.length(t.digits(v)).between(7, 15), 0.92),
    ("payment_card", c.STRICT_CARD, t.luhn, 0.95),
    ("account_identifier", c.IPV4, None, 0.90),
    ("account_identifier", c.STRICT_ACCOUNT_ID, None, 0.85),
]


_DIGITS = r"[0-9](?:[-.\s()]*[0-9]){6}"
#: What a text must have for a pattern (and its check) to match at all; cheaper than the pattern.
GATES = {
    c.EMAIL: lambda x: F.contains(x, F.lit("@")),
    c.PHONE: lambda x: x.rlike(_DIGITS),
    c.CARD: lambda x: x.rlike(_DIGITS),
    c.STRICT_PHONE: lambda x: x.rlike(_DIGITS),
    c.STRICT_CARD: lambda x: x.rlike(_DIGITS),
    c.IPV4: lambda x: x.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"),
    c.ACCOUNT_ID: lambda x: x.rlike(r"[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{11}|[Aa][Cc][Cc]-"),
    c.STRICT_ACCOUNT_ID: lambda x: x.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}|ACC-"),
    c.PERSON_NAME: lambda x: F.contains(x, F.lit("Mr")) | F.contains(x, F.lit("Ms")) | F.contains(x, F.lit("Dr")) | F.contains(x, F.lit("Prof")),
    c.ADDRESS: lambda x: x.rlike(r"[0-9]\s+[A-Za-z][a-z]+\s+[SARBDL]"),
}
SPAN = "struct<category:string,start:bigint,end:bigint,value:string,confidence:double>"


def checked(text: Column, pattern: str, check=None) -> Column:
    """The spans of a pattern whose values pass the check; texts that cannot have any are not searched."""
    own = t.spans(text, pattern)
    if check:
        own = F.filter(own, lambda s: check(s["value"]))
    gate = GATES.get(pattern) if check or pattern not in (c.PHONE, c.STRICT_PHONE) else None
    return F.when(gate(text), own).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")) if gate else own


def spans_of(df: DataFrame, key: str, text: str, pattern: str, check=None) -> DataFrame:
    """(key, start, end, value) of one pattern."""
    return df.select(key, F.explode(checked(F.col(text), pattern, check)).alias("s")).select(key, "s.start", "s.end", "s.value")


def category_counts(text: Column) -> list[Column]:
    """Counts of e-mail addresses, phone numbers and valid cards; never a value."""

    def gated(pattern: str, found: Column) -> Column:
        return F.when(GATES[pattern](text), found).otherwise(F.lit(0)).cast("long")

    cards = F.filter(t.matches(text, c.CARD), t.luhn)
    return [
        gated(c.EMAIL, F.size(t.matches(text, c.EMAIL))).alias("email"),
        F.size(t.matches(text, c.PHONE)).cast("long").alias("phone"),
        gated(c.CARD, F.size(cards)).alias("payment_card"),
    ]


def _found(text: Column, category: str, pattern: str, check, confidence: Column) -> Column:
    def named(s: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), confidence.alias("confidence"))

    return F.transform(checked(text, pattern, check), named)


def core_found(text: Column) -> Column:
    """All spans of the six core patterns as one array, so a text is read once."""
    parts = []
    for category, pattern, check, evidence in CORE:
        parts.append(_found(text, category, pattern, check, t.confidence(F.lit(category), F.array(*map(F.lit, ["PATTERN", *evidence])))))
    return F.concat(*parts).cast(f"array<{SPAN}>")


def hybrid_found(text: Column) -> Column:
    """All spans of the strict patterns as one array."""
    return F.concat(*[_found(text, category, pattern, check, F.lit(score)) for category, pattern, check, score in HYBRID]).cast(f"array<{SPAN}>")


def exploded(df: DataFrame, keys: list[str], found: Column) -> DataFrame:
    return df.select(*keys, F.explode(found).alias("s")).select(*keys, "s.*")


def core_spans(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, category, start, end, value, confidence) of the six core patterns, by one scan."""
    return exploded(df, [*keys], core_found(F.col(text)))


def hybrid_spans(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The same of the strict patterns."""
    return exploded(df, [*keys], hybrid_found(F.col(text)))


def overlapping(a: Column, b: Column) -> Column:
    return F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])


def dominant(found: Column) -> Column:
    """The spans of one text without those that a card or account span overlaps; those themselves stay."""

    def strong(s: Column) -> Column:
        return s["category"].isin("payment_card", "account_identifier")

    def keep(own: Column) -> Column:
        return t.let(F.filter(own, strong), lambda over: F.filter(own, lambda m: strong(m) | ~F.exists(over, lambda d: overlapping(m, d))))

    return t.let(found, keep)


def both_sources(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, category, start, end, value, confidence, source) of core and strict patterns, by one scan."""
    found = F.array(*[F.struct(F.lit(name).alias("source"), own.alias("own")) for name, own in (("core", core_found(F.col(text))), ("strict", hybrid_found(F.col(text))))])
    return df.select(key, F.inline(found)).select(key, "source", F.explode("own").alias("s")).select(key, "s.*", "source")


def exact_merge(found: DataFrame, key: str) -> DataFrame:
    """Spans of several sources: equal spans become one, of source `hybrid` if sources differ, with the highest confidence."""
    return found.groupBy(key, "category", "start", "end").agg(
        F.max("confidence").alias("confidence"), F.when(F.count_distinct("source") > 1, "hybrid").otherwise(F.min("source")).alias("source")
    )


#: kind, pattern, test of the value, whether a value that the text has already is left out; in order
LABELLED = [
    ("email", c.EMAIL, None, False),
    ("phone", c.STRICT_PHONE, lambda v: F.length(t.digits(v)).between(7, 15), False),
    ("card", c.STRICT_CARD, t.luhn, False),
    ("labelled_card", c.LABELLED_CARD, lambda v: F.length(t.digits(v)) >= 13, True),
    ("ip", c.IPV4, None, False),
    ("account", c.STRICT_ACCOUNT_ID, None, False),
    ("name", c.LABELLED_NAME, lambda v: F.length(v) >= 2, False),
    ("id", c.LABELLED_ID, lambda v: F.length(v) >= 2, False),
    ("otp", f"(?:{c.OTP_AFTER}|{c.OTP_BEFORE}(?={c.OTP_FOLLOWS}))", lambda v: F.length(v) >= 4, True),
    ("greeting", c.GREETING, lambda v: (F.length(v) >= 2) & ~F.lower(v).isin(c.NO_NAMES), True),
]


def labelled_found(text: Column) -> Column:
    """All spans of plain and labelled detectors in order, as (kind, start, end, value); some kinds skip a value found before."""
    parts = []
    for kind, pattern, check, once in LABELLED:
        parts.append(_labelled(text, kind, pattern, check, once))

    def step(done: Column, s: Column) -> Column:
        return F.when(s["once"] & F.exists(done, lambda x: x["value"] == s["value"]), done).otherwise(F.array_append(done, s))

    kind = "array<struct<kind:string,start:bigint,end:bigint,value:string,once:boolean>>"
    return F.aggregate(F.concat(*parts).cast(kind), F.array().cast(kind), step)


def _labelled(text: Column, kind: str, pattern: str, check, once: bool) -> Column:
    def one(s: Column) -> Column:
        value = s["value"]
        if kind == "otp":  # what follows a code is no part of the match
            value = F.regexp_extract(value, r"[0-9]{4,8}$", 0)
        elif kind in ("labelled_card", "name", "id", "greeting"):
            value = F.regexp_extract(value, c.java(pattern), 1)
        value = F.trim(value)
        start = s["start"] + F.instr(s["value"], value) - 1
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.lit(once).alias("once"))

    own = F.transform(t.spans(text, pattern), one)
    return F.filter(own, lambda s: check(s["value"])) if check else own


def disjoint(found: Column) -> Column:
    """One (start, end, category) for each run of overlapping spans of a text: the first start, the last end, the category of the first (longest first)."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["category"].alias("category"))))

    def step(done: Column, s: Column) -> Column:
        last, end = F.try_element_at(done, F.lit(-1)), -s["back"]
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), last["category"].alias("category"))
        new = F.struct(s["start"].alias("start"), end.alias("end"), s["category"].alias("category"))
        meets = (F.size(done) > 0) & (s["start"] < last["end"])
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.array_append(done, new))

    return F.aggregate(order, F.array().cast("array<struct<start:bigint,end:bigint,category:string>>"), step)
