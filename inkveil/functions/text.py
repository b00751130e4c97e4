"""Column functions on text: checksums, spans, masks. All stay in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BASE_CONFIDENCE, EVIDENCE_BOOST, LEAST_CONFIDENCE, MOST_CONFIDENCE, OTHER_BASE, OTHER_BOOST, java

MARK, INSTEAD = "\u0001", "\u0002"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's argument is bound, an expression inside a lambda is computed at each call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def luhn(c: Column) -> Column:
    """Whether the 13 to 19 digits of the text pass the checksum."""

    def check(d: Column) -> Column:
        n = F.length(d)

        def add(total: Column, i: Column) -> Column:
            x = F.substr(d, i, F.lit(1)).cast("int")
            twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
            return total + F.when(i % 2 == 0, twice).otherwise(x)

        return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)

    return let(F.reverse(digits(c)), check)


def matches(c: Column, pattern: str) -> Column:
    """All matches as an array; empty for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(java(pattern)), F.lit(0)), F.array().cast("array<string>"))


def _reach(parts: Column) -> Column:
    """Where each part ends if they stand in a row. Sums run within blocks, so that no long array is copied for each part."""

    def append(a: Column, x: Column) -> Column:
        return F.array_append(a, F.element_at(a, -1) + x)

    def sums(blocks: Column) -> Column:
        before = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + F.length(x))), F.array(F.lit(0)), append)
        return let(before, lambda at: F.flatten(F.transform(blocks, lambda b, j: F.slice(F.aggregate(b, F.array(F.get(at, j)), lambda a, x: append(a, F.length(x))), 2, BLOCK))))

    starts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(BLOCK))
    return let(F.transform(starts, lambda s: F.slice(parts, s + 1, F.lit(BLOCK))), sums)


def spans(c: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points from 0, end exclusive; empty for null.

    The text is searched once. A mark that it holds already counts as another control character of the same length.
    """
    marked = F.regexp_replace(F.replace(c, F.lit(MARK), F.lit(INSTEAD)), java(pattern), f"{MARK}$0{MARK}")
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def cut(parts: Column) -> Column:
        def place(known: Column) -> Column:
            def span(i: Column) -> Column:
                start, end = F.get(known["reach"], i - 1).cast("long"), F.get(known["reach"], i).cast("long")
                value = F.when(known["own"], F.substr(c, start + 1, end - start)).otherwise(F.get(parts, i))
                return F.struct(start.alias("start"), end.alias("end"), value.alias("value"))

            return F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), span)

        return F.when(F.size(parts) > 1, let(F.struct(_reach(parts).alias("reach"), (F.instr(c, MARK) > 0).alias("own")), place)).otherwise(none)

    return F.coalesce(let(F.split(marked, MARK, -1), cut), none)


def mask(category: Column, value: Column) -> Column:
    """What may be shown of a value."""
    user, host = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    one_at = F.size(F.split(value, "@", -1)) == 2
    email = F.concat(F.when(F.length(user) > 2, F.substring(user, 1, 2)).otherwise(F.substring(user, 1, 1)), F.lit("***@"), host)
    phone = F.when(F.length(value) > 6, F.concat(F.substring(value, 1, 3), F.lit("******"), F.right(value, F.lit(4)))).otherwise("******")
    d = digits(value)
    card = F.when(F.length(d) >= 4, F.concat(F.lit("****-****-****-"), F.right(d, F.lit(4)))).otherwise("****")
    other = F.when(F.length(value) > 2, F.concat(F.substring(value, 1, 2), F.lit("***"))).otherwise("***")
    return (
        F.when(F.coalesce(F.length(value), F.lit(0)) == 0, "[EMPTY]")
        .when((category == "email") & one_at, email)
        .when(category == "phone", phone)
        .when(category == "payment_card", card)
        .otherwise(other)
    )


def given(value: Column) -> Column:
    """A generator: a row with the value, none where it is null. Unlike a filter after a projection, it computes the value once."""
    return F.explode(F.array_compact(F.array(value)))


def changed(text: Column, rewritten: Column) -> Column:
    """A generator of the rewritten text where it differs."""
    return given(let(rewritten, lambda x: F.when(x != text, x)))


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def confidence(category: Column, evidence: Column) -> Column:
    """Base of the category and boosts of distinct evidence other than the pattern's, clamped, to two places."""
    groups = F.filter(F.array_distinct(evidence), lambda g: g != "PATTERN")
    raw = F.aggregate(groups, lookup(BASE_CONFIDENCE, category, OTHER_BASE), lambda a, g: a + lookup(EVIDENCE_BOOST, g, OTHER_BOOST))
    return F.floor(F.least(F.lit(MOST_CONFIDENCE), F.greatest(F.lit(LEAST_CONFIDENCE), raw)) * 100 + 0.5) / 100
