"""What a goal in words asks for: constraints as attribute, operator and value, and entities after prepositions.

Constraints come from one rule each, in order, the first match of a rule counting; then from two grammars of field updates,
which change the first constraint that means the same field or add one; then from entities. All are column expressions
within the row. The patterns stand in config.py.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as c
from ..functions import text as t

CONSTRAINT = "struct<name:string,operator:string,value:string,is_update:boolean,target:string>"
ENTITY = "struct<preposition:string,text:string,person:boolean,roles:array<string>>"
PERSONAL = ["from", "by"]  # a sender or an author may be meant


def _java(pattern: str) -> str:
    """For Spark: ASCII word boundaries, and `$` at the very end only."""
    return c.java(pattern).replace("$|", r"\z|").replace("$)", r"\z)")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing matches."""
    return F.when(text.rlike(_java(pattern)), F.regexp_extract(text, _java(pattern), group))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def _unquoted(text: Column) -> Column:
    return _trimmed(F.regexp_replace(text, r"""^["']|["']\z""", ""))


def number(value: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def _made(name: Column | str, operator: str, value: Column, update: Column | None = None, target: Column | str | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(name).cast("string").alias("name"), F.lit(operator).alias("operator"), value.alias("value"), (F.lit(False) if update is None else update).alias("is_update"), lit(target).cast("string").alias("target")
    )


def _price(text: Column, pattern: str) -> Column:
    amount = F.regexp_replace(_first(text, pattern), ",", "").try_cast("double")
    times = F.when(F.lower(_first(text, pattern, 2)).startswith("k") | F.lower(_first(text, pattern, 2)).startswith("thousand"), 1000.0).otherwise(1.0)
    return number(amount * times)


def _rules(text: Column) -> list[tuple[str, str, Column]]:
    """(name, operator, value) of the plain rules, in order."""
    word = lambda p: F.lower(_first(text, p))
    brand = word(c.BRAND_WORD)
    rating = _first(text, c.RATING_WORD).try_cast("double")
    count = F.coalesce(_first(text, c.COUNT_BEFORE), _first(text, c.COUNT_AFTER)).try_cast("long")
    url = _first(text, c.URL_WORD, 0)
    return [
        ("price", "<=", _price(text, c.MOST_PRICE)),
        ("price", ">=", _price(text, c.LEAST_PRICE)),
        ("color", "=", word(c.COLOR_WORD)),
        ("brand", "=", F.concat(F.upper(F.substring(brand, 1, 1)), F.substr(brand, F.lit(2)))),
        ("rating", ">=", F.when(rating.between(1, 5), number(rating))),
        ("size", "=", F.upper(_first(text, c.SIZE_WORD))),
        ("candidate_count", ">=", F.when(count > 0, count.cast("string"))),
        ("spec", "contains", F.regexp_replace(word(c.SPEC_WORD), r"\s+", "")),
        ("url", "=", F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))),
    ]


def _fields(text: Column) -> list[tuple[str, Column]]:
    """(name, value) of form fields that a goal names."""
    return [
        ("email", _trimmed(F.coalesce(_first(text, c.EMAIL_FIELD), _first(text, c.EMAIL_ANYWHERE)))),
        ("name", _trimmed(_first(text, c.NAME_FIELD))),
        ("phone", F.regexp_replace(_first(text, c.PHONE_FIELD), r"[\s-]", "")),
        ("message", _unquoted(_first(text, c.MESSAGE_FIELD))),
    ]


def plain_constraints(text: Column) -> Column:
    """Of the plain rules and the form fields, in order."""
    explicit = text.rlike(_java(c.MODIFIES))


    def plain(name: str, operator: str, value: Column) -> Column:
        return t.let(value, lambda v: F.when(v.isNotNull(), _made(name, operator, v)))

    def field(name: str, value: Column) -> Column:
        return t.let(value, lambda v: F.when(v.isNotNull(), _made(name, "=", v, explicit, name)))

    return F.array_compact(F.array(*[plain(*r) for r in _rules(text)], *[field(*r) for r in _fields(text)]))


def _clean_target(raw: Column) -> Column:
    low = F.lower(_trimmed(raw))
    return _trimmed(F.regexp_replace(F.regexp_replace(low, r"^(?:the|an|a)\s+", ""), r"\s+(?:field|input|box|control|element)\z", ""))


def _updates(text: Column, pattern: str, field: int, value: int, refused: str) -> Column:
    """array<struct<target, value>> of a grammar's matches."""
    fields, values = (F.regexp_extract_all(text, F.lit(_java(pattern)), F.lit(g)) for g in (field, value))
    pairs = F.zip_with(fields, values, lambda f, v: F.struct(_trimmed(f).alias("field"), _unquoted(v).alias("value")))
    good = F.filter(pairs, lambda p: (p["field"] != "") & (p["value"] != "") & ~p["field"].rlike(_java(refused)))
    return F.transform(good, lambda p: F.struct(_clean_target(p["field"]).alias("target"), p["value"].alias("value")))


def _merged(constraints: Column, updates: Column, with_name: bool) -> Column:
    """Each update in order on the first constraint that means its field, or as a constraint of its own."""

    def same(x: Column, target: Column) -> Column:
        name = F.regexp_replace(target, r"\s+", "_")
        either = lambda k: (x["name"] == k) | F.coalesce(x["target"] == k, F.lit(False))
        out = (x["name"] == name) | F.coalesce(x["target"] == target, F.lit(False)) | ((target == "email") & either("email")) | (F.contains(target, F.lit("phone")) & either("phone"))
        return out | ((target == "name") & either("name")) if with_name else out

    def step(a: Column, u: Column) -> Column:
        at = F.array_position(F.transform(a, lambda x: same(x, u["target"])), True)
        changed = F.transform(a, lambda x, i: F.when(i + 1 == at, _struct(x["name"], x["operator"], u["value"], F.lit(True), u["target"])).otherwise(x))
        added = F.array_append(a, _struct(F.regexp_replace(u["target"], r"\s+", "_"), F.lit("="), u["value"], F.lit(True), u["target"]))
        return F.when(at > 0, changed).otherwise(added)

    return F.aggregate(updates, constraints.cast(f"array<{CONSTRAINT}>"), step)


def _struct(name: Column, operator: Column, value: Column, update: Column, target: Column) -> Column:
    return F.struct(name.alias("name"), operator.alias("operator"), value.alias("value"), update.alias("is_update"), target.alias("target"))


def entities(text: Column) -> Column:
    """array<struct<preposition, text, person, roles>>: from, by, to, for, then on and in; of equal texts the first."""

    def of(preposition: str, ends: str, refused: str, roles: list[str]) -> Column:
        pattern = F.lit(_java(c.entity_pattern(preposition, ends)))
        words, values = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
        known = F.array(*map(F.lit, roles))
        own = F.zip_with(words, values, lambda w, v: F.struct(F.lower(w).alias("preposition"), _trimmed(v).alias("text"), F.lower(w).isin(PERSONAL).alias("person"), known.alias("roles")))
        return F.filter(own, lambda e: (e["text"] != "") & ~e["text"].rlike(f"^(?i:{refused})\\z"))

    parts = [of(*r) for r in c.ENTITY_RULES]
    first = lambda every: F.filter(every, lambda e, i: F.array_position(F.transform(every, lambda x: F.lower(x["text"])), F.lower(e["text"])) == i + 1)
    none = F.array().cast(f"array<{ENTITY}>")
    return F.when(text.isNull(), none).otherwise(t.let(F.concat(*parts), first))


def constraints(text: Column, named: Column) -> Column:
    """array<struct<name, operator, value, is_update, target>>; `named` are the goal's entities."""
    text = F.coalesce(text, F.lit(""))
    changed = t.let(plain_constraints(text), lambda own: _merged(own, _updates(text, c.CHANGE_FIELD, 1, 2, c.NO_FIELD_CHANGED), True))
    entered = t.let(changed, lambda own: _merged(own, _updates(text, c.ENTER_FIELD, 2, 1, c.NO_FIELD_ENTERED), False))
    role = lambda e: F.when(e["preposition"] == "from", "sender").otherwise("author")
    people = F.transform(F.filter(named, lambda e: e["person"]), lambda e: _struct(role(e), F.lit("contains"), e["text"], F.lit(False), F.lit(None).cast("string")))
    return F.concat(entered, people)
