"""Named spans by rules over word groups, and the order-dependent selections among spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---
HONORIFICS = ["mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "lord", "lady", "rev"]
GIVEN_NAMES = [
    "john", "jane", "alex", "sarah", "michael", "emily", "david", "emma", "daniel", "olivia", "james", "sophia", "william", "isabella", "robert", "mia",
    "joseph", "charlotte", "thomas", "amelia", "charles", "harper", "christopher", "evelyn", "rahul", "priya", "amit", "ananya", "vikram", "neha",
    "arjun", "sneha", "rohit", "pooja", "suresh", "deepa", "rajesh", "sunita", "mohammed", "fatima", "ahmed", "aisha", "ali", "zainab", "wei", "mei",
    "chen", "yan", "taro", "hanako",
]
STREETS = [
    "street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd", "lane", "ln", "drive", "dr", "way", "court", "ct", "circle", "cir", "highway",
    "hwy", "square", "sq",
]
COMPANIES = [
    "inc", "corp", "llc", "ltd", "gmbh", "co", "company", "corporation", "technologies", "tech", "solutions", "group", "holdings", "enterprise",
    "foundation", "institute", "bank",
]
# --- end of fixed values ---

#: White space as the reference's own expressions have it; their other classes are ASCII.
SPACE = "\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
TOKEN = re.compile(rf"[A-Za-z0-9'’-]+|[^{SPACE}A-Za-z0-9_]")
POSTAL = r"(?<![A-Za-z0-9_])[0-9]{5,6}(?:-[0-9]{4})?(?![A-Za-z0-9_])"
NAME_WORD, ORG_WORD = r"^[A-Z][a-zA-Z'’-]+$", r"^([A-Z][a-zA-Z0-9&]*|[oO][fF]|&)$"
MOST_TOKENS, BEFORE = 6, 25
CLUE = r"(?:address|ship to|bill to|location|delivered to|sent to)\s*:?\s*$"
_POSTAL = re.compile(POSTAL)
_ROWS = 20_000


_NAME, _ORG, _CLUE = re.compile(NAME_WORD), re.compile(ORG_WORD), re.compile(CLUE)
_CLUES = re.compile(CLUE[:-1])  # where it stands, not only at an end
_CAPITALS, _WORDS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), frozenset([*GIVEN_NAMES, "of", "&"])  # what a run may start with, but for postal numbers and clues
_GIVEN, _TITLE = frozenset(GIVEN_NAMES), re.compile("|".join(HONORIFICS))
_CODE_DIGITS = 7  # the fewest that an identity number has


def _runs(tokens: list[str], i: int, before: str, postal: list[bool]) -> Iterator[int]:
    """Lengths of the runs from token i on that some label may score: all others would score nothing.

    A person is capitalised words, or a given name or a titled word alone; an address ends in a street word, holds a postal number or
    follows a clue; an organization ends in a company word or is of its own kind of words; an identity number has many digits.
    """
    first = tokens[i]
    names = orgs = True
    posted, clue = False, None
    for n in range(1, min(MOST_TOKENS, len(tokens) - i) + 1):
        token = tokens[i + n - 1]
        low = token.lower()
        names, orgs, posted = names and _NAME.match(token) is not None, orgs and _ORG.match(token) is not None, posted or postal[i + n - 1]
        if n == 1:
            titled = names and _TITLE.search(before[-15:].lower()) is not None
            if titled or low in _GIVEN or (orgs and low in COMPANIES) or (token[-1].isdigit() and sum(map(str.isdigit, token)) >= _CODE_DIGITS):
                yield n
            continue
        if clue is None:
            clue = _CLUE.search(before.lower()) is not None
        if names or orgs or posted or clue or low in STREETS:
            yield n
        elif not posted and not any(postal[i + n : i + MOST_TOKENS]) and not first[0].isdigit() and not names and not orgs:
            return


def word_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens, start, end, span, before): every run of 1 to 6 tokens that may be an entity, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for own, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(whole or "")]
                tokens = [t for _, _, t in found]
                postal = [not t.isalpha() and _POSTAL.search(t) is not None for t in tokens]
                starts = {i for i, t in enumerate(tokens) if t[0] in _CAPITALS or t in _WORDS or (not t.islower() and t.lower() in _WORDS)}
                starts.update(j for i, p in enumerate(postal) if p for j in range(max(i - MOST_TOKENS + 1, 0), i + 1))
                if clues := {m.end() for m in _CLUES.finditer((whole or "").lower())}:
                    starts.update(i for i, f in enumerate(found) if f[0] in clues)
                for i in sorted(starts):
                    start = found[i][0]
                    before = whole[max(start - BEFORE, 0) : start]
                    for n in _runs(tokens, i, before, postal):
                        end = found[i + n - 1][1]
                        rows.append((own, tokens[i : i + n], start, end, whole[start:end], before))
                    if len(rows) >= _ROWS:
                        yield _batch(rows, batch.schema.field(0).type)
                        rows = []
            if rows:
                yield _batch(rows, batch.schema.field(0).type)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens array<string>, start int, end int, span string, before string")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "tokens", "start", "end", "span", "before"])


def _last(tokens: Column) -> Column:
    return F.lower(F.element_at(tokens, -1))


def person_score(tokens: Column, span: Column, before: Column) -> Column:
    n = F.size(tokens)
    title = F.regexp_replace(F.lower(F.trim(F.right(before, F.lit(15)))), r"\.$", "").isin(HONORIFICS)
    capital = F.forall(tokens, lambda x: x.rlike(NAME_WORD))
    known = F.lower(F.element_at(tokens, 1)).isin(GIVEN_NAMES)
    never = (n > 4) | span.rlike(r"^\d+$") | ((n == 1) & (span == F.lower(span))) | (~capital & ~title) | F.exists(tokens, lambda x: F.lower(x).isin(COMPANIES)) | _last(tokens).isin(STREETS)
    return F.when(never, 0.0).when(title & capital, 0.94).when(known & (n >= 2) & capital, 0.92).when(known & (n == 1), 0.78).when((n >= 2) & capital, 0.72).when((n == 1) & capital, 0.35).otherwise(0.0)


def address_score(tokens: Column, span: Column, before: Column) -> Column:
    n, number, street = F.size(tokens), F.element_at(tokens, 1).rlike(r"^\d"), _last(tokens).isin(STREETS)
    capital = F.forall(F.slice(tokens, F.when(number, 2).otherwise(1), n), lambda x: x.rlike(NAME_WORD))
    clue = F.lower(before).rlike(CLUE)
    return (
        F.when((n < 2) | (n > 8), 0.0)
        .when(number & street, 0.95)
        .when(street & capital & (_last(tokens) != "dr"), 0.88)
        .when(span.rlike(POSTAL), 0.85)
        .when(clue & (number | (street & capital)), 0.92)
        .otherwise(0.0)
    )


def organization_score(tokens: Column, span: Column, before: Column) -> Column:
    n, suffix, capital = F.size(tokens), _last(tokens).isin(COMPANIES), F.forall(tokens, lambda x: x.rlike(ORG_WORD))
    trade = span.rlike(r"(?i:Bank|Tech|Solutions|Services|Holdings|Labs|Systems)(?![A-Za-z0-9_])")
    return F.when(n > 5, 0.0).when(suffix & capital & (n >= 2), 0.94).when(suffix & capital, 0.80).when(capital & (n >= 2) & trade, 0.85).otherwise(0.0)


def identity_score(tokens: Column, span: Column, before: Column) -> Column:
    passport, near = span.rlike(r"^[A-Z]{1,2}\d{7,9}$"), F.lower(before)
    asked = near.rlike(r"(?:ssn|social\s*security|national\s*id|id\s*number)\s*:?\s*$")
    return (
        F.when(span.rlike(r"^\d{3}-\d{2}-\d{4}$") | (asked & span.rlike(r"^\d{8,12}$")), 0.95)
        .when(passport & near.rlike(r"passport(?:\s*no|\s*number)?\s*:?\s*$"), 0.94)
        .when(passport, 0.75)
        .otherwise(0.0)
    )


LABELS = {"person": person_score, "address": address_score, "organization": organization_score, "national_id": identity_score}


def entity_candidates(df: DataFrame, key: str, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, label, start, end, value, confidence) of all word groups that score `threshold` or more under a label."""
    groups = word_groups(df, key, text)
    scored = F.array(*[F.struct(F.lit(label).alias("label"), score(F.col("tokens"), F.col("span"), F.col("before")).alias("confidence")) for label, score in LABELS.items()])
    return groups.select(key, "start", "end", F.col("span").alias("value"), F.explode(F.filter(scored, lambda s: s["confidence"] >= threshold)).alias("s")).select(
        key, "s.label", "start", "end", "value", "s.confidence"
    )


def best_disjoint(found: DataFrame, key: str) -> DataFrame:
    """Greedy per document: the surest span first, then the longest, none that overlaps one taken. A group is one document's spans."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        order = rows.assign(size=rows["start"] - rows["end"]).sort_values(["confidence", "size", "start", "label"], ascending=[False, True, True, True])
        taken: list[tuple[int, int]] = []
        keep = []
        for i, s, e in zip(order.index, order["start"], order["end"], strict=True):
            if all(max(s, a) >= min(e, b) for a, b in taken):
                taken.append((s, e))
                keep.append(i)
        return rows.loc[sorted(keep)]

    return found.groupBy(key).applyInPandas(pick, found.schema)


def merge_sources(found: DataFrame, key: str) -> DataFrame:
    """Spans (key, category, start, end, confidence, source) merged in order of start: equal spans of two sources become `hybrid`, of others that overlap the surer one stays."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        merged: list[dict] = []
        for item in rows.sort_values(["start", "confidence", "end", "source"], ascending=[True, False, True, True]).to_dict("records"):
            hit = next((m for m in merged if max(m["start"], item["start"]) < min(m["end"], item["end"])), None)
            if hit is None:
                merged.append(item)
            elif (hit["start"], hit["end"]) == (item["start"], item["end"]) and hit["source"] != item["source"]:
                hit.update(confidence=max(hit["confidence"], item["confidence"]), source="hybrid")
            elif item["confidence"] > hit["confidence"]:
                hit.update(item)
        return pd.DataFrame(merged, columns=rows.columns)

    return found.groupBy(key).applyInPandas(merge, found.schema)
