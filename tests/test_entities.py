"""Named spans against the reference's rule, which scores every run of 1 to 6 tokens; brute force over small texts."""

import random
import re

import pytest

from inkveil.operators import entities as en
from inkveil.plans import catalog, seeded  # noqa: F401

NAME, ORG = re.compile(r"[A-Z][a-zA-Z'’-]+"), re.compile(r"[A-Z][a-zA-Z0-9&]*|[oO][fF]|&")


def person(t, span, before):
    title, capital = re.sub(r"\.$", "", before[-15:].strip().lower()) in en.HONORIFICS, all(NAME.fullmatch(x) for x in t)
    if len(t) > 4 or re.fullmatch("[0-9]+", span) or (len(t) == 1 and span == span.lower()) or not (capital or title):
        return 0
    if any(x.lower() in en.COMPANIES for x in t) or t[-1].lower() in en.STREETS:
        return 0
    known = t[0].lower() in en.GIVEN_NAMES
    return 0.94 if title and capital else 0.92 if known and len(t) > 1 and capital else 0.78 if known and len(t) == 1 else 0.72 if capital and len(t) > 1 else 0.35 if capital else 0


def address(t, span, before):
    number, street = t[0][0] in "0123456789", t[-1].lower() in en.STREETS
    capital = all(NAME.fullmatch(x) for x in t[number:])
    if len(t) < 2:
        return 0
    if number and street:
        return 0.95
    if street and capital and t[-1].lower() != "dr":
        return 0.88
    if re.search(r"\b\d{5,6}(?:-\d{4})?\b", span, re.ASCII):
        return 0.85
    return 0.92 if re.search(r"(?:address|ship to|bill to|location|delivered to|sent to)\s*:?\s*$", before.lower()) and (number or (street and capital)) else 0


def organization(t, span, before):
    suffix, capital = t[-1].lower() in en.COMPANIES, all(ORG.fullmatch(x) for x in t)
    if len(t) > 5 or not capital:
        return 0
    return (0.94 if len(t) > 1 else 0.80) if suffix else 0.85 if len(t) > 1 and re.search(r"(?:Bank|Tech|Solutions|Services|Holdings|Labs|Systems)\b", span, re.I | re.A) else 0


def national_id(t, span, before):
    passport = re.fullmatch(r"[A-Z]{1,2}[0-9]{7,9}", span)
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", span) or (re.search(r"(?:ssn|social\s*security|national\s*id|id\s*number)\s*:?\s*$", before.lower()) and re.fullmatch("[0-9]{8,12}", span)):
        return 0.95
    return (0.94 if re.search(r"passport(?:\s*no|\s*number)?\s*:?\s*$", before.lower()) else 0.75) if passport else 0


def brute(text, threshold=0.5):
    """Sorted (label, start, end, confidence), and the best of them that don't overlap."""
    found = [(m[0], m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9'’-]+|[^\sA-Za-z0-9_]", text)]
    out = []
    for n in range(1, min(6, len(found)) + 1):
        for i in range(len(found) - n + 1):
            start, end = found[i][1], found[i + n - 1][2]
            for label, score in (("person", person), ("address", address), ("organization", organization), ("national_id", national_id)):
                s = score([x for x, _, _ in found[i : i + n]], text[start:end], text[max(0, start - 25) : start])
                if s >= threshold:
                    out.append((label, start, end, s))
    best = []
    for x in sorted(out, key=lambda x: (-x[3], x[1] - x[2])):
        if all(max(x[1], y[1]) >= min(x[2], y[2]) for y in best):
            best.append(x)
    return sorted(out), sorted(best)


TEXTS = [
    "we met Greta Lindholm there", "send it to delhi 110001", "old mill near the river 90210-1234 thanks", "see of Bank and & Holdings today", "Mr jOHN left", "a 12 Baker Street b", "ship to: 9 lower words",
    "nothing here", "", None, "office: foo_12345 bar 123456", "passport no: A1234567, ssn 123-45-6789", "Dr. Ana Maria Lopez of Acme Tech Inc", "x y zip 110001", "\u0001zip 110001 😀 Paul Meyer",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["delhi", "110001", "90210-1234", "of", "&", "Of", "Bank", "bank", "Inc", "Street", "st", "12", "Greta", "Lindholm", "john", "jOHN", "Mr", "Dr.", ",", "ship to:", "A1234567", "ssn", "12345678", "foo_12345", "plain", "words", "here", "O'Neil"]
    return TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(200)]


def test_every_run_is_scored(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in en.entity_candidates(df, "doc_id").collect():
        assert r["value"] == texts[r["doc_id"]][r["start"] : r["end"]]
        got.setdefault(r["doc_id"], []).append((r["label"], r["start"], r["end"], r["confidence"]))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == brute(text or "")[0], text


def test_doc_entities_from_the_references_threshold_on(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in catalog.QUERIES["doc_entities"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["label"], r["start"], r["end"], r["confidence"]))
    for i, text in enumerate(TEXTS):
        assert sorted(got.get(i, [])) == brute(text or "")[1], text
    assert ("person", 7, 21, 0.72) in got[0]
