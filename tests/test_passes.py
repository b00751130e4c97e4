"""Passes over nodes against a plain replay on a text that shrinks and grows, and the text of pages against a plain walk."""

import random
import re
from html.parser import HTMLParser

from inkveil import config as c
from inkveil.operators import passes
from inkveil.plans import passed
from inkveil.sources import dom

SF = "/root/testdata/sf0.001"
NODE = "node_id long, text string, element_path string"
PATTERNS = {"card": passes.SPACED_CARD, "id": c.SSN, "email": c.EMAIL, "phone": c.PHONE, "name": c.PERSON_NAME}


def luhn(value):
    digits = [int(x) for x in value if x in "0123456789"][::-1]
    twice = lambda d: d * 2 - 9 if d > 4 else d * 2
    return 13 <= len(digits) <= 19 and sum(twice(d) if i % 2 else d for i, d in enumerate(digits)) % 10 == 0


def replayed(text, path):
    """(text, sanitized, spans, counts): each pass replaces for real, with the original place of each character beside it."""
    text, path = text or "", path or ""
    if re.search("password", path, re.I):
        return passes.LOCAL_ONLY, True, [(0, len(text), "id")], [0, 1, 0, 0, 0]
    now, places, spans, counts = text, list(range(len(text))), [], dict.fromkeys(passes.KINDS, 0)

    def replace(kind, check=lambda v: True):
        nonlocal now, places
        found = [m.span() for m in re.finditer(PATTERNS[kind], now, re.A) if check(m[0])]
        for a, b in reversed(found):
            assert None not in places[a:b]
            spans.append((places[a], places[b - 1] + 1, kind))
            now, places = now[:a] + passes.REDACTED + now[b:], places[:a] + [None] * 10 + places[b:]
        return len(found)

    counts["card"] = replace("card", luhn)
    numbers = replace("id")
    if numbers or (re.search("ssn|account|id", path, re.I) and not counts["card"]):
        if passes.REDACTED not in now and re.search("ssn", path, re.I):
            return passes.REDACTED, True, [(0, len(text), "id")], [0, 1, 0, 0, 0]
        counts["id"] = int(passes.REDACTED in now)
    counts["email"], counts["phone"] = min(1, replace("email")), min(1, replace("phone"))
    if re.search(passes.PERSON_PATH, path.lower()) or not re.search(passes.PRODUCT_PATH, path.lower()):
        counts["name"] = min(1, replace("name"))
    return now, any(counts.values()), sorted(spans), list(counts.values())


def check(spark, nodes):
    got = {r.node_id: r for r in passes.redact_nodes(spark.createDataFrame([(i, *n) for i, n in enumerate(nodes)], NODE)).collect()}
    for i, n in enumerate(nodes):
        text, sanitized, spans, counts = replayed(*n)
        r = got[i]
        assert (r.text, r.is_sanitized, [tuple(s) for s in r.spans], [r[k] for k in passes.KINDS]) == (text, sanitized, spans, counts), n
        if text not in (passes.LOCAL_ONLY, passes.REDACTED):  # what lies between the spans is the original's
            cut, at = "", 0
            for a, b, _ in spans:
                cut, at = cut + n[0][at:a] + passes.REDACTED, b
            assert cut + (n[0] or "")[at:] == text
    return got


def test_passes_by_hand(spark):
    card = "4111 1111 1111 1111"
    nodes = [
        (f"pay {card} or {card} now", "p"), (f"4111 1111 1111 1112 by Dr. Ada Lovelace, {card}", "p"), ("078-05-1120", "p"), ("nothing here", "form/ssn"), ("a@b.io", "form/SSN"), ("see 078-05-1120", "form/ssn"), (f"x {card}", "form/ssn"),
        ("[REDACTED] before", "form/ssn"), ("[REDACTED] before", "div#account"), ("[REDACTED] before", "p"), ("secret", "input#Password"), (None, "input#password"), (None, None), ("", "video"), ("Mr. Bean a@b.io (555) 123-4567", None),
        ("Mr. Bean", "h1.product-title"), ("Mr. Bean", "span.author-title"), ("Mrs Smith Jones\nDr Who", "p"), (f"é😀 {card} ü a@b.io +49 170 1234567", "p"), ("a@b.io" * 3, "p"), ("\u0001 a@b.io \u0002", "p"), (f"{card}a@b.io", "p"), (f"a@b.io{card}", "p"),
    ]
    got = check(spark, nodes)
    assert got[0].card == 2 and got[1].card == 1 and got[1].name == 1
    assert got[4].text == "[REDACTED]" and got[4].email == 0 and got[10].text == passes.LOCAL_ONLY and got[15].is_sanitized is False and got[16].name == 1


def test_passes_at_random(spark):
    rng = random.Random(5)
    parts = ["4111111111111111", "4111-1111-1111-1111", "378282246310005", "12345678901234567", "078-05-1120", "a.b@c.org", "@", "+1 (555) 123-4567", "5551234567", "Dr. ", "Mr ", "Ada", " Lovelace", " ", "-", "[REDACTED]", "é", "x", "9", "\n", ".", "("]
    nodes = [("".join(rng.choice(parts) for _ in range(rng.randrange(14))), rng.choice(passed.PATHS)) for _ in range(1500)]
    check(spark, nodes)


def test_passes_over_lines_of_documents(spark):
    rows = [(r.text, r.element_path) for r in passed.lines(spark, SF).orderBy("doc_id", "line").collect()]
    got = check(spark, rows)
    assert all(sum(r[k] for r in got.values()) > 0 for k in ("card", "id", "email", "phone"))


def test_passes_over_other_columns_long_texts_and_no_rows(spark):
    text = "a@b.io call " * 3000
    df = spark.createDataFrame([(1, text, "p", 7, True, "k")], "node_id long, text string, element_path string, card long, is_sanitized boolean, `a.b` string")
    (r,) = passes.redact_nodes(df).collect()
    assert r.text == "[REDACTED] call " * 3000 and len(r.spans) == 3000 and r["a.b"] == "k" and r.card == 0
    assert passes.redact_nodes(df.limit(0)).collect() == []


def test_a_filter_computes_no_pass_again(spark):
    plan = passes.redact_nodes(passed.lines(spark, SF)).where("is_sanitized")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Mr|Mrs") == 1 and plan.count("@[A-Za-z0-9.-]+") == 1


PAGE = "page_id long, pos long, source string, path string, text string, type string, protected boolean"
SPAN = "page_id long, pos long, start long, end long"


def test_page_text_by_hand(spark):
    nodes = [
        (1, 3, "input", "#mail", "a@b.io", "email", True), (1, 1, "text", "p", "  mail a@b.io and 😀 c@d.io \n", None, None), (1, 2, "text", "p", "   ", None, False), (1, 4, "input", "input", "open", None, False), (1, 5, "input", "#pw", "hunter2", "Password", False),
        (1, 6, "input", "#empty", " ", "text", False), (1, 7, "button", "button", " Send ", None, False), (1, 8, "button", "button", "", None, False), (1, 9, "image", "img", "cat", None, False), (1, 10, "image", "#me", "", None, True), (1, 11, "other", "x", "y", None, True),
        (2, 1, "image", "img", None, None, None), (3, 1, "text", None, None, None, None),
    ]
    spans = [(1, 1, 7, 13), (1, 1, 20, 26), (1, 1, 7, 9), (1, 1, 12, 13), (1, 1, 5, 5), (9, 1, 0, 3)]
    got = {r.page_id: tuple(r)[1:] for r in passes.page_text(spark.createDataFrame(nodes, PAGE), spark.createDataFrame(spans, SPAN)).collect()}
    want = "mail [REDACTED] and 😀 [REDACTED]\n[#mail]: [REDACTED]\n[input]: open\n[#pw]: [LOCAL_ONLY_PROTECTED]\n[Button: Send]\n[#me]: " + passes.IMAGE_LINE
    assert got == {1: (9, 4, want), 2: (1, 0, "")}
    assert passes.page_text(spark.createDataFrame([], PAGE), spark.createDataFrame([], SPAN)).collect() == []


class Walk(HTMLParser):
    """Shown texts, fields, buttons and images of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.rows = [], []

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in reversed(attrs)}
        if not any(t in dom.NOT_SHOWN for t, _ in self.open) and tag not in dom.NOT_SHOWN:
            path = f"#{own['id']}" if own.get("id") else f'{tag}[name="{own["name"]}"]' if own.get("name") else tag
            if tag in ("input", "textarea"):
                self.rows.append(["input", path, own.get("value") or own.get("placeholder") or ""])
                self.typed = not own.get("value")
            elif tag == "button":
                self.rows.append(["button", path, ""])
            elif tag == "img":
                self.rows.append(["image", path, own.get("alt", "")])
        if tag not in dom.VOID:
            self.open.append((tag, own.get("id")))

    def handle_endtag(self, tag):
        at = [i for i, (t, _) in enumerate(self.open) if t == tag]
        if at:
            del self.open[at[-1] :]

    def handle_data(self, data):
        if self.open and any(t in dom.NOT_SHOWN for t, _ in self.open):
            return
        if any(t == "button" for t, _ in self.open):
            last = [r for r in self.rows if r[0] == "button"][-1]
            last[2] += data
        if self.open and self.open[-1][0] == "textarea" and self.typed:  # its content comes before its placeholder
            self.rows[-1][2] = data
        parent = self.open[-1] if self.open else ("text", None)
        self.rows.append(["text", f"#{parent[1]}" if parent[1] else parent[0], data])


def test_rows_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").unionByName(passed.shops(spark, SF))
    got = {}
    for r in dom.shown_rows(pages).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append([r.source, r.path, r.text])
    plain = lambda rows: [r for r in rows if r[0] != "text" or r[2].strip()]
    for r in pages.collect():
        walk = Walk()
        walk.feed(r.html or "")
        walk.close()
        assert plain(got.get(r.page_id, [])) == plain(walk.rows), r.page_id


def test_pages_lose_what_was_found(spark):
    rows = passed.page_nodes(spark, SF)
    assert rows.where("source = 'input' AND protected").count() + rows.where("source = 'button'").count() > 0
    found = passed.detection.core_spans(rows.where("source = 'text'"), "page_id", "pos")
    values = {}
    for r in found.collect():
        values.setdefault(r.page_id, set()).add(r.value)
    texts = {r.page_id: r.text for r in passes.page_text(rows, found.select("page_id", "pos", "start", "end")).collect()}
    assert values and all("[REDACTED]" in texts[p] for p in values)
