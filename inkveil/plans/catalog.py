"""The reference queries: each takes a session and a folder of tables and gives a DataFrame. SQL twins are in sql.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions import geometry as g
from ..functions import text as t
from ..operators import detection as d
from ..operators import events as ev
from ..operators import policy as p
from ..operators import redaction as r
from ..sources import pages as pg
from .derived import derived, fed, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- documents: detection -----------------------------------------------------------------------------------------


@query
def doc_pii_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *d.category_counts(F.col("text")))


@query
def doc_pii_summary(spark, sf):
    counts = table(spark, sf, "documents").select(*d.category_counts(F.col("text"))).agg(*[F.sum(x).alias(x) for x in ("email", "phone", "payment_card")])
    long = counts.unpivot([], ["email", "phone", "payment_card"], "category", "n").where("n > 0")
    return long.select("category", F.col("n").cast("long").alias("n"), F.lit("ALWAYS_REDACT").alias("decision"))


@query
def page_pii_counts(spark, sf):
    return table(spark, sf, "pages").select("page_id", *d.category_counts(F.col("html")))


def _spans(name: str, pattern: str, check=None) -> None:
    def run(spark, sf):
        return d.spans_of(table(spark, sf, "documents"), "doc_id", "text", pattern, check)

    run.__name__ = name
    query(run)


def _phone_length(v):
    return F.length(t.digits(v)).between(7, 15)


_spans("doc_email_spans", c.EMAIL)
_spans("doc_card_spans", c.STRICT_CARD, t.luhn)
_spans("doc_ip_spans", c.IPV4)
_spans("doc_phone_spans", c.STRICT_PHONE, _phone_length)
_spans("doc_name_spans", c.PERSON_NAME)


@query
def doc_core_spans(spark, sf):
    return d.core_spans(table(spark, sf, "documents"), "doc_id").drop("value")


@query
def doc_dominant_spans(spark, sf):
    return d.exploded(table(spark, sf, "documents"), ["doc_id"], d.dominant(d.core_found(F.col("text")))).drop("value")


@query
def doc_exact_merge(spark, sf):
    return d.exact_merge(d.both_sources(table(spark, sf, "documents"), "doc_id"), "doc_id")


@query
def pii_by_category(spark, sf):
    return d.hybrid_spans(table(spark, sf, "documents"), "doc_id").groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query
def pii_by_lang_source(spark, sf):
    found = d.hybrid_spans(table(spark, sf, "documents"), "lang", "source").select("lang", "source", "category")
    return found.groupingSets([["lang", "category"], ["source", "category"], ["category"]], "lang", "source", "category").agg(F.count("*").alias("n"))


@query
def doc_masked_values(spark, sf):
    found = d.hybrid_spans(table(spark, sf, "documents"), "doc_id")
    return found.select("doc_id", "category", "start", t.mask(F.col("category"), F.col("value")).alias("masked"))


@query
def labelled_fields(spark, sf):
    """Labelled names, ids, cards and codes, greetings and numbers in seeded lines and in lines on customers."""
    seeds = spread(fed(spark, sf, "lines", SEEDED_LINES, "line_id long, text string"))
    found = seeds.select("line_id", F.explode(d.labelled_found(F.col("text"))).alias("s")).select("line_id", "s.kind", "s.start", "s.end", "s.value")
    plain = d.spans_of(seeds, "line_id", "text", c.SSN).select("line_id", F.lit("ssn").alias("kind"), "start", "end", "value")
    return found.unionByName(plain)


SEEDED_LINES = [
    (1, "Full Name: Ana Lima"),
    (2, "Customer ID: AB_12-9"),
    (3, "Card Number: 4111 1111 1111 1111"),
    (4, "Dear Peter Fox, your code"),
    (5, "SSN 123-45-6789 and 987-65-4321"),
    (6, "é ID: 77"),
    (7, "nothing here"),
    (8, "full name: ana lima"),
    (9, "id: 77, ID: 7"),
    (10, "dear Bob"),
    (11, "Dear Customer, welcome"),
    (12, "card: 4111-1111-1111-111, CARD: 4111-1111-1111-111"),
    (13, "Your OTP is: 4821; otp 4821 and pin 99887"),
    (14, "123456 is your verification code"),
    (15, "account 10.0.0.1 and ACC-12AB34 mail a.b@c.io or call 415-555-0199"),
    (16, "code 12345678901"),
    (17, "4444 - login code"),
]


# ---- policy, redaction, audit -------------------------------------------------------------------------------------

TASK_RELEVANCE = [("email", "REQUIRED"), ("phone", "OPTIONAL"), ("payment_card", "IRRELEVANT"), ("account_identifier", "UNKNOWN")]


def _decided(spark, sf):
    found = d.hybrid_spans(table(spark, sf, "documents"), "doc_id")
    relevance = spark.createDataFrame(TASK_RELEVANCE, "category string, relevance string")
    rows = found.join(F.broadcast(relevance), "category", "left").withColumn("necessity", p.necessity(F.col("category"), F.col("relevance")))
    one = F.lit(0.9)
    choice = p.decide(F.col("category"), F.lit(None).cast("string"), F.col("relevance"), F.col("necessity"), F.lit("REMOTE_REASONING"), F.lit(False), F.col("confidence"), one, one)
    return rows.withColumn("choice", choice)


@query
def doc_policy_decisions(spark, sf):
    return _decided(spark, sf).select("doc_id", "category", "start", "necessity", "choice.decision", "choice.reason", F.col("choice.confidence").alias("policy_confidence"))


@query
def policy_matrix(spark, sf):
    """All combinations of category, relevance, destination and authorization, and those of events."""
    item = spark.range(1).select()
    for name, values in (("category", POLICY_CATEGORIES), ("relevance", POLICY_RELEVANCE), ("destination", POLICY_DESTINATIONS), ("authorized", (True, False)), ("detection", (0.5, 0.9))):
        item = item.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    item = item.unionByName(derived(spark, sf, "matrix").withColumn("detection", F.col("detection").cast("double")))
    rows = item.withColumn("necessity", p.necessity(F.col("category"), F.col("relevance")))
    one = F.lit(0.9)
    choice = p.decide(F.col("category"), F.lit(None).cast("string"), F.col("relevance"), F.col("necessity"), F.col("destination"), F.col("authorized"), F.col("detection"), one, one)
    return rows.withColumn("choice", choice).select(*rows.columns, "choice.decision", "choice.reason", F.col("choice.confidence").alias("policy_confidence"))


POLICY_CATEGORIES = ("email", "phone", "password_field", "otp", "payment_card", "address", "account_identifier", "person_name", "product_title", "price", "public_text")
POLICY_RELEVANCE = ("REQUIRED", "OPTIONAL", "IRRELEVANT", "UNKNOWN")
POLICY_DESTINATIONS = ("LOCAL_BROWSER", "REMOTE_REASONING", "REMOTE_SERVICE", "ELSEWHERE")


def _redaction_spans(text):
    """Disjoint spans of e-mail addresses, cards and IP addresses with a fixed decision for each category, numbered within it."""
    wanted = F.filter(d.hybrid_found(text), lambda s: s["category"].isin("email", "payment_card", "account_identifier"))

    def decided(own):
        def one(s, i):
            n = F.size(F.filter(F.slice(own, F.lit(1), i + 1), lambda x: x["category"] == s["category"]))
            decision = F.when(s["category"] == "email", "TOKENIZE").when(s["category"] == "payment_card", "LOCAL_ONLY").otherwise("REDACT")
            token = F.concat(F.upper(s["category"]), F.lit("_"), n.cast("string"))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), decision.alias("decision"), token.alias("token"))

        return F.transform(own, one)

    return t.let(d.disjoint(wanted), decided)


@query
def doc_tokenized(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(_redaction_spans(F.col("text"))).alias("s"))
    return rows.where("s.decision = 'TOKENIZE'").select("doc_id", "s.start", "s.end", "s.token")


def _redacted(spark, sf):
    """Documents with their spans and what is left of their texts: all within the row, so no shuffle."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.posexplode(F.array(_redaction_spans(F.col("text")))).alias("one", "spans"))
    return docs.select("doc_id", "text", r.rewritten(F.col("text"), F.col("spans")).alias("sanitized"), *r.counted(F.col("spans")))


@query
def doc_redacted_text(spark, sf):
    return _redacted(spark, sf).select("doc_id", F.sha2("sanitized", 256).alias("sanitized_sha256"), "redacted", "allowed")


def _sentinels(text):
    return F.transform(d.checked(text, c.EMAIL), lambda s: s["value"])


@query
def leak_audit(spark, sf):
    """No sanitized text holds an address of its document: no rows."""
    return _redacted(spark, sf).select("doc_id", F.explode(r.leaks(F.col("sanitized"), _sentinels(F.col("text")))).alias("sentinel"))


@query
def leak_audit_control(spark, sf):
    """The same audit of the raw texts finds every address."""
    return table(spark, sf, "documents").select("doc_id", F.explode(r.leaks(F.col("text"), _sentinels(F.col("text")))).alias("sentinel"))


@query
def token_secret_scrub(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", t.changed(F.col("text"), r.scrub_secrets(F.col("text"))).alias("scrubbed"))
    return docs.select("doc_id", F.sha2("scrubbed", 256).alias("scrubbed_sha256"))


@query
def payload_audit(spark, sf):
    errors = t.let(r.payload_errors(F.col("text")), lambda e: F.when(F.size(e) > 0, F.array_join(e, ",")))
    return table(spark, sf, "documents").select("doc_id", t.given(errors).alias("errors"))


@query
def pii_vs_labels(spark, sf):
    n = F.size(d.hybrid_found(F.col("text")))
    docs = table(spark, sf, "documents").select("doc_id", F.nullif(n, F.lit(0)).alias("n")).join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.sum(F.coalesce("n", F.lit(0))).alias("spans"), F.count("n").alias("docs_with_spans"))


@query
def unlabelled_docs(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query
def label_diff(spark, sf):
    """Both ways in one pass: what stands on one side only."""
    docs, labels = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("doc")), table(spark, sf, "labels").select("doc_id", F.lit(1).alias("label"))
    both = docs.join(labels, "doc_id", "full_outer").where("doc IS NULL OR label IS NULL")
    return both.groupBy(F.when(F.col("doc").isNull(), "orphan_label").otherwise("unlabelled").alias("kind")).agg(F.count("*").alias("n"))


@query
def class_distribution(spark, sf):
    labels = table(spark, sf, "labels")
    n = labels.groupingSets([["quality", "toxic"], ["toxic"]], "quality", "toxic").agg(F.count("*").alias("n"), F.grouping("quality").cast("int").alias("total"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("total"))  # two totals and a few classes: small by now
    return n.withColumn("percent", F.round(share, 6)).select("quality", "toxic", "n", "total", "percent")


# ---- pages, conversations, events ---------------------------------------------------------------------------------


@query
def page_host(spark, sf):
    return pg.metadata(table(spark, sf, "pages"))


@query
def page_links(spark, sf):
    return pg.links(table(spark, sf, "pages"))


@query
def page_endpoint_class(spark, sf):
    return table(spark, sf, "pages").select("page_id", pg.endpoint_class(F.col("url")).alias("endpoint"))


@query
def page_text_nodes(spark, sf):
    return pg.text_nodes(table(spark, sf, "pages"))


@query
def conv_role_turns(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query
def conv_last_n(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return ev.last_n(turns, "conv_id", [F.desc("turn"), F.desc("role")], 5)


def _events(spark, sf):
    return table(spark, sf, "events")


@query
def event_filter(spark, sf):
    return ev.since(_events(spark, sf), 500, "Error").select("event_id", "user_id", "event_type")


@query
def event_level(spark, sf):
    return _events(spark, sf).groupBy(ev.level(F.col("event_type")).alias("level")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query
def event_metrics(spark, sf):
    k = F.regexp_extract("props", r'"k": *(-?\d+)', 1).cast("int")
    return _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("total"), F.max(k).alias("max_k"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(k > 50).alias("high"))


@query
def event_ring(spark, sf):
    return ev.ring(_events(spark, sf)).select("event_id", "event_type")


@query
def event_loop3(spark, sf):
    return ev.repeats(_events(spark, sf).select("event_id", "user_id", "event_type"), "user_id", ["event_id"], "event_type").where("looping").select("event_id", "user_id", "event_type")


@query
def event_failure_runs(spark, sf):
    return ev.failure_runs(_events(spark, sf), "user_id", ["event_id"], F.col("event_type") == "error", 2)


@query
def event_replan_budget(spark, sf):
    rows = ev.budget_spent(_events(spark, sf).select("event_id", "user_id", "event_type"), "user_id", ["event_id"], F.col("event_type") == "error", 5)
    return rows.where("exhausted").groupBy("user_id").agg(F.min("event_id").alias("from_event"), F.max("used").alias("used"))


@query
def event_halted(spark, sf):
    rows = ev.halted(_events(spark, sf), "user_id", ["event_id"], F.col("event_type") == "error")
    return rows.groupBy("user_id").agg(F.count_if("executed").alias("executed"), F.count_if(~F.col("executed")).alias("not_executed"))


@query
def event_sessions(spark, sf):
    rows = _events(spark, sf).groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("s")).agg(F.count("*").alias("n"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query
def event_size_gate(spark, sf):
    return _events(spark, sf).select("event_id", F.octet_length("props").cast("long").alias("bytes"), (F.octet_length("props") > 8).alias("too_large")).where("too_large")


@query
def event_stale(spark, sf):
    """Events more than 300 s before their user's next one."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    gap = F.lead(ms).over(w) - ms
    return _events(spark, sf).withColumn("gap_ms", gap).where(F.abs("gap_ms") > 300_000).groupBy("user_id").agg(F.count("*").alias("stale"), F.max("gap_ms").alias("longest_ms"))


# ---- seeded: boxes, confidence, vault, tasks ----------------------------------------------------------------------

BOXES = [(1, 50, 50, 100, 20), (2, 52, 51, 98, 18), (3, 140, 55, 90, 20), (4, 400, 300, 10, 0), (5, 410, 310, 0, 10), (6, 120, 60, 400, 300), (7, 700, 20, 30, 30)]


def _boxes(spark, sf):
    """Seeded boxes and those of order lines; a box's page is its number without the last digit."""
    rows = fed(spark, sf, "boxes", [tuple(map(float, b)) for b in BOXES], "id double, x double, y double, width double, height double")
    return rows.select(F.col("id").cast("long").alias("id"), F.floor(F.col("id") / 10).cast("long").alias("page"), g.box(F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("b"))


@query
def bbox_overlap(spark, sf):
    """Pairs of boxes of one page that overlap."""
    a, b = (_boxes(spark, sf).select("page", F.col("id").alias(n), F.col("b").alias(f"box_{n}")) for n in ("a", "b"))
    return a.join(b, "page").where((F.col("a") < F.col("b")) & g.overlap(F.col("box_a"), F.col("box_b"))).select("a", "b")


@query
def bbox_transform(spark, sf):
    size = [F.lit(float(x)) for x in (1280, 720, 2560, 1440)]
    view, page = g.viewport_to_bitmap(F.col("b"), *size), g.page_to_bitmap(F.col("b"), F.lit(0.0), F.lit(40.0), *size)
    visible, back = g.in_viewport(F.col("b"), F.lit(0.0), F.lit(40.0), *size[:2]), g.bitmap_to_viewport(F.col("b"), *size)
    out = _boxes(spark, sf).select("id", view.alias("v"), page.alias("p"), back.alias("k"), visible.alias("visible"))
    return out.select("id", "visible", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in "vpk" for f in ("x", "y", "width", "height")])


EVIDENCE = [[], ["CHECKSUM"], ["DOM_SEMANTIC", "DOM_SEMANTIC"], ["OCR_VISUAL", "HEURISTIC_SYNTAX"], ["CHECKSUM", "DOM_SEMANTIC", "OCR_VISUAL"]]


@query
def confidence_table(spark, sf):
    cats = spark.range(1).select(F.explode(F.array(*map(F.lit, [*c.BASE_CONFIDENCE, "unlisted"]))).alias("category"))
    groups = F.array(*[F.array(*map(F.lit, e)).cast("array<string>") for e in EVIDENCE])
    rows = cats.select("category", F.posexplode(groups).alias("evidence_no", "evidence"))
    rows = rows.unionByName(derived(spark, sf, "evidence").select("category", "evidence_no", F.get(groups, F.col("evidence_no").cast("int")).alias("evidence")))
    return rows.select("category", F.col("evidence_no").cast("long").alias("evidence_no"), t.confidence(F.col("category"), F.col("evidence")).alias("confidence"))


VAULT = [(1, "ACTIVE", 5000, "login"), (2, "REVOKED", 5000, "login"), (3, "ACTIVE", 900, "login"), (4, "EXPIRED", 5000, "login")]
VAULT_ASKS = [
    (10, 1, "LOCAL_BROWSER", True, "login"), (11, 1, "REMOTE_SERVICE", True, "login"), (12, 2, "LOCAL_EXTENSION", True, "login"), (13, 3, "LOCAL_BROWSER", True, "login"),
    (14, 4, "LOCAL_BROWSER", True, "login"), (15, 1, "LOCAL_BROWSER", False, "login"), (16, 1, "LOCAL_BROWSER", True, "checkout"), (17, 9, "LOCAL_BROWSER", True, "login"), (18, None, "LOCAL_BROWSER", True, "login"),
]


@query
def vault_retrieve_codes(spark, sf):
    vault = fed(spark, sf, "vault", VAULT, "vault_id long, state string, expires_ms long, purpose string")
    asks = fed(spark, sf, "vault_asks", VAULT_ASKS, "ask_id long, vault_id long, destination string, authorized boolean, wanted string")
    rows = asks.join(vault.withColumn("known", F.lit(True)), "vault_id", "left")
    code = p.vault_result(F.col("known"), F.col("destination"), F.col("state"), F.col("expires_ms"), F.lit(1000), F.col("authorized"), F.col("purpose"), F.col("wanted"))
    return rows.select("ask_id", code.alias("code"))


GOALS = [
    (1, "Find my email address and log in"), (2, "Read the article without phone or address"), (3, "Sign up with my name, do not use my credit card"), (4, "Verify the otp"),
    (5, "Pay with credit card"), (6, "Checkout now"), (7, "Search for laptops"), (8, "hello there"), (9, "Register an account"),
]


@query
def task_intent(spark, sf):
    low = F.lower("goal")
    ladder = None
    for intent, words, base in c.INTENTS:
        test, value = low.rlike(c.java(rf"\b(?:{words})\b")), F.struct(F.lit(intent).alias("intent"), F.lit(base).alias("confidence"))
        ladder = F.when(test, value) if ladder is None else ladder.when(test, value)
    clause = F.array_join(F.regexp_extract_all(low, F.lit(c.java(c.NEGATION)), F.lit(1)), " ")
    named = lambda text: F.array_compact(F.array(*[F.when(text.rlike(c.java(rf"\b(?:{w})\b")), k) for k, w in c.CATEGORY_WORDS.items()]))
    rows = fed(spark, sf, "goals", GOALS, "goal_id long, goal string").select("goal_id", ladder.alias("i"), named(clause).alias("negated"), named(low).alias("named"))
    return rows.select(
        "goal_id", F.coalesce("i.intent", F.lit("UNKNOWN")).alias("intent"), F.coalesce("i.confidence", F.lit(0.5)).alias("confidence"),
        F.array_join("negated", ",").alias("negated"), F.array_join(F.array_except("named", "negated"), ",").alias("explicit"),
    )


PRICE_BRACKETS = [(1, None, 920.0), (2, 920.0, 950.0), (3, 950.0, 980.0), (4, 980.0, None)]


@query
def price_bracket(spark, sf):
    """Each part's price bracket: four fixed rows, so a broadcast range join."""
    brackets = spark.createDataFrame(PRICE_BRACKETS, "bracket long, low double, high double")
    price = F.col("p_retailprice")
    fits = (F.col("low").isNull() | (price >= F.col("low"))) & (F.col("high").isNull() | (price < F.col("high")))
    return table(spark, sf, "part").join(F.broadcast(brackets), fits).groupBy("bracket").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"))


@query
def candidate_division(spark, sf):
    """Parts that break no constraint; a missing value breaks none."""
    part = table(spark, sf, "part")
    ok = F.coalesce(F.col("p_retailprice") <= 960, F.lit(True)) & F.coalesce(F.col("p_size") >= 20, F.lit(True)) & F.coalesce(F.lower("p_brand") == "brand#1", F.lit(True))
    return part.where(ok).select("p_partkey", "p_size")


@query
def tensor_check(spark, sf):
    """Whether a tensor's data has as many values as its shape says, and all are finite."""
    e = table(spark, sf, "embeddings")
    shape = F.array(F.lit(8), F.lit(8))
    fits = F.size("embedding") == F.aggregate(shape, F.lit(1), lambda a, x: a * x)
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.groupBy("label").agg(F.count_if(fits).alias("fits"), F.count_if(finite).alias("finite"), F.count("*").alias("n"))

