"""Queries on goals in words, telemetry and remote payloads, boxes of models. Inputs that the tables lack are inline rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions import geometry as g
from ..functions import text as t
from ..operators import goals, telemetry
from .catalog import query, table
from .derived import fed, spread

GOALS = [
    (1, "Open https://example.org/a?b=1 now"), (2, "go to example.org and read the article"), (3, "Navigate to youtube"), (4, "open amazon and buy the second pair of shoes"), (5, "open mail and reply"),
    (6, "open youtube"), (7, "open cart"), (8, "Change the email to a@b.c"), (9, "type hello into the message box"), (10, "Click on the Submit button"), (11, "find the report and then press download link"),
    (12, "add to cart the last laptop"), (13, "select all"), (14, "book a train ticket for the first of May"), (15, "fix the ticket issue"), (16, "confirm order"), (17, "order pizza"), (18, "search about stars"),
    (19, "subscribe"), (20, "select the first"), (21, "read the latest paper, then star it"), (22, "every invoice"), (23, "hello"), (24, ""), (25, "Sign up for the survey"), (26, "visit news.site.io"),
]


@query
def goal_parse(spark, sf):
    """Where a goal leads, which item it means, its domain, what it clicks and does."""
    rows = fed(spark, sf, "goals", GOALS, "goal_id long, goal string")
    goal = F.col("goal")
    out = rows.select("goal_id", "goal", goals.navigation(goal).alias("n"), goals.selection(goal).alias("s"), goals.click_target(goal).alias("click_target"), goals.action(goal).alias("action"))
    return out.select("goal_id", "n.explicit", "n.destination", "n.url", "s.ordinal", "s.index", "s.quantifier", goals.domain(goal, F.col("n.explicit")).alias("domain"), "click_target", "action")


@query
def telemetry_scrub(spark, sf):
    """Documents that the six replacements change."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", t.changed(F.col("text"), telemetry.scrub(F.col("text"))).alias("scrubbed"))
    return docs.select("doc_id", F.sha2("scrubbed", 256).alias("scrubbed_sha256"))


@query
def telemetry_leaks(spark, sf):
    """Scrubbed documents that still hold an address: no rows."""
    held = t.let(telemetry.scrub(F.col("text")), lambda x: F.when(x.rlike(c.java(c.EMAIL)), True))
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", t.given(held).alias("held")).select("doc_id")


RECORDS = [
    (1, "login with password hunter2", None), (2, "buy shoes", "buy shoes"), (3, "pay 4111 1111 1111 1111 at 12 Long Oak Street", "pay"), (4, "see https://a.b/?Token=abc&x=1 TEST_TELEMETRY_1", "mail a@b.io"), (5, None, None), (6, "1234 5678 9012 3456", "OTP 4821"),
]


@query
def telemetry_tasks(spark, sf):
    rows = fed(spark, sf, "records", RECORDS, "record_id long, text string, summary string").select("record_id", telemetry.task(F.col("text"), F.col("summary")).alias("t"))
    return rows.select("record_id", "t.task", "t.summary", "t.had_secrets")


ERRORS = [
    (1, "TypeError", "token=abc is bad", None, "a\nb pin: 1\nc\nd\ne\nf"), (2, None, "plain", "E1", None), (3, "X", "mail a@b.io", None, "one line"),
]


@query
def telemetry_errors(spark, sf):
    rows = fed(spark, sf, "errors", ERRORS, "error_id long, kind string, message string, code string, stack string")
    out = rows.select("error_id", telemetry.error(F.col("kind"), F.col("message"), F.col("code"), F.col("stack")).alias("e"))
    return out.select("error_id", "e.kind", "e.message", "e.code", "e.stack")


@query
def remote_strings(spark, sf):
    """Documents that masking for a remote service changes."""
    docs = table(spark, sf, "documents").select("doc_id", t.changed(F.col("text"), telemetry.remote_string(F.col("text"))).alias("sent"))
    return docs.select("doc_id", F.sha2("sent", 256).alias("sent_sha256"))


MODEL_BOXES = [(1, 0.1, 0.2, 0.5, 0.25), (2, 64.0, 200.0, 128.0, 40.0), (3, -5.0, 100.0, 700.0, 700.0), (4, 0.0, 0.0, 0.0, 0.0), (5, 600.0, 560.0, 80.0, 10.5), (6, 1.0, 1.0, 1.0, 1.5)]


@query
def model_boxes(spark, sf):
    rows = fed(spark, sf, "model_boxes", MODEL_BOXES, "box_id long, x double, y double, width double, height double")
    own = g.box(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    size = [F.lit(float(x)) for x in (800, 600, 640, 640)]
    out = rows.select("box_id", g.model_to_bitmap(own, *size).alias("b"), g.label_box(own, *size[:2]).alias("l"))
    return out.select("box_id", *[F.col(f"{s}.{n}").alias(f"{s}_{n}") for s in "bl" for n in ("x", "y", "width", "height")])


ANSWERS = [(1, 200, 0), (2, 408, 0), (3, 429, 3), (4, 503, 2), (5, 401, 0), (6, 422, 1), (7, 418, 0), (8, None, 0), (9, 500, 4)]
MOST_RETRIES = 3


@query
def retry_class(spark, sf):
    """What follows an answer after so many attempts; a missing status counts as 500."""
    rows = fed(spark, sf, "answers", ANSWERS, "answer_id long, status int, attempt int")
    status = F.coalesce("status", F.lit(500))
    what = (
        F.when(status == 200, "DONE").when(status.isin(c.NEVER_RETRIED), "FATAL").when(status.isin(c.RETRYABLE) & (F.col("attempt") < MOST_RETRIES), "RETRY").when(status.isin(c.RETRYABLE), "EXHAUSTED").otherwise("FAILED")
    )
    return rows.select("answer_id", what.alias("outcome"))


@query
def ordinal_choice(spark, sf):
    """Of each customer's orders by key, the one an index means: 2 clamped to what there is, and -1, the last."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = F.count("*").over(Window.partitionBy("o_custkey"))
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).alias("at"), n.alias("n"))
    asked = rows.select("*", F.explode(F.array(F.lit(2), F.lit(-1))).alias("index"))
    place = F.when(F.col("index") == -1, F.col("n") - 1).otherwise(F.greatest(F.lit(0), F.least(F.col("index").cast("long"), F.col("n") - 1)))
    return asked.where(F.col("at") == place).select("o_custkey", "index", "o_orderkey")
