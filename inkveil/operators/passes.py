"""Nodes rewritten in passes, each on what the one before has left, and the text of a page put together from its rewritten nodes.

A pass overwrites what it takes by as many brackets. So a later pass sees the same neighbours as beside a replacement, which begins and ends with
brackets too, and its spans are places in the original text without further ado: the map of positions is the identity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions import text as t

# --- fixed values ---
SPACED_CARD = r"\b(?:\d[ -]*){13,19}\b"
PASSWORD_PATH, SSN_PATH, ID_PATH = "(?i)password", "(?i)ssn", "(?i)ssn|account|id"
PERSON_PATH = "author|user_name|customer_name|full_name|first_name|last_name|recipient|cardholder"
PRODUCT_PATH = "product|brand|title|item|heading|category|tag|btn|button|price"
REDACTED, LOCAL_ONLY, IMAGE = "[REDACTED]", "[LOCAL_ONLY_PROTECTED]", "[IMAGE_PII_REDACTED_LOCALLY]"
IMAGE_LINE = "[Image: Sanitized on-device - 0 raw PII transmitted]"
# --- end of fixed values ---
KINDS = ["card", "id", "email", "phone", "name"]
SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def _put(text: Column, spans: Column, instead: Callable[[Column], Column]) -> Column:
    """The text with its spans (disjoint, in order) replaced."""

    def piece(s: Column, i: Column) -> Column:
        at = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        return F.concat(F.substr(text, at + 1, s["start"] - at), instead(s))

    tail = F.substr(text, F.get(spans, F.size(spans) - 1)["end"] + 1)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(spans, piece), ""), tail))


def _has(path: Column, pattern: str) -> Column:
    return F.coalesce(path.rlike(pattern), F.lit(False))


def _count(kind: str) -> Column:
    return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")


def _pass(rows: DataFrame, kind: str, found: Column) -> DataFrame:
    """rows after a pass that finds these spans in `_work`: a column for each step, so that each is computed once."""
    own = F.col("_found")
    named = F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    work = _put(F.col("_work"), own, lambda s: F.repeat(F.lit("]"), (s["end"] - s["start"]).cast("int")))
    rows = rows.withColumn("_found", found)
    return rows.withColumns({"_work": work, "_spans": F.concat("_spans", named)})


def redact_nodes(nodes: DataFrame) -> DataFrame:
    """nodes with text, is_sanitized, spans, card, id, email, phone, name in place of columns of these names; further columns go along.

    In order: an element_path of a password hides the whole text; cards that pass the checksum; numbers of the SSN form, or by a path that names one the
    whole text; addresses; phones; titled names unless the path is a product's. spans (start, end, kind) are in the given text, in order. card counts
    cards, the others whether there was one. Of equal card numbers each is replaced where it was found. Null text counts as empty, null path as none.
    """
    given = F.struct(*[F.col(f"`{x}`") for x in nodes.columns]).alias("_given")
    rows = nodes.select(given, F.coalesce("text", F.lit("")).alias("_text"), F.coalesce("element_path", F.lit("")).alias("_path"))
    text, path = F.col("_text"), F.col("_path")
    literal = F.contains(text, F.lit(REDACTED))
    person = _has(F.lower(path), PERSON_PATH) | ~_has(F.lower(path), PRODUCT_PATH)
    local = _has(path, PASSWORD_PATH)
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    rows = rows.withColumns({"_work": F.when(local, "").otherwise(text), "_spans": F.array().cast(SPANS)})
    rows = _pass(rows, "card", F.filter(t.spans(F.col("_work"), SPACED_CARD), lambda s: t.luhn(s["value"])))
    rows = _pass(rows, "id", t.spans(F.col("_work"), c.SSN))
    rows = rows.withColumn("_whole", ~local & _has(path, SSN_PATH) & (F.size("_spans") == 0) & ~literal)
    numbered = (_count("id") > 0) | (_has(path, ID_PATH) & (_count("card") == 0))
    rows = rows.withColumn("_by_id", local | F.col("_whole") | (numbered & ((F.size("_spans") > 0) | literal)))
    rows = rows.withColumn("_work", F.when(F.col("_whole"), "").otherwise(F.col("_work")))
    rows = _pass(rows, "email", t.spans(F.col("_work"), c.EMAIL))
    rows = _pass(rows, "phone", t.spans(F.col("_work"), c.PHONE))
    rows = _pass(rows, "name", F.when(person, t.spans(F.col("_work"), c.PERSON_NAME)).otherwise(none))
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length(text).cast("long").alias("end"), F.lit("id").alias("kind"))).cast(SPANS)
    rows = rows.withColumn("_spans", F.when(local | F.col("_whole"), every).otherwise(F.array_sort("_spans")))
    shown = F.when(local, LOCAL_ONLY).when(F.col("_whole"), REDACTED).otherwise(_put(text, F.col("_spans"), lambda s: F.lit(REDACTED)))
    counts = {"card": _count("card"), "id": F.col("_by_id").cast("long"), **{k: F.least(_count(k), F.lit(1)).cast("long") for k in ("email", "phone", "name")}}
    out = F.struct(shown.alias("text"), (F.col("_by_id") | (F.size("_spans") > 0)).alias("is_sanitized"), F.col("_spans").alias("spans"), *[counts[k].alias(k) for k in KINDS])
    others = [F.col(f"_given.`{x}`") for x in nodes.columns if x not in ("text", "is_sanitized", "spans", *KINDS)]
    # A generator: a filter on what it gives stays above it, so no pass is computed for the filter again.
    return rows.select(*others, F.inline(F.array(out)))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{A0}]+|[\s\x{A0}]+\z", "")


def _ranges(spans: DataFrame) -> DataFrame:
    """page_id, pos, ranges: the spans of each node, those that overlap as one."""
    node = Window.partitionBy("page_id", "pos").orderBy("start", "end")
    before = F.max("end").over(node.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.where("start < end").select("page_id", "pos", "start", "end", F.coalesce(F.col("start") >= before, F.lit(True)).alias("apart"))
    apart = apart.withColumn("no", F.count_if("apart").over(node)).groupBy("page_id", "pos", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return apart.groupBy("page_id", "pos").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def page_text(nodes: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(page_id, nodes, sanitized, text): each page's visible nodes after redaction, a line each, in order.

    nodes: page_id, pos, source, path, text, type, protected. source: text (redacted at its spans, left out where nothing is left), input (a password
    hidden, a protected one redacted, an empty one without a line), button, image (a line if protected); rows of other sources are left out.
    spans: page_id, pos, start, end of nodes of source text, in code points; spans of a node that overlap are one, and of an empty one nothing goes.
    Without spans, nodes have their own in `ranges` (array of struct<start, end, ...>, disjoint and in order; null or empty for none).
    Pages without nodes have no row.
    """
    source, protected, shown = F.col("source"), F.coalesce("protected", F.lit(False)), F.coalesce("text", F.lit(""))
    rows = nodes.where(source.isin("text", "input", "button", "image")).select("page_id", "pos", "source", F.coalesce("path", F.lit("")).alias("path"), shown.alias("text"), "type", protected.alias("protected"), *(["ranges"] if spans is None else []))
    if spans is not None:
        rows = rows.join(_ranges(spans), ["page_id", "pos"], "left")
    any_ = F.coalesce(F.size("ranges"), F.lit(0)) > 0
    cut = F.when(~any_, _trimmed(F.col("text"))).otherwise(_trimmed(_put(F.col("text"), F.col("ranges"), lambda s: F.lit(REDACTED))))
    password = F.coalesce(F.lower("type") == "password", F.lit(False))
    out = (
        F.when(source == "text", cut)
        .when(source == "input", F.when(password, LOCAL_ONLY).when(F.col("protected"), REDACTED).otherwise(_trimmed(F.col("text"))))
        .when(source == "button", _trimmed(F.col("text")))
        .otherwise(F.when(F.col("protected"), IMAGE).when(F.col("text") != "", F.concat(F.lit("[Image: "), "text", F.lit("]"))).otherwise("[Image]"))
    )
    changed = F.when(source == "text", any_).when(source == "input", password | F.col("protected")).when(source == "image", F.col("protected")).otherwise(False)
    rows = rows.select("page_id", "pos", "source", "path", "protected", changed.alias("changed"), out.alias("out")).where((F.col("source") != "text") | (F.col("out") != ""))
    field = F.concat(F.lit("["), "path", F.lit("]: "))
    line = (
        F.when(source == "text", F.col("out"))
        .when((source == "input") & (F.col("out") != ""), F.concat(field, "out"))
        .when((source == "button") & (F.col("out") != ""), F.concat(F.lit("[Button: "), "out", F.lit("]")))
        .when((source == "image") & F.col("protected"), F.concat(field, F.lit(IMAGE_LINE)))
    )
    lines = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("pos", line.alias("line")))))
    return rows.groupBy("page_id").agg(F.count("*").alias("nodes"), F.count_if("changed").alias("sanitized"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
