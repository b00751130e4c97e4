"""Queries on nodes rewritten in passes, and on the text of pages put together from rewritten nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import detection, gates, passes
from ..sources import dom
from .catalog import query, table
from .derived import pick, spread
from .page_tree import shops

PATHS = ("div/p", "form/input#user_password", "li/span.product-title", "form/ssn", "td#account", "p.author", None)
LINE_PATH = f"{pick('doc_id + line', *PATHS)} AS element_path"


def lines(spark, sf):
    """The lines of documents as nodes."""
    docs = spread(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).selectExpr("doc_id", "line", "text", LINE_PATH)


@query
def line_passes(spark, sf):
    """Lines that the passes change: what is left of them, what was found, and how many characters went."""
    rows = passes.redact_nodes(lines(spark, sf)).where("is_sanitized")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.sha2("text", 256).alias("text_sha256"), *passes.KINDS, gone.alias("chars"))


def page_nodes(spark, sf):
    """Texts, fields, buttons and images of pages and of shop pages, and spans in the texts."""
    pages = spread(table(spark, sf, "pages").select("page_id", "html")).unionByName(shops(spark, sf, spread))
    rows = dom.shown_rows(pages)
    of = lambda name: F.coalesce(F.try_element_at("attributes", F.lit(name)), F.lit(""))
    field = gates.field_category(F.coalesce("type", F.lit("text")), of("autocomplete"), of("name"), of("id"), of("placeholder"), of("aria-label"))
    rows = rows.withColumn("protected", ((F.col("source") == "input") & field.isNotNull()) | (of("data-privacy-agent-image-redacted") == "true"))
    return rows.drop("attributes")


@query
def page_sanitized_text(spark, sf):
    """The text of each page with what was found in it redacted."""
    own = F.when(F.col("source") == "text", t.let(detection.core_found(F.col("text")), detection.disjoint))
    rows = page_nodes(spark, sf).withColumn("ranges", own)
    return passes.page_text(rows).select("page_id", "nodes", "sanitized", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha256"))
