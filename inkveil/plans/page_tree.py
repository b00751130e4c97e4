"""Queries on pages as trees: sanitised trees, visible texts, and elements with their flags. Shop pages are made of `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elements
from ..sources import dom
from ..sources.pages import SKIPPED
from .catalog import query, table
from .derived import spread

SHOP = (
    '<html><body><aside class="filters"><h3>Price range</h3><input type="text" id="low-price" placeholder="Min"><input type=text name="high-price"><button>Go</button>'
    '<label><input type="checkbox" value="{brand}" checked> {brand}</label></aside><article class="product-card"><a href="/p/{key}"><b>{name}</b> &amp; more</a><button onclick="add({key})">Add to cart</button>'
    '<img alt="pic"></article><div data-ad="1"><a href="/ad">{type}</a></div><p><a href="/x" title="Promoted"><img alt="z"></a></p>'
    '<form id="f"><input type="email" name="mail"><input type="password" value="{key}"><input name="fname"><textarea name="message">hi</textarea>'
    '<select name="size"><option value="s">Small</option><option selected>{size}</option></select><input type="submit" value="Send" disabled></form>'
    '<div role="Button" aria-label="Open cart">c</div><span tabindex="0">Tab</span><div contenteditable>Note</div><p role="note">no</p></body></html>'
)


def shops(spark, sf, through=lambda parts: parts):
    """A page for each part, numbered below zero; parts go through `through` first, as they are smaller than their pages."""
    html = F.lit(SHOP)
    for name, column in (("key", "p_partkey"), ("brand", "p_brand"), ("name", "p_name"), ("type", "p_type"), ("size", "p_size")):
        html = F.replace(html, F.lit(f"{{{name}}}"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return through(table(spark, sf, "part")).select((-F.col("p_partkey") - 1).alias("page_id"), html.alias("html"))


def _pages(spark, sf):
    return spread(table(spark, sf, "pages").select("page_id", "html"))


@query
def page_element_details(spark, sf):
    return elements.described(_pages(spark, sf).unionByName(shops(spark, sf, spread)))


@query
def page_tree_sanitized(spark, sf):
    """What is left of each whole page: nodes, texts and attributes, with a digest of the texts in order."""
    rows = dom.sanitized(_pages(spark, sf), most_depth=None, most_nodes=None)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("node_id", "text")))), lambda x: x["text"]), "\n")
    return rows.groupBy("page_id").agg(F.count("*").alias("nodes"), F.count("text").alias("texts"), F.sum(F.size("attributes")).alias("attributes"), F.sha2(texts, 256).alias("texts_sha256"))


@query
def page_visible_texts(spark, sf):
    rows = dom.text_rows(_pages(spark, sf).unionByName(shops(spark, sf, spread)), sorted(SKIPPED))
    return rows.groupBy("page_id", "source").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
