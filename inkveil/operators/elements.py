"""What a user can act on in a page: membership, descriptions and flags, from a page's nodes in the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.dom import content, get, spaced, with_nodes

# --- fixed values ---
TAGS = ["button", "a", "input", "textarea", "select", "option", "summary"]
ROLES = ["button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "option", "tab", "menuitem", "switch"]
SPONSORED_TEXT = r"(?i)(?<![A-Za-z0-9_])(?:sponsored|advertisement|ad feedback|promoted|ad by)(?![A-Za-z0-9_])"
FILTER_KINDS = [("price", "price|₹|\\$|eur|gbp"), ("brand", "brand"), ("color", "colou?r"), ("size", "size")]
HEADINGS = ["legend", "h4", "h3", "h2", "label"]
GO_WORDS = ["go", "apply", "submit", "filter"]
SEMANTIC_TYPES = [
    ("email", "email", "email|e-mail"), ("phone", None, "phone|mobile|tel|contact"), ("first_name", None, "first.*name|fname"), ("last_name", None, "last.*name|lname"),
    ("name", None, "full.*name|(?<![a-z0-9_])name(?![a-z0-9_])"), ("password", "password", "password|passwd"), ("search", "search", "search|query|(?<![a-z0-9_])q(?![a-z0-9_])|keyword"), ("message", None, "message|comment|feedback|body|notes"),
]
# --- end of fixed values ---


def _has(node: Column, name: str, *words: str) -> Column:
    """Whether an attribute holds one of the words, in any case."""
    value = F.lower(F.coalesce(get(node, name), F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(value, F.lit(w))
    return out


def interactive(n: Column) -> Column:
    role, tabindex, editable = F.lower(F.coalesce(get(n, "role"), F.lit(""))), get(n, "tabindex"), get(n, "contenteditable")
    return n["tag"].isin(TAGS) | role.isin(ROLES) | F.coalesce(tabindex == "0", F.lit(False)) | F.coalesce(editable.isin("true", ""), F.lit(False)) | get(n, "onclick").isNotNull()


def _sponsor(n: Column) -> Column:
    marks = get(n, "data-ad").isNotNull() | get(n, "data-ad-id").isNotNull() | get(n, "data-ad-slot").isNotNull() | get(n, "data-ad-preview").isNotNull()
    return marks | _has(n, "data-component-type", "sponsored") | _has(n, "class", "sponsored", "ad-container", "advertisement") | _has(n, "id", "sponsored") | _has(n, "aria-label", "sponsored", "advertisement")


def _filters(n: Column) -> Column:
    named = n["tag"].isin("aside", "nav", "form", "fieldset") | F.coalesce(get(n, "role") == "search", F.lit(False))
    return named | _has(n, "aria-label", "refine", "filter") | _has(n, "id", "refinement", "filter") | _has(n, "class", "refinement", "filter", "facet")


def _product(n: Column) -> Column:
    named = (n["tag"] == "article") | F.coalesce(get(n, "role").isin("article", "listitem"), F.lit(False))
    return named | _has(n, "class", "product", "search-result", "result-item", "item-card") | _has(n, "data-testid", "product")


def _ids(nodes: Column, test) -> Column:
    return F.transform(F.filter(nodes, lambda n: n["text"].isNull() & test(n)), lambda n: n["id"])


def _nearest(chain: Column, ids: Column) -> Column:
    """The innermost of an element's chain (itself last) that is among ids; null without one."""
    return F.get(F.reverse(F.array_intersect(chain, ids)), F.lit(0))


def _first_given(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values])


def described(pages: DataFrame) -> DataFrame:
    """A row for each element: page_id, element_id (el_1 and so on), tag, role, text, aria_label, placeholder, name, type, value, checked, disabled,
    is_sponsored, is_filter, filter_category, is_max_price, is_min_price, is_price_go, is_product, semantic_type.

    Values of passwords and of free text never appear.
    """
    nodes = F.col("nodes")
    sets = {
        "sponsors": _sponsor, "filters": _filters, "products": _product, "sections": lambda n: n["tag"].isin("fieldset", "section", "div", "li"), "labels": lambda n: n["tag"] == "label", "items": lambda n: n["tag"] == "li",
        "headings": lambda n: n["tag"].isin(HEADINGS) | ((n["tag"] == "span") & _has(n, "class", "heading", "title")), "wrappers": lambda n: n["tag"].isin("button", "form", "div", "span") | F.coalesce(get(n, "role") == "button", F.lit(False)),
    }
    found = with_nodes(pages.select("page_id", "html")).select("page_id", "nodes", *[_ids(nodes, test).alias(name) for name, test in sets.items()])
    inside = lambda node_id, most: F.substring(spaced(content(nodes, node_id)), 1, most)
    kind_of = lambda n: F.lower(F.coalesce(F.when(get(n, "type") != "", get(n, "type")), F.when(n["tag"] == "input", F.lit("text")), F.lit("")))
    box_of = lambda n: kind_of(n).isin("checkbox", "radio")

    def label_text(n: Column) -> Column:
        chain = F.array_append(n["ancestors"], n["id"])
        named = F.get(F.filter(nodes, lambda x: (x["tag"] == "label") & (get(x, "for") == get(n, "id"))), F.lit(0))["id"]
        label = F.coalesce(named, _nearest(chain, F.col("labels")))
        return F.coalesce(F.when(label.isNotNull(), spaced(content(nodes, label))), inside(F.coalesce(_nearest(chain, F.col("items")), n["parent"]), 100))

    def own_text(n: Column) -> Column:
        wrapped = inside(_nearest(F.array_append(n["ancestors"], n["id"]), F.col("wrappers")), 80)
        button = F.coalesce(_first_given(get(n, "value"), get(n, "aria-label"), get(n, "title")), wrapped)
        field = n["tag"].isin("input", "textarea")
        return F.when(field & kind_of(n).isin("button", "submit", "reset"), button).when(field & box_of(n), label_text(n)).when(field, "").otherwise(inside(n["id"], 120))

    def chosen(n: Column) -> Column:
        options = F.filter(nodes, lambda x: (x["tag"] == "option") & F.array_contains(x["ancestors"], n["id"]))
        option = F.coalesce(F.get(F.filter(options, lambda x: get(x, "selected").isNotNull()), F.lit(0)), F.get(options, F.lit(0)))
        return F.coalesce(get(option, "value"), spaced(content(nodes, option["id"])))

    def value_of(n: Column) -> Column:
        return (
            F.when(kind_of(n) == "password", None).when(n["tag"] == "select", chosen(n)).when(n["tag"] == "option", F.coalesce(get(n, "value"), inside(n["id"], 80)))
            .when(box_of(n), F.coalesce(get(n, "value"), F.lit("on"))).when(kind_of(n).isin("button", "submit"), get(n, "value"))
        )

    def member(n: Column) -> Column:
        chain = F.array_append(n["ancestors"], n["id"])
        section = _nearest(chain, F.col("sections"))
        heading = F.get(F.filter(nodes, lambda x: F.array_contains(F.col("headings"), x["id"]) & F.array_contains(x["ancestors"], section)), F.lit(0))["id"]
        image = F.get(F.filter(nodes, lambda x: (x["tag"] == "img") & F.array_contains(x["ancestors"], n["id"])), F.lit(0))
        in_filter = F.arrays_overlap(chain, F.col("filters"))
        return F.struct(
            n["tag"].alias("tag"), n["attributes"].alias("attributes"), kind_of(n).alias("kind"), own_text(n).alias("own_text"), spaced(get(image, "alt")).alias("alt"), value_of(n).alias("value"),
            F.arrays_overlap(chain, F.col("sponsors")).alias("in_sponsored"), in_filter.alias("in_filter"), F.arrays_overlap(chain, F.col("products")).alias("in_product"),
            F.lower(F.when(in_filter & heading.isNotNull(), content(nodes, heading))).alias("section_text"),
        )

    members = F.transform(F.filter(nodes, lambda n: n["text"].isNull() & interactive(n)), member)
    rows = found.select("page_id", F.posexplode(members).alias("at", "n"))
    n, kind = F.col("n"), F.col("kind")
    rows = rows.select(
        "page_id", "at", "n", *[F.col(f"n.{x}").alias(x) for x in ("kind", "in_sponsored", "in_filter", "in_product", "section_text")], _first_given(get(n, "aria-label"), get(n, "aria-labelledby")).alias("aria"),
        *[F.when(get(n, x) != "", get(n, x)).alias(y) for x, y in (("placeholder", "placeholder"), ("name", "name"), ("role", "role_given"))], F.when(F.col("n.value") != "", F.substring("n.value", 1, 80)).alias("value"),
    )
    rows = rows.withColumn("text", _first_given(F.col("n.own_text"), F.col("aria"), get(n, "title"), F.substring("n.alt", 1, 120)))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    name, ident, hint, aria = low(F.col("name")), low(get(n, "id")), low(F.col("placeholder")), low(F.col("aria"))
    price_field = (n["tag"] == "input") & kind.isin("text", "number")
    highest = price_field & ((ident == "high-price") | (name == "high-price") | (hint == "max") | name.rlike("max-?price") | aria.rlike("max.*price"))
    lowest = price_field & ~highest & ((ident == "low-price") | (name == "low-price") | (hint == "min") | name.rlike("min-?price") | aria.rlike("min.*price"))
    category = None
    for word, pattern in FILTER_KINDS:
        test = F.col("section_text").rlike(pattern)
        category = F.when(test, word) if category is None else category.when(test, word)
    by_text = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("aria", F.lit("")), F.coalesce(get(n, "title"), F.lit(""))).rlike(SPONSORED_TEXT)
    rows = rows.select(
        "*", (F.col("in_sponsored") | by_text).alias("is_sponsored"), highest.alias("is_max_price"), lowest.alias("is_min_price"),
        (F.col("in_filter") | (kind == "checkbox") | (F.coalesce("role_given", F.lit("")) == "checkbox") | highest | lowest).alias("filter_so_far"),
        F.when(highest | lowest, "price").when(F.col("in_filter"), category).alias("category_so_far"),
    )
    go = ((n["tag"] == "input") & (kind == "submit") | (n["tag"] == "button")) & F.lower(F.coalesce("text", "value", F.lit(""))).isin(GO_WORDS)
    go = go & (F.col("filter_so_far") | F.coalesce(F.col("category_so_far") == "price", F.lit(False)))
    role = F.coalesce(
        "role_given",
        F.when((n["tag"] == "button") | kind.isin("submit", "button"), "button").when(n["tag"] == "a", "link").when(n["tag"] == "input", F.when(kind == "checkbox", "checkbox").when(kind == "radio", "radio").otherwise("textbox")).when(n["tag"] == "label", "label"),
    )
    return rows.select(
        "page_id", F.concat(F.lit("el_"), (F.col("at") + 1).cast("string")).alias("element_id"), n["tag"].alias("tag"), role.alias("role"), "text", F.col("aria").alias("aria_label"), "placeholder", "name",
        F.coalesce(F.when(get(n, "type") != "", get(n, "type")), F.when(n["tag"] == "input", F.lit("text"))).alias("type"), "value", F.when(get(n, "checked").isNotNull(), True).alias("checked"), get(n, "disabled").isNotNull().alias("disabled"),
        "is_sponsored", (F.col("filter_so_far") | go).alias("is_filter"), F.when(go, "price").otherwise(F.col("category_so_far")).alias("filter_category"), "is_max_price", "is_min_price", go.alias("is_price_go"),
        (F.col("in_product") & ~F.col("is_sponsored")).alias("is_product"), t.let(F.concat_ws(" ", name, ident, hint, aria, low(get(n, "autocomplete"))), lambda x: semantic_type(n["tag"], kind, F.coalesce("role_given", F.lit("")), name, ident, x)).alias("semantic_type"),
    )


def semantic_type(tag: Column, kind: Column, role: Column, name: Column, ident: Column, hint: Column) -> Column:
    out = None
    for label, type_, pattern in SEMANTIC_TYPES:
        test = hint.rlike(pattern)
        if label == "name":
            test = test & ~hint.rlike("username|user")
        if type_ is not None:
            test = test | (kind == type_)
        if label == "search":
            test = test | (role == "searchbox") | ((tag == "textarea") & ((name == "q") | (ident == "search")))
        if label == "message":
            test = test | (tag == "textarea")
        out = F.when(test, label) if out is None else out.when(test, label)
    return out
