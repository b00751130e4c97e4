"""What a goal in words asks for: where to go, which of several, what kind of task, what to press. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as c

# --- fixed values ---
PLATFORMS = {
    "google": "https://www.google.com", "wikipedia": "https://www.wikipedia.org", "youtube": "https://www.youtube.com", "github": "https://github.com", "reddit": "https://www.reddit.com", "flipkart": "https://www.flipkart.com",
    "ebay": "https://www.ebay.com", "walmart": "https://www.walmart.com", "amazon": "https://www.amazon.in", "myntra": "https://www.myntra.com", "twitter": "https://www.twitter.com", "x": "https://www.x.com",
    "linkedin": "https://www.linkedin.com", "stackoverflow": "https://www.stackoverflow.com", "bing": "https://www.bing.com", "duckduckgo": "https://duckduckgo.com",
}
INTERNAL_PAGES, SEARCH_PAGE = ["chrome://", "about:", "chrome-extension://", "devtools://"], "https://www.google.com"
NAMED_HOST = r"\b(?i:go to|open|visit|navigate to)\s+(?i:www\.)?((?i:[a-z0-9-]+\.(?:com|in|org|net|io|co|gov|edu|ai|app|dev)))\b"
# --- end of fixed values ---


def _group(text: Column, pattern: str) -> Column:
    """The first group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, c.java(pattern), 1), F.lit(""))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(c.java(pattern))


def navigation(goal: Column) -> Column:
    """struct<explicit, destination, url>."""
    low = F.lower(F.trim(goal))
    url = F.nullif(F.regexp_extract(goal, c.FULL_URL, 0), F.lit(""))
    site = _group(low, c.NAMED_SITE)
    opened, alone = _group(low, c.OPEN_AND), _group(low, c.OPEN_SITE)
    place = F.coalesce(F.split_part(site, F.lit("."), F.lit(1)), _group(low, c.ROOT_VERB), F.when(~opened.isin(c.NO_SITE_AND), opened), F.when(~alone.isin(c.NO_SITE), alone))
    where = F.coalesce(url, F.concat(F.lit("https://"), site))
    return F.struct((where.isNotNull() | place.isNotNull()).alias("explicit"), F.when(url.isNull(), place).alias("destination"), where.alias("url"))


def selection(goal: Column) -> Column:
    """struct<ordinal, index, quantifier> of the first rule that holds; null without one."""
    low, out = F.lower(goal), None
    for name, index, pattern in c.ORDINALS:
        value = F.struct(F.lit(name).alias("ordinal"), F.lit(index).alias("index"), F.lit("single").alias("quantifier"))
        out = F.when(_has(low, pattern), value) if out is None else out.when(_has(low, pattern), value)
    none = F.lit(None)
    return out.when(_has(low, c.EVERY), F.struct(none.cast("string").alias("ordinal"), none.cast("int").alias("index"), F.lit("all").alias("quantifier")))


def domain(goal: Column, explicit: Column) -> Column:
    low = F.lower(goal)
    has = {k: _has(low, p) for k, p in c.DOMAIN_WORDS.items()}
    form = has["form"] | has["change"] | has["put"] | has["field"] | (has["paper"] & ~has["goods"])
    return (
        F.when(form, "form_filling")
        .when(explicit & ~has["stay"], "navigation")
        .when(has["travel"] & ~has["fault"], "booking")
        .when(has["shop"] | (has["order"] & ~has["ordering"]), "ecommerce")
        .when(has["learn"], "research")
        .otherwise("general")
    )


def click_target(goal: Column) -> Column:
    low = F.lower(goal)

    def named(pattern: str) -> Column:
        target = F.nullif(F.regexp_replace(F.trim(_group(low, pattern)), r"\s+(?:button|btn|link)\z", ""), F.lit(""))
        return F.when(~target.isin(c.NO_TARGET), target)

    return F.coalesce(named(c.CLICK_LATER), named(c.CLICK_NOW), F.trim(_group(low, c.COMMAND)))


def action(goal: Column) -> Column:
    """The verb of the action asked for; adding to a cart is a workflow of its own."""
    low = F.lower(goal)
    later, now = _group(low, c.ACT_LATER), F.when(~_has(low, c.ABOUT), _group(low, c.ACT_NOW))
    return F.when(~_has(low, c.CART), F.coalesce(F.regexp_extract(click_target(goal), r"^[^\s]+", 0), later, now))


def start_url(goal: Column, place: Column, current: Column) -> Column:
    """Where a browser at the page `current` should go first, null to stay. place: the goal's `navigation`.

    An address in the goal counts first; a page outside the browser's own is left only for a goal that says where to; a known platform, then a named
    host, unless the page is there already; from the browser's own pages else to a search. A null page is the browser's own.
    """
    at = F.lower(F.coalesce(current, F.lit("")))
    internal = at == ""
    for start in INTERNAL_PAGES:
        internal = internal | F.coalesce(current.startswith(start), F.lit(False))
    platform = F.try_element_at(F.create_map(*[F.lit(x) for kv in PLATFORMS.items() for x in kv]), F.lower(place["destination"]))
    host = F.regexp_replace(F.regexp_extract(platform, "^https://([^/]+)", 1), r"^www\.", "")
    named = _group(goal, NAMED_HOST)
    away = lambda where: ~F.contains(at, F.lower(where))
    return F.when(goal.isNull(), None).otherwise(
        F.coalesce(
            F.nullif(F.regexp_extract(goal, r"(?i:https?://[^\s]+)", 0), F.lit("")),
            place["url"],
            F.when(
                internal | F.coalesce(place["explicit"], F.lit(False)),
                F.coalesce(F.when(platform.isNotNull() & away(host), platform), F.when(named.isNotNull() & away(named), F.concat(F.lit("https://"), named)), F.when(internal, SEARCH_PAGE)),
            ),
        )
    )
