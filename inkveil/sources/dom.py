"""Pages as trees of nodes, in the row: markup is cut into tokens by one pattern and folded with a stack of open elements.

`nodes(html)` is an array in document order. Elements and texts have an id (their place, from 1), their parent's, the ids of all
ancestors, depth (1 at the top), tag (`#text` for texts), number among siblings of its tag, attributes and whether the caller's rule hides them or an ancestor.
An end tag closes everything open inside its element; an end tag without one counts for nothing; void elements and `<x/>`
hold nothing. Scripts and styles are one token each, and their content is no text. Comments and
declarations make no node; every text between tags does, blank ones too.

The fold goes through chunks of tokens and gathers a chunk's nodes apart, so a page costs what its tokens and depth make, and stays JVM-side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions import text as t

VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
# --- fixed values ---
FORBIDDEN = ["script", "style", "noscript", "iframe", "object", "embed", "applet", "base"]
NOT_SHOWN = ["head", "script", "style", "noscript", "template", "svg"]
STRIPPED_ATTRIBUTES = ["onclick", "onload", "onerror", "onmouseover", "onfocus", "onblur", "onchange", "onsubmit", "data-raw-value", "data-secret", "data-password"]
MOST_DEPTH, MOST_NODES, MOST_TEXT = 32, 1000, 5000
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»", "euro": "€", "bull": "•", "times": "×"}
BARE = ["amp", "lt", "gt", "quot", "nbsp", "copy", "reg", "middot", "laquo", "raquo", "times"]  # valid without their semicolon too
# --- end of fixed values ---
TOKEN = (
    r"(?s)<!--.*?(?:-->|\z)|<(?i:script)\b[^>]*+>.*?(?:</(?i:script)\s*+>|\z)|<(?i:style)\b[^>]*+>.*?(?:</(?i:style)\s*+>|\z)"
    r"|</?[A-Za-z](?:[^>\"']*+(?:\"[^\"]*+\"|'[^']*+')){0,300}[^>]*+>|<[!?/][^>]*+>|[^<]++|<"
)
ATTRIBUTE = r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?"""
CHUNK = 128
NODE = "struct<id:int,parent:int,ancestors:array<int>,depth:int,tag:string,nth:int,hidden:boolean,attributes:map<string,string>,text:string>"
KIDS = "array<struct<tag:string,n:int>>"
OPEN = f"struct<id:int,tag:string,hidden:boolean,kids:{KIDS}>"


def decoded(text: Column) -> Column:
    """Text with its named and numbered entities as characters; names outside ENTITIES stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    parts = F.regexp_extract_all(text, F.lit(rf"&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]*);|&(?:{'|'.join(BARE)})|[^&]+|&"), F.lit(0))

    def one(p: Column) -> Column:
        body = F.rtrim(F.substr(p, F.lit(2)), F.lit(";"))
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 6), 16, 10).cast("int")).otherwise(F.substring(body, 2, 7).try_cast("int"))
        fits = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.when(fits, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.when(p.startswith("&"), F.coalesce(F.when(body.startswith("#"), char).otherwise(F.try_element_at(names, body)), p)).otherwise(p)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def attributes(tag: Column) -> Column:
    """Lower-case names to values, the first of each; empty where a name has none."""
    none = F.create_map().cast("map<string,string>")
    body = F.regexp_extract(tag, r"(?s)^<[A-Za-z][^\s>/]*+(.*)>$", 1)

    def both(b: Column) -> Column:
        names = F.transform(F.regexp_extract_all(b, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
        values = F.regexp_extract_all(b, F.lit(ATTRIBUTE), F.lit(2))

        def paired(p: Column) -> Column:
            bare = lambda v: decoded(F.when(v.rlike("^[\"']"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))
            return t.let(F.array_distinct(p["names"]), lambda n: F.map_from_arrays(n, F.transform(n, lambda x: bare(F.get(p["values"], F.array_position(p["names"], x).cast("int") - 1)))))

        return t.let(F.struct(names.alias("names"), values.alias("values")), paired)

    return F.when(F.trim(body) != "", t.let(body, both)).otherwise(none)


def _token(s: Column) -> Column:
    """struct<kind, tag, attributes, text>: kinds open, void, close, text and skip."""
    none, no_text = F.create_map().cast("map<string,string>"), F.lit(None).cast("string")
    made = lambda kind, tag, own, text: F.struct(kind.alias("kind"), tag.alias("tag"), own.alias("attributes"), text.alias("text"))

    def element(x: Column) -> Column:
        closed = x["tag"].isin(VOID) | x["tag"].isin("script", "style") | F.endswith(x["whole"], F.lit("/>"))
        return made(F.when(closed, "void").otherwise("open"), x["tag"], attributes(x["whole"]), no_text)

    name = lambda: F.lower(F.regexp_extract(s, r"^</?([A-Za-z][^\s>/]*)", 1))
    whole = F.when(s.rlike("^<(?i:script|style)"), F.regexp_extract(s, r"(?s)^<(?:[^>\"']*+(?:\"[^\"]*+\"|'[^']*+')){0,300}[^>]*+>", 0)).otherwise(s)
    return (
        F.when(~s.startswith("<") | (s == "<"), made(F.lit("text"), F.lit(""), none, decoded(s)))
        .when(s.rlike("^<[A-Za-z]"), t.let(F.struct(name().alias("tag"), whole.alias("whole")), element))
        .when(s.rlike("^</[A-Za-z]"), made(F.lit("close"), name(), none, no_text))
        .otherwise(made(F.lit("skip"), F.lit(""), none, no_text))
    )


def _step(hidden: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """One token on struct<stack, last, out>. Nothing is bound by a lambda here: that would copy the state at each token."""

    def state(stack: Column, last: Column, out: Column) -> Column:
        return F.struct(stack.alias("stack"), last.alias("last"), out.alias("out"))

    def node(a: Column, x: Column, tag: Column, nth: Column, gone: Column) -> Column:
        ids = F.transform(F.slice(a["stack"], F.lit(2), F.size(a["stack"])), lambda e: e["id"])
        return F.struct(
            (a["last"] + 1).alias("id"), F.element_at(a["stack"], -1)["id"].alias("parent"), ids.alias("ancestors"), F.size(a["stack"]).alias("depth"), tag.alias("tag"), nth.alias("nth"), gone.alias("hidden"), x["attributes"].alias("attributes"), x["text"].alias("text")
        )

    def entry(id_: Column, tag: Column, gone: Column, kids: Column) -> Column:
        return F.array(F.struct(id_.alias("id"), tag.alias("tag"), gone.alias("hidden"), kids.alias("kids")))

    def step(a: Column, x: Column) -> Column:
        stack, top = a["stack"], F.element_at(a["stack"], -1)
        nth = F.coalesce(F.get(F.filter(top["kids"], lambda k: k["tag"] == x["tag"]), F.lit(0))["n"], F.lit(0)) + 1
        gone = top["hidden"] | hidden(x)
        kids = F.concat(F.filter(top["kids"], lambda k: k["tag"] != x["tag"]), F.array(F.struct(x["tag"].alias("tag"), nth.alias("n"))))
        counted = F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), entry(top["id"], top["tag"], top["hidden"], kids))
        opened = F.concat(counted, F.when(x["kind"] == "open", entry(a["last"] + 1, x["tag"], gone, F.array().cast(KIDS))).otherwise(F.array().cast(f"array<{OPEN}>")))
        at = F.array_position(F.reverse(F.transform(stack, lambda e: e["tag"])), x["tag"]).cast("int")
        left = F.when(at > 0, F.slice(stack, F.lit(1), F.size(stack) - at)).otherwise(stack)
        return (
            F.when(x["kind"] == "text", state(stack, a["last"] + 1, F.array_append(a["out"], node(a, x, F.lit("#text"), F.lit(0), top["hidden"]))))
            .when(x["kind"] == "close", state(left, a["last"], a["out"]))
            .when(x["kind"] == "skip", a)
            .otherwise(state(opened, a["last"] + 1, F.array_append(a["out"], node(a, x, x["tag"], nth, gone))))
        )

    return step


def with_nodes(pages: DataFrame, hidden: Callable[[Column], Column] = lambda x: F.lit(False), html: str = "html") -> DataFrame:
    """pages with `nodes` in place of their markup; `hidden` judges an element by its struct of tag and attributes."""
    others = [x for x in pages.columns if x != html]
    cut = pages.select(*others, F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0)), _token).alias("tokens"))
    root = F.array(F.struct(F.lit(0).alias("id"), F.lit("").alias("tag"), F.lit(False).alias("hidden"), F.array().cast(KIDS).alias("kids")))
    start = F.struct(root.alias("stack"), F.lit(0).alias("last"), F.array().cast(f"array<{NODE}>").alias("out"))
    both = lambda now, outs: F.struct(now.alias("now"), outs.alias("outs"))

    def chunk(a: Column, i: Column) -> Column:
        again = F.struct(a["now"]["stack"].alias("stack"), a["now"]["last"].alias("last"), F.array().cast(f"array<{NODE}>").alias("out"))
        return both(F.aggregate(F.slice("tokens", i * CHUNK + 1, F.lit(CHUNK)), again, _step(hidden)), F.array_append(a["outs"], a["now"]["out"]))

    chunks = F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.expr(f"cast((size(tokens) - 1) div {CHUNK} as int)"))).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(chunks, both(start, F.array().cast(f"array<array<{NODE}>>")), chunk, lambda a: F.flatten(F.array_append(a["outs"], a["now"]["out"])))
    return cut.select(*others, folded.alias("nodes"))


def path(nodes: Column, n: Column) -> Column:
    """`tag:nth-of-type(n)` of all ancestors and the element itself, or of a text's ancestors; ids are places in nodes."""
    chain = F.when(n["text"].isNull(), F.array_append(n["ancestors"], n["id"])).otherwise(n["ancestors"])
    place = lambda e: F.concat(e["tag"], F.lit(":nth-of-type("), e["nth"].cast("string"), F.lit(")"))
    return F.array_join(F.transform(chain, lambda i: place(F.get(nodes, i - 1))), "/")


# ---- texts ----------------------------------------------------------------------------------------------------------


def get(node: Column, name: str) -> Column:
    """An attribute, or null."""
    return F.try_element_at(node["attributes"], F.lit(name))


def spaced(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))


def content(nodes: Column, node_id: Column) -> Column:
    """The text inside an element."""
    own = F.filter(nodes, lambda n: n["text"].isNotNull() & (n["id"] > node_id) & F.array_contains(n["ancestors"], node_id))
    return F.array_join(F.transform(own, lambda n: n["text"]), "")


def _not_shown(x: Column, skipped: list[str]) -> Column:
    own = lambda name: F.try_element_at(x["attributes"], F.lit(name))
    return x["tag"].isin(skipped) | F.coalesce(own("aria-hidden") == "true", F.lit(False)) | own("hidden").isNotNull()


def text_rows(pages: DataFrame, skipped: list[str], most: int | None = None) -> DataFrame:
    """page_id, pos, element_path, text, source: visible texts, values of fields, selected options, editable text and labels, all of a page or its first `most`."""
    found = with_nodes(pages.select("page_id", "html"), lambda x: _not_shown(x, skipped))
    row = lambda n, text, source: F.struct(path(F.col("nodes"), n).alias("element_path"), text.alias("text"), F.lit(source).alias("source"))

    def of(n: Column) -> Column:
        value, kind = get(n, "value"), F.coalesce(get(n, "type"), F.lit(""))
        options = F.filter("nodes", lambda x: (x["tag"] == "option") & F.array_contains(x["ancestors"], n["id"]))
        chosen = F.coalesce(F.get(F.filter(options, lambda x: get(x, "selected").isNotNull()), F.lit(0)), F.get(options, F.lit(0)))
        shown = lambda c: F.when(c != "", c)
        selected, editable = shown(t.let(chosen["id"], lambda i: spaced(content(F.col("nodes"), i)))), shown(spaced(content(F.col("nodes"), n["id"])))
        edits = F.coalesce(get(n, "contenteditable").isin("", "true"), F.lit(False))  # null AND x would look at x, which reads the whole page
        label = get(n, "aria-label")
        return F.array_compact(
            F.array(
                F.when(n["text"].isNotNull(), F.when(spaced(n["text"]) != "", row(n, spaced(n["text"]), "text"))),
                F.when((n["tag"] == "input") & (value != "") & (kind != "hidden"), row(n, value, "input")),
                F.when((n["tag"] == "textarea") & (value != "") & (kind != "hidden"), row(n, value, "textarea")),
                F.when((n["tag"] == "select") & selected.isNotNull(), row(n, selected, "select")),
                F.when(edits & editable.isNotNull(), row(n, editable, "contenteditable")),
                F.when(label != "", row(n, label, "aria")),
            )
        )

    shown = F.flatten(F.transform(F.filter("nodes", lambda n: ~n["hidden"]), of))
    return found.select("page_id", F.posexplode(shown if most is None else F.slice(shown, 1, most)).alias("pos", "r")).select("page_id", "pos", "r.*")


# ---- sanitised trees ------------------------------------------------------------------------------------------------

_CODE = r"(?i:<script(?![A-Za-z0-9_])|eval\(|new Function\(|javascript:)"


def shown_rows(pages: DataFrame) -> DataFrame:
    """page_id, pos, source, path, text, type, attributes of a page's texts, fields, buttons and images, in order; head, code and drawings left out."""
    found = with_nodes(pages.select("page_id", "html"), lambda x: x["tag"].isin(NOT_SHOWN))
    nodes = F.col("nodes")
    empty = lambda x: F.coalesce(x, F.lit(""))

    def named(n: Column) -> Column:
        by_name = F.when(empty(get(n, "name")) != "", F.concat(n["tag"], F.lit('[name="'), get(n, "name"), F.lit('"]'))).otherwise(n["tag"])
        return F.when(empty(get(n, "id")) != "", F.concat(F.lit("#"), get(n, "id"))).otherwise(by_name)

    def row(n: Column) -> Column:
        parent = F.get(nodes, n["parent"] - 1)
        above = F.when(empty(get(parent, "id")) != "", F.concat(F.lit("#"), get(parent, "id"))).otherwise(F.coalesce(parent["tag"], F.lit("text")))
        field = n["tag"].isin("input", "textarea")
        value = F.coalesce(F.nullif(get(n, "value"), F.lit("")), F.when(n["tag"] == "textarea", F.nullif(content(nodes, n["id"]), F.lit(""))), get(n, "placeholder"), F.lit(""))
        source = F.when(n["text"].isNotNull(), "text").when(field, "input").when(n["tag"] == "button", "button").when(n["tag"] == "img", "image")
        text = F.when(n["text"].isNotNull(), n["text"]).when(field, value).when(n["tag"] == "button", content(nodes, n["id"])).otherwise(empty(get(n, "alt")))
        return F.struct(source.alias("source"), F.when(n["text"].isNotNull(), above).otherwise(named(n)).alias("path"), text.alias("text"), get(n, "type").alias("type"), n["attributes"].alias("attributes"))

    wanted = F.filter("nodes", lambda n: ~n["hidden"] & (n["text"].isNotNull() | n["tag"].isin("input", "textarea", "button", "img")))
    return found.select("page_id", F.posexplode(F.transform(wanted, row)).alias("pos", "r")).select("page_id", "pos", "r.*")


def _neutral(value: Column) -> Column:
    calm = F.regexp_replace(F.regexp_replace(value, r"(?i:javascript:)", "#"), r"(?i:eval\()[^\n\r]*?\)", "[NEUTRALIZED_CODE]")
    return F.when(value.rlike(_CODE), calm).otherwise(value)


def clean_attributes(own: Column) -> Column:
    """Without handlers and raw values; code in values disarmed, long ones cut."""
    kept = F.map_filter(own, lambda k, v: ~k.isin(STRIPPED_ATTRIBUTES) & ~k.startswith("on"))
    return F.transform_values(kept, lambda k, v: F.substring(_neutral(v), 1, MOST_TEXT))


def clean_text(text: Column) -> Column:
    """Code disarmed; e-mail addresses, then phone numbers, then cards masked; long texts cut."""
    script = F.regexp_replace(text, r"(?i:<script(?![A-Za-z0-9_])[^>]*>)[\s\S]*?(?i:</script>)", "[SCRIPT_REMOVED]")
    script = F.regexp_replace(F.regexp_replace(script, r"(?i:eval\()[^\n\r]*?\)", "[NEUTRALIZED_CODE]"), r"(?i:javascript:)", "#")
    out = F.when(text.rlike(_CODE), script).otherwise(text)
    out = F.regexp_replace(out, c.java(c.EMAIL), "[EMAIL_REDACTED]")
    return F.substring(F.regexp_replace(F.regexp_replace(out, c.PHONE, "[PHONE_REDACTED]"), c.CARD, "[CARD_REDACTED]"), 1, MOST_TEXT)


def sanitized(pages: DataFrame, most_depth: int | None = MOST_DEPTH, most_nodes: int | None = MOST_NODES) -> DataFrame:
    """page_id, node_id, parent, depth, tag, attributes, text of what may leave of a page's tree.

    In document order, the first most_nodes that are visited count: those below a forbidden element or deeper than most_depth
    aren't visited, a forbidden element itself is. None is no limit. A password's value never stays.
    """
    found = with_nodes(pages.select("page_id", "html"))

    def visited(nodes: Column) -> Column:
        forbidden = F.transform(F.filter(nodes, lambda n: n["tag"].isin(FORBIDDEN)), lambda n: n["id"])
        shallow = lambda n: F.lit(True) if most_depth is None else n["depth"] <= most_depth + 1
        all_ = t.let(forbidden, lambda ids: F.filter(nodes, lambda n: shallow(n) & ~F.arrays_overlap(n["ancestors"], ids)))
        return all_ if most_nodes is None else F.slice(all_, 1, most_nodes)

    def one(n: Column) -> Column:
        own = clean_attributes(n["attributes"])
        secret = F.coalesce(F.lower(get(n, "type")).contains("password"), F.lit(False))
        masked = F.map_concat(F.map_filter(own, lambda k, v: ~k.isin("value", "sanitizedvalue")), F.create_map(F.lit("sanitizedvalue"), F.lit("[LOCAL_ONLY_PROTECTED]")))
        return F.struct(n["id"].alias("node_id"), n["parent"].alias("parent"), (n["depth"] - 1).alias("depth"), n["tag"].alias("tag"), F.when(secret, masked).otherwise(own).alias("attributes"), clean_text(n["text"]).alias("text"))

    kept = F.filter(visited(F.col("nodes")), lambda n: ~n["tag"].isin(FORBIDDEN))
    return found.select("page_id", F.explode(F.transform(kept, one)).alias("n")).select("page_id", "n.*")
