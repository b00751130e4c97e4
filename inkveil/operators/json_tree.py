"""Rewriting free-form JSON within its row: a VARIANT is opened level by level into a flat array of pieces, in order.

Opening an object or array puts its brackets, names and members in its place, so the array always spells the whole value
from left to right. Rules are decided where an object is opened, as all its names are known there: a whole object can be
replaced, a member left out or replaced. Strings are rewritten once, when all is open. No shuffle, no Python: a payload stays
in its row. Members of objects come out sorted by name, as VARIANT keeps them.

Text that is no JSON, and an object that has a name twice, give null: what wasn't read doesn't leave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions import text as t
from . import telemetry

PIECE = "struct<lead:string,text:string,value:variant,open:boolean>"
TOO_DEEP = '"[TOO_DEEP]"'


def quoted(text: Column) -> Column:
    """A string as JSON."""
    return t.let(F.to_json(F.array(text)), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))


def nesting(json: Column) -> Column:
    """How deep brackets stand in each other, strings apart."""
    bare = F.regexp_replace(json, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, b: Column) -> Column:
        now = a["now"] + F.when(b.isin("[", "{"), 1).when(b.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    most = F.aggregate(brackets, state, step, lambda a: a["most"])
    opening = F.length(json) - F.length(F.translate(json, "{[", ""))
    return F.when(opening == 0, 0).when((opening == 1) & json.substr(1, 1).isin("{", "["), 1).otherwise(most)  # flat values need no walk


def deepest(rows: DataFrame, json: str) -> int:
    """The levels that rows need: one pass, one number."""
    return depths(rows, json)[0]


def depths(rows: DataFrame, *json: str) -> list[int]:
    """The levels that rows need for each of the columns, in one pass."""
    return list(rows.agg(*[F.coalesce(F.max(nesting(F.col(x))), F.lit(0)).alias(x) for x in json]).first())


def _piece(lead: Column | str, text: Column | str | None, value: Column | None = None, open_: Column | bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    value = F.lit(None).cast("variant") if value is None else value
    return F.struct(lit(lead).cast("string").alias("lead"), lit(text).cast("string").alias("text"), value.alias("value"), lit(open_).alias("open"))


def _opened(piece: Column, whole: Callable[[Column], Column], member: Callable[[Column, Column], Column], dropped: Callable[[Column], Column]) -> Column:
    comma = lambda i: F.when(i > 0, ",").otherwise("")

    def of_object(m: Column) -> Column:
        entries = F.filter(F.map_entries(m), lambda e: ~dropped(e["key"]))

        def one(e: Column, i: Column) -> Column:
            return t.let(member(e["key"], e["value"]), lambda x: _piece(F.concat(comma(i), quoted(e["key"]), F.lit(":")), x, e["value"], x.isNull()))

        inner = F.concat(F.array(_piece(F.concat(piece["lead"], F.lit("{")), "")), F.transform(entries, one), F.array(_piece("", "}")))
        return t.let(whole(m), lambda x: F.when(x.isNotNull(), F.array(_piece(piece["lead"], x))).otherwise(inner))

    def of_array(a: Column) -> Column:
        inner = F.transform(a, lambda v, i: _piece(comma(i), None, v, True))
        return F.concat(F.array(_piece(F.concat(piece["lead"], F.lit("[")), "")), inner, F.array(_piece("", "]")))

    closed = F.array(_piece(piece["lead"], None, piece["value"]))
    members, items = F.try_variant_get(piece["value"], "$", "map<string,variant>"), F.try_variant_get(piece["value"], "$", "array<variant>")
    read = t.let(members, lambda m: F.when(m.isNotNull(), of_object(m)).otherwise(t.let(items, lambda a: F.when(a.isNotNull(), of_array(a)).otherwise(closed))))
    return F.when(piece["open"], read).otherwise(F.array(piece))


def rewritten(
    rows: DataFrame,
    column: str,
    string: Callable[[Column], Column],
    whole: Callable[[Column], Column] = lambda m: F.lit(None).cast("string"),
    member: Callable[[Column, Column], Column] = lambda key, value: F.lit(None).cast("string"),
    dropped: Callable[[Column], Column] = lambda key: F.lit(False),
    levels: int | None = None,
) -> DataFrame:
    """rows with the JSON of `column` rewritten: strings by `string`; where `whole(members)` or `member(name, value)` isn't null, it is the JSON that stands instead.

    levels: how deep to open; by default what the deepest row needs, measured by one pass. What lies deeper is replaced by TOO_DEEP.
    """
    levels = deepest(rows, column) if levels is None else levels
    others = [x for x in rows.columns if x != column]
    opened = rows.select(*others, t.let(F.try_parse_json(column), lambda v: F.when(v.isNotNull(), F.array(_piece("", None, v, True)))).alias(column))
    for _ in range(levels + 1):  # a select a level: one expression of all levels would be too deep for the analyzer
        opened = opened.select(*others, F.flatten(F.transform(column, lambda p: _opened(p, whole, member, dropped))).alias(column))

    def end(p: Column) -> Column:
        text = F.try_variant_get(p["value"], "$", "string")
        leaf = F.when(F.schema_of_variant(p["value"]) == "STRING", quoted(string(text))).otherwise(F.to_json(p["value"]))
        return F.concat(p["lead"], F.when(p["open"], TOO_DEEP).when(p["text"].isNotNull(), p["text"]).otherwise(leaf))

    return opened.select(*others, F.array_join(F.transform(column, end), "").alias(column)).select(*rows.columns)


# ---- telemetry ------------------------------------------------------------------------------------------------------


def sensitive(key: Column) -> Column:
    return F.trim(key).rlike(f"^(?i:{'|'.join(c.SENSITIVE_KEYS)})$")


def _given(value: Column) -> Column:
    """Neither missing nor null, false, zero or empty."""
    return F.coalesce(~F.to_json(value).isin("null", "false", "0", "-0", "0.0", '""'), F.lit(False))


def _protected(m: Column) -> Column:
    """JSON that stands for a vault's entry, or for a token with its value; null for other objects."""
    get = lambda k: F.try_element_at(m, F.lit(k))
    or_else = lambda k, other: F.when(_given(get(k)), F.to_json(get(k))).otherwise(F.lit(f'"{other}"'))
    vault = _given(get("isVaultInstance")) | (get("secretValue").isNotNull() & get("category").isNotNull())
    entry = F.concat(F.lit('{"category":'), or_else("category", "vault_entry"), F.lit(',"isVaultProtected":true,"purpose":'), or_else("purpose", "local_execution"), F.lit(',"status":"PROTECTED_LOCAL_ONLY"}'))
    token = F.try_variant_get(get("token"), "$", "string")
    mapped = F.coalesce(F.startswith(token, F.lit(c.TOKEN_PREFIX)), F.lit(False)) & _given(get("value"))
    mapping = F.concat(F.lit('{"category":'), or_else("category", "tokenized_entity"), F.lit(',"token":'), quoted(token), F.lit(f',"value":"{c.PROTECTED_MAPPING}"}}'))
    return F.when(vault, entry).when(mapped, mapping)


def _masked(key: Column, value: Column) -> Column:
    null = F.schema_of_variant(value) == "VOID"
    return (
        F.when(sensitive(key), F.when(null, "null").otherwise(f'"{c.PROTECTED}"'))
        .when(key.isin(c.RAW_PAGE_KEYS), f'"{c.RAW_PAGE}"')
        .when(key.isin(c.RAW_IMAGE_KEYS), f'"{c.RAW_IMAGE}"')
    )


def scrubbed(rows: DataFrame, column: str, levels: int | None = None) -> DataFrame:
    """Telemetry payloads without secrets: sensitive names, vault entries, token mappings, raw pages and images, and every string scrubbed."""
    return rewritten(rows, column, telemetry.scrub, _protected, _masked, levels=levels)


def remote(rows: DataFrame, column: str, levels: int | None = None) -> DataFrame:
    """Payloads for a remote service: sensitive members left out, addresses and long digit runs in every string masked."""
    return rewritten(rows, column, telemetry.remote_string, dropped=lambda key: F.lower(key).isin(c.REMOTE_KEYS), levels=levels)


# ---- payloads for remote reasoning ----------------------------------------------------------------------------------


def assembled(rows: DataFrame, key: str, levels: int = 4, most_bytes: int = c.MOST_PAYLOAD_BYTES) -> DataFrame:
    """From (key, task, intent, elements array<struct>, blocks array<string>, tokens array<struct<token, category>>): key, ok, status, bytes, payload.

    The payload has the task's beginning, the first 100 elements, the blocks, what each token stands for by category only,
    and counts; it is sanitised as a whole and refused beyond most_bytes.
    """
    entry = lambda x: F.struct(x["token"], F.struct(x["token"].alias("token"), x["category"].alias("category"), F.lit("OPAQUE_ID").alias("type"), F.lit("TOKENIZE").alias("decision")))
    mapping = F.map_from_entries(F.transform(F.array_distinct("tokens"), entry))
    counts = F.struct(F.size("elements").alias("nodeCount"), F.size("blocks").alias("visualBlockCount"), F.size(F.array_distinct("tokens")).alias("tokensCount"), F.lit("REMOTE_REASONING").alias("destination"))
    candidate = F.struct(
        F.lit("SANITIZED").alias("status"), F.substring("task", 1, c.MOST_TASK_CHARS).alias("userTask"), F.coalesce("intent", F.lit("UNKNOWN")).alias("taskIntent"),
        F.slice("elements", 1, 100).alias("interactiveElements"), F.col("blocks").alias("visualBlocks"), mapping.alias("tokenMapping"), counts.alias("metadata"),
    )

    built = remote(rows.select(key, F.to_json(candidate).alias("payload")), "payload", levels)
    size = F.octet_length("payload").cast("long")
    sized = built.select(key, "payload", size.alias("bytes"), (size <= most_bytes).alias("ok"))
    return sized.select(key, "ok", F.when(F.col("ok"), "SANITIZED").otherwise("REJECTED").alias("status"), "bytes", F.when(F.col("ok"), F.col("payload")).alias("payload"))
