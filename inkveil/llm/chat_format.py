"""Chat formatting from an event log, in DataFrame functions only.

Method. A log has rows (conv_id, seq, message, kind, role, payload) of kinds `start` (a message opens, with its role),
`delta` (text to append), `edit` (payload replaces the text so far), `regenerate` (the text starts anew, and later
messages that had started by then go) and `delete`. Events fold by message first: the last start, edit, regeneration
or deletion decides from where on payloads count, and those are joined by sequence. A running maximum over a conversation
drops what a regeneration cut off. Messages are then gathered by conversation and rendered. A conversation's messages
come together only as its one result row, after folding.

Template: `<|im_start|>role<|im_sep|>text<|im_end|>` for each message, nothing between. In roles and texts a backslash
is put into every `<|`, `<\\|`, `<\\\\|` and so on; taking one out again is exact, and no control string is left inside.
Loss spans give, for each assistant message, its number and the place of its text within that message's stretch, in code points.

Defined results. Null text or role: empty. Null conv_id is a conversation of its own. Messages of one conversation with
the same turn stand in order of role, then text; repeated rows are messages each. Deltas without a start open a message with
an empty role. Equal seq within a message: in order of payload. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def events_of_turns(turns: DataFrame, delta_chars: int = 256) -> DataFrame:
    """The log that would have streamed these turns: a start and deltas of at most delta_chars code points each."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    numbered = numbered.withColumn("message", F.row_number().over(order).cast("long"))
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    start = F.array(F.struct(F.lit("start").alias("kind"), "role", F.lit("").alias("payload")))
    deltas = F.transform(parts, lambda p: F.struct(F.lit("delta").alias("kind"), F.lit("").alias("role"), p.alias("payload")))
    one = numbered.select("conv_id", "message", F.posexplode(F.concat(start, deltas)).alias("at", "event"))
    return one.select("conv_id", (F.col("message") * (1 << 32) + F.col("at")).alias("seq"), "message", "event.*")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the messages that are left."""
    kind = F.col("kind")
    messages = events.groupBy("conv_id", "message").agg(
        F.collect_list(F.when(kind.isin("delta", "edit"), F.struct("seq", "payload"))).alias("parts"),
        F.max(F.when(kind.isin("start", "edit", "regenerate"), F.col("seq"))).alias("since"),
        F.max(F.when(kind == "delete", F.col("seq"))).alias("deleted"),
        F.max(F.when(kind == "regenerate", F.col("seq"))).alias("regenerated"),
        F.min("seq").alias("began"),
        F.max_by("role", F.when(kind == "start", F.col("seq"))).alias("role"),
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    alive = messages.withColumn("cut", F.max("regenerated").over(before)).where(
        (F.col("cut").isNull() | (F.col("began") > F.col("cut"))) & (F.col("deleted").isNull() | (F.col("deleted") < F.col("since")))
    )
    own = F.filter(F.array_sort("parts"), lambda p: F.col("since").isNull() | (p["seq"] >= F.col("since")))
    text = F.array_join(F.transform(own, lambda p: p["payload"]), "")
    return alive.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans array<struct<turn, start, length>> (turn from 0, start from 0 within the turn's stretch)."""
    head, text = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)), escape(F.col("text"))
    one = messages.select(
        "conv_id", F.struct("message", F.concat(head, text, F.lit(END)).alias("out"), F.length(head).alias("start"), F.length(text).alias("length"), (F.col("role") == "assistant").alias("loss")).alias("m")
    )
    all_ = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    spans = F.transform("m", lambda m, i: F.struct(i.alias("turn"), m["start"].alias("start"), m["length"].alias("length"), m["loss"].alias("loss")))
    loss = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length")))
    return all_.select("conv_id", F.array_join(F.transform("m", lambda m: m["out"]), "").alias("formatted"), loss.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """From formatted and loss_spans alone: conv_id, turns array<struct<role, text>>, loss_text, formatted."""
    stretches = F.split("formatted", r"<\|im_end\|>", -1)
    cut = rendered.select("conv_id", "formatted", "loss_spans", F.slice(stretches, F.lit(1), F.size(stretches) - 1).alias("own"))
    head = len(START)

    def turn(s: Column) -> Column:
        role = F.substring_index(s, SEP, 1)
        text = F.substr(s, F.length(role) + len(SEP) + 1)
        return F.struct(unescape(F.substr(role, F.lit(head + 1))).alias("role"), unescape(text).alias("text"))

    loss = F.transform("loss_spans", lambda x: unescape(F.substr(F.get("own", x["turn"]), x["start"] + 1, x["length"])))
    return cut.select("conv_id", F.transform("own", turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def format_chats(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) through the log to rendered conversations."""
    return render(fold(events_of_turns(turns)))


def digests(rendered: DataFrame) -> DataFrame:
    back = read_back(rendered)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
