"""Chat formatting: event-sourced reconstruction, rendering and reading back.

All of it is DataFrame functions. A log holds (conv_id, message_id, seq, kind,
role, text); kind is ``message`` (a whole message), ``delta`` (a streamed piece),
``edit`` (replaces the text) or ``regenerate`` (starts the text anew; further deltas
follow). Within a message the events fold in order of seq: the text is that of the
last event that is no delta, then the deltas after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template and how a text's own are written.
OPEN, MID, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
ESCAPES = (("\\", "\\e"), ("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("[INST]", "\\bINST]"), ("[/INST]", "\\b/INST]"))


def escape(text: Column) -> Column:
    """No control string is left in the result; ``unescape`` restores every text."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for coded, plain in (("\\l", "<"), ("\\b", "["), ("\\e", "\\")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """One row (conv_id, seq, role, text) per message of the log.

    Null texts and roles count as empty, null seq sorts first, equal seq by kind and
    text; repeated rows are repeated events. seq of a message is its first event's.
    A null conv_id or message_id is a key like any other; an empty log gives no message.
    All deltas of a message are gathered before those that a restart overrides are left
    out, so one message's pieces must fit into a row; a conversation of very many is
    spread over its messages.
    """
    e = events.select(
        "conv_id",
        "message_id",
        "seq",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = F.struct(F.col("seq").isNotNull(), "seq", "kind", "text")
    pieces = e.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("first"),
        F.min_by("role", order).alias("role"),
        F.max(F.when(F.col("kind") != "delta", order)).alias("restart"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "delta", order))).alias("deltas"),
    )
    late = F.filter("deltas", lambda d: F.col("restart").isNull() | (d > F.col("restart")))
    text = F.concat(F.coalesce(F.col("restart")["text"], F.lit("")), F.array_join(F.transform(late, lambda d: d["text"]), ""))
    return pieces.select("conv_id", F.col("first").alias("seq"), "role", text.alias("text"))


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask) per conversation.

    Messages stand in order of seq (nulls first), then role and text. loss_mask is
    run lengths over ``formatted`` in code points: ``skip`` characters without loss,
    then ``keep`` with it, per message. Other columns of messages are passed over, repeated
    rows are repeated messages, no message gives no row. A conversation is one row, so its text must
    fit into one (2 GB); before it is gathered only one struct a message is shuffled.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    body = messages.select(
        "conv_id",
        F.struct(
            F.col("seq").isNotNull().alias("known"),
            "seq",
            F.col("role").alias("raw_role"),
            F.col("text").alias("raw"),
            role.alias("role"),
            text.alias("text"),
        ).alias("m"),
    )
    turns = body.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("turns"))
    piece = lambda m: F.concat(F.lit(OPEN), m["role"], F.lit(MID), m["text"], F.lit(CLOSE))
    head = lambda m: F.lit(len(OPEN) + len(MID)) + F.length(m["role"])
    run = lambda m: F.when(
        m["raw_role"] == learn_role,
        F.struct(head(m).alias("skip"), F.length(m["text"]).alias("keep"), F.lit(len(CLOSE)).alias("tail")),
    ).otherwise(F.struct((head(m) + F.length(m["text"])).alias("skip"), F.lit(0).alias("keep"), F.lit(len(CLOSE)).alias("tail")))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", piece), "").alias("formatted"),
        F.transform("turns", run).alias("loss_mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Parses ``formatted`` and applies ``loss_mask``: conv_id, turns (role, text), loss_texts, formatted; a row for each row."""
    pieces = F.split(F.col("formatted"), CLOSE)
    body = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        inner = F.substring(p, len(OPEN) + 1, 2147483647)
        at = F.locate(MID, inner)
        return F.struct(
            unescape(F.substring(inner, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(inner, at + len(MID), F.lit(2147483647))).alias("text"),
        )

    learnt = F.zip_with(body, F.col("loss_mask"), lambda p, m: unescape(F.substring(p, m["skip"] + 1, m["keep"])))
    return rendered.select("conv_id", F.transform(body, turn).alias("turns"), learnt.alias("loss_texts"), "formatted")


def from_turns(turns: DataFrame) -> DataFrame:
    """A log of whole messages out of a table of turns; every row is a message of its own."""
    return turns.select(
        "conv_id",
        F.monotonically_increasing_id().alias("message_id"),
        F.col("turn").alias("seq"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def digest(rendered: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` finds in each conversation's output; a row for each row."""
    back = read_back(rendered)
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
