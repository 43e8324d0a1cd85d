"""Chat formatting with Spark expressions alone.

Turns are collected as structs, sorted, merged where adjacent roles agree by an array
aggregation, and concatenated:

    <s>[INST]role[/INST]text<t>text</s>

A message holds the texts of adjacent turns of one role, kept apart by <t>. In roles and
texts each of the characters < [ \\ gets a backslash behind it, so that no control string can
arise there, and one replacement takes them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD_END, BETWEEN, CLOSE = "<s>[INST]", "[/INST]", "<t>", "</s>"

#: Starts of pieces are gathered so many at a time.
BLOCK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def format_chats(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: id, n_messages, formatted, loss_spans (start and chars, in
    code points of formatted, one span for each text of loss_role).

    Null texts and roles count as empty. A null turn comes first; ties are ordered by role,
    then text; rows that repeat stay. Rows with a null conversation form one conversation.
    No rows give no rows; other columns are ignored. A conversation becomes one value, so it
    has to fit into one; long texts and many turns are not cut.
    """
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy(F.col(conv_col)).agg(F.sort_array(F.collect_list(row)).alias("_turns"))

    def message(role: Column, texts: Column) -> Column:
        return F.struct(role.alias("role"), texts.alias("texts"))

    # messages: from each turn whose role isn't the one before's up to the next such turn
    turns_ = F.col("_turns")
    opens = lambda i: (i == 0) | (F.get(turns_, i)["role"] != F.get(turns_, i - 1)["role"])
    merged = sorted_turns.withColumn("_opens", F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), opens))
    until = F.concat(F.slice("_opens", F.lit(2), F.size("_opens")), F.array(F.size("_turns")))
    parts = F.arrays_zip(F.col("_opens").alias("at"), until.alias("until"))

    def from_to(part: Column) -> Column:
        return message(F.get(turns_, part["at"])["role"], F.transform(F.slice(turns_, part["at"] + 1, part["until"] - part["at"]), lambda t: t["text"]))

    merged = merged.withColumn("_messages", F.transform(parts, from_to))
    escaped = merged.withColumn(
        "_messages", F.transform("_messages", lambda m: message(escape(m["role"]), F.transform(m["texts"], escape)))
    )

    def written(m: Column) -> Column:
        return F.concat(F.lit(OPEN), m["role"], F.lit(HEAD_END), F.array_join(m["texts"], BETWEEN), F.lit(CLOSE))

    def pieces(m: Column) -> Column:
        """Per text: characters before it since the piece before, its own, and those behind."""
        head = F.char_length(m["role"]) + F.lit(len(OPEN + HEAD_END))
        last = F.size(m["texts"]) - 1
        return F.transform(
            m["texts"],
            lambda t, i: F.struct(
                F.when(i == 0, head).otherwise(F.lit(len(BETWEEN))).cast("long").alias("before"),
                F.char_length(t).cast("long").alias("chars"),
                F.when(i == last, F.lit(len(CLOSE))).otherwise(F.lit(0)).cast("long").alias("behind"),
                (m["role"] == loss_role).alias("loss"),
            ),
        )

    # Starts in one pass. Arrays that grow are copied, so they grow in blocks. What a lambda reads from
    # outside is a column of the grouped rows at most: anything else may be worked out anew for each element.
    empty = F.expr("named_struct('total', 0L, 'block', cast(array() as array<bigint>), 'done', cast(array() as array<array<bigint>>))")

    def advance(at: Column, piece: Column) -> Column:
        start, full = F.array(at["total"] + piece["before"]), F.size(at["block"]) >= BLOCK
        return F.struct(
            (at["total"] + piece["before"] + piece["chars"] + piece["behind"]).alias("total"),
            F.when(full, start).otherwise(F.concat(at["block"], start)).alias("block"),
            F.when(full, F.concat(at["done"], F.array(at["block"]))).otherwise(at["done"]).alias("done"),
        )

    laid = escaped.withColumn("_pieces", F.flatten(F.transform("_messages", pieces)))
    starts = F.aggregate("_pieces", empty, advance, lambda at: F.flatten(F.concat(at["done"], F.array(at["block"]))))
    placed = F.arrays_zip(starts.alias("start"), F.col("_pieces").alias("piece"))
    spans = F.transform(placed, lambda p: F.struct(p["start"].alias("start"), p["piece"]["chars"].alias("chars"), p["piece"]["loss"].alias("loss")))
    return laid.select(
        F.col(conv_col),
        F.size("_messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("_messages", written), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["chars"])).alias("loss_spans"),
    )


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The turns and the text under the loss mask, from formatted and loss_spans alone: id,
    turns (role and text), loss_text, formatted."""

    def turns_of(m: Column) -> Column:
        end = F.locate(HEAD_END, m)
        role = unescape(F.substring(m, F.lit(len(OPEN) + 1), end - len(OPEN) - 1))
        texts = F.split(F.substring(m, end + len(HEAD_END), F.char_length(m)), BETWEEN, -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    messages = F.split("formatted", CLOSE, -1)
    messages = F.slice(messages, F.lit(1), F.size(messages) - 1)
    under = F.transform(
        "loss_spans",
        lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int"))),
    )
    return chats.select(
        F.col(conv_col), F.flatten(F.transform(messages, turns_of)).alias("turns"), F.array_join(under, "").alias("loss_text"), "formatted"
    )
