"""Chat formatting as relational expressions: no Python runs on the executors.

Turns of a conversation are collected as structs, sorted, and adjacent turns of
one role become one block::

    <|role|>text<|end|>            one turn
    <|role|>text<|and|>text<|end|> adjacent turns of one role

Inside texts and roles a backslash precedes a backslash and splits ``<|`` (and
``|>`` in a role), so no text can form a mark, and ``unescape`` restores it.

Defined results: a null text or role is empty; rows that tie on the turn are
ordered by role, then text; repeated rows stay repeated turns; a null
conversation id is a conversation of its own; a null turn comes first; an empty
table gives an empty table; columns other than the four named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.arrays import cut, let, running, text_pieces

OPEN, CLOSE, AND, END = "<|", "|>", "<|and|>", "<|end|>"


@dataclass(frozen=True)
class ChatTemplate:
    """Which columns hold a conversation, and whose text is trained on."""

    conversation: str = "conv_id"
    turn: str = "turn"
    role: str = "role"
    text: str = "text"
    loss_role: str = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(OPEN), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(CLOSE), F.lit("|\\>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row a conversation: its id, ``formatted`` and ``loss_spans``.

    ``loss_spans`` holds start and end (exclusive), in code points of
    ``formatted``, of each text of the loss role, escapes included.
    """
    t = template
    turn = F.struct(
        F.col(t.turn).alias("turn"),
        F.coalesce(F.col(t.role), F.lit("")).alias("role"),
        F.coalesce(F.col(t.text), F.lit("")).alias("text"),
    )
    turns = rows.groupBy(F.col(t.conversation).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    first = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    block = lambda s, i: F.struct(
        F.get("turns", s)["role"].alias("role"),
        F.transform(
            F.slice("turns", s + 1, F.coalesce(F.get("first", i + 1), F.size("turns")) - s),
            lambda x: escape(x["text"]),
        ).alias("texts"),
    )
    blocks = turns.withColumn("first", first).select("conv_id", F.transform("first", block).alias("blocks"))
    written = F.transform(
        "blocks",
        lambda b: F.concat(F.lit(OPEN), escape_role(b["role"]), F.lit(CLOSE), F.array_join(b["texts"], AND), F.lit(END)),
    )
    # Pieces in order: each text with what stands before it, and whether it is trained on.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda x, j: F.struct(
                    F.when(j == 0, F.char_length(escape_role(b["role"])) + len(OPEN + CLOSE))
                    .otherwise(len(AND))
                    .alias("before"),
                    F.char_length(x).alias("length"),
                    F.when(j == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("after"),
                    (b["role"] == t.loss_role).alias("loss"),
                ),
            ),
        )
    )
    def spans(p: Column) -> Column:
        at = running(F.transform(p, lambda x: (x["before"] + x["length"] + x["after"]).cast("long")))
        begin = lambda at, x, i: F.get(at, i) + x["before"]
        held = let(at, lambda at: F.transform(p, lambda x, i: F.struct(x["loss"], begin(at, x, i).alias("start"), (begin(at, x, i) + x["length"]).alias("end"))))
        return F.transform(F.filter(held, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["end"]))

    return blocks.select("conv_id", F.array_join(written, "").alias("formatted"), let(pieces, spans).alias("loss_spans"))


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted text again: array of role and text, in order."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        head = F.substring_index(b, CLOSE, 1)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        texts = F.split(F.substr(b, F.char_length(head) + len(CLOSE) + 1), r"<\|and\|>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between its parts."""
    part = lambda pieces: lambda s: unescape(cut(pieces, s["start"], s["end"]))
    return let(text_pieces(formatted), lambda pieces: F.array_join(F.transform(spans, part(pieces)), ""))
