"""Chat formatting with Spark expressions only.

A conversation becomes one text::

    <|im_start|>user
    first text<|im_sep|>second text<|im_end|>
    <|im_start|>assistant
    ...

Turns are collected as structs and sorted; adjacent turns of one role share one block, in which
``<|im_sep|>`` keeps their border. Inside a text every ``<``, backslashes, ``|`` gets one more
backslash, so that no text holds a control string and unescaping is exact. Roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.llm.text import whole

START, END, BORDER = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: its id, ``formatted``, and ``loss_runs``.

    ``loss_runs`` is the loss mask: an array of (skip, take), code points of ``formatted`` to pass
    over and then to train on, for each text of a role in ``loss_roles``.

    NULL roles and texts count as empty. Rows with equal turn numbers go by role, then text; NULL
    turns come first; repeated rows are repeated turns. Rows with a NULL id form one conversation.
    Other columns are ignored, an empty table gives an empty result. A conversation is one row and
    so must stay below 2 GB.
    """
    role = F.url_encode(whole(F.col(role_col)))
    turn = F.struct(
        F.col(turn_col).alias("turn"), role.alias("role"), escape(whole(F.col(text_col))).alias("text"),
        whole(F.col(role_col)).isin(*loss_roles).alias("loss"),
    )
    sorted_turns = turns.groupBy(F.col(conv_col).alias(conv_col)).agg(
        F.sort_array(F.collect_list(turn)).alias("_turns"))

    def piece(t: Column, i: Column) -> Column:
        before = F.get("_turns", i - 1)["role"]
        after = F.get("_turns", i + 1)["role"]
        head = F.when(before.eqNullSafe(t["role"]), F.lit(BORDER)).otherwise(
            F.concat(F.lit(START), t["role"], F.lit("\n")))
        tail = F.when(after.eqNullSafe(t["role"]), F.lit("")).otherwise(F.lit(END))
        return F.struct(head.alias("head"), t["text"].alias("text"), tail.alias("tail"), t["loss"].alias("loss"))

    pieces = sorted_turns.select(conv_col, F.transform("_turns", piece).alias("_pieces"))

    def run(state: Column, p: Column) -> Column:
        """The state: code points since the last loss run, and the runs so far."""
        skip = state["skip"] + F.char_length(p["head"])
        take = F.char_length(p["text"])
        runs = F.when(p["loss"], F.array_append(state["runs"], F.struct(skip.alias("skip"), take.alias("take"))))
        return F.struct(
            F.when(p["loss"], F.lit(0)).otherwise(skip + take).__add__(F.char_length(p["tail"])).alias("skip"),
            runs.otherwise(state["runs"]).alias("runs"),
        )

    none = F.lit(None).cast("array<struct<skip:int,take:int>>")
    zero = F.struct(F.lit(0).alias("skip"), F.coalesce(none, F.array().cast(
        "array<struct<skip:int,take:int>>")).alias("runs"))
    return pieces.select(
        conv_col,
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), "").alias("formatted"),
        F.aggregate("_pieces", zero, run, lambda s: s["runs"]).alias("loss_runs"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, in order: array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b, i: i > 0)

    def turns(block: Column) -> Column:
        border = F.instr(block, "\n")
        role = F.url_decode(F.substring(block, F.lit(1), border - 1))
        body = F.substring(block, border + 1, F.char_length(block) - border - len(END))
        return F.transform(
            F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(formatted: Column, runs: Column) -> Column:
    """The texts under the loss mask, unescaped: array<string>."""
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("texts"))

    def step(state: Column, r: Column) -> Column:
        start = state["at"] + r["skip"]
        return F.struct(
            (start + r["take"]).alias("at"),
            F.array_append(state["texts"], unescape(F.substring(formatted, start, r["take"]))).alias("texts"))

    return F.aggregate(runs, zero, step, lambda s: s["texts"])
