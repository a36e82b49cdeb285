"""Chat formatting with Spark expressions.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged into one block whose
texts stay apart. A block is ``<turn:ROLE>TEXT<+>TEXT</turn>`` and a line end. In roles and texts a backslash, ``<`` and
``>`` are written ``\\b``, ``\\l`` and ``\\g``, so no text can hold a mark, and unescaping gives back every character.
The result has the formatted string and its segments, each flagged when it is under the loss mask (the texts of the
``assistant`` role); joined, the segments are the string.

Edge cases: a NULL text or role is empty; turns are ordered by number (NULL first), then role, then text; repeated rows
are turns each; a NULL conversation id is one conversation; an empty table gives an empty result; other columns are not
read. A conversation is one value of the output, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import let

# Fixed values of the template.
OPEN, ROLE_END, PART, CLOSE = "<turn:", ">", "<+>", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _merged(turns: Column) -> Column:
    """Runs of one role as (role, texts)."""
    starts = F.filter(
        F.transform(turns, lambda t, i: F.when(F.coalesce(F.get(turns, i - 1)["role"] == t["role"], F.lit(False)), -1).otherwise(i)),
        lambda i: i >= 0,
    )

    def run(s: Column) -> Column:
        return F.transform(s, lambda a, j: F.struct(
            F.get(turns, a)["role"].alias("role"),
            F.transform(F.slice(turns, a + 1, F.coalesce(F.get(s, j + 1), F.size(turns)) - a), lambda t: t["text"]).alias("texts"),
        ))

    return let(starts, run)


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _segments(block: Column) -> Column:
    never = F.lit(False)
    under = block["role"] == "assistant"
    texts = F.flatten(F.transform(block["texts"], lambda t, i: F.when(
        i == 0, F.array(_segment(escape(t), under))
    ).otherwise(F.array(_segment(F.lit(PART), never), _segment(escape(t), under)))))
    head = F.array(_segment(F.concat(F.lit(OPEN), escape(block["role"]), F.lit(ROLE_END)), never))
    return F.concat(head, texts, F.array(_segment(F.lit(CLOSE), never)))


def format_conversations(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, formatted, segments) of every conversation; segments are (text, loss)."""
    one = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    turns = df.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    segments = F.flatten(F.transform(_merged(F.col("turns")), _segments))
    return turns.select("conv_id", segments.alias("segments")).select(
        "conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) written in a formatted conversation."""
    blocks = F.slice(F.split(formatted, CLOSE), F.lit(1), F.greatest(F.lit(0), F.size(F.split(formatted, CLOSE)) - 1))

    def parts(block: Column) -> Column:
        head = F.substring_index(block, ROLE_END, 1)
        body = F.substr(block, F.length(head) + 2)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        return F.transform(F.split(body, r"<\+>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, parts))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
