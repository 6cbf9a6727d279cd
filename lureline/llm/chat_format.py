"""Chat formatting by prefix-target expansion (operator 7, DataFrame functions only).

Every assistant turn becomes one training example: all turns before it are the context, its own
reply is the only trainable part. Turns after the last assistant turn (or a conversation without
one) give one more example that trains nothing, so the output holds every turn.

Template, one block per turn::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings (:data:`CONTROL`) inside a text are broken by a backslash after their first
character, and backslashes are doubled, so a text can never end its block and :func:`unescape`
restores it. In a role, ``% \\n < [`` are percent-encoded.

Cases: a null text is an empty text, a null role an empty role; turns sort by (turn, role, text),
nulls first
(role and text as escaped); repeated rows are turns of their own; rows with a null conversation id form one
conversation with a null id; an empty table gives no rows; other columns are ignored.
An example holds all its context, so one conversation costs the square of its turns: that is what
the format asks for, and a conversation is the unit that one task must be able to hold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that chat templates give a meaning.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|endoftext|>")
START, END = "<|im_start|>", "<|im_end|>\n"

_ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


#: A backslash, or the first character of a control string (look-ahead, so overlaps count too).
_BREAK = r"\\|[<\[](?=" + "|".join(re.escape(w[1:]) for w in CONTROL) + ")"


def escape(text: Column) -> Column:
    """Text without control strings, reversible; one pass over the text."""
    return F.regexp_replace(text, _BREAK, r"$0\\")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: a pair of backslashes is one, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escape_role(role: Column) -> Column:
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text",
                         trainable_role: str = "assistant") -> DataFrame:
    """One row per example: ``conv_id, example, formatted, loss_start, loss_end, complete``.

    ``loss_start``/``loss_end`` are code point offsets into ``formatted`` of the trainable reply
    (equal where nothing is trainable); ``complete`` marks the example that holds every turn.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turns = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        escape_role(role).alias("role"), escape(text).alias("body")).select(
        "conv_id", F.struct(
            "turn", "role", "body", (F.col("role") == escape_role(F.lit(trainable_role))).alias("train"),
            F.length("body").alias("size")).alias("t"))
    parts = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["train"], t["size"])).alias("meta"),
        F.transform("turns", lambda t: F.concat(
            F.lit(START), t["role"], F.lit("\n"), t["body"], F.lit(END))).alias("blocks"))
    n = F.size("blocks")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("meta", i.cast("int"))["train"])
    last_open = ~F.element_at("meta", -1)["train"]
    examples = parts.withColumn("targets", targets).withColumn(
        "upto", F.concat("targets", F.when(last_open, F.array(n)).otherwise(F.array().cast("array<int>"))))
    each = examples.select("conv_id", "blocks", "meta", F.posexplode("upto").alias("example", "last"))
    text = F.array_join(F.slice("blocks", F.lit(1), F.col("last")), "")
    meta = F.element_at("meta", F.col("last"))
    out = each.select("conv_id", "example", text.alias("formatted"), meta.alias("m"),
                      (F.col("last") == F.size("blocks")).alias("complete"))
    stop = F.length("formatted") - F.lit(len(END))
    size = F.when(F.col("m.train"), F.col("m.size")).otherwise(F.lit(0))
    return out.select("conv_id", "example", "formatted", (stop - size).alias("loss_start"),
                      stop.alias("loss_end"), "complete")


_BLOCK = r"(?s)\A<\|im_start\|>([^\n]*)\n(.*)"


def parse_turns(formatted: Column) -> Column:
    """Read a formatted example back: array of ``(role, text)``."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    return F.transform(blocks, lambda b: F.struct(
        unescape_role(F.regexp_extract(b, _BLOCK, 1)).alias("role"),
        unescape(F.regexp_extract(b, _BLOCK, 2)).alias("text")))


def conversation_digest(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: turns, loss text and sizes."""
    turns = parse_turns(F.col("formatted"))
    loss = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1,
                                F.col("loss_end") - F.col("loss_start")))
    read = examples.select(
        "conv_id", "example", F.length("formatted").alias("chars"), loss.alias("loss"),
        F.when(F.col("complete"), turns).alias("turns"))
    per = read.groupBy("conv_id").agg(
        F.max("turns").alias("turns"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))),
                                 lambda x: x["loss"]), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
