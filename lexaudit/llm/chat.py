"""Chat formatting with relational expressions only.

Turns of a conversation are collected as structs, sorted, and joined to one string in which
adjacent turns of one role share a block. Every text keeps its own segment inside the block, so
the output can be read back turn by turn.

Layout of a block: ``OPEN role BODY text (SEP text)* END``.

Control strings inside roles and texts are broken by a backslash after their first character,
and backslashes are doubled. No control string holds a backslash, ``<`` or ``[`` beyond its first
character, so occurrences cannot overlap and the escape is reversible.

Defined cases: null role or text counts as empty; a null turn sorts first; turns that tie are
ordered by role, then text; repeated rows stay; an empty table gives no rows; columns that are
not asked for are ignored, whatever their names. A null ``conv_id`` is a conversation of its own. A
conversation is one row of the result, so its length is bounded by what a row can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, SEP, END = "<|im_start|>", "<|im_body|>", "<|im_sep|>", "<|im_end|>"

#: This template's marks and those of other public chat templates.
CONTROL = (OPEN, BODY, SEP, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

_META = r"\.[]{}()*+?^$|"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in _META else c for c in text)


#: First characters of control strings, told apart by what follows.
_HEADS = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in CONTROL)


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({_HEADS})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``."""
    flat = turns.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = flat.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def piece(t: Column, i: Column) -> Column:
        role_before = F.col("ts")[F.greatest(i - 1, F.lit(0))]["role"]
        opened = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY))
        return F.concat(
            F.when(i == 0, opened).when(role_before == t["role"], F.lit(SEP)).otherwise(F.concat(F.lit(END), opened)),
            escape(t["text"]),
        )

    joined = F.concat(F.array_join(F.transform("ts", piece), ""), F.lit(END))
    return ordered.select(F.col("conv").alias(conv), joined.alias("formatted"))


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``."""
    blocks = F.filter(F.split(formatted, _quoted(END)), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        parts = F.split(F.substring(block, len(OPEN) + 1, 2**31 - 1), _quoted(BODY), 2)
        return F.transform(
            F.split(parts[1], _quoted(SEP)),
            lambda s: F.struct(unescape(parts[0]).alias("role"), unescape(s).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: the texts of one role, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def chat_digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests and lengths of conversations, read back from their formatted text."""
    read = formatted.select(conv, "formatted", read_chat(F.col("formatted")).alias("turns"))
    masked = loss_text(F.col("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col(conv),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
