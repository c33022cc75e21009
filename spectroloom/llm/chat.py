"""Chat formatting with Spark expressions only.

A conversation becomes one string. Each run of adjacent turns of the same role is one block::

    <|role|>user<|text|>first turn<|next|>second turn<|end|>

Texts and roles are escaped so that no control string (of this template or of the common
``[INST]`` one) stays intact in them: each backslash is doubled, then a backslash goes behind the
first character of each control string. ``unescape`` is the exact inverse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"

#: A first character and what makes a control string of it.
CONTROL = r"([<\[])(\||/?s>|/?INST\]|/?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(CONTROL), F.lit("$1\\\\$2"))


def unescape(text: Column) -> Column:
    """Backslashes of a text come in even runs, so a single one behind < or [ was put there."""
    return F.replace(F.regexp_replace(text, r"([<\[])\\(?!\\)", "$1"), F.lit("\\\\"), F.lit("\\"))


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` string and ``segments``.

    ``segments`` are the pieces whose concatenation is ``formatted``, each with ``loss``: true for
    the (escaped) texts of ``loss_roles``, which are what a model is trained on; marks never are.

    Turns are ordered by (turn, role, text); ties and repeated rows are all kept. A null turn
    comes first; null roles and texts are empty; rows with a null conversation form one
    conversation. Other columns are ignored. An empty table gives no rows. A conversation's own
    text is the only thing that is held together, because it is one output value; if a large share
    of all rows has no conversation, give them ids first.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sorted_ = turns.select(F.col(conv), row.alias("row")).groupBy(conv).agg(F.sort_array(F.collect_list("row")).alias("turns"))
    n, roles = F.size("turns"), F.col("turns.role")
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), roles), F.lit(1), n)
    after = F.slice(F.concat(roles, F.array(F.lit(None).cast("string"))), F.lit(2), n)
    placed = sorted_.select(conv, F.zip_with(F.zip_with("turns", before, lambda t, p: F.struct(t.alias("t"), (~t["role"].eqNullSafe(p)).alias("first"))), after, lambda x, a: F.struct(x["t"].alias("t"), x["first"].alias("first"), (~x["t"]["role"].eqNullSafe(a)).alias("last"))).alias("placed"))
    mark = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))

    def pieces(x: Column) -> Column:
        t = x["t"]
        head = F.when(x["first"], F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT))
        body = F.struct(escape(t["text"]).alias("text"), t["role"].isin(*loss_roles).alias("loss"))
        return F.array(mark(head), body, mark(F.when(x["last"], F.lit(END)).otherwise(F.lit(""))))

    cut = placed.select(conv, F.flatten(F.transform("placed", pieces)).alias("segments"))
    return cut.select(conv, F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(ROLE) + 1, 2**31 - 1), r"<\|text\|>", 2)
        return F.transform(F.split(parts[1], r"<\|next\|>", -1), lambda t: F.struct(unescape(parts[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
