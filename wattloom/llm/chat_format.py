"""Chat formatting as a grammar round trip, in DataFrame functions only.

Grammar: a conversation is a sequence of turns `<|im_start|>role\\ntext<|im_end|>\\n`. No `<|` may stand inside a role or
text, so the parser needs no look-ahead. A value goes in as it is if the parser would give it back unchanged; else each
`<`, backslashes, `|` in it gets one backslash more, which the parser takes off again. Line feeds in roles are escaped
likewise. The whole output is parsed again and compared with the source turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONFLICT = "<(\\\\*)\\|"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONFLICT, "<\\\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "<\\\\(\\\\*)\\|", "<$1|")


def _accepted(text: Column) -> Column:
    """`text`, escaped if the parser would not give it back as it is."""
    return F.when(~F.contains(text, F.lit("<|")) & (unescaped(text) == text), text).otherwise(escaped(text))


def _role_in(role: Column) -> Column:
    return _accepted(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_out(role: Column) -> Column:
    # Between doubled backslashes, the only ones left stand for line feeds.
    pieces = F.split(unescaped(role), r"\\\\")
    return F.array_join(F.transform(pieces, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def formatted(conversations: DataFrame) -> DataFrame:
    """Per conv_id of `conversations` (conv_id, turn, role, text): conv_id, formatted, loss_spans, identical.

    Turns come in the order of turn (null first), ties by role and text; repeated rows are turns of their own. Null roles
    and texts are empty; rows with a null conv_id form one conversation. `loss_spans` are the code point ranges of the
    assistant's texts in `formatted`, `identical` tells whether parsing gave the source back. Other columns are ignored;
    an empty table gives no rows. Rows are rendered before the shuffle; a conversation is one value of its result row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumns(
        {"role_in": _role_in(F.col("role")), "text_in": _accepted(F.col("text"))}
    )
    rendered = rows.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(OPEN), "role_in", F.lit("\n"), "text_in", F.lit(CLOSE + "\n")).alias("rendered"),
        (F.length("role_in") + len(OPEN) + 1).alias("skip"),
        F.length("text_in").alias("chars"),
    )
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rendered.withColumns(
        {
            "place": F.row_number().over(ordered),
            "before": F.coalesce(F.sum(F.length("rendered")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    start = (F.col("before") + F.col("skip")).cast("int")
    trained = F.when(F.col("role") == TRAINED_ROLE, F.struct(start.alias("start"), (start + F.col("chars")).alias("end")))
    turns = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "rendered", "role", "text"))).alias("turns"),
        F.sort_array(F.collect_list(trained)).alias("loss_spans"),
    )
    joined = turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        "loss_spans",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    return joined.withColumn("turns", parsed(F.col("formatted"))).select(
        "conv_id", "formatted", "loss_spans", "turns", (F.col("turns") == F.col("source")).alias("identical")
    )


def parsed(output: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.filter(F.split(output, "<\\|im_start\\|>"), lambda piece, i: i > 0)

    def turn(piece: Column) -> Column:
        body = F.left(piece, F.length(piece) - len(CLOSE) - 1)
        role = F.substring_index(body, "\n", 1)
        text = F.right(body, F.length(body) - F.length(role) - 1)
        return F.struct(_role_out(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def loss_texts(output: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescaped(F.substring(output, s["start"] + 1, s["end"] - s["start"])))
