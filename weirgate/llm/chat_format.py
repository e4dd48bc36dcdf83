"""Chat formatting by prefix-target expansion: one training example for each assistant turn.

Only DataFrame functions. An example holds all turns before the assistant's as context, and that one
reply as its target, the only trainable part. Turns after a conversation's last assistant turn come in
one more example that trains nothing, so that no turn is lost. A conversation is one record, as is each
of its examples; conversations themselves are spread over all tasks.

Template: `<turn:ROLE>TEXT</turn>` and a newline for each turn; in ROLE and TEXT the characters & < >
are written as &amp; &lt; &gt;, which is undone without loss. Control strings inside a text are so
never taken for the template's.

Defined results: a null text or role is an empty one; turns are ordered by turn (null first), then role,
then text, so ties and repeated rows have one order; rows with a null conv_id are one conversation;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_ROLE = "assistant"
CLOSE = "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def head(role: Column) -> Column:
    return F.concat(F.lit("<turn:"), escape(role), F.lit(">"))


def chat_examples(rows: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_len) from rows (conv_id, turn, role, text).

    loss_start and loss_len are code points of `formatted`, 0-based; both are null where nothing is trained.
    """
    turns = (
        rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
    )
    # (index of the last turn, whether it is a target), 1-based.
    size = F.size("turns")
    targets = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TARGET_ROLE, i + 1)), lambda i: i.isNotNull())
    turns = turns.select("conv_id", "turns", targets.alias("targets"))
    ends = F.transform("targets", lambda i: F.struct(i.alias("upto"), F.lit(True).alias("trains")))
    rest = F.when(
        F.coalesce(F.try_element_at("targets", F.lit(-1)), F.lit(0)) < size,
        F.array(F.struct(size.alias("upto"), F.lit(False).alias("trains"))),
    ).otherwise(F.array().cast("array<struct<upto:int,trains:boolean>>"))
    spread = turns.select("conv_id", "turns", F.posexplode(F.concat(ends, rest)).alias("example", "end"))
    last = F.element_at("turns", F.col("end.upto"))
    written = lambda ts: F.array_join(F.transform(ts, lambda t: F.concat(head(t["role"]), escape(t["text"]), F.lit(CLOSE))), "")
    parts = spread.select(
        "conv_id", "example", F.col("end.trains").alias("trains"), F.col("end.upto").alias("n_turns"),
        F.concat(written(F.slice("turns", F.lit(1), F.col("end.upto") - 1)), head(last["role"])).alias("context"),
        escape(last["text"]).alias("target"),
    )
    return parts.select(
        "conv_id", "example", "n_turns", F.concat("context", "target", F.lit(CLOSE)).alias("formatted"),
        F.when(F.col("trains"), F.length("context")).alias("loss_start"), F.when(F.col("trains"), F.length("target")).alias("loss_len"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example: an array of (role, text)."""
    pattern = F.lit("<turn:([^<>]*)>([^<>]*)</turn>\n")
    return F.arrays_zip(
        F.transform(F.regexp_extract_all(formatted, pattern, F.lit(1)), unescape).alias("role"),
        F.transform(F.regexp_extract_all(formatted, pattern, F.lit(2)), unescape).alias("text"),
    )


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under an example's loss mask, as it was before formatting; null where nothing is trained."""
    return unescape(F.substring(formatted, start + 1, length))
