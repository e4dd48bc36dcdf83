"""Requests and conversations: validation, last prompt, system text, context turns, completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.functions.text import unicode_strip

#: A chat request; content is kept as JSON, since it is a string or a list of typed parts.
REQUEST = "model string, stream boolean, messages array<struct<role string, content string>>, _corrupt_record string"
PARTS = "array<struct<type string, text string>>"
COMPLETION = "id string, choices array<struct<index int, message struct<role string, content string>>>"


def parse_requests(bodies: DataFrame, column: str = "body") -> DataFrame:
    """A column `request` with the parsed body; what is not JSON has a _corrupt_record."""
    return bodies.withColumn("request", F.from_json(column, REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))


def request_error(body: Column, request: Column) -> Column:
    """Error code of the first failed check, null for a valid request."""
    not_object = ~F.coalesce(F.trim(body).startswith("{"), F.lit(False))
    return F.coalesce(
        F.when(F.try_parse_json(body).isNull(), "invalid_json"),
        F.when(not_object, "invalid_request"),
        F.when(request["messages"].isNull() | (F.size(request["messages"]) == 0), "invalid_request"),
        F.when(F.coalesce(request["stream"], F.lit(False)), "streaming_not_supported"),
    )


def content_text(content: Column) -> Column:
    """A string as it is; the texts of a list's text parts, by line; else nothing."""
    parts = F.from_json(content, PARTS)
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    return F.when(content.isNull(), "").when(content.startswith("["), F.coalesce(F.array_join(texts, "\n"), content)).otherwise(content)


def prompt_of(messages: Column) -> Column:
    """The last user message."""
    return F.coalesce(content_text(F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]), F.lit(""))


def system_of(messages: Column) -> Column:
    """All system texts that are not empty, in order."""
    texts = F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: content_text(m["content"]))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def with_sanitised_prompt(messages: Column, text: Column) -> Column:
    """The messages with the last user message's content replaced.

    Of a list of parts, the first text part carries the new text, other text parts go, the rest stays.
    """
    last = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)))

    def renewed(content: Column) -> Column:
        parts = F.filter(F.from_json(content, "array<map<string,string>>"), lambda p: p.isNotNull())
        is_text = lambda p: p["type"] == "text"
        first = F.array_min(F.transform(parts, lambda p, i: F.when(is_text(p), i)))
        new = F.create_map(F.lit("type"), F.lit("text"), F.lit("text"), text)
        kept = F.filter(F.transform(parts, lambda p, i: F.when(i == first, new).when(~is_text(p), p)), lambda p: p.isNotNull())
        return F.when(content.startswith("["), F.to_json(F.when(first.isNull(), F.concat(F.array(new), kept)).otherwise(kept))).otherwise(text)

    return F.transform(messages, lambda m, i: F.when(i == last, F.struct(m["role"].alias("role"), renewed(m["content"]).alias("content"))).otherwise(m))


def completion_text(choices: Column, index: int = 0) -> Column:
    return F.coalesce(F.get(choices, F.lit(index))["message"]["content"], F.lit(""))


def context_turns(texts: Column, turns: int, chars: int) -> Column:
    """The last `turns` texts that are not blank, stripped and cut to `chars`."""
    stripped = F.filter(F.transform(texts, unicode_strip), lambda t: t.isNotNull() & (t != ""))
    if turns <= 0:
        return F.array().cast("array<string>")
    last = F.slice(stripped, F.greatest(F.lit(1), F.size(stripped) - turns + 1), F.lit(turns))
    return F.transform(last, lambda t: F.left(t, F.lit(chars)))


def scorer_text(turns: Column, prompt: Column) -> Column:
    return F.array_join(F.concat(turns, F.array(prompt)), "\n")


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, prompt, system_text, history) from rows by turn: one aggregation with ordered lists per conversation."""
    text = F.coalesce("text", F.lit(""))
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", text.alias("text"))))), lambda x: x["text"])
    is_user = F.col("role") == "user"
    grouped = rows.groupBy("conv_id").agg(
        F.max_by(F.struct(text.alias("text"), F.col("turn").alias("turn")), F.when(is_user, F.col("turn"))).alias("last"),
        listed((F.col("role") == "system") & (text != "")).alias("system"),
        F.array_sort(F.collect_list(F.struct("turn", text.alias("text"), F.col("role").alias("role")))).alias("all"),
    )
    before = F.filter("all", lambda x: (x["turn"] < F.col("last.turn")) & (x["role"] != "system"))
    return grouped.select("conv_id", F.coalesce("last.text", F.lit("")).alias("prompt"), F.array_join("system", "\n").alias("system_text"), F.transform(before, lambda x: x["text"]).alias("history"))
