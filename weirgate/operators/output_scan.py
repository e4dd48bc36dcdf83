"""The output scan: leaked system text, personal data and secrets in completions; policy and redaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.functions import matching
from weirgate.functions.text import SPANS, SYSTEM_PROMPT_LEAK, WordHashes, no_spans, once, redact
from weirgate.sources.rules import Rule, active_scanner

#: How much of either text the leak detector of a request reads, and words in a row that make a leak.
MAX_COMPLETION, MAX_SYSTEM, MIN_WORDS = 20_000, 50_000, 8


def pii_spans(rules: list[Rule], text: Column) -> Column:
    """Merged spans of all active PII rules, in one pass over each text."""
    return matching.rule_spans(active_scanner(rules), text)


def shingled(rows: DataFrame, key: str, text: Column, min_words: int) -> DataFrame:
    """(key, i, start, end, h1, h2): each run of min_words words by its number, range and 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(batch.num_rows):
                start, end, found = hashes.runs(batch.column(1)[at].as_py() or "", min_words)
                if n := len(start):
                    columns = [pa.array(np.arange(n, dtype=np.int32)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), *(pa.array(h.view(np.int64)) for h in found)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, at))), *columns], names=[key, "i", "start", "end", "h1", "h2"])

    named = rows.select(key, text.alias("text"))
    return named.mapInArrow(run, T.StructType([named.schema[key], *T.StructType.fromDDL("i int, start int, end int, h1 long, h2 long").fields]))


def runs_to_spans(hits: DataFrame, keys: list[str], min_words: int) -> DataFrame:
    """Spans of maximal runs of matching shingles: a new one where the gap exceeds min_words."""
    w = W.partitionBy(*keys).orderBy("i")
    new = F.coalesce(F.col("i") - F.lag("i").over(w) > min_words, F.lit(True)).cast("int")
    runs = hits.distinct().select("*", new.alias("new")).select("*", F.sum("new").over(w).alias("run"))
    per_run = runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(SYSTEM_PROMPT_LEAK).alias("category"))
    return per_run.groupBy(*keys).agg(F.array_sort(F.collect_list(span)).alias("leak_spans"))


def own_leak_spans(completion: Column, system: Column, min_words: int = MIN_WORDS, most: tuple[int, int] | None = (MAX_COMPLETION, MAX_SYSTEM)) -> Column:
    """Spans of a completion that repeat min_words words of its own request's system text.

    `most` bounds the characters that a live request has read of both texts; None reads them whole.
    """
    if most:
        completion, system = (F.left(c, F.lit(n)) for c, n in zip((completion, system), most, strict=True))
    return matching.own_leaks(completion, system, min_words)


def leaks_of_own_system(rows: DataFrame, key: str = "request_id", completion: str = "completion", system: str = "system_text", min_words: int = MIN_WORDS, most: tuple[int, int] | None = (MAX_COMPLETION, MAX_SYSTEM)) -> DataFrame:
    """(key, leak_spans) of each row whose completion leaks its own system text; nothing is shuffled, and rows of one key stay apart."""
    spans = own_leak_spans(F.col(completion), F.col(system), min_words, most)
    return rows.select(key, once(spans).alias("leak_spans")).where(F.size("leak_spans") > 0)


def leaks_of_corpus(completions: DataFrame, systems: DataFrame, key: str, text: str, system: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, leak_spans) where a completion repeats min_words words of any of the system texts, all of them whole."""
    k = max(1, min_words)
    said = shingled(completions, key, F.col(text), k)
    told = shingled(systems, system, F.col("text"), k).select("h1", "h2").distinct()
    return runs_to_spans(said.join(told, ["h1", "h2"], "left_semi"), [key], k)


def scan(rows: DataFrame, rules: list[Rule], policy: str = "redact", enabled: bool = True, completion: str = "completion", system: str = "system_text") -> DataFrame:
    """rows with spans, categories, output_flagged, scan_action and the text that goes out."""
    if not enabled:
        return rows.select("*", no_spans().alias("spans"), F.array().cast("array<string>").alias("categories"), F.lit(False).alias("output_flagged"), F.lit("PASS").alias("scan_action"), F.col(completion).alias("delivered"))
    text = F.coalesce(F.col(completion), F.lit(""))
    spans = F.array_sort(F.concat(own_leak_spans(text, F.col(system)), pii_spans(rules, text)).cast(SPANS))
    found = rows.withColumn("spans", once(spans)).withColumn("output_flagged", F.size("spans") > 0)
    action = F.when(F.col("output_flagged"), policy.upper()).otherwise("PASS")
    out = F.when(action == "BLOCK", F.lit(None)).when(action == "REDACT", redact(text, F.col("spans"))).otherwise(F.col(completion))
    return found.select("*", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["category"]))).alias("categories"), action.alias("scan_action"), out.alias("delivered"))


def has_secret(spans: Column) -> Column:
    """Whether one of the spans is a leaked secret."""
    return F.exists(spans, lambda s: s["category"] == "SECRET_LEAK")


def categories_of(spans: Column) -> Column:
    """(category, n) of the spans, in order of category."""
    names = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["category"])))
    return F.transform(names, lambda c: F.struct(c.alias("category"), F.size(F.filter(spans, lambda s: s["category"] == c)).alias("n")))


def redact_choices(choices: Column, spans_by_choice: Column) -> Column:
    """A completion's choices with the content of each index in the map redacted; other indices stay."""

    def one(c: Column, i: Column) -> Column:
        spans, content = F.try_element_at(spans_by_choice, i), c["message"]["content"]
        return F.when(spans.isNotNull() & content.isNotNull(), c.withField("message.content", redact(content, spans))).otherwise(c)

    return F.transform(choices, one)


def final_row(rows: DataFrame) -> DataFrame:
    """Decision columns after the scan: the scanner's block or redaction wins, a warning only flags."""
    action = F.when(F.col("scan_action") == "BLOCK", "BLOCKED").when((F.col("scan_action") == "REDACT") | (F.col("action_taken") == "REDACTED"), "REDACTED").otherwise(F.col("action_taken"))
    layer = F.when(F.col("scan_action").isin("BLOCK", "REDACT"), "OUTPUT_SCANNER").otherwise(F.col("triggered_layer"))
    return rows.withColumns({"action_taken": action, "triggered_layer": layer, "is_blocked": F.col("is_blocked") | (F.col("scan_action") == "BLOCK")})
